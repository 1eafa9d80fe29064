"""WARC archives as a chunked record table.

An archive is a Parquet folder of rows (page_id, record_id, chunk_no, n_chunks, running_digest, member). A payload over `chunk_bytes` is
many rows: its record's identifier, chunk numbers from 1, and the digest of the payload so far. Each member is a WARC record
(the first chunk's) or a continuation (the others'), as a gzip member of its own, so one row can be fetched by record and
chunk number, and members in order are a WARC file.

Which record is a response is decided on narrow rows: a scan digests each payload chunk by chunk and hands on its digests and size alone. A second scan
cuts payloads into chunk rows, each with the digest so far, and those of revisits are left out by an anti-join; no join, sort or write after a scan
holds more than chunks. Only the scan itself sees a payload whole, as its reader gives it.

Reading checks every block against its digest. Records of one chunk are read where they lie; only chunks of longer ones are
dealt by record and streamed in order. `write_files` turns an archive into plain WARC files for other tools.

Of records with equal payloads (by size, SHA-1 and SHA-256) of at least `least_bytes` bytes the one with the smallest page_id is the response, the
others are revisits that refer to it. Defined results: null html is an empty payload; a null url is left out; a null
page_id never is a group's response unless all its ids are null; rows repeated in full are records of their own, and those
with the group's smallest page_id are all responses; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CHUNK_BYTES = 1 << 20
#: Parts that the rows of one payload are dealt to, so that a hot payload is many groups.
SALTS = 1 << 14
#: Bytes of members that a task holds before it hands them on.
HELD_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n\r\n"
ARCHIVE = "page_id long, record_id string, chunk_no long, n_chunks long, running_digest string, member binary"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, n_chunks long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _payload(column: pa.Array, i: int) -> memoryview:
    """A value of a binary column where it lies, without a copy; null is empty."""
    if not column[i].is_valid:
        return memoryview(b"")
    return memoryview(column[i].as_buffer())


def _digests(payload: memoryview) -> tuple[bytes, bytes]:
    one, two = hashlib.sha1(), hashlib.sha256()
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        one.update(part)
        two.update(part)
    return one.digest(), two.digest()


def _identity(page_id: int | None, url: str | None, two: bytes, size: int) -> bytes:
    """What tells a record from others that aren't its copies in full."""
    return hashlib.sha256(repr((page_id, url, size)).encode() + two).digest()[:16]


def _scan(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))


NARROW = "page_id long, url string, identity binary, key binary, other binary, payload_bytes long"


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, identity, key (SHA-1), payload_bytes, record_type and refers_to of each of pages (page_id, url, html), without payloads. Rows meet
    their group's smallest page_id by (digests, size, salt): a payload that a third of all pages hold is up to SALTS groups."""
    names = [c.split()[0] for c in NARROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, ids, urls = batch.column("html"), batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            payloads = [_payload(html, i) for i in range(batch.num_rows)]
            found = [(*_digests(p), len(p)) for p in payloads]
            rows = [(i, u, _identity(i, u, two, n), one, two, n) for i, u, (one, two, n) in zip(ids, urls, found, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    keyed = _scan(pages).mapInArrow(run, NARROW).withColumn("salt", F.pmod(F.xxhash64("identity"), F.lit(SALTS)).cast("int"))
    group = ["key", "other", "payload_bytes"]
    least = keyed.filter(F.col("payload_bytes") >= least_bytes).groupBy(*group, "salt").agg(F.min("page_id").alias("least"))
    first = least.groupBy(*group).agg(F.min("least").alias("first_id"), F.collect_list("salt").alias("salts")).select(*group, "first_id", F.explode("salts").alias("salt"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    out = keyed.join(first, [*group, "salt"], "left")
    return out.select("page_id", "url", "identity", "key", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


CHUNK = "page_id long, url string, identity binary, key binary, payload_bytes long, record_id string, n_chunks int, chunk_no int, running binary, piece binary"


def chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each payload, with the digest up to its end: cut as the scan reads the pages, HELD_BYTES at a time."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, records, partition = [], 0, 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made, strict=True)) or [()] * len(names), kinds, strict=True)], names)

        for batch in batches:
            html, ids, urls = batch.column("html"), batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for i, (page_id, url) in enumerate(zip(ids, urls, strict=True)):
                payload = _payload(html, i)
                one, two = _digests(payload)
                identity, digest, records = _identity(page_id, url, two, len(payload)), hashlib.sha1(), records + 1
                n = max(1, -(-len(payload) // chunk_bytes))
                for k in range(n):
                    piece = bytes(payload[k * chunk_bytes : (k + 1) * chunk_bytes])
                    digest.update(piece)
                    made.append((page_id, url, identity, one, len(payload), f"{partition}-{records}", n, k + 1, digest.digest(), piece))
                    held += len(piece) + 200
                    if held >= HELD_BYTES:
                        yield out()
                        made, held = [], 0
        yield out()

    return _scan(pages).mapInArrow(run, CHUNK)


def _record(fields: tuple[tuple[str, object], ...], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + BREAK.encode()


def _member(page_id, url, size: int, key: bytes, kind: str, refers_to, n: int, number: int, piece: bytes, running: str) -> bytes:
    """One row's WARC record; url has no line breaks."""
    name = f"<urn:page:{page_id}>"
    common = (("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{base32(key)}"), ("X-Payload-Length", size))
    segment = (("WARC-Segment-Number", number), ("X-Running-Digest", running)) if n > 1 else ()
    if kind == "revisit":
        return _record((("WARC-Type", kind), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")), b"")
    if number == 1:
        return _record((("WARC-Type", kind), *common, *segment, ("Content-Type", "text/html")), piece)
    total = (("WARC-Segment-Total-Length", size),) if number == n else ()
    return _record((("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), *segment, *total), piece)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, level: int = 6, least_bytes: int = 0) -> None:
    """pages (page_id, url, html) to an archive."""
    names = [c.split()[0] for c in ARCHIVE.split(", ")]
    fields = ("page_id", "url", "payload_bytes", "key", "record_type", "refers_to", "record_id", "n_chunks", "chunk_no", "running", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, partition, records = [], 0, TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names)

        for batch in batches:
            for page_id, url, total, key, kind, refers_to, record, n, number, running, piece in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                records += 1
                running = f"sha1:{base32(running)}"
                raw = _member(page_id, url and re.sub(r"[\r\n]+", " ", url), total, key, kind, refers_to, n, number, piece, running)
                made.append((page_id, record or f"v{partition}-{records}", number, n, running, gzip.compress(raw, level, mtime=0)))
                size += len(made[-1][-1])
                if size >= HELD_BYTES:
                    yield out()
                    made, size = [], 0
        yield out()

    revisits = written(plan_records(pages, least_bytes).filter("record_type = 'revisit'"), "warc-revisits")
    nothing = lambda kind: F.lit(None).cast(kind)
    responses = chunks(pages, chunk_bytes).join(revisits.select("identity"), "identity", "left_anti").withColumns({"record_type": F.lit("response"), "refers_to": nothing("long")})
    others = revisits.withColumns({"record_id": nothing("string"), "n_chunks": F.lit(1), "chunk_no": F.lit(1), "running": F.unhex(F.sha1(F.lit(b""))), "piece": F.lit(b"")})
    # members are squeezed already; row groups stay small, as a row may be a megabyte
    out = responses.select(*fields).unionByName(others.select(*fields)).mapInArrow(run, ARCHIVE)
    out.write.option("compression", "uncompressed").option("parquet.block.size", 32 << 20).parquet(path)


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """A member's header fields and block."""
    head, found, rest = gzip.decompress(member).partition(BREAK.encode())
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields.get("Content-Length", -1))
    if first != "WARC/1.1" or not found or size < 0 or rest[size:] != BREAK.encode():
        raise ValueError(f"no WARC record: {first[:80]!r}")
    return fields, rest[:size]


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "None" else int(found)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record (RECORD), its digest checked over the whole payload."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("n_chunks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, last, head = hashlib.sha1(), 0, 0, {}
        for batch in batches:
            found = []
            for record, number, n, member in zip(*(batch.column(c).to_pylist() for c in ("record_id", "chunk_no", "n_chunks", "member")), strict=True):
                fields, block = _parsed(member)
                if number == 1:
                    digest, size, last, head = hashlib.sha1(), 0, 0, fields
                elif number != last + 1 or fields["WARC-Segment-Origin-ID"] != head.get("WARC-Record-ID"):
                    raise ValueError(f"{record}: chunk {number} without the one before")
                digest.update(block)
                size, last, running = size + len(block), number, base32(digest.digest())
                if fields.get("X-Running-Digest", f"sha1:{running}") != f"sha1:{running}":
                    raise ValueError(f"{record}: the digest up to chunk {number} doesn't match")
                if number == n:
                    said, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                    if not revisit and (said != running or size != int(head["X-Payload-Length"])):
                        raise ValueError(f"{record}: the payload doesn't match its digest")
                    found.append({"page_id": _page(head["WARC-Record-ID"]), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": said, "record_type": head["WARC-Type"], "refers_to": _page(head["WARC-Refers-To"]) if revisit else None, "url": head.get("WARC-Target-URI"), "n_chunks": n})
            yield pa.RecordBatch.from_pylist(found, kinds)

    rows = spark.read.schema(ARCHIVE).parquet(path).select("record_id", "chunk_no", "n_chunks", "member")
    long = rows.filter("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return rows.filter("n_chunks = 1").mapInArrow(run, RECORD).unionByName(long.mapInArrow(run, RECORD))


def write_files(spark: SparkSession, archive: str, path: str) -> None:
    """The archive as WARC files, gzip as a whole: a row is a record without its last blank line, which is the line separator.
    Chunks of a record stand in one file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.decompress(m)[: -len(BREAK)] for m in batch.column("member").to_pylist()], pa.binary())], ["value"])

    rows = spark.read.schema(ARCHIVE).parquet(archive).select("record_id", "chunk_no", "member").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    rows.select("member").mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)
