"""Token ids as files: blocks of ids, shuffled into byte or bit planes, each plane compressed with zstandard.

A file set is a Parquet folder that Spark writes, so that it lies on whatever store the cluster shares. Each row is a
chunk of whole documents: its place (shard, chunk), the documents in it with their numbers of ids, and the payload:
fixed-size blocks of ids, each cut into planes that are compressed one by one. `plane_ends` is the chunk's index: where
each plane of each block ends in the payload. A reader takes single blocks or whole chunks by it; chunks stand alone, so
reading is parallel and a lost task is repeated alone.

Order is ascending doc_id: a range partitioning by doc_id, sorted inside. Rows with the same doc_id stand together, by text.
Defined results: null text is an empty document (its end id alone); a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, texts
from .tokens import encoder, vocabulary_path

BLOCK_IDS = 32768
#: A chunk closes at so many ids.
CHUNK_IDS = 1 << 19
LEVEL = 3

CHUNK = "shard long, chunk long, first_id long, n_ids long, planes string, block_ids int, doc_ids array<long>, doc_lengths array<long>, plane_ends array<long>, payload binary"


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """A block of unsigned 32-bit ids as 4 byte planes or 32 bit planes, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(parts: list[bytes], n: int, planes: str = "byte") -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in parts]
    if planes == "byte":
        return np.ascontiguousarray(np.stack(rows, 1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(r, count=n) for r in rows], 1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").ravel()


def encode_chunk(ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL) -> tuple[bytes, list[int]]:
    """The payload of a chunk, and where each plane ends in it."""
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(p) for i in range(0, len(ids), block_ids) for p in to_planes(ids[i : i + block_ids], planes)]
    return b"".join(parts), np.cumsum([len(p) for p in parts]).tolist()


def decode_block(payload: bytes, plane_ends: list[int], block: int, n_ids: int, planes: str, block_ids: int) -> np.ndarray:
    """One block's ids, without touching the others."""
    k = 4 if planes == "byte" else 32
    n = min(block_ids, n_ids - block * block_ids)
    open_up = zstandard.ZstdDecompressor()
    edges = [plane_ends[block * k - 1] if block else 0, *plane_ends[block * k : block * k + k]]
    return from_planes([open_up.decompress(payload[a:b]) for a, b in zip(edges, edges[1:], strict=False)], n, planes)


def decode_chunk(payload: bytes, plane_ends: list[int], n_ids: int, planes: str, block_ids: int) -> np.ndarray:
    blocks = [decode_block(payload, plane_ends, i, n_ids, planes, block_ids) for i in range(-(-n_ids // block_ids))]
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def write_ids(docs: DataFrame, path: str, end_id: int = 0, planes: str = "byte", vocabulary: str | None = None, partitions: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the documents (doc_id, text), ends each with end_id and writes the file set to path."""
    names = [x.split()[0] for x in CHUNK.split(", ")]
    where = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(where).encode, TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        chunk = first = size = 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            payload, ends = encode_chunk(np.frombuffer(b"".join(parts), "<u4"), planes, block_ids)
            row = (shard, chunk, first, size, planes, block_ids, doc_ids, [len(p) // 4 for p in parts], ends, payload)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int32()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= CHUNK_IDS:
                    yield close()
                    chunk, first, size, doc_ids, parts = chunk + 1, first + size, 0, [], []
        if doc_ids:
            yield close()

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", empty_text()).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, CHUNK).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    chunks = spark.read.parquet(path)
    # a row for each shard, of which there are as many as the writer had partitions
    totals = {r.shard: r.n for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, starts = 0, {}
    for shard in sorted(totals):
        starts[shard] = before
        before += totals[shard]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_chunk(row["payload"], row["plane_ends"], row["n_ids"], row["planes"], row["block_ids"]).tobytes()
                ends = np.cumsum([0, *row["doc_lengths"]])
                crcs = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + (starts[row["shard"]] + row["first_id"]), pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return chunks.mapInArrow(run, schema)
