"""Divergence of sources: how far the terms of each source of a language lie from those of the others, and which terms it overuses.

1. Tasks read documents some CHUNK_BYTES at a time (a text above LONG_BYTES alone, slice by slice), put their words in the order (lang, term, source, document) and scan its runs: each run of a
   (lang, term, source) becomes one row with its documents and occurrences. That's the aggregation before the shuffle.
2. The runs are dealt by (lang, term), put in the order (lang, term, source, document) and scanned again, as a stream: runs that touch become one,
   and a term goes out once its runs hold LEAST documents. Until then at most LEAST - 1 runs wait, whatever the number of documents.
3. A term's probabilities in its sources and in its language come from its counts and the totals of groups. Pairs: the terms of a language, dealt into
   buckets, are met by blocks of SOURCES sources; for each bucket and pair of blocks a task streams over the terms in order and emits one partial sum
   for a pair of sources. Terms of which neither source has any are covered by each source's probability of an absent term, which leads the bucket.
4. Terms: the rows of the second scan, ranked within each group; Spark cuts each task's rows to the rank before the shuffle.

Arithmetic is exact: probabilities are integers of 1/10^9, computed in decimals and held as longs.

Defined results: null text, lang and source are ''; each row is a document, whatever its doc_id; a group without terms has the probability
of an absent term for each kept one; a language of one source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_text, text_bytes, written

LEAST, TOP = 30, 50
CHUNK_BYTES, LONG_BYTES = 8 << 20, 4 << 20
#: Sources in a block of pairs, terms whose probabilities are held at once, and rows of terms in a bucket, each of which gives a sum for each pair.
SOURCES, TERMS, BUCKET = 128, 1024, 200_000

_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
RUNS = "lang binary, term binary, source binary, document long, docs long, n long"


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text of spaced words, cut at spaces, of about `size` bytes (more where a word is longer)."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def chunk_runs(langs: list[bytes], sources: list[bytes], texts: list[bytes], first: int) -> pa.RecordBatch:
    """The runs of some documents, in order. document: the number of the run's first one in its task."""
    numbers = Numbers()
    words = [np.fromiter(map(numbers.__getitem__, t.translate(_TERMS).split()), np.int64) for t in texts]
    flat, doc = np.concatenate([np.empty(0, np.int64), *words]), np.repeat(np.arange(len(texts)), [len(w) for w in words])
    groups = sorted(set(zip(langs, sources, strict=True)))
    at = {g: i for i, g in enumerate(groups)}
    group = np.array([at[g] for g in zip(langs, sources, strict=True)], np.int64)
    terms = sorted(numbers)
    place = np.empty(len(terms), np.int64)
    place[[numbers[t] for t in terms]] = np.arange(len(terms))
    lang_of = np.unique([lang for lang, _ in groups], return_inverse=True)[1]
    sizes = (len(terms), len(groups), len(texts))
    if len(groups) * len(terms) * len(groups) * len(texts) < 1 << 62:
        key = np.sort(((lang_of[group[doc]] * sizes[0] + place[flat]) * sizes[1] + group[doc]) * sizes[2] + doc)
        key, doc = np.divmod(key, sizes[2])
        key, g = np.divmod(key, sizes[1])
        flat = key % max(sizes[0], 1)
    else:
        order = np.lexsort((doc, group[doc], place[flat], lang_of[group[doc]]))
        flat, doc = place[flat[order]], doc[order]
        g = group[doc]
    edge = np.ones(len(flat), bool)
    edge[1:] = (flat[1:] != flat[:-1]) | (g[1:] != g[:-1])
    fresh = edge.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(edge)
    docs = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else start
    return runs_batch(groups, g[start], terms, flat[start], doc[start] + first, docs, np.diff(np.append(start, len(flat))))


def text_runs(lang: bytes, source: bytes, text: bytes, document: int) -> pa.RecordBatch:
    """The runs of one long text, read slice by slice."""
    found = Counter()
    for part in slices(text.translate(_TERMS), LONG_BYTES):
        found.update(part.split())
    terms = sorted(found)
    same = np.zeros(len(terms), np.int64)
    return runs_batch([(lang, source)], same, terms, np.arange(len(terms)), same + document, same + 1, np.array([found[t] for t in terms], np.int64))


def runs_batch(groups: list[tuple[bytes, bytes]], group: np.ndarray, terms: list[bytes], term: np.ndarray, document: np.ndarray, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    lang, source = (pa.array([x[k] for x in groups], pa.binary()).take(pa.array(group)) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, pa.array(terms, pa.binary()).take(pa.array(term)), source, *(pa.array(x, pa.int64()) for x in (document, docs, n))], ["lang", "term", "source", "document", "docs", "n"])


def document_runs(docs: DataFrame) -> DataFrame:
    """lang, term, source, document, docs, n: a row for each run of a task's chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = seen = 0
        for batch in batches:
            for row in zip(*(text_bytes(batch, c) for c in ("lang", "source", "text")), strict=True):
                if len(row[2]) > LONG_BYTES:
                    yield from pieces(text_runs(*row, seen + len(held[0])))
                    row = (*row[:2], b"")
                for to, x in zip(held, row, strict=True):
                    to.append(x)
                size += len(row[2])
                if size >= CHUNK_BYTES:
                    yield from pieces(chunk_runs(*held, seen))
                    seen, size, held = seen + len(held[0]), 0, ([], [], [])
        if held[0]:
            yield from pieces(chunk_runs(*held, seen))

    return docs.select(*(empty_text(c) for c in ("lang", "source", "text"))).mapInArrow(run, RUNS)


def pieces(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def same_as_before(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row but the first has the row before's values."""
    out = np.ones(max(batch.num_rows - 1, 0), bool)
    for c in names:
        out &= pc.equal(batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def merged_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, term, source, n, first of the kept terms, from runs in order. What a batch ends in waits for the next: its last run, and the
    runs of its last term while they hold fewer than `least` documents. first: the term's first run."""
    names, empty = ["lang", "term", "source", "n", "first"], None
    rest: pa.RecordBatch | None = None
    going: tuple | None = None  # the term whose runs go out already

    def emit(b: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None, tuple | None]:
        starts = np.flatnonzero(np.append(True, ~same_as_before(b, ("lang", "term", "source"))))
        docs, n = (np.add.reduceat(b.column(c).to_numpy(), starts) for c in ("docs", "n"))
        b = b.take(pa.array(starts))
        term = np.cumsum(np.append(True, ~same_as_before(b, ("lang", "term")))) - 1
        first = np.append(True, term[1:] != term[:-1])
        mark = lambda i: (b.column("lang")[i].as_py(), b.column("term")[i].as_py())
        continued = going is not None and going == mark(0)
        total = np.bincount(term, docs)
        known = total >= least
        known[0] |= continued
        if continued:
            first[0] = False
        out = known[term]
        if last:
            keep, now = np.zeros(len(b), bool), None
        else:  # the last run may go on, and so may its term
            keep = (term == term[-1]) & ~known[-1]
            keep[-1] = True
            now = mark(len(b) - 1) if known[-1] and (continued and term[-1] == 0 or (term == term[-1]).sum() > 1) else None
        out &= ~keep
        going_out = pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(out)) for c in ("lang", "term", "source")] + [pa.array(n[out]), pa.array(first[out])], names)
        waiting = pa.RecordBatch.from_arrays([b.column(c) for c in ("lang", "term", "source")] + [pa.array(docs), pa.array(n)], ["lang", "term", "source", "docs", "n"]).filter(pa.array(keep)) if keep.any() else empty
        return going_out, waiting, now

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select(["lang", "term", "source", "docs", "n"])
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch.cast(rest.schema)]).combine_chunks().to_batches()[0]
        out, rest, going = emit(batch, False)
        if out.num_rows:
            yield out
    if rest is not None:
        out, _, _ = emit(rest, True)
        yield out


def kept_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, source, n, first: the occurrences of each kept term in each source that has it."""
    order = ["lang", "term", "source", "document"]
    # the hash leads only because Spark compares whole rows where the first eight bytes of an order are equal, as those of a language are
    runs = document_runs(docs).repartition("lang", "term").withColumn("key", F.xxhash64("lang", "term")).sortWithinPartitions("key", *order)
    return runs.select(*order, "docs", "n").mapInArrow(lambda batches: merged_runs(batches, least), "lang binary, term binary, source binary, n long, first boolean")


def probability(n: str, total: str, terms: str) -> F.Column:
    return F.expr(f"CAST(1 + (1000000000BD * (CAST({n} AS DECIMAL(20,0)) + 5)) div ({total} + 5 * {terms}) AS LONG)")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), lang_total, terms (V), number (of the source in its language, from 0), sources."""
    binary = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    every = docs.select(binary("lang"), binary("source")).distinct()
    groups = every.join(sums, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "firsts")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), F.count("*").alias("sources"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number")
    return groups.select("lang", "source", "total", number).join(langs, "lang")


PAIRS = "lang binary, block_a int, block_b int, i int, j int, value long, seen long"


def pair_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums over terms of |p - q| for each pair of sources (i of block_a, j of block_b; numbers within their blocks) of each bucket, and how many
    terms they are: those that some source of either block has. Rows: lang, block_a, block_b, bucket, term, side, place, p in this order; rows of an empty term hold the probability of an absent one."""
    state: dict = {}

    def close() -> Iterator[pa.RecordBatch]:
        if state:
            flush()
            i, j = np.nonzero(np.outer(state["zero"][0] >= 0, state["zero"][1] >= 0))
            lang, a, b = state["mark"][:3]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.binary()), *(pa.array(np.full(len(i), x), pa.int32()) for x in (a, b)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(state["sum"][i, j]), pa.array(np.full(len(i), state["seen"]))], ["lang", "block_a", "block_b", "i", "j", "value", "seen"])

    def flush() -> None:
        if state["terms"]:
            p, q = (np.repeat(np.maximum(state["zero"][k], 0)[None], state["terms"], 0) for k in (0, 1))
            at, side, place, value = (np.concatenate(x) for x in zip(*state["rows"], strict=True))
            p[at[side == 0], place[side == 0]] = value[side == 0]
            q[at[side == 1], place[side == 1]] = value[side == 1]
            for i in np.flatnonzero(state["zero"][0] >= 0):
                state["sum"][i] += np.abs(p[:, i : i + 1] - q).sum(0)
            state["rows"], state["terms"] = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        mark_of = lambda k: tuple(batch.column(c)[k].as_py() for c in ("lang", "block_a", "block_b", "bucket"))  # noqa: B023, E731
        same = same_as_before(batch, ("lang", "block_a", "block_b", "bucket"))
        new_term = np.append(True, ~same | ~same_as_before(batch, ("term",)))
        side, place, value = (batch.column(c).to_numpy() for c in ("side", "place", "p"))
        term = batch.column("term")
        edges = np.append(np.flatnonzero(np.append(True, ~same)), batch.num_rows).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if not state or state["mark"] != mark_of(lo):
                yield from close()
                state = {"mark": mark_of(lo), "zero": np.full((2, width), -1, np.int64), "sum": np.zeros((width, width), np.int64), "rows": [], "terms": 0, "seen": 0, "last": b""}
            starts = np.unique(np.append(lo, lo + np.flatnonzero(new_term[lo:hi]))).tolist()
            # whole terms at a time, TERMS of them
            number = np.cumsum(np.isin(np.arange(lo, hi), starts))
            names = [term[s].as_py() for s in starts]
            continues = names[0] == state["last"]
            for k in range(0, len(starts), TERMS):
                a, b = starts[k], starts[k + TERMS] if k + TERMS < len(starts) else hi
                part = slice(a, b)
                here = number[a - lo : b - lo] - number[a - lo]
                if k == 0 and names[0] == b"":
                    zeros = here == 0
                    state["zero"][side[part][zeros], place[part][zeros]] = value[part][zeros]
                    rows, here = ~zeros, here - 1
                    skipped = 1
                else:
                    rows, skipped = np.ones(b - a, bool), 0
                count = min(len(starts) - k, TERMS) - skipped
                if not count:
                    continue
                base = state["terms"] - 1 if k == 0 and continues and names[0] != b"" else state["terms"]
                state["rows"].append((here[rows] + base, side[part][rows], place[part][rows], value[part][rows]))
                state["seen"] += base + count - state["terms"]
                state["terms"] = base + count
                if state["terms"] > TERMS:
                    flush_whole(state, flush)
            state["last"] = names[-1]
    yield from close()


def flush_whole(state: dict, flush) -> None:
    """Flushes all terms but the last, which may go on."""
    at, side, place, value = (np.concatenate(x) for x in zip(*state["rows"], strict=True))
    last = at == state["terms"] - 1
    state["rows"], state["terms"] = [(at[~last], side[~last], place[~last], value[~last])], state["terms"] - 1
    flush()
    state["rows"], state["terms"] = [(np.zeros(int(last.sum()), np.int64), side[last], place[last], value[last])], 1


def source_pairs(terms: DataFrame, groups: DataFrame, width: int = SOURCES) -> DataFrame:
    """lang, source, item, value: the divergence of each source from each other of its language."""
    buckets = max(1, math.ceil(terms.count() / BUCKET))
    own, place = F.floor(F.col("number") / width).cast("int"), (F.col("number") % width).cast("int")
    blocks = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / width).cast("int"))
    # a source's rows are side 0 of its own block with each block from it on, side 1 of each block up to its own with its own
    tile = lambda a, b, side: F.struct(a.cast("int").alias("block_a"), b.cast("int").alias("block_b"), F.lit(side).alias("side"))
    tiles = F.concat(F.transform(F.filter(blocks, lambda j: j >= own), lambda j: tile(own, j, 0)), F.transform(F.filter(blocks, lambda j: j <= own), lambda j: tile(j, own, 1)))
    columns = ["lang", "t.block_a", "t.block_b", "bucket", "term", "t.side", place.alias("place"), "p"]
    several = F.col("sources") > 1
    rows = terms.filter(several).withColumns({"t": F.explode(tiles), "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")}).select(columns)
    absent = groups.filter(several & (F.col("terms") > 0)).withColumns({"term": F.lit(b""), "p": probability("0", "total", "terms")})
    absent = absent.withColumn("t", F.explode(tiles)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).select(columns)
    order = ["lang", "block_a", "block_b", "bucket"]
    dealt = rows.unionByName(absent).repartition(*order).sortWithinPartitions(*order, "term", "side", "place")
    sums = dealt.mapInArrow(lambda batches: pair_sums(batches, width), PAIRS).groupBy("lang", "block_a", "block_b", "i", "j").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    sums = sums.select("lang", (F.col("block_a") * width + F.col("i")).alias("a"), (F.col("block_b") * width + F.col("j")).alias("b"), "value", "seen").filter("a < b")
    names = groups.select("lang", F.col("source"), F.col("number").cast("int").alias("number"), "terms")
    both = sums.select("lang", "a", "b", "value", "seen").union(sums.select("lang", "b", "a", "value", "seen"))
    # without kept terms each pair's sum is 0
    none = names.filter("terms = 0").select("lang", F.col("number").alias("a"))
    none = none.join(none.select("lang", F.col("a").alias("b")), "lang").filter("a <> b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("seen"))
    both = both.union(none)
    zero = F.when(F.col("terms") > 0, probability("0", "total", "terms"))
    left = groups.select("lang", F.col("number").cast("int").alias("a"), "source", "terms", zero.alias("zero_a"))
    right = groups.select("lang", F.col("number").cast("int").alias("b"), F.col("source").alias("item"), zero.alias("zero_b"))
    # terms that no source of either block has
    unseen = F.coalesce((F.col("terms") - F.col("seen")) * F.abs(F.col("zero_a") - F.col("zero_b")), F.lit(0))
    return both.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select("lang", "source", "item", (F.col("value") + unseen).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source)."""
    kept = written(kept_runs(docs, least), "divergence-kept")
    groups = written(group_totals(docs, kept), "divergence-groups")
    overall = F.sum("n").over(Window.partitionBy("lang", "term"))
    rows = kept.select("lang", "term", "source", "n", overall.alias("lang_n")).join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "term", "number", "sources", probability("n", "total", "terms").alias("p"), probability("lang_n", "lang_total", "terms").alias("q"))
    rows = written(rows, "divergence-terms")
    pairs = source_pairs(rows, groups, width)
    over = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("*", F.lit("pair").alias("part"), rank.alias("rank")).unionByName(over.select("*", F.lit("term").alias("part"), rank.alias("rank")).filter(F.col("rank") <= top))
    text = lambda c: F.col(c).cast("string").alias(c)
    return ranked.select(text("lang"), text("source"), "part", text("item"), "value", "rank")
