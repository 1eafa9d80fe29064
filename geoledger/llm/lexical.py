"""Ranked lexical search: WAND in each shard of an index of documents, heaps of shards merged.

1. Tasks read documents some SHARD_BYTES at a time and write each lot as one shard, a row of the index: doc_ids, lengths, sorted terms and their
   postings (document numbers and occurrences), packed. No text is shuffled, and a shard is made again from its documents alone.
2. Items are taken in blocks of about BLOCK_TERMS terms, each of which passes over the index: first for the documents of its terms, which give
   their weights, then for the search. The driver holds one block; its size doesn't depend on the documents.
3. In a shard each of an item's terms has a greatest impact. Terms whose greatest impacts don't reach the heap's threshold together make no
   pivot alone, so their postings aren't read: pivots are documents of the other terms. A document is a pivot if the greatest impacts of the
   terms it may hold reach the threshold; the terms that it doesn't hold are then taken out of the sum, and it's scored only if what is left still reaches it.
   Pivots are taken WINDOW at a time, those of the highest sums first, until the next sum is below the k-th score.
4. A task keeps one heap an item over all its shards, so thresholds grow; the heaps of the first SEEDS shards, searched before the others, are where all begin.
   The k best of all heaps are the result, the same whatever the shards are.

Defined results: null text has no terms; each row of documents is a document, whatever its doc_id; rows with a null doc_id count in all statistics, and are
never returned; items are the distinct rows (item_id, text) with an id: one that stands under several texts has a result for each; items without a term that
a document holds have no rows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_text, text_bytes, written
from .divergence import Numbers, slices

TOP = 10
SHARD_BYTES, LONG_BYTES = 8 << 20, 4 << 20
#: Terms with repeats of a block of items; shards whose heaps are where the others begin; pivots scored at once.
BLOCK_TERMS, SEEDS, WINDOW = 200_000, 8, 64

_TERMS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
INDEX = "shard long, documents long, length long, ids binary, lengths binary, terms binary, ends binary, docs binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def shard_row(ids: list, texts: list[bytes]) -> list:
    """documents (with a term), length, ids, lengths, terms, ends, docs, tfs. Postings of a term end at its place in `ends`."""
    numbers = Numbers()
    flat, doc, tf = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    short = [i for i, t in enumerate(texts) if len(t) <= LONG_BYTES]
    words = [np.fromiter(map(numbers.__getitem__, terms_of(texts[i])), np.int64) for i in short]
    if words:
        one = np.concatenate(words)
        key, n = np.unique(one * len(texts) + np.repeat(np.array(short), [len(w) for w in words]), return_counts=True)
        flat, doc, tf = [key // len(texts)], [key % len(texts)], [n]
    for i, t in enumerate(texts):
        if len(t) > LONG_BYTES:
            found = Counter()
            for part in slices(t.translate(_TERMS), LONG_BYTES):
                found.update(part.split())
            flat.append(np.array([numbers[w] for w in found], np.int64))
            doc.append(np.full(len(found), i))
            tf.append(np.array(list(found.values()), np.int64))
    flat, doc, tf = (np.concatenate(x).astype(np.int64) for x in (flat, doc, tf))
    terms = sorted(numbers)
    place = np.empty(len(terms), np.int64)
    place[[numbers[t] for t in terms]] = np.arange(len(terms))
    flat = place[flat]
    order = np.lexsort((doc, flat))
    flat, doc, tf = flat[order], doc[order], tf[order]
    lengths = np.bincount(doc, tf, len(texts)).astype(np.int64)
    ends = np.cumsum(np.bincount(flat, minlength=len(terms)))
    known = np.array([i is not None for i in ids], bool)
    packed = np.where(known, np.array([i or 0 for i in ids], np.int64), 0)
    # a null id stays in the statistics: its length is kept below zero, so that it's never ranked
    return [int((lengths > 0).sum()), int(lengths.sum()), packed.tobytes(), np.where(known, lengths, -1 - lengths).tobytes(), b" ".join(terms), ends.astype(np.int64).tobytes(), doc.astype(np.int32).tobytes(), np.minimum(tf, 2**31 - 1).astype(np.int32).tobytes()]


def index(docs: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text): a row for each shard, written to the shared folder."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def batch_of(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        row = [0, *shard_row(ids, texts)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield batch_of(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield batch_of(ids, texts)

    shards = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text()).mapInArrow(run, INDEX)
    return written(shards.withColumn("shard", F.monotonically_increasing_id()), "lexical-index")


@dataclass
class Items:
    """A block of items: their numbers of terms, with repeats, by the block's own numbers of terms."""

    ids: list[int]
    queries: list[dict[int, int]]
    terms: dict[bytes, int]

    @classmethod
    def of(cls, rows: list) -> Items:
        numbers = Numbers()
        return cls([r.item_id for r in rows], [dict(Counter(map(numbers.__getitem__, terms_of(bytes(r.text))))) for r in rows], dict(numbers))


def frequencies(shards: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each term of the block."""
    terms = items.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for words, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                n = np.diff(np.frombuffer(ends, np.int64), prepend=0)
                for k, word in enumerate(words.split(b" ") if words else ()):
                    if (t := terms.get(word)) is not None:
                        total[t] += n[k]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    found = shards.select("terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms), np.int64)
    for r in found:
        out[r.term] = r.n
    return out


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) if df else 0 for df in frequency], np.int64)


@dataclass
class Shard:
    """What a search reads of a shard: the postings of the block's terms, with their impacts for one occurrence in an item."""

    ids: np.ndarray
    docs: dict[int, np.ndarray]
    impacts: dict[int, np.ndarray]
    most: dict[int, int]

    @classmethod
    def of(cls, row: dict, terms: dict[bytes, int], weight: np.ndarray, documents: int, length: int) -> Shard:
        ids, lengths, ends = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "ends"))
        docs, tfs = (np.frombuffer(row[c], np.int32) for c in ("docs", "tfs"))
        known = lengths >= 0
        m = 25 + 75 * np.where(known, lengths, -1 - lengths) * documents // max(length, 1)
        out = cls(ids, {}, {}, {})
        for k, word in enumerate(row["terms"].split(b" ") if row["terms"] else ()):
            t = terms.get(word)
            if t is None or not weight[t]:
                continue
            part = slice(int(ends[k - 1]) if k else 0, int(ends[k]))
            d, tf = docs[part], tfs[part].astype(np.int64)
            if not known.all():
                d, tf = d[known[d]], tf[known[d]]
            if len(d):
                out.docs[t], out.impacts[t] = d, weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[d]))
                out.most[t] = int(out.impacts[t].max())
        return out


def wand(shard: Shard, query: dict[int, int], heap: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The heap of an item, (-score, doc_id) in order, k at most, after a shard. Documents whose bound is below the k-th score are skipped."""
    terms = sorted((t for t in query if t in shard.docs), key=lambda t: query[t] * shard.most[t])
    if not terms:
        return heap
    threshold = -heap[-1][0] if len(heap) == k else 1
    most = [query[t] * shard.most[t] for t in terms]
    below = np.cumsum(most)
    first = int(np.searchsorted(below, threshold))  # terms before it reach no pivot alone
    if first == len(terms):
        return heap
    bound = np.full(len(shard.ids), int(below[first - 1]) if first else 0)
    for t, x in zip(terms[first:], most[first:], strict=True):
        bound[shard.docs[t]] += x
    pivots = np.flatnonzero(bound >= max(threshold, (int(below[first - 1]) if first else 0) + 1))
    for at in range(first - 1, -1, -1):  # the strongest of the others first
        if not len(pivots):
            return heap
        docs = shard.docs[terms[at]]
        place = np.minimum(np.searchsorted(docs, pivots), len(docs) - 1)
        bound[pivots[docs[place] != pivots]] -= most[at]
        pivots = pivots[bound[pivots] >= threshold]
    pivots = pivots[np.argsort(-bound[pivots], kind="stable")]
    for at in range(0, len(pivots), WINDOW):
        part = pivots[at : at + WINDOW]
        part = part[bound[part] >= threshold]
        if not len(part):
            break
        score = np.zeros(len(part), np.int64)
        for t in terms:
            docs = shard.docs[t]
            place = np.minimum(np.searchsorted(docs, part), len(docs) - 1)
            score += np.where(docs[place] == part, query[t] * shard.impacts[t][place], 0)
        good = score >= threshold
        heap = sorted(heap + list(zip((-score[good]).tolist(), shard.ids[part[good]].tolist(), strict=True)))[:k]
        threshold = -heap[-1][0] if len(heap) == k else threshold
    return heap


def heaps(shards: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, floors: list[int], k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: what each task's heaps hold in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a floor is a score that k documents of other shards reach: k places that any better score takes
        found = [[(-f, 1 << 62)] * k if f else [] for f in floors]
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard.of(batch.slice(at, 1).to_pylist()[0], items.terms, weight, documents, length)
                found = [wand(shard, q, h, k) for q, h in zip(items.queries, found, strict=True)]
        rows = [(i, d, -s) for i, h in enumerate(found) for s, d in h if d < 1 << 62] or [()] * 3
        item, doc, score = zip(*rows, strict=True) if rows[0] else ((), (), ())
        for a in range(0, max(len(item), 1), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(item[a : a + 10_000], pa.int32()), pa.array(doc[a : a + 10_000], pa.int64()), pa.array(score[a : a + 10_000], pa.int64())], ["item", "doc_id", "score"])

    return shards.select("ids", "lengths", "terms", "ends", "docs", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(shards: DataFrame, benchmark: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of an index for each item (item_id, text)."""
    spark = shards.sparkSession
    totals = (F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "length"))
    documents, length, n = shards.agg(*totals, F.count("*")).first()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), empty_text().cast("binary").alias("text")).filter("item_id IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / (5 * block_terms)))
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "lexical-items")
    out = None
    for b in range(blocks):
        block = Items.of(items.filter(F.col("block") == b).orderBy("item_id", "text").collect())
        if not block.ids or not documents:
            continue
        weight = weights(documents, frequencies(shards, block))
        seeds = [r.shard for r in shards.select("shard").orderBy("shard").limit(SEEDS).collect()] if n > 4 * SEEDS else []
        floors = [0] * len(block.ids)
        if seeds:
            first = ranked(heaps(shards.filter(F.col("shard").isin(seeds)), block, weight, documents, length, floors, k), k)
            for r in first.filter(F.col("rank") == k).collect():
                floors[r.item] = r.score
        found = ranked(heaps(shards, block, weight, documents, length, floors, k), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        part = written(part, "lexical-found") if blocks > 1 else part
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
