"""Exact top-k search by pivot-table elimination.

Every vector keeps its distances to PIVOTS pivots. By the triangle inequality |d(q,p) - d(x,p)| is a lower bound of d(q,x) for
each pivot p; the largest of them bounds the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. Inside a tile of a block of
queries and a block of candidates, each query takes its candidates in the order of their bounds, some at a time (twice as many each time), until the
next bound is below its k-th best score. A first pass over one block of candidates gives every query a score to begin with.
Results don't depend on the pivots, which are far-apart vectors of a small sample.

Tiles come from a join on the candidates' block number; queries are repeated once for each block of candidates, BLOCK rows, and
nothing is broadcast but the pivots. Vectors are integers floor(scale * x). Defined results: vectors that are null or hold null or
non-finite components take no part; vectors of each length are searched among their own; ties go to the smaller vec_id; a repeated
vec_id is a candidate for each of its rows and a query once for each distinct vector; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best_rows, each_length, finite_vectors

PIVOTS, PIVOT_SAMPLE, QUERY_BLOCK, BLOCK, LEAST_BLOCK, STEP = 24, 512, 1024, 8192, 1024, 256
#: The score that a query begins with.
LOWEST = -(1 << 62)


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Far-apart vectors of a bounded sample, one after the other."""
    rows = vectors.select("vector", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).collect()
    x = np.array([r.vector for r in rows])
    if not len(x):
        return np.zeros((0, 0))
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def pivot_blocks(vectors: DataFrame, pivots: np.ndarray, n_blocks: int) -> DataFrame:
    """block, ids, vectors, distances to the pivots and floors, packed: the pivot table."""
    names = ("block", "ids", "vectors", "distances", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, r in zip(batch.column("block").to_pylist(), batch.column("r"), strict=True):
                ids, floors = (r.values.field(c).to_numpy() for c in ("vec_id", "floor"))
                x = r.values.field("vector").flatten().to_numpy().reshape(len(ids), -1)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v.tobytes()]) for v in (ids, x, d, floors))], names)

    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)).cast("int").alias("block")
    packed = vectors.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector", "floor"))).alias("r"))
    return packed.mapInArrow(run, "block int, ids binary, vectors binary, distances binary, floors binary")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles."""
    if len(x) and len(y) and np.abs(x).max() * np.abs(y).max() * x.shape[1] >= 2**53:
        return (x.astype(np.int64) @ y.astype(np.int64).T).astype(np.int64)
    return (x @ y.T).astype(np.int64)


def tile_best(qi, q, qd, ci, c, cd, k: int, floor: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score): the k best of a tile for each query, by elimination; floor: scores that k candidates of
    other tiles reach already."""
    qq, cc = (q * q).sum(1), (c * c).sum(1)
    for a in range(len(qi)):
        low = np.abs(cd - qd[a]).max(1) if cd.shape[1] else np.zeros(len(ci))
        bound = (qq[a] + cc - np.maximum(low - 1e-6 * (1 + low), 0) ** 2) / 2
        open_ = np.flatnonzero(bound >= floor[a])
        order = open_[np.argsort(-bound[open_], kind="stable")]
        scores, ids, kth = np.empty(0, np.int64), np.empty(0, np.int64), floor[a]
        at, step = 0, STEP
        while at < len(order) and bound[order[at]] >= kth:
            part = order[at : at + step]
            at, step = at + step, 2 * step
            part = part[ci[part] != qi[a]]
            scores, ids = np.concatenate([scores, products(q[a : a + 1], c[part])[0]]), np.concatenate([ids, ci[part]])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) == k:
                kth = max(kth, scores[-1])
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            if s >= floor[a]:
                yield int(qi[a]), i, s


def search(embeddings: DataFrame, every: int, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, whose vec_id is divisible by `every`, against all other rows."""
    vectors = finite_vectors(embeddings).select("vec_id", F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("vector"))
    vectors = written(vectors.withColumn("floor", F.lit(LOWEST)), "exact-vectors")
    return each_length(vectors, lambda own: _searched(own, every, k))


def _searched(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """search() among vectors (vec_id, vector, floor) of one length."""
    is_query = F.col("vec_id") % every == 0
    n, n_query = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    pivots = choose_pivots(vectors)
    # small tables are cut finer, so that all task slots have tiles
    blocks = max(1, math.ceil(n / BLOCK), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    query_blocks = max(1, math.ceil(n_query / QUERY_BLOCK))
    rows = written(pivot_blocks(vectors, pivots, blocks), "exact-blocks")
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                (qi, q, qd, floor), (ci, c, cd, _) = (_unpacked(t, p, width, len(pivots)) for p in ("q_", ""))
                found = list(zip(*tile_best(qi, q, qd, ci, c, cd, k, floor), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    def best(queries: DataFrame, to: int) -> DataFrame:
        """The best of the first `to` blocks of candidates: each block of queries meets each of them. Spark doesn't count the rows that an explode adds, and
        would send the queries' blocks to the driver as a broadcast: once for each block of candidates."""
        each = pivot_blocks(queries, pivots, query_blocks)
        each = each.select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "distances", "floors")), F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("block"))
        return best_rows(each.hint("merge").join(rows, "block").mapInArrow(run, "query_id long, vec_id long, score long"), k)

    queries = vectors.filter(is_query).distinct()
    if blocks > 1:
        floors = best(queries, 1).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("first"))
        queries = queries.join(floors, "vec_id", "left").select("vec_id", "vector", F.coalesce("first", "floor").alias("floor"))
    return best(queries, blocks)


def _unpacked(tile: dict, prefix: str, width: int, pivots: int) -> tuple[np.ndarray, ...]:
    ids, floors = (np.frombuffer(tile[prefix + c], np.int64) for c in ("ids", "floors"))
    return ids, np.frombuffer(tile[prefix + "vectors"]).reshape(len(ids), width), np.frombuffer(tile[prefix + "distances"]).reshape(len(ids), pivots), floors
