"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample (SAMPLE vectors) is cut into balanced parts: vectors first go to the nearest of centres, in
rounds and under a size limit, then each moves to the part of most of its neighbours in the graph while sizes allow it, which cuts fewer
edges. A small softmax classifier learns to tell the parts of a vector's neighbours from the vector. Every row is indexed under its most
probable part; a query goes to its most probable parts, as many as hold PROBED of the probability but at least LEAST_PARTS, and the
rows there are reranked by the exact inner product. The first LEAST_PARTS parts give a query its k-th score so far; from the
others only rows that reach it leave their task.

Parts grow in number with the table, about PART_ROWS rows each (a small table has up to FEW_PARTS of FEW_ROWS rows or more): up to MOST_PARTS by one classifier; beyond that each part is cut
again by a classifier of its own, learned in a task from a bounded sample of the part, and probabilities multiply (MOST_PARTS squared parts
at most; then parts grow). A part's rows lie in blocks of at most about BLOCK rows, so that a part with a third of all rows is many
rows of the join.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of each length are searched
among their own; ties go to the smaller vec_id; a repeated vec_id is a candidate for each of its rows and a query once for each
distinct vector; an empty table gives no rows; a query that finds fewer than k rows in its parts is searched against all
parts, so that it returns k, or all candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best_rows, each_length, finite_vectors

SAMPLE, GRAPH_DEGREE, PART_ROWS, MOST_PARTS = 6000, 16, 1024, 64
PROBED, LEAST_PARTS, QUERY_BLOCK, BLOCK = 0.98, 4, 512, 4096
FEW_PARTS, FEW_ROWS = 8, 64


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest by inner product of each row."""
    out = np.empty((len(x), min(degree, len(x) - 1)), int)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def balanced_parts(near: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15) -> np.ndarray:
    """A part for each node of the graph: few edges between parts, none much over the mean size."""
    n = len(near)
    most = math.ceil(slack * n / parts)
    rng = np.random.default_rng(5)
    centres = x[rng.permutation(n)[:parts]]
    sides = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()]), np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    part = np.zeros(n, int)
    for step in range(rounds):
        if step < rounds // 2:  # rough places first, from centres
            want = x @ centres.T
        else:  # then edges: how many neighbours each part holds
            want = np.zeros((n, parts))
            np.add.at(want, (sides[0], part[sides[1]]), 1.0)
            want += 1e-3 * (x @ centres.T)
        order = np.argsort(-(np.sort(want, 1)[:, -1] - np.median(want, 1)), kind="stable")
        ranked, room = np.argsort(-want, 1, kind="stable"), np.full(parts, most)
        for i in order:
            for p in ranked[i]:
                if room[p]:
                    part[i] = p
                    room[p] -= 1
                    break
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return part


def fit_router(x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, rounds: int = 200, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a softmax over parts; a node's target is spread over the parts of its neighbours."""
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    np.add.at(target, (np.arange(len(x)), part), max(1.0, near.shape[1] / 4))
    target /= target.sum(1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        p = probabilities(x, w, b)
        r = (target - p) / len(x)
        dw, db = x.T @ r, r.sum(0)
        sw, sb = sw + dw**2, sb + db**2
        w, b = w + rate * dw / np.sqrt(sw), b + rate * db / np.sqrt(sb)
    return w, b


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(scale > 0, scale, 1)


def learned_parts(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a classifier over at most `parts` parts of a bounded sample."""
    x = _scaled(sample) if len(sample) else sample
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return np.zeros((x.shape[1], 1)), np.zeros(1)
    near = neighbour_graph(x, GRAPH_DEGREE)
    return fit_router(x, balanced_parts(near, x, parts), near, parts)


class Router:
    """A classifier over parts and, where given, one over the parts of each of them: `below`."""

    def __init__(self, top: tuple[np.ndarray, np.ndarray], below: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.top, self.below = top, below or {}
        self.starts = np.cumsum([0, *(len(self.below[i][1]) if i in self.below else 1 for i in range(len(top[1])))])
        self.parts = int(self.starts[-1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each part, for each row."""
        x = _scaled(x)
        p = probabilities(x, *self.top)
        out = np.empty((len(x), self.parts))
        for i in range(p.shape[1]):
            inner = probabilities(x, *self.below[i]) if i in self.below else 1.0
            out[:, self.starts[i] : self.starts[i + 1]] = p[:, i : i + 1] * inner
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of the most probable part above."""
        x = _scaled(x)
        top = probabilities(x, *self.top).argmax(1)
        out = self.starts[top]
        for i in set(top.tolist()) & set(self.below):
            rows = top == i
            out[rows] += probabilities(x[rows], *self.below[i]).argmax(1)
        return out

    def probes(self, x: np.ndarray, probed: float = PROBED) -> list[list[int]]:
        p = self.probabilities(x)
        order = np.argsort(-p, 1, kind="stable")
        mass = np.cumsum(np.take_along_axis(p, order, 1), 1)
        n = np.minimum(np.maximum((mass < probed).sum(1) + 1, LEAST_PARTS), self.parts)
        return [o[:m].tolist() for o, m in zip(order, n, strict=True)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)


def learn(vectors: DataFrame, n: int, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> Router:
    """The router of a table of n vectors. On the driver: a sample of SAMPLE vectors, and at most most_parts classifiers of a part's parts."""
    sample = vectors.select("vector", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()
    wanted = max(1, n // part_rows, min(FEW_PARTS, n // FEW_ROWS))
    top = Router(learned_parts(np.array([r.vector for r in sample]).reshape(len(sample), -1 if sample else 0), min(most_parts, wanted)))
    if wanted <= most_parts or top.parts == 1:
        return top

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(top.home(_matrix(batch)), pa.int32()), batch.column("vec_id"), batch.column("vector")], ["part", "vec_id", "vector"])

    at = written(vectors.mapInArrow(placed, "part int, vec_id long, vector array<double>"), "ann-placed")
    sizes = at.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part: most_parts at most
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    drawn = at.join(sizes, "part").filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))

    def below(key: tuple, rows: pa.Table) -> pa.Table:
        """A part's sample is about SAMPLE rows, by its hash."""
        rows = rows.sort_by([("vec_id", "ascending")]).slice(0, 2 * SAMPLE).combine_chunks()
        x = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        w, b = learned_parts(x, min(most_parts, max(1, rows.column("n")[0].as_py() // part_rows)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float32).tobytes()], pa.binary())})

    found = drawn.groupBy("part").applyInArrow(below, "part int, w binary, b binary").collect()
    tables = {r.part: (np.frombuffer(r.w, np.float32), np.frombuffer(r.b, np.float32)) for r in found}
    return Router(top.top, {i: (w.reshape(-1, len(b)), b) for i, (w, b) in tables.items()})


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order, so that equal vectors have equal scores wherever they lie."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


def rerank(qi, q, floor, ci, c, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best of each query that reach its floor."""
    rough = q @ c.T
    off = 1e-9 * (1 + np.abs(q).max() * np.abs(c).max() * q.shape[1])
    for a in range(len(qi)):
        s = np.where(ci == qi[a], -np.inf, rough[a])
        least = max(floor[a], np.partition(s, -k)[-k] if len(s) > k else -np.inf) - off
        near = np.flatnonzero((s >= least) & (ci != qi[a]))
        score = exact_scores(q[a], c[near])
        for i in np.lexsort((ci[near], -score))[:k]:
            if score[i] >= floor[a]:
                yield int(qi[a]), int(ci[near[i]]), float(score[i])


def search(embeddings: DataFrame, every: int, k: int, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS, probed: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, whose vec_id is divisible by `every`, against all other rows."""
    vectors = finite_vectors(embeddings).filter(F.exists("vector", lambda x: x != 0))
    return each_length(written(vectors, "ann-vectors"), lambda own: _searched(own, every, k, part_rows, most_parts, probed))


def _searched(vectors: DataFrame, every: int, k: int, part_rows: int, most_parts: int, probed: float) -> DataFrame:
    """search() among vectors of one length."""
    n = vectors.count()
    router = learn(vectors, n, part_rows, most_parts)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(router.home(_matrix(batch)), pa.int32()), batch.column("vec_id"), batch.column("vector")], ["part", "vec_id", "vector"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(router.probes(_matrix(batch), probed), pa.list_(pa.int32())), batch.column("vec_id"), batch.column("vector")], ["parts", "vec_id", "vector"])

    indexed = written(vectors.mapInArrow(at_home, "part int, vec_id long, vector array<double>"), "ann-index")
    # a row for each part that holds rows: parts are 4096 at most
    counts = written(indexed.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("n_blocks")), "ann-counts")
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("n_blocks")).cast("int")
    blocks = indexed.join(counts, "part").groupBy("part", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("r")).select("part", "block", "r")

    queries = vectors.filter(F.col("vec_id") % every == 0).distinct().mapInArrow(probing, "parts array<int>, vec_id long, vector array<double>")
    queries = written(queries, "ann-queries")
    n_blocks = max(1, math.ceil(n / every / QUERY_BLOCK))

    def found(probing_rows: DataFrame) -> DataFrame:
        """probing_rows: part, vec_id, vector, floor. Query blocks of each part, with each block of it."""
        mine = probing_rows.groupBy("part", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(n_blocks)).alias("q_block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector", "floor"))).alias("q"))
        mine = mine.join(counts, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        return mine.join(blocks, ["part", "block"]).select("q", "r").mapInArrow(tile, "query_id long, vec_id long, score double")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, r in zip(batch.column("q"), batch.column("r"), strict=True):
                (qi, qx), (ci, cx) = ((v.values.field("vec_id").to_numpy(), v.values.field("vector").flatten().to_numpy()) for v in (q, r))
                best = list(zip(*rerank(qi, qx.reshape(len(qi), -1), q.values.field("floor").to_numpy(), ci, cx.reshape(len(ci), -1), k), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["query_id", "vec_id", "score"])

    def probe(rows: DataFrame, parts: Column) -> DataFrame:
        return rows.select("vec_id", "vector", "floor", F.explode(parts).alias("part"))

    none = F.lit(float("-inf"))
    first = written(best_rows(found(probe(queries.withColumn("floor", none), F.slice("parts", 1, LEAST_PARTS))), k), "ann-first")
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    others = queries.filter(F.size("parts") > LEAST_PARTS).join(floors, "vec_id", "left").withColumn("floor", F.coalesce("reached", none))
    more = found(probe(others, F.slice("parts", LEAST_PARTS + 1, router.parts)))
    both = written(best_rows(first.drop("rank").unionByName(more), k), "ann-found")
    # queries whose parts hold fewer than k rows are searched everywhere
    short = queries.join(both.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= min(k, n - 1)), "vec_id", "left_anti")
    everywhere = probe(short.withColumn("floor", none), F.sequence(F.lit(0), F.lit(router.parts - 1)))
    return both.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(best_rows(found(everywhere), k))
