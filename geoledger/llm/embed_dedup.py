"""Near duplicates among embeddings: cosine of all pairs, by a PCA-ordered tiled comparison.

1. Vectors that are equal in all components are one node with a count, so copies cost one row of the comparison however many they
   are. A node is held as its unit vector, its LEAD coordinates along the principal axes, and the suffix norms |x|^2 - |lead|^2 that
   are left after each of STEPS.
2. Nodes are cut into regions of near leading coordinates, by medians of a bounded sample, and regions into blocks of about BLOCK_BYTES.
   The least distance of two regions' boxes bounds the cosine of every pair between them; pairs of regions that it rules out give no tile.
3. In a tile the products of the first leading dimensions are summed for all pairs, then more dimensions for the pairs that are left:
   a pair is given up once its partial product and the product of its two suffix norms can't reach the threshold. What is left
   is confirmed by the whole product. The order of dimensions changes the work, never the result.
4. A tile gives each node's number of links and the few links that join its components: about as many rows as it has nodes,
   however dense it is. Components of those links are the components of all links.

No pair of nodes escapes: the result is exact. The work in tiles grows with the square of the distinct vectors, less the pairs of regions
ruled out, which on vectors without structure are few. The driver holds the axes, boxes of at most REGIONS regions and of one more for each
other length of vector, and the number of their rows.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
lengths don't link; a repeated vec_id has a result for each of its rows, and its copies are links like any other; rows with a null vec_id
take no part (no links, component null, kept); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import written

LEAD, STEPS = 32, (8, 16, 32)
SAMPLE, REGIONS, SPLIT_DIMS = 4096, 512, 8
BLOCK_BYTES, CHUNK = 6 << 20, 256
#: Room for rounding: nearer than this to the threshold, a pair is decided by its own sum of products.
SLACK = 1e-9


def packed(embeddings: DataFrame) -> DataFrame:
    """vec_id, key (a digest of the vector; null where it links with nothing), vector (doubles, packed) for each row."""
    good = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            vectors = [values[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
            keys = [None if v is None else xxhash.xxh3_128_digest(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "key", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & good("v"), F.col("v")).alias("v"))
    return rows.mapInArrow(run, "vec_id long, key binary, vector binary")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Axes:
    """Leading axes of the most frequent length, cuts into regions (dimension, value, left, right; leaves are negative), first region of each other length."""

    width: int
    axes: np.ndarray
    cuts: list[tuple[int, float, int, int]]
    others: dict[int, int]

    def lead(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes if x.shape[1] == self.width else x[:, :LEAD].copy()

    def region(self, lead: np.ndarray, width: int) -> np.ndarray:
        if width != self.width:
            return np.full(len(lead), self.others[width])
        at = np.zeros(len(lead), np.int64) if self.cuts else np.full(len(lead), -1)
        while (inner := at >= 0).any():
            for k in np.unique(at[inner]):
                d, value, left, right = self.cuts[k]
                here = at == k
                at[here] = np.where(lead[here, d] <= value, left, right)
        return -1 - at


def learn(nodes: DataFrame, widths: dict[int, int], regions: int) -> Axes:
    """Axes of a bounded sample, and cuts at its medians along the widest leading dimension. Results don't depend on either."""
    width = max(widths, key=lambda w: (widths[w], -w))
    rows = nodes.filter(F.length("vector") == 8 * width).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect()
    x = unit(np.frombuffer(b"".join(bytes(r.vector) for r in rows)).reshape(len(rows), width))
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :LEAD])
    lead = (x @ axes)[:, :SPLIT_DIMS]
    cuts: list[tuple[int, float, int, int]] = []
    leaves = 0

    def cut(members: np.ndarray, parts: int) -> int:
        nonlocal leaves
        spread = np.ptp(lead[members], axis=0) if len(members) > 1 else np.zeros(1)
        d = int(spread.argmax())
        value = float(np.median(lead[members, d])) if spread[d] > 0 else 0.0
        low = lead[members, d] <= value if spread[d] > 0 else np.ones(len(members), bool)
        if parts < 2 or low.all():
            leaves += 1
            return -leaves
        k = len(cuts)
        cuts.append((d, value, 0, 0))
        cuts[k] = (d, value, cut(members[low], parts // 2), cut(members[~low], parts - parts // 2))
        return k

    cut(np.arange(len(x)), regions)
    return Axes(width, axes, cuts, {w: leaves + i for i, w in enumerate(sorted(set(widths) - {width}))})


def placed(nodes: DataFrame, axes: Axes) -> DataFrame:
    """node, n, width, region, unit and lead (packed), low and high: the leading coordinates that boxes are made of."""
    names = ["node", "n", "width", "region", "unit", "lead", "box"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            widths = np.array([len(v) // 8 for v in vectors], np.int64)
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                x = unit(np.frombuffer(b"".join(vectors[i] for i in at)).reshape(len(at), w))
                lead = axes.lead(x)
                box = np.zeros((len(at), SPLIT_DIMS))
                box[:, : lead.shape[1]] = lead[:, :SPLIT_DIMS]
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), pa.array(np.full(len(at), w), pa.int32()), pa.array(axes.region(lead, w), pa.int32()), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in lead]), pa.array(box.tolist(), pa.list_(pa.float64()))], names)

    return nodes.select("node", "n", "vector").mapInArrow(run, "node long, n long, width int, region int, unit binary, lead binary, box array<double>")


def partners(regions: list, threshold: float) -> np.ndarray:
    """Whether a pair of regions can hold a link: boxes of leading coordinates of unit vectors are no farther apart than links are."""
    low, high = (np.array([[r[f"{k}{d}"] for d in range(SPLIT_DIMS)] for r in regions]) for k in ("low", "high"))
    width = np.array([r["width"] for r in regions])
    gap = np.zeros((len(regions), len(regions)))
    for d in range(SPLIT_DIMS):
        gap += np.maximum(np.maximum(low[:, None, d] - high[None, :, d], low[None, :, d] - high[:, None, d]), 0) ** 2
    return (gap <= 2 - 2 * threshold + SLACK) & (width[:, None] == width[None, :])


@dataclass
class Block:
    node: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    lead: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, row: dict, prefix: str) -> Block:
        node, n = (np.frombuffer(row[f"{prefix}_{c}"], np.int64) for c in ("node", "n"))
        x, lead = (np.frombuffer(row[f"{prefix}_{c}"]).reshape(len(node), -1) for c in ("unit", "lead"))
        steps = steps_of(lead.shape[1])
        rest = np.stack([np.sqrt(np.maximum(1 - (lead[:, :k] ** 2).sum(1), 0)) for k in steps], 1)
        return cls(node, n, x, lead, rest)


def steps_of(width: int) -> list[int]:
    return sorted({min(k, width) for k in STEPS})


def chunk_links(a: Block, rows: slice, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of some rows of a with b whose cosine reaches the threshold."""
    steps, least = steps_of(a.lead.shape[1]), threshold - SLACK
    dots = a.lead[rows, : steps[0]] @ b.lead[:, : steps[0]].T
    open_ = dots + a.rest[rows, :1] * b.rest[None, :, 0] >= least
    i, j = np.nonzero(open_)
    dots = dots[i, j]
    for k in range(1, len(steps)):
        if len(i) * 8 > open_.size:
            break
        part = slice(steps[k - 1], steps[k])
        dots = dots + sums(a.lead[rows], b.lead, i, j, part)
        left = dots + a.rest[rows][i, k] * b.rest[j, k] >= least
        i, j, dots = i[left], j[left], dots[left]
    if len(i) * 8 > open_.size:  # crowded: one product of matrices costs less than so many pairs
        dots = a.unit[rows] @ b.unit.T
        i, j = np.nonzero(dots >= least)
        keep = dots[i, j] >= threshold + SLACK
    else:
        keep = np.zeros(len(i), bool)
    unsure = np.flatnonzero(~keep)
    keep[unsure] = sums(a.unit[rows], b.unit, i[unsure], j[unsure], slice(None)) >= threshold
    return i[keep] + rows.start, j[keep]


def sums(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, part: slice, step: int = 1 << 15) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        out[s] = np.einsum("ij,ij->i", x[i[s], part], y[j[s], part])
    return out


def tile(a: Block, b: Block, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each node of a and of b (copies of the other node count each), and links that join the tile's components."""
    links_a, links_b = np.zeros(len(a.node), np.int64), np.zeros(len(b.node), np.int64)
    offset = 0 if same else len(a.node)
    root = np.arange(len(a.node) + (0 if same else len(b.node)))
    joins = []
    for start in range(0, len(a.node), CHUNK):
        i, j = chunk_links(a, slice(start, min(start + CHUNK, len(a.node))), b, threshold)
        if same:
            i, j = i[i != j], j[i != j]
        np.add.at(links_a, i, b.n[j])
        if not same:
            np.add.at(links_b, j, a.n[i])
        apart = root[i] != root[j + offset]
        i, j = i[apart], j[apart]
        for at, to in _runs(i):
            u, others = int(i[at]), j[at:to]
            roots, first = np.unique(root[others + offset], return_index=True)
            fresh = roots != root[u]
            if fresh.any():
                joins += [(int(a.node[u]), int(b.node[k])) for k in others[first[fresh]]]
                root[np.isin(root, roots[fresh])] = root[u]
    return links_a, links_b, joins


def _runs(i: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = (np.flatnonzero(np.diff(i)) + 1).tolist()
    return zip([0, *edges], [*edges, len(i)], strict=True) if len(i) else iter(())


def blocks_of(rows: DataFrame, sizes: np.ndarray, first: np.ndarray) -> DataFrame:
    """block, region and its nodes' columns, packed: about BLOCK_BYTES each."""
    cut = F.pmod(F.xxhash64("node"), F.element_at(F.lit([int(x) for x in sizes]), F.col("region") + 1)).cast("int")
    block = (F.element_at(F.lit([int(x) for x in first]), F.col("region") + 1) + cut).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.column("r")):
                r = row.values
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(k, 1), batch.column("region").slice(k, 1), *(pa.array([r.field(c).to_numpy().tobytes()]) for c in ("node", "n")), *(pa.array([b"".join(r.field(c).to_pylist())]) for c in ("unit", "lead"))], ["block", "region", "a_node", "a_n", "a_unit", "a_lead"])

    grouped = rows.withColumn("block", block).groupBy("block", "region").agg(F.collect_list(F.struct("node", "n", "unit", "lead")).alias("r"))
    return grouped.mapInArrow(run, "block int, region int, a_node binary, a_n binary, a_unit binary, a_lead binary")


def node_links(nodes: DataFrame, threshold: float, regions: int = REGIONS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(node, links to other nodes' rows) and links (a, b) that join the components, of nodes (node, n, key, vector)."""
    spark = nodes.sparkSession
    widths = {r.w: r["count"] for r in nodes.groupBy((F.length("vector") / 8).cast("int").alias("w")).count().collect()}
    if not widths:
        none = nodes.filter("false")
        return none.select("node", F.lit(0).cast("long").alias("links")), none.select(F.col("node").alias("a"), F.col("node").alias("b"))
    n, width = sum(widths.values()), max(widths)
    per_block = max(CHUNK, block_bytes // (8 * (width + LEAD + 2)))
    # small tables are cut finer, so that all task slots have tiles
    per_block = max(CHUNK, min(per_block, math.ceil(n / (2 * spark.sparkContext.defaultParallelism) ** 0.5 / 2)))
    axes = learn(nodes, widths, max(1, min(regions, n // per_block)))
    rows = written(placed(nodes, axes), "cosine-placed")
    box = [f(F.col("box")[d]).alias(f"{k}{d}") for k, f in (("low", F.min), ("high", F.max)) for d in range(SPLIT_DIMS)]
    found = {r.region: r.asDict() for r in rows.groupBy("region", "width").agg(F.count("*").alias("rows"), *box).collect()}
    order = sorted(found)
    near = partners([found[r] for r in order], threshold)
    sizes, first = np.zeros(max(order) + 1, np.int64), np.zeros(max(order) + 1, np.int64)
    for r in order:
        sizes[r] = math.ceil(found[r]["rows"] / per_block)
    first[1:] = np.cumsum(sizes)[:-1]
    total = int(sizes.sum())
    region_of = np.repeat(np.arange(len(sizes)), sizes)
    may = np.zeros((len(sizes), len(sizes)), bool)
    may[np.ix_(order, order)] = near
    blocks = written(blocks_of(rows, np.maximum(sizes, 1), first), "cosine-blocks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block once for each block from its own on that it may have links with."""
        for batch in batches:
            for k, (block, region) in enumerate(zip(batch.column("block").to_pylist(), batch.column("region").to_pylist(), strict=True)):
                for other in range(block, total):
                    if may[region, region_of[other]]:
                        yield pa.RecordBatch.from_arrays([pa.array([other], pa.int32()), *(batch.column(c).slice(k, 1) for c in ("block", "a_node", "a_n", "a_unit", "a_lead"))], ["to", "block", "a_node", "a_n", "a_unit", "a_lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, b = Block.of(row, "a"), Block.of(row, "b")
                links_a, links_b, joins = tile(a, b, row["same"], threshold)
                ua, ub = np.flatnonzero(links_a), np.flatnonzero(links_b)
                left = np.concatenate([a.node[ua], b.node[ub], np.array([x for x, _ in joins], np.int64)])
                counts = np.concatenate([links_a[ua], links_b[ub], np.zeros(len(joins), np.int64)])
                right = pa.array([None] * (len(ua) + len(ub)) + [y for _, y in joins], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(left), right, pa.array(counts)], ["a", "b", "links"])

    tiles = blocks.mapInArrow(meet, "to int, block int, a_node binary, a_n binary, a_unit binary, a_lead binary")
    other = blocks.select(F.col("block").alias("to"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in ("node", "n", "unit", "lead")))
    tiles = tiles.join(other, "to").withColumn("same", F.col("block") == F.col("to")).drop("block", "to")
    out = written(tiles.mapInArrow(run, "a long, b long, links long"), "cosine-tiles")
    return out.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), out.filter("b IS NOT NULL").select("a", "b")


def link(embeddings: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings (vec_id, embedding)."""
    rows = written(packed(embeddings), "cosine-rows")
    nodes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "cosine-nodes")
    links, joins = node_links(nodes, threshold, **options)
    member = nodes.select("node", "key", "least", "n").join(components(joins), "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = written(member.join(links, "node", "left").select("key", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "cosine-members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    found = member.join(least, "component").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
