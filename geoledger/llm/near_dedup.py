"""Near duplicates by MinHash bands, sequential Bayesian verification and exact confirmation.

1. Texts to sets: 64-bit fingerprints of their distinct five-word shingles. Texts with equal sets are one node, so exact
   copies cost one row each, whatever their number.
2. Bands: BANDS keys of ROWS minhashes each. A bucket's hub is the node that meets most others over all its buckets, which in a group
   of copies is the one nearest to their original. Each node is a candidate with the HUBS hubs that it shares most buckets with.
3. Signatures of candidates are compared batch by batch; a pair is dropped once the posterior probability (uniform prior)
   that its similarity reaches the threshold is below MISS. Survivors are confirmed on their full sets.
4. Connected components of the confirmed links. Buckets that still hold several components are taken again, whole: nodes outside
   the hub's component meet all others in blocks, inside tasks, by the same test on signatures, each pair in the first
   bucket that it shares. The nodes of surviving pairs meet again with their full sets, and only links that join components leave a task. So every pair that shares a bucket has been
   tested or is connected already, and a group of near copies gives about as many rows as it has nodes.

The chance that a pair at the threshold shares no band is (1 - 0.75^4)^32 = 5e-6, and falls steeply above it.

Defined results: a text of fewer than five words is one shingle; without words or text the set is empty and linked with nothing;
rows with a null doc_id take no part (component null, kept); doc_id is otherwise taken as an identifier, and texts that
share it are one node where it is the smallest of each of their sets; rows repeated in full have the same result, each;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import empty_text, text_bytes, written

WORDS, BANDS, ROWS = 5, 32, 4
SIMILARITY_PERCENT = 75
#: Hashes compared at once, and the chance at which a pair is given up.
BATCH, MISS = 16, 1e-7
#: Hubs that a node is tested with at first; nodes of a block, where a bucket's nodes meet each other.
HUBS, BLOCK = 2, 256

_LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
KEPT_WORDS = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct fingerprints, one text after the other, and how many each text has."""
    if len(_words) > KEPT_WORDS:
        _words.clear()
    parts, counts = [np.empty(0, np.uint64)], []
    for text in texts:
        words = text.translate(_LOWER).split()
        parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        if 0 < len(words) < WORDS:  # zeros make a short text one shingle
            parts.append(np.zeros(WORDS - len(words), np.uint64))
        counts.append(max(len(words), WORDS) if words else 0)
    n, flat = np.array(counts, np.int64), np.concatenate(parts)
    grams = np.zeros(len(flat), np.uint64)
    for i in range(min(WORDS, len(flat))):
        grams[: len(flat) - i] += flat[i:] * np.uint64(pow(_STEP, i, 1 << 64))
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(flat)) + WORDS <= np.cumsum(n)[owner]  # those that cross a text's end are left out
    values, owner = _mix(grams[inside]), owner[inside]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.bincount(owner[first], minlength=len(n))


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of 32-bit minhashes for each set; empty sets get zeros."""
    out = np.zeros((len(sizes), len(_MULTIPLIERS)), np.uint32)
    ends = np.cumsum(sizes)
    filled = np.flatnonzero(sizes)
    k = 0
    while k < len(filled):  # some sets at a time, so that they stay in the processor's cache
        m = k + 1
        base = ends[filled[k]] - sizes[filled[k]]
        while m < len(filled) and ends[filled[m]] - base <= 32768:
            m += 1
        part = values[base : ends[filled[m - 1]]]
        at = ends[filled[k:m]] - sizes[filled[k:m]] - base
        for j, a in enumerate(_MULTIPLIERS):
            out[filled[k:m], j] = np.minimum.reduceat(part * a, at) >> np.uint64(32)
        k = m
    return out


def _least_matches() -> np.ndarray:
    """After each batch: the matches below which a pair is dropped."""
    grid = np.linspace(0, 1, 20001)[1:-1]
    least = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= SIMILARITY_PERCENT / 100].sum() / mass.sum() >= MISS:
                least.append(m)
                break
    return np.array(least)


LEAST = _least_matches()


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of two signature arrays, whether the pair survives all batches. Dropped pairs cost no later batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(LEAST):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _as_rows(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(n, -1)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null: empty set), signature for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = shingle_sets(text_bytes(batch))
            sig, ends = signatures(values, sizes), np.cumsum(sizes)
            keys = [xxhash.xxh3_128_digest(values[e - n : e].tobytes()) if n else None for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", empty_text()).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """node, band, key: a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _as_rows(batch.column("signature").to_pylist(), batch.num_rows).astype(np.uint64)
            bands = np.arange(BANDS, dtype=np.uint64)
            keys = np.zeros((batch.num_rows, BANDS), np.uint64) + bands
            for r in range(ROWS):
                keys = _mix(keys * np.uint64(_STEP) + sig[:, r::ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(np.tile(bands.astype(np.int32), batch.num_rows)), pa.array(keys.ravel().view(np.int64))], ["node", "band", "key"])

    return nodes.select("node", "signature").mapInArrow(run, "node long, band int, key long")


def surviving(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sequential test keeps."""
    sig = nodes.select("node", "signature")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = likely(*(_as_rows(batch.column(c).to_pylist(), batch.num_rows) for c in ("sig_a", "sig_b")))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, grams (sorted fingerprints) for the nodes in `needed`, made again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = shingle_sets(text_bytes(batch))
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), grams], ["node", "grams"])

    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), empty_text()).join(needed.select("node").distinct(), "node", "left_semi")
    return texts.mapInArrow(run, "node long, grams array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    both = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.filter(100 * shared >= SIMILARITY_PERCENT * (F.size("grams_a") + F.size("grams_b") - shared)).select("a", "b")


def hub_candidates(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the hubs that it shares most buckets with. keys: node, key, meets."""
    hubs = keys.groupBy("key").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("hub"))
    shared = keys.join(hubs, "key").filter("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("n"), F.max("meets").alias("m"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub"))
    return shared.withColumn("r", rank).filter(F.col("r") <= HUBS).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of sets `rows` with sets `columns`: products of indicator matrices, `width` fingerprints at a time."""
    used = np.unique(np.concatenate([rows, columns]))
    flat, owner = np.concatenate([sets[i] for i in used]), np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n > 1  # a fingerprint of one set is in no intersection
    place, owner = (np.cumsum(common) - 1)[place[common[place]]], owner[common[place]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    at, other = np.searchsorted(used, rows), np.searchsorted(used, columns)
    total = np.zeros((len(rows), len(columns)), np.float32)
    for start in range(0, int(common.sum()), width):
        part = slice(*np.searchsorted(place, [start, start + width]))
        has = np.zeros((len(used), width), np.float32)
        has[owner[part], place[part] - start] = 1
        total += has[at] @ has[other].T
    return total.astype(np.int64)


def open_pairs(part: np.ndarray, side: np.ndarray, sig: np.ndarray, band: int) -> list[tuple[int, int, int]]:
    """(equal minhashes, i, j) of a tile's pairs that aren't connected yet and survive the sequential test: nodes of side 0 meet side 1,
    or one another where there is none. Pairs whose first shared bucket is another band's are left to it."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    found: list[tuple[int, int, int]] = []
    for n, i in enumerate(left):
        other = left[n + 1 :] if alone else right
        other = other[part[other] != part[i]]
        same = sig[other] == sig[i]
        mine = same.reshape(len(other), BANDS, ROWS).all(2).argmax(1) == band
        other, same = other[mine], same[mine]
        ok = likely(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other]) if len(other) else mine[:0]
        found += zip(same[ok].sum(1).tolist(), [int(i)] * int(ok.sum()), other[ok].tolist(), strict=True)
    return found


def tile_links(node, part, side, sig, sets, band: int) -> list[tuple[int, int]]:
    """Links that join components of a tile. The most similar pairs, by their signatures, are confirmed first."""
    open_ = sorted(open_pairs(part, side, sig, band), reverse=True)
    if not open_:
        return []
    rows, columns = (np.unique([x[k] for x in open_]) for k in (1, 2))
    both = shared_counts(sets, rows, columns)[np.searchsorted(rows, [x[1] for x in open_]), np.searchsorted(columns, [x[2] for x in open_])].tolist()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            x = y
        return x

    found = []
    for (_, i, j), shared in zip(open_, both, strict=True):
        if 100 * shared >= SIMILARITY_PERCENT * (len(sets[i]) + len(sets[j]) - shared) and (a := find(part[i])) != (b := find(part[j])):
            root[a] = b
            found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return found


TILE = ["key", "tile_a", "tile_b"]
PLACED = "key long, tile_a int, tile_b int, band int, node long, component long, side int"


def _tiles(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(key and tile, band, nodes, components, sides, signatures, sets) of tiles that lie one after the other; the one that a batch ends in is held."""
    held: list[tuple] = []
    current = None

    def whole() -> tuple:
        return (current, held[0][5], *(np.concatenate([h[k] for h in held]) for k in range(4)), [g for h in held for g in h[4]])

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in TILE], 1)
        node, part, side, bands = (batch.column(c).to_numpy() for c in ("node", "component", "side", "band"))
        sig = _as_rows(batch.column("signature").to_pylist(), batch.num_rows)
        grams = batch.column("grams") if with_sets else None
        offsets, values = (grams.offsets.to_numpy(), grams.values.to_numpy()) if with_sets else (None, None)
        edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(marks)], strict=True):
            mark = tuple(marks[a].tolist())
            if mark != current and held:
                yield whole()
                held = []
            current = mark
            held.append((node[a:b], part[a:b], side[a:b], sig[a:b], [values[offsets[i] : offsets[i + 1]] for i in range(a, b)] if with_sets else [], int(bands[a])))
    if held:
        yield whole()


def remaining_links(keys: DataFrame, parts: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) in buckets that hold several components. keys: node, band, key, meets. Tiles first carry signatures alone; full
    sets are fetched only for nodes of pairs that survive the sequential test."""
    member = keys.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = member.groupBy("key").agg(F.max_by("component", F.struct("meets", -F.col("node"))).alias("main"), F.max("component").alias("hi"), F.min("component").alias("lo"))
    member = member.join(sizes.filter("lo <> hi").select("key", "main"), "key").withColumn("outside", F.col("component") != F.col("main"))
    counts = member.groupBy("key").agg(F.count_if("outside").alias("n_out"), F.count_if(~F.col("outside")).alias("n_main"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    member = written(member.join(counts.select("key", blocks("n_out").alias("b_out"), blocks("n_main").alias("b_main")), "key"), "near-open")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    struct = lambda a, b, side: F.struct(a.cast("int").alias("tile_a"), b.cast("int").alias("tile_b"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outside, main = member.filter("outside").withColumn("own", own("b_out")), member.filter("NOT outside").withColumn("own", own("b_main"))
    # nodes outside meet each other in tiles of two of their blocks, and each block of the main component
    among = F.transform(upto("b_out"), lambda j: struct(F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.col("own") > j))
    against = F.transform(upto("b_main"), lambda j: struct(F.col("own"), -1 - j, F.lit(0)))
    placed = outside.withColumn("t", F.explode(F.concat(among, against))).unionByName(main.withColumn("t", F.explode(F.transform(upto("b_out"), lambda j: struct(j, -1 - F.col("own"), F.lit(1))))))
    rows = placed.select("key", "t.tile_a", "t.tile_b", "band", "node", "component", "t.side")
    signed_nodes = nodes.select("node", "signature")
    by_tile = lambda df: df.repartition(*TILE).sortWithinPartitions(*TILE, "node")
    names = [c.split()[0] for c in PLACED.split(", ")]

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, band, node, part, side, sig, _ in _tiles(batches, False):
            at = np.unique([x[k] for x in open_pairs(part, side, sig, band) for k in (1, 2)]).astype(int)
            if len(at):
                same = [np.full(len(at), v) for v in (*mark, band)]
                columns = zip([*same, node[at], part[at], side[at]], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, band, node, part, side, sig, grams in _tiles(batches, True):
            yield _pairs(tile_links(node, part, side, sig, grams, band))

    kept = written(by_tile(rows.join(signed_nodes, "node")).select(*names, "signature").mapInArrow(survivors, PLACED), "near-survivors")
    return by_tile(kept.join(signed_nodes, "node").join(sets, "node")).select(*names, "signature", "grams").mapInArrow(links, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text)."""
    rows = written(signed(docs), "near-signed")
    usable = rows.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    sets = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    sets = written(sets, "near-nodes")
    nodes = sets.groupBy("node").agg(F.min_by("signature", "set_key").alias("signature"))
    keys = band_keys(sets)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keys = written(keys.join(sizes, "key"), "near-buckets")  # buckets of one node are gone
    meets = keys.groupBy("node").agg(F.sum("n").alias("meets"))
    keys = written(keys.drop("n").join(meets, "node"), "near-keys")
    grams = written(full_sets(docs, meets), "near-sets")
    links = written(confirmed(written(surviving(hub_candidates(keys), nodes), "near-pairs"), grams), "near-links")
    more = written(remaining_links(keys, components(links), nodes, grams), "near-rest")
    parts = components(links.union(more))
    by_set = sets.join(parts, "node", "left").select("set_key", F.coalesce("component", "node").alias("found"))
    out = rows.drop("signature").join(by_set, "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
