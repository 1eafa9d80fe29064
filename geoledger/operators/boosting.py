"""Gradient-boosted regression trees in which a missing value has a direction of its own at each split, learned like the threshold.

Numbers become bins of their quantiles, of which bin 0 is for missing ones; categories become a bin for each value seen in training. For each level of a tree
every task adds up gradients by node, feature and bin over its rows; Spark adds the tasks' sums, and the driver, which sees nodes x features x bins
numbers whatever the rows are, chooses the splits. Rows lie in packed blocks in the shared folder, with the sum of the trees so far, so a lost executor costs
a level's reading. Loss is squared error; results don't depend on how rows are dealt, but for the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..storage import written
from . import splits

#: Rows of a packed block, trees after which their sum is written, and categories that a column may have.
BLOCK, FOLD_EVERY, MOST_CATEGORIES = 16_384, 8, 1024


@dataclass
class Tree:
    """Nodes by number; feature -1 is a leaf. Bins up to `threshold` go left; missing ones where `missing_left` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.missing_left[node], self.left[node] = feature, threshold, missing_left, len(self.feature)
        for v in values:
            for column, x in ((self.feature, -1), (self.threshold, 0), (self.missing_left, True), (self.left, 0), (self.value, v)):
                column.append(x)
        return self.left[node], self.left[node] + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold, missing, left = (np.array(x) for x in (self.feature, self.threshold, self.missing_left, self.left))
        at = np.zeros(len(bins), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            k = at[inner]
            b = bins[inner, feature[k]]
            at[inner] = left[k] + ~np.where(b == 0, missing[k], b <= threshold[k])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Booster:
    """Fitted trees. `predict` adds a column; columns may hold nulls, NaN and categories never seen, which count as missing."""

    numeric: list[str]
    categorical: list[str]
    edges: list[np.ndarray]
    levels: list[list[str]]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}={v}" for c, values in zip(self.categorical, self.levels, strict=True) for v in values)]

    def bins(self, numbers: Sequence[np.ndarray], texts: Sequence[Sequence[str | None]]) -> np.ndarray:
        out = []
        for v, edges in zip(numbers, self.edges, strict=True):
            v = np.asarray(v, float)
            out.append(np.where(np.isnan(v), 0, np.searchsorted(edges, v, side="right") + 1))
        for values, levels in zip(texts, self.levels, strict=True):
            place = {v: i for i, v in enumerate(levels)}
            at = np.array([-1 if v is None else place.get(v, len(levels)) for v in values], np.int64)
            out += [np.where((at < 0) | (at == len(levels)), 0, 1 + (at == i)) for i in range(len(levels))]
        n = len(numbers[0]) if numbers else len(texts[0])
        return np.stack(out, 1).astype(np.uint8) if out else np.zeros((n, 0), np.uint8)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.values(bins) for t in self.trees), np.zeros(len(bins)))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts in columns:
                parts = parts if isinstance(parts, tuple) else (parts,)
                numbers = [p.to_numpy(float, na_value=np.nan) for p in parts[: len(model.numeric)]]
                texts = [[None if v is None else str(v) for v in p.astype(object).where(p.notna(), None)] for p in parts[len(model.numeric) :]]
                yield pd.Series(model.scores(model.bins(numbers, texts)))

        columns = [F.col(f"`{c}`").cast("double") for c in self.numeric] + [F.col(f"`{c}`").cast("string") for c in self.categorical]
        return df.withColumn(name, score(*columns) if columns else F.lit(self.base))

    def importance(self) -> dict[str, float]:
        """How many splits use each feature, those of a category's values together."""
        own = [*self.numeric, *(c for c, values in zip(self.categorical, self.levels, strict=True) for _ in values)]
        counts = dict.fromkeys([*self.numeric, *self.categorical], 0)
        for t in self.trees:
            for f in t.feature:
                if f >= 0:
                    counts[own[f]] += 1
        return counts


def _learn_bins(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int) -> Booster:
    number = lambda c: F.when(is_finite(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    steps = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(number(c), steps, 10_000).alias(f"q{i}") for i, c in enumerate(numeric))).first() if numeric else None
    edges = [np.unique(np.array(row[i] or [], float)) for i in range(len(numeric))]
    levels = []
    for c in categorical:
        found = [r.v for r in df.select(F.col(f"`{c}`").cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(MOST_CATEGORIES + 1).collect()]
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"{c} has more than {MOST_CATEGORIES} values: not a category")
        levels.append(sorted(found))
    return Booster(list(numeric), list(categorical), edges, levels)


def _pack(df: DataFrame, model: Booster, target: str, weight: str | None, validation: str | None) -> DataFrame:
    """bins, y, w, margin, valid of up to BLOCK rows each, packed."""
    numbers, texts = len(model.numeric), len(model.categorical)
    columns = [F.when(is_finite(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"n{i}") for i, c in enumerate(model.numeric)]
    columns += [F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(model.categorical)]
    columns += [F.col(f"`{target}`").cast("double").alias("y"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"), (F.coalesce(F.col(f"`{validation}`"), F.lit(False)) if validation else F.lit(False)).alias("valid")]
    names = ["bins", "y", "w", "margin", "valid"]

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        x = model.bins([t.column(f"n{i}").to_numpy() for i in range(numbers)], [t.column(f"t{i}").to_pylist() for i in range(texts)])
        y, w, valid = (t.column(c).to_numpy() for c in ("y", "w", "valid"))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (x, y, w, np.full(len(y), model.base), valid.astype(np.uint8))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held, n = [*held, part], n + part.num_rows
                if n >= BLOCK:
                    yield blocks(held)
                    held, n = [], 0
        if n:
            yield blocks(held)

    return df.select(*columns).mapInArrow(run, "bins binary, y binary, w binary, margin binary, valid binary")


def _unpack(row: dict, width: int, pending: list[Tree]) -> tuple[np.ndarray, ...]:
    y, w, margin = (np.frombuffer(row[c]) for c in ("y", "w", "margin"))
    bins, valid = np.frombuffer(row["bins"], np.uint8).reshape(len(y), width), np.frombuffer(row["valid"], np.uint8).astype(bool)
    return bins, y, w, sum((t.values(bins) for t in pending), margin), valid


def _sums(blocks: DataFrame, width: int, most: int, tree: Tree, open_: list[int], pending: list[Tree]) -> tuple[np.ndarray, float, float]:
    """(gradients and weights by open node, feature and bin; squared errors and weight of the validation rows)."""
    place = {n: i for i, n in enumerate(open_)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, error, weight = np.zeros((2, len(open_), width, most)), 0.0, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, w, margin, valid = _unpack(row, width, pending)
                error += float((w * (y - margin) ** 2)[valid].sum())
                weight += float(w[valid].sum())
                node = np.array([place.get(n, -1) for n in range(len(tree.feature))])[tree.nodes(bins)]
                rows = np.flatnonzero((node >= 0) & ~valid)
                g, h, at = (w * (margin - y))[rows], w[rows], node[rows] * most
                for f in range(width):
                    key = at + bins[rows, f]
                    for k, v in enumerate((g, h)):
                        total[k, :, f] += np.bincount(key, v, len(open_) * most).reshape(-1, most)
        used = np.nonzero(total[1])
        columns = [*used, total[0][used], total[1][used]]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.append(c, -1).astype(np.int32)) for c in columns[:3]), pa.array(np.append(columns[3], error)), pa.array(np.append(columns[4], weight))], ["node", "feature", "bin", "g", "h"])

    found = blocks.mapInArrow(run, "node int, feature int, bin int, g double, h double").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out, error, weight = np.zeros((2, len(open_), width, most)), 0.0, 0.0
    for r in found:
        if r.node < 0:
            error, weight = r.g, r.h
        else:
            out[:, r.node, r.feature, r.bin] = r.g, r.h
    return out, error, weight


def best_split(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool, tuple[float, float], tuple[float, float]] | None:
    """(gain, feature, threshold, missing left, sums of the left side, of the right) of the best split of a node's sums by feature and bin; None if none
    gains. With missing values both directions are tried; without, they would follow the heavier side."""
    whole_g, whole_h = g[0].sum(), h[0].sum()
    best = None
    for missing_left in (True, False):
        left_g, left_h = np.cumsum(g[:, 1:], 1), np.cumsum(h[:, 1:], 1)
        if missing_left:
            left_g, left_h = left_g + g[:, :1], left_h + h[:, :1]
        right_g, right_h = whole_g - left_g, whole_h - left_h
        score = lambda a, b: a**2 / np.maximum(b + l2, 1e-300)
        gain = score(left_g, left_h) + score(right_g, right_h) - score(whole_g, whole_h)
        gain = np.where((left_h >= least) & (right_h >= least) & (np.minimum(left_h, right_h) > 0), gain, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 1e-12 and (best is None or gain[f, b] > best[0] + 1e-12):
            best = (float(gain[f, b]), int(f), int(b) + 1, missing_left, (left_g[f, b], left_h[f, b]), (right_g[f, b], right_h[f, b]))
    if best and h[best[1], 0] == 0:
        best = (*best[:3], bool(best[4][1] >= best[5][1]), *best[4:])
    return best


def fit(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), trees: int = 50, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 1.0, weight: str | None = None, validation: str | None = None, patience: int = 10) -> Booster:
    """Trees of the rows with a finite target and a positive weight. Rows with a true `validation` teach nothing: the trees end where their error was least, once it
    hasn't fallen for `patience` trees. Without rows the prediction is 0."""
    if not 2 <= bins <= 250:
        raise ValueError("between 2 and 250 bins")
    usable = df.filter(is_finite(F.col(f"`{target}`").cast("double")))
    usable = usable.filter(F.col(f"`{weight}`") > 0) if weight else usable
    teaching = usable.filter(~F.coalesce(F.col(f"`{validation}`"), F.lit(False))) if validation else usable
    model = _learn_bins(teaching, numeric, categorical, bins)
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    sums = teaching.agg(F.sum(w * F.col(f"`{target}`")), F.sum(w)).first()
    width = len(model.names)
    if sums[1] is None or not width:
        model.base = sums[0] / sums[1] if sums[1] else 0.0
        return model
    model.base = sums[0] / sums[1]
    most = max([len(e) + 2 for e in model.edges] + [3])
    blocks = written(_pack(usable, model, target, weight, validation), "boosting-rows")
    pending: list[Tree] = []
    for _ in range(trees + bool(validation)):
        tree, open_ = Tree(), [0]
        for level in range(depth):
            (g, h), error, weighed = _sums(blocks, width, most, tree, open_, pending)
            if level == 0 and validation:
                model.losses.append(error / weighed if weighed else 0.0)
                if len(model.losses) - 1 - int(np.argmin(model.losses)) >= patience or len(model.losses) > trees:
                    model.trees = model.trees[: int(np.argmin(model.losses))]
                    return model
            deeper = []
            for k, node in enumerate(open_):
                if found := best_split(g[k], h[k], l2, least):
                    _, f, b, missing_left, *sides = found
                    deeper += tree.split(node, f, b, missing_left, tuple(-rate * sg / (sh + l2) for sg, sh in sides))
            open_ = deeper
            if not open_:
                break
        if len(tree.feature) == 1:  # nothing more to gain
            break
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == FOLD_EVERY:
            blocks, pending = written(_folded(blocks, width, pending), "boosting-rows"), []
    if validation and model.losses:
        model.trees = model.trees[: int(np.argmin(model.losses))]
    return model


def _folded(blocks: DataFrame, width: int, pending: list[Tree]) -> DataFrame:
    """The blocks with the pending trees in their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [_unpack(row, width, pending)[3].tobytes() for row in batch.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


def out_of_fold(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], group: str, folds: int, seed: str, **options) -> DataFrame:
    """df with fold and prediction: each row is predicted by trees, bins and categories that saw no row of its group."""
    dealt = written(splits.group_folds(df, group, folds, seed), "boosting-folds")
    parts = [fit(dealt.filter(F.col("fold") != k), target, numeric, categorical, **options).predict(dealt.filter(F.col("fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)
