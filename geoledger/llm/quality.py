"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in cycles, add up to one lookup table for each feature; a second cycle over the
pairs with the most left to explain adds small two-way tables. A score is the logistic of the sum of table entries that a
document's bins point to: vectorised additions, no tree is walked. The features are shares and lengths over the whole text.

The model is fitted on the driver from at most `most_rows` labelled documents (SAMPLE_ROWS), taken by a hash of doc_id over
all of them; lang, source and doc_id are never features. Defined results: null or empty text has the features of an empty
text and gets a score; labels other than 0 and 1 and labels without a document play no part; without both labels in the
sample every score is the sample's share of label 1 (0.5 without any); repeated rows are scored alike.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, texts

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: A document is predicted good from this score on.
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "upper", "digits", "stops", "marks", "symbols", "not_ascii", "spread", "top_word", "line_words", "same_lines", "pipes", "shouts", "squeezed", "long_words", "ends")

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_SYMBOLS = b"#$%&*@^~<>{}=_\\/+[]"
_HIGH = bytes(range(0x80, 0x100))


def features(text: str) -> list[float]:
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, k = len(raw), len(words)
    count = lambda chars: (n - len(raw.translate(None, chars))) / n
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = [len(w) for w in words]
    return [
        math.log1p(k),
        sum(lengths) / k,
        count(_UPPER),
        count(_DIGITS),
        count(_STOPS),
        raw.count(b"!") / k,
        count(_SYMBOLS),
        count(_HIGH),
        math.log1p(len(counts)) / math.log1p(k),
        max(counts.values()) / k,
        math.log1p(k / len(lines)),
        1 - len(set(lines)) / len(lines),
        raw.count(b"|") / k,
        sum(map(str.isupper, words)) / k,
        len(zlib.compress(raw, 1)) / n,
        sum(x > 20 for x in lengths) / k,
        raw.count(b". ") / k,
    ]


@dataclasses.dataclass
class Model:
    """edges: inner bin edges of each feature; tables: a value for each bin; pairs: ((i, j), coarse edges, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, i], "right")]
        for (i, j), a, b, values in self.pairs:
            total += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values of a tree with up to so many leaves over ordered bins, from sums of gradients and curvatures."""
    cuts = [0, len(g)]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + ridge)
    for _ in range(leaves - 1):
        best = max(((worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for m in [a + 1 + int(np.argmax(worth(a, np.arange(a + 1, b)) + worth(np.arange(a + 1, b), b)))]), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    values = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + ridge)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four: its worth, and the table."""
    corner = lambda m: np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0)))
    cg, ch = corner(g), corner(h)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    part = lambda c: (c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b])
    parts = list(zip(part(cg), part(ch), strict=True))
    worth = sum(x * x / (y + ridge) for x, y in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    at = np.unravel_index(int(np.argmax(worth)), worth.shape)
    i, j = at[0] + 1, at[1] + 1
    values = np.zeros_like(g)
    for (x, y), place in zip(parts, ((slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))), strict=True):
        values[place] = x[at] / (y[at] + ridge)
    return float(worth[at]), values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0, bins: int = 64, n_pairs: int = 6, coarse: int = 12) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(math.log(share / (1 - share)), [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    cut = lambda column, n: np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))
    edges = [cut(x[:, i], bins) for i in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    intercept = math.log(share / (1 - share))
    total = np.full(len(y), intercept)
    slopes = lambda: ((p := 1 / (1 + np.exp(-total))), y - p, p * (1 - p))[1:]
    for _ in range(rounds):
        for i, bin_of in enumerate(at):
            g, h = slopes()
            step = rate * _tree(np.bincount(bin_of, g, len(tables[i])), np.bincount(bin_of, h, len(tables[i])), leaves, ridge)
            tables[i] += step
            total += step[bin_of]
    rough = [cut(x[:, i], coarse) for i in range(x.shape[1])]
    place = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(rough)]

    def grid(i: int, j: int) -> tuple[tuple[int, int], np.ndarray]:
        shape = (len(rough[i]) + 1, len(rough[j]) + 1)
        return shape, place[i] * shape[1] + place[j]

    ranked = []
    g, h = slopes()
    for i in range(x.shape[1]):
        for j in range(i):
            shape, cell = grid(i, j)
            if min(shape) > 1:
                ranked.append((_quadrants(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), ridge)[0], i, j))
    chosen = [(i, j, np.zeros(grid(i, j)[0])) for _, i, j in sorted(ranked, reverse=True)[:n_pairs]]
    for _ in range(rounds // 3):
        for i, j, values in chosen:
            g, h = slopes()
            shape, cell = grid(i, j)
            step = rate * _quadrants(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), ridge)[1]
            values += step
            total += step.ravel()[cell]
    return Model(intercept, edges, tables, [((i, j), rough[i], rough[j], values) for i, j, values in chosen])


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _with_features(rows: DataFrame, kept: str) -> DataFrame:
    """doc_id, the kept long column and x, the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column(kept).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", kept, "x"])

    return rows.select("doc_id", empty_text(), kept).mapInArrow(run, f"doc_id long, {kept} long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS) -> Model:
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("label_id"), "quality")
    n = usable.count()
    parts = 1 << 20
    sample = usable.filter(F.pmod(F.xxhash64("label_id"), F.lit(parts)) < int(parts * min(1.0, 0.95 * most_rows / max(n, 1)) + 1))
    sample = sample.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(most_rows)  # the same rows after a lost task
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # at most most_rows rows of two numbers
    rows = _with_features(found, "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(2 * most_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], float))


def _scores(batch_texts: list[str], model: Model) -> np.ndarray:
    return model.scores(np.array([features(t) for t in batch_texts]).reshape(len(batch_texts), len(FEATURES)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(texts(batch), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", empty_text()).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted good, with the columns that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(texts(batch), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
