"""Mixing sources to target weights, by hierarchical budgeting.

A tree of domain, language and source holds the corpus; a node's capacity is its tokens times the epochs allowed. From the
root down each node's budget is shared among its children by weight: a child that can't use its share gets its capacity, and its
shortage goes to its siblings by weight; only what a whole family can't use is left to the families above, whose capacities
say so beforehand. Each level is one window over siblings ordered by capacity per weight: the children that are
filled come first, so running sums give the share of the others without iteration.

A leaf's budget is whole epochs and a rest. Whole epochs repeat all its documents; the rest is the prefix of the leaf's documents in
the epoch's own order, by md5 of seed, epoch and doc_id, up to the budget: documents while the tokens before them are less. The order is cut
into BUCKETS by the hash's first digits; sums of buckets tell which are taken whole, so only one bucket of a leaf is ever put in order.

Texts are encoded once, into a narrow table (id, leaf, tokens by the shared encoder, key of the text). All planning works on that; a leaf's
plan ends in one cut, the last place of its order that is taken, and documents meet it as rows of a small table.

Defined results: null or empty text has no tokens and is not selected; a null key is a node of its own; without a domain column
or mapping all documents are of one domain; rows with equal doc_id and text have one place in the order and are taken together;
rows with equal doc_id alone are ordered by a hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_text, texts, written
from .tokens import encoder, vocabulary_path

#: Share of the corpus' tokens that is asked for, epochs allowed, seed, and the power of a node's tokens that is its weight where none is given.
SHARE, EPOCHS, SEED, POWER = 0.9, 2, "mix-1", 0.7
LEVELS = ("domain", "lang", "source")
#: Hex digits of the hash that make a bucket: 4096 of them.
DIGITS = 3

Weights = dict[str, dict[str, float]]


def domain_by(sources: dict[str, str], other: str = "other") -> Column:
    """The domain of a document by its source."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in sources.items() for x in pair))[F.col("source")], F.lit(other)) if sources else F.lit(other)


def text_key() -> Column:
    return F.xxhash64(empty_text())


def counted(docs: DataFrame, domain: Column, vocabulary: str | None = None) -> DataFrame:
    """doc_id, mix_domain, lang, source, mix_key, mix_tokens of the documents that have tokens; texts are read and encoded once."""
    where = vocabulary or vocabulary_path()
    names = ["doc_id", "mix_domain", "lang", "source", "mix_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where).encode
        for batch in batches:
            n = [len(ids) // 4 for ids in encode(texts(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64())], [*names, "mix_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain.cast("string").alias("mix_domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_key().alias("mix_key"), empty_text())
    return rows.mapInArrow(run, "doc_id long, mix_domain string, lang string, source string, mix_key long, mix_tokens long").filter("mix_tokens > 0")


def budgets(leaves: DataFrame, levels: tuple[str, ...], budget: Column, epochs: int, power: float, weights: Weights | None = None) -> DataFrame:
    """leaves (levels, tokens) with budget, in tokens. weights: by level, a node's value to its weight; other nodes of such a level have the
    least weight listed there. Nodes of other levels weigh a power of their tokens."""
    tree = leaves.withColumn("share", budget.cast("double"))
    for depth, level in enumerate(levels):
        parents = [F.col(c) for c in levels[:depth]]
        children = tree.groupBy(*levels[: depth + 1]).agg(F.sum("tokens").alias("node_tokens"), F.max("share").alias("given"))
        weight = F.pow(F.col("node_tokens").cast("double"), power)
        if weights and level in weights:
            listed = F.create_map(*(F.lit(x) for name, w in weights[level].items() for x in (name, float(w))))
            weight = F.coalesce(listed[F.col(level)], F.lit(float(min(weights[level].values()))))
        children = children.withColumns({"capacity": F.col("node_tokens").cast("double") * epochs, "weight": weight})
        by_fill = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), F.col(level).asc_nulls_first())
        before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
        # what a unit of weight gets if all before are filled; it grows up to the first child that this doesn't fill, then falls
        children = children.withColumn("unit", (F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        open_unit = F.max(F.when(F.col("capacity") > F.col("unit") * F.col("weight"), F.col("unit"))).over(Window.partitionBy(*parents))
        share = F.coalesce(F.least("capacity", open_unit * F.col("weight")), F.col("capacity"))
        children = children.select(*(F.col(c).alias(f"child_{c}") for c in levels[: depth + 1]), share.alias("child_share"))
        same = [F.col(c).eqNullSafe(F.col(f"child_{c}")) for c in levels[: depth + 1]]
        tree = tree.join(children, same).select(*leaves.columns, F.col("child_share").alias("share"))
    return tree.withColumn("budget", F.floor("share").cast("long")).drop("share")


LEAF = ["leaf_domain", "leaf_lang", "leaf_source"]


def _placed(rows: DataFrame, planned: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, mix_domain, lang, source, mix_key) with their leaf's plan and their place in its order."""
    same = F.col("mix_domain").eqNullSafe(F.col("leaf_domain")) & F.col("lang").eqNullSafe(F.col("leaf_lang")) & F.col("source").eqNullSafe(F.col("leaf_source"))
    said = F.concat_ws(":", F.lit(seed), F.col("whole_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.struct(F.md5(said.cast("binary")).alias("hash"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("mix_key").alias("key"))
    return rows.join(planned, same).withColumn("place", place)


def plan(rows: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, power: float = POWER, weights: Weights | None = None) -> DataFrame:
    """A row for each leaf of `rows` (as of counted()): whole_epochs, and cut, the last place that the next epoch's prefix takes (null: none)."""
    leaves = rows.groupBy(F.col("mix_domain").alias("domain"), "lang", "source").agg(F.sum("mix_tokens").alias("tokens"))
    whole = leaves.agg(F.sum("tokens").alias("all_tokens"))
    # one row: the corpus' tokens
    planned = budgets(leaves.join(F.broadcast(whole)), LEVELS, F.floor(F.col("all_tokens") * share), epochs, power, weights).drop("all_tokens")
    planned = planned.select(F.col("domain").alias("leaf_domain"), F.col("lang").alias("leaf_lang"), F.col("source").alias("leaf_source"), F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(epochs)).cast("int").alias("whole_epochs"), "budget", "tokens")
    planned = written(planned.withColumn("rest", F.when(F.col("whole_epochs") < epochs, F.col("budget") - F.col("whole_epochs") * F.col("tokens")).otherwise(0)), "mix-planned")
    at = _placed(rows, planned, seed).filter("rest > 0").withColumn("bucket", F.substring("place.hash", 1, DIGITS))
    sums = at.groupBy(*LEAF, "rest", "bucket").agg(F.sum("mix_tokens").alias("bucket_tokens"))  # 4096 rows of a leaf at most
    sums = sums.withColumn("before", F.sum("bucket_tokens").over(Window.partitionBy(*LEAF).orderBy("bucket")) - F.col("bucket_tokens"))
    edge = sums.filter("before < rest AND before + bucket_tokens >= rest").select(*(F.col(c).alias(f"edge_{c}") for c in LEAF), F.col("bucket").alias("edge_bucket"), (F.col("rest") - F.col("before")).alias("edge_rest"))
    on_leaf = [F.col(c).eqNullSafe(F.col(f"edge_{c}")) for c in LEAF]
    edge = written(edge, "mix-edges")
    inside = at.join(edge, [*on_leaf, F.col("bucket") == F.col("edge_bucket")]).groupBy(*LEAF, "edge_rest", "place").agg(F.sum("mix_tokens").alias("place_tokens"))
    earlier = F.sum("place_tokens").over(Window.partitionBy(*LEAF).orderBy("place")) - F.col("place_tokens")
    cuts = inside.withColumn("earlier", earlier).filter("earlier < edge_rest").groupBy(*(F.col(c).alias(f"edge_{c}") for c in LEAF)).agg(F.max("place").alias("cut"))
    return written(planned.join(cuts, on_leaf, "left").select(*LEAF, "whole_epochs", "cut"), "mix-plan")


def selected(rows: DataFrame, planned: DataFrame, seed: str = SEED) -> DataFrame:
    """rows once for each epoch that takes them: mix_epoch, from 0."""
    at = _placed(rows, planned, seed)
    whole = F.when(F.col("whole_epochs") > 0, F.sequence(F.lit(0), F.col("whole_epochs") - 1)).otherwise(F.array().cast("array<int>"))
    rest = F.when(F.col("place") <= F.col("cut"), F.array("whole_epochs")).otherwise(F.array().cast("array<int>"))
    return at.withColumn("mix_epoch", F.explode(F.concat(whole, rest))).select(*rows.columns, "mix_epoch")


def mix_ids(docs: DataFrame, domain: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, power: float = POWER, weights: Weights | None = None) -> DataFrame:
    """doc_id, mix_domain, lang, source, mix_key, mix_tokens, mix_epoch of what is selected; texts are read once."""
    rows = written(counted(docs, F.lit("all") if domain is None else domain), "mix-counted")
    return selected(rows, plan(rows, share, epochs, seed, power, weights), seed)


def mix(docs: DataFrame, domain: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, power: float = POWER, weights: Weights | None = None) -> DataFrame:
    """The selected documents with their columns; a document of several epochs is several rows. Texts are read twice: to count, and to select."""
    domain = F.lit("all") if domain is None else domain
    planned = plan(written(counted(docs, domain), "mix-counted"), share, epochs, seed, power, weights)
    # the documents' own columns stay in a struct, apart from those that are added here
    rows = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) > 0).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), domain.cast("string").alias("mix_domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_key().alias("mix_key"))
    return selected(rows, planned, seed).select(*(F.col("row")[c].alias(c) for c in docs.columns))
