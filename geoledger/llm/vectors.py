"""What the two searches share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: no null, empty or non-finite vectors, no null ids."""
    vector = F.col(column).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & good)


def each_length(vectors: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A search among the vectors of each length, as products of different lengths aren't defined: most tables have one."""
    lengths = sorted(r.n for r in vectors.select(F.size("vector").alias("n")).distinct().collect())
    if len(lengths) < 2:
        return search(vectors)
    return reduce(DataFrame.unionByName, [search(vectors.filter(F.size("vector") == n)) for n in lengths])


def best_rows(found: DataFrame, k: int, names: tuple[str, str, str] = ("query_id", "vec_id", "score")) -> DataFrame:
    """The k best of each query (highest score, then smaller vec_id), with rank from 1."""
    query, row, score = names
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(row))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query, "rank", row, score)
