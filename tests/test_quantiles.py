"""Exact quantiles without a group in one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators import summaries


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_quantiles_are_those_of_all_values(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=3000), "ties": rng.integers(0, 4, 2500).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), None: rng.exponential(size=701), "same": np.full(900, 7.0)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("odd", float("nan")), ("odd", None), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r.k: r.quantiles for r in summaries.exact_quantiles(df, ["k"], "v", at, accuracy=accuracy).collect()}
    assert got == {k: [pytest.approx(q, abs=1e-12) for q in np.quantile(v, at)] for k, v in groups.items()}
    whole = summaries.exact_quantiles(df, [], "v", at, accuracy=accuracy).collect()
    assert [pytest.approx(q) for q in np.quantile(np.concatenate(list(groups.values())), at)] == whole[0].quantiles and len(whole) == 1
    assert summaries.exact_quantiles(df.limit(0), ["k"], "v", at).count() == 0


def test_describe_and_distribution(spark):
    df = spark.createDataFrame([("a", 1.0, 4), ("a", 2.0, None), ("b", None, 6), (None, 9.0, 1), (None, 10.0, 2)], "k string, v double, w int")
    r = {x.name: x for x in summaries.describe(df, ["v", "w"]).collect()}
    assert (r["v"].n, r["v"].missing, r["v"].q25, r["v"].median, r["v"].q75, r["v"].most) == (4, 1, 1.75, 5.5, 9.25, 10.0) and r["w"].median == 3.0
    d = {x.k: (x["count"], x.median, x.status) for x in summaries.distribution(df, ["k"], "v", 2).collect()}
    assert d == {"a": (2, 1.5, "ok"), "b": (0, None, "no_data"), None: (2, 9.5, "ok")}
    assert [tuple(x) for x in summaries.distribution(df, [], "v").collect()] == [(4, 1.0, 10.0, 5.5, 5.5, "insufficient")]
    assert [x.status for x in summaries.distribution(df.filter(F.col("k") == "b"), [], "v").collect()] == ["no_data"]
    assert {x.name: (x.n, x.median) for x in summaries.describe(df.limit(0).withColumn("z", F.lit(1)), ["z"]).collect()} == {}
