"""Dense row numbers, and scoring that follows a manifest of digests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geoledger.operators import chunk_cache, ledger


def test_dense_ids_are_row_numbers(spark):
    rows = [((i * 37) % 101 if i % 3 else 5, (i * 7) % 11 or None, f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "a long, b long, t string").repartition(7)
    got = {r.t: r.n for r in ledger.dense_ids(df, ["a", "b", "t"], "n").collect()}
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert got == {r[2]: k + 1 for k, r in enumerate(order)}
    one = ledger.dense_ids(df.withColumn("same", F.lit(1)), ["same"], "n", start=0)
    assert sorted(r.n for r in one.collect()) == list(range(700)) and one.columns == ["a", "b", "t", "same", "n"]
    assert ledger.dense_ids(df.limit(0), ["a"]).count() == 0
    twice = ledger.dense_ids(df.select("b").union(df.select("b")), ["b"], "n")
    assert sorted(r.n for r in twice.collect()) == list(range(1, 1401)) and twice.filter("b IS NULL").agg(F.max("n")).first()[0] == twice.filter("b IS NULL").count()


def test_a_value_of_many_rows_is_dealt_to_several_tasks(spark):
    df = spark.range(40_000).select(F.lit(7).alias("same"), "id")
    out = ledger.dense_ids(df, ["same"], "n")
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 40_000, 40_000)


def scorer(calls):
    def predict(df):
        calls.append(sorted({r.tile for r in df.select("tile").distinct().collect()}, key=str))
        return df.select("tile", "x", (F.col("x") * 2).alias("value"))

    return predict


def test_only_changed_chunks_are_scored_again(spark, tmp_path):
    path, calls = str(tmp_path / "out"), []
    rows = [(t, float(i)) for t in ("a", "b", "c", None) for i in range(5)]
    frame = lambda r: spark.createDataFrame(r, "tile string, x double").repartition(3)
    run = lambda r, model="m1", **o: chunk_cache.score_changed(frame(r), "tile", scorer(calls), model, path, **o)
    values = lambda: sorted(((r.tile, r.x, r.value) for r in chunk_cache.result(spark, path).collect()), key=str)
    want = lambda r: sorted(((t, x, 2 * x) for t, x in r), key=str)
    assert chunk_cache.result(spark, path) is None
    assert run(rows) == {"scored": 4, "unchanged": 0, "gone": 0, "left": 0} and values() == want(rows)
    calls.clear()
    assert run(list(reversed(rows)))["unchanged"] == 4 and not calls  # another order is the same chunk
    changed = [(t, x + (t == "b" and x == 3.0)) for t, x in rows]
    assert run(changed) == {"scored": 1, "unchanged": 3, "gone": 0, "left": 0} and calls == [["b"]] and values() == want(changed)
    fewer = [r for r in changed if r[0] != "a"]
    assert run(fewer) == {"scored": 0, "unchanged": 3, "gone": 1, "left": 0} and values() == want(fewer)
    calls.clear()
    assert run(changed)["scored"] == 1 and calls == [["a"]] and values() == want(changed)  # it's back
    calls.clear()
    assert run(changed, "m2", lot=2)["scored"] == 4 and values() == want(changed)
    assert sorted(sum(calls, []), key=str) == ["a", "b", "c", None] or sorted(map(str, sum(calls, []))) == ["None", "a", "b", "c"]


def test_a_stopped_run_goes_on(spark, tmp_path):
    path, calls = str(tmp_path / "out"), []
    rows = [(f"t{t}", float(i)) for t in range(9) for i in range(3)]
    df = spark.createDataFrame(rows, "tile string, x double")
    asked = iter([False, True])
    first = chunk_cache.score_changed(df, "tile", scorer(calls), "m", path, lot=3, stop=lambda: next(asked))
    assert first["scored"] + first["left"] == 9 and first["left"] > 0 and chunk_cache.result(spark, path).select("tile").distinct().count() == first["scored"]

    def broken(part):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        chunk_cache.score_changed(df, "tile", broken, "m", path)
    # rows of a commit that didn't end aren't read
    df.withColumn("value", F.lit(-1.0)).withColumn("_chunk", F.col("tile")).write.parquet(f"{path}/data/9-9-lost")
    again = chunk_cache.score_changed(df, "tile", scorer(calls), "m", path, lot=3)
    assert again["unchanged"] == first["scored"] and again["left"] == 0
    assert sorted((r.tile, r.x, r.value) for r in chunk_cache.result(spark, path).collect()) == sorted((t, x, 2 * x) for t, x in rows)
    done = [c for call in calls for c in call]
    assert sorted(done) == sorted({t for t, _ in rows})  # each chunk once


def test_digests(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, "x")], "tile string, n int, t string")
    d = lambda f: {r.chunk: r.digest for r in chunk_cache.chunk_digests(f, "tile").collect()}
    assert d(df) == d(df.select("t", "tile", "n")) and d(df)["a"] != d(df.distinct())["a"] and d(df)["b"] == d(df.distinct())["b"]
    assert d(df.withColumn("t", F.lit("y")))["b"] != d(df)["b"]
    (tmp_path / "model" / "deep").mkdir(parents=True)
    (tmp_path / "model" / "deep" / "part").write_text("1")
    first = chunk_cache.model_digest(spark, str(tmp_path / "model"))
    (tmp_path / "model" / "deep" / "_SUCCESS").write_text("")
    assert chunk_cache.model_digest(spark, str(tmp_path / "model")) == first
    (tmp_path / "model" / "deep" / "part").write_text("2")
    assert chunk_cache.model_digest(spark, str(tmp_path / "model")) != first
