"""The opN_ queries' SQL beside them, and the cases that every operator and stage defines: nulls, repeats, empty tables, clashing names."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from geoledger.llm import mixing, pii, quality, queries, token_files
from geoledger.storage import scratch

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, n long, mix_tokens int, place string"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    want = con.sql(queries.ORACLES[name])
    got = queries.queries()[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got.select(columns).collect(), key=key) == sorted((tuple(r) for r in want.select(*columns).fetchall()), key=key)


def odd(spark, n=30):
    texts = [None, "", " ", "same text for all of these rows", "same text for all of these rows", "word " * 20_000, "mail a.b@x.example.com and +1 (988) 555-2485", "|" * 5000]
    rows = [(i % 20 if i % 7 else None, texts[i % len(texts)], None if i % 5 == 0 else "en", None if i % 3 == 0 else "src1", 1, True, "x", 1, 2, "y") for i in range(n)]
    return spark.createDataFrame(rows + rows[:4], SCHEMA)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark)
    out = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns and out.schema == docs.schema
    rows = out.collect()
    kept = {r.doc_id for r in rows}
    assert kept <= {r.doc_id for r in docs.collect()}
    if name == "pii":
        assert len(rows) == docs.count() and any("[EMAIL]" in (r.text or "") for r in rows) and any(r.text is None for r in rows)
    if name == "near_dedup":  # rows with an id stand once, by group
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert len({(r.doc_id, r.text) for r in rows if r.doc_id is not None}) == len(ids)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_tables(spark):
    docs, labels = odd(spark).limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path = scratch(spark, "none")
    token_files.write_ids(docs, path)
    assert token_files.read_ids(spark, path).count() == 0
    assert quality.classify(docs, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == 0
    assert pii.mask(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_scores_are_sums_of_table_entries():
    """A plain sum: for each feature the entry of its bin, counted by hand, for each pair the entry of its cell."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.FEATURES))).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600)) > 0).astype(float)
    model = quality.fit(x, y, rounds=20)
    new = np.concatenate([rng.normal(size=(80, x.shape[1])).round(1), [[e[0] if len(e) else 0.0 for e in model.edges]]])
    place = lambda edges, v: sum(1 for e in edges if v >= e)
    for row, got in zip(new, model.scores(new), strict=True):
        total = model.intercept
        for v, edges, table in zip(row, model.edges, model.tables, strict=True):
            total += table[place(edges, v)]
        for (i, j), a, b, table in model.pairs:
            total += table[place(a, row[i]), place(b, row[j])]
        assert got == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
    assert len(model.pairs) == 6


def test_cyclic_steps_lower_the_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # seen by a pair alone
    loss = lambda m: -np.mean(np.log(np.where(y == 1, m.scores(x), 1 - m.scores(x))))
    losses = [loss(quality.fit(x, y, rounds=r)) for r in (3, 30, 150)]
    assert losses[0] > losses[1] > losses[2] and (1, 0) in [p[0] for p in quality.fit(x, y, rounds=30).pairs]


def test_query_scores_by_the_fitted_model(spark):
    """op7 against a second scoring of the same documents, row by row, from the model that the labelled rows outside the held-out part give."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sorted(((r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5), key=lambda r: (r[0], r[1]))
    model = quality.fit(np.array([quality.features(text[i]) for i, _ in rows]), np.array([q for _, q in rows], float))
    for r in queries.queries()["op7_quality"](spark, DATA).collect():
        score = model.scores(np.array([quality.features(text[r.doc_id])]))[0]
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
