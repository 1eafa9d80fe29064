"""Recall of the approximate search at the parameters that it runs with."""

from __future__ import annotations

import numpy as np

import pytest

from geoledger.llm import ann_search


def recall_of(x, found, every, k=20):
    score = x[::every] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), every)] = -np.inf
    best = np.argsort(-score, 1, kind="stable")[:, :k]
    return np.mean([len(found[every * q] & set(b.tolist())) / k for q, b in enumerate(best)])


@pytest.mark.parametrize(("most_parts", "levels"), [(64, 1), (12, 2)])
def test_ann_prunes_clustered_vectors(spark, most_parts, levels):
    """20,480 vectors in clusters, by one classifier and by two levels of them: recall, and the share of rows that queries scan."""
    rng, n = np.random.default_rng(11), 20_480
    x = rng.normal(size=(160, 32))[rng.integers(0, 160, n)] + 0.5 * rng.normal(size=(n, 32))
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in ann_search.search(df, 80, 20, part_rows=512, most_parts=most_parts, probed=0.95).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(range(0, n, 80)) and recall_of(x, found, 80) >= 0.9
    vectors = ann_search.finite_vectors(df)
    router = ann_search.learn(vectors, n, 512, most_parts)
    assert (len(router.below) > 0) == (levels == 2) and router.parts > most_parts / 2
    home = np.bincount(router.home(x), minlength=router.parts)
    assert np.mean([home[p].sum() for p in router.probes(x[::80], 0.95)]) < 0.25 * n


def test_ann_recall_with_its_own_parameters(spark):
    assert ann_search.PROBED >= 0.98
    rng, n = np.random.default_rng(7), 6000
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + 0.9 * rng.normal(size=(n, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found = {}
    for r in ann_search.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>"), 20, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert n >= 2 * ann_search.PART_ROWS and set(found) == set(range(0, n, 20))
    score = x[::20].astype(float) @ x.T.astype(float)
    score[np.arange(len(score)), np.arange(0, n, 20)] = -np.inf
    best = np.argsort(-score, 1, kind="stable")[:, :20]
    assert np.mean([len(found[20 * q] & set(b.tolist())) / 20 for q, b in enumerate(best)]) >= 0.95
