"""The queries over whole tables, against brute force on a small fixture."""

from __future__ import annotations

import math
import random

import pytest

import __spark_entry__ as entry


def place(k):
    return -45800.0 + 10 * (k * 7919 % 6481), 105400.0 + 10 * (k * 6131 % 6581)


def least_of_parts(nodes, links):
    """node to the least node of its component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """600 orders, 1 to 9 lines each."""
    rng, path = random.Random(8), tmp_path_factory.mktemp("small")
    keys = rng.sample(range(1, 60000), 600)
    orders = [(k, rng.randint(1, 2000)) for k in keys]
    lines = [(k, rng.randint(1, 20), 1, i, float(rng.randint(1, 40)), 1000.0 * rng.randint(1, 60)) for k in keys for i in range(1, rng.randint(1, 9) + 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    return str(path), dict(orders), lines


def test_knn_hole_serves_every_hole(spark, small):
    path, orders, _ = small
    found = {r.hole_id: (r.nearest_ref_id, r.nearest_distance, r.n_within) for r in entry.queries()["knn_hole"](spark, path).collect()}
    want = {}
    for a in orders:
        near = sorted((d, b) for b in orders if b != a and (d := math.dist(place(a), place(b))) <= 1500)
        want[a] = (near[0][1], round(near[0][0], 6), len(near)) if near else (None, None, 0)
    assert found == want and any(n for _, _, n in want.values())


def test_connected_components_of_every_hole(spark, small):
    path, orders, _ = small
    found = {r.hole_id: r.location for r in entry.queries()["connected_components"](spark, path).collect()}
    links = [(a, b) for a in orders for b in orders if a < b and math.dist(place(a), place(b)) <= 600]
    assert links and found == least_of_parts(orders, links)


def test_spatial_block_folds_of_every_hole(spark, small):
    path, orders, _ = small
    rows = entry.queries()["spatial_block_folds"](spark, path).collect()
    block = {k: ":".join(str(math.floor(v / 10000)) for v in place(k)) for k in orders}
    of_owner = {}
    for k, owner in orders.items():
        of_owner.setdefault(owner, []).append(block[k])
    group = least_of_parts(set(block.values()), [(b[0], x) for b in of_owner.values() for x in b[1:]])
    assert {r.hole_id: (r.owner, r.block, r.spatial_group) for r in rows} == {k: (orders[k], block[k], group[block[k]]) for k in orders}
    assert len({(r.spatial_group, r.fold) for r in rows}) == len(set(group.values())) and len(rows) == len(orders)


def test_interval_match_of_every_hole(spark, small):
    path, orders, lines = small
    found = {r.sample_id: (r.n_match_method, r.spt_count, r.n_measured) for r in entry.queries()["interval_match"](spark, path).collect()}
    want = {}
    for k in orders:
        top, bottom = k % 30, k % 30 - 1 if k % 11 == 0 else k % 30 + 4
        low, high = (top, bottom) if k % 5 else (top + 2, top + 2)
        values = [n / 1000 for h, _, _, _, q, n in lines if h == k and low <= q - 1 <= high]
        if k % 7 == 0:  # 5 m off its hole, and no other hole is there
            want[k] = ("no_matching_hole", 0, None)
        elif k % 5 and bottom < top:
            want[k] = ("invalid_sample_interval", 0, None)
        else:
            want[k] = (("interval_mean" if k % 5 else "exact_depth_mean") if values else "no_spt_in_interval", len(values), round(sum(values) / len(values), 6) if values else None)
    assert found == want


def test_wide_to_long_keeps_every_measurement(spark, small):
    path, _, lines = small
    rows = entry.queries()["wide_to_long"](spark, path).collect()
    want = {(k, i): (q - 1, n / 1000) for k, _, _, i, q, n in lines}
    most = max(i for _, i in want)
    assert most == 9 and {(r.hole_id, r.measurement_no): (r.depth, r.n_value) for r in rows} == {(k, i): want.get((k, i), (None, None)) for k, _ in want for i in range(1, most + 1)}


def test_thickness_pivot_has_every_horizon(spark, small):
    path, _, lines = small
    spark.createDataFrame([(i, f"type {i % 3}") for i in range(1, 21)], "p_partkey long, p_type string").write.mode("overwrite").parquet(f"{path}/part.parquet")
    rows = entry.queries()["thickness_pivot"](spark, path).collect()
    want = {f"type {t}": {f"h{i}": float(sum(q for _, p, _, j, q, _ in lines if j == i and p % 3 == t)) for i in range(1, 10)} for t in range(3)}
    assert {r.p_type: {c: r[c] for c in r.asDict() if c != "p_type"} for r in rows} == want


def test_reshapes_of_empty_tables(spark, small, tmp_path):
    spark.read.parquet(f"{small[0]}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert entry.queries()["wide_to_long"](spark, str(tmp_path)).count() == 0
    assert entry.queries()["thickness_pivot"](spark, str(tmp_path)).count() == 0
