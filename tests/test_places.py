"""Distances of point sets against all pairs, with few pairs at a time so that cells are halved many times."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from factweave.operators import places

SCHEMA = "p int, m long, x double, y double"


def sets(kind):
    rng = random.Random(7)
    if kind == "even":
        return [[(p, k * 10 + side, rng.uniform(0, 90), rng.uniform(0, 90)) for p in (1, 2) for k in range(60)] for side in (0, 1)]
    if kind == "clusters":  # both sides' points are crowded, far from the other side
        return [[(1, k * 10 + side, 1000 * side + rng.gauss(0, 1), rng.gauss(0, 1e-4)) for k in range(70)] for side in (0, 1)]
    lattice = lambda side: [(p, k * 10 + side, float(rng.randint(0, 6)), float(rng.randint(0, 3))) for p in (1, 2) for k in range(40)]
    odd = [(1, 901, None, 1.0), (1, 902, float("nan"), 1.0), (3, 903, 1.0, 1.0)]
    return [lattice(0) + odd + [(4, 904, 5.0, 5.0)] * 2, lattice(1) + [(1, 905, 2.0, None), (5, 906, 0.0, 0.0), (4, 907, 5.0, 5.0)]]


def all_pairs(left, right):
    good = lambda r: r[2] is not None and r[3] is not None and not math.isnan(r[2])
    return [(a[0], a[1], b[1], math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)) for a in left for b in right if a[0] == b[0] and good(a) and good(b)]


@pytest.mark.parametrize("kind, at_once", [("even", 200), ("clusters", 200), ("lattice", 1 << 16)])
def test_as_by_all_pairs(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(places, "ARRAY", 3)
    left, right = sets(kind)
    pairs = all_pairs(left, right)
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    best_a, best_b, n = {}, {}, Counter((p, i) for p, i, _, _ in pairs)
    for p, i, j, d in pairs:
        best_a[p, i], best_b[p, j] = min(d, best_a.get((p, i), math.inf)), min(d, best_b.get((p, j), math.inf))
    want = Counter((p, i, j, near, mate, near and mate, n[p, i] // left.count(next(r for r in left if r[:2] == (p, i)))) for p, i, j, d in pairs for near, mate in [(d <= best_a[p, i] + 1e-9, d <= best_b[p, j] + 1e-9)] if near or mate)
    got = places.nearest_partners(a, b, ["p"], "m", at_once=at_once)
    assert Counter((r.p, r.a, r.b, r.nearest_a, r.nearest_b, r.mutual, r.candidates_a) for r in got.collect()) == want
    edges = (1, 5, 25) if kind != "clusters" else (998, 1000, 1002)
    bands = Counter((p, next((k for k, e in enumerate((0, *edges)) if d <= e + 1e-9), 9)) for p, _, _, d in pairs)
    got = {(r.p, r.band): r.pairs for r in places.distance_bands(a, b, ["p"], ["p"], edges, at_once=at_once).collect()}
    names = {0: "0", 1: f"(0,{edges[0]}]", 2: f"({edges[0]},{edges[1]}]", 3: f"({edges[1]},{edges[2]}]", 9: f">{edges[2]}"}
    assert got == {(p, names[k]): m for (p, k), m in bands.items()}
    far = {p: (m, max(d for q, _, _, d in pairs if q == p), min(d for q, _, _, d in pairs if q == p)) for p, m in Counter(p for p, *_ in pairs).items()}
    assert {r.p: (r.pairs, r.farthest, r.closest) for r in places.distance_extremes(a, b, ["p"], at_once=at_once).collect()} == far


def test_nothing_in_common(spark):
    one, none = spark.createDataFrame([(1, 1, 0.0, 0.0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    for a, b in ((one, none), (none, one), (none, none), (one, spark.createDataFrame([(2, 1, 0.0, 0.0)], SCHEMA))):
        assert places.nearest_partners(a, b, ["p"], "m").count() == 0
        assert places.distance_bands(a, b, ["p"], [], (1.0,)).count() == 0 and places.distance_extremes(a, b, ["p"]).count() == 0


def test_a_large_bucket_is_narrowed(spark):
    rng = random.Random(1)
    a, b = (spark.createDataFrame([(1, k, rng.random(), rng.random()) for k in range(8_000)], SCHEMA) for _ in range(2))
    g = places.both_ways(a, b, ["p"])
    left = places.narrowed(g, places._nearest_cells(g.bucket), 1000)
    assert sum(size for _, _, size in left) < 2 * 8_000**2 / 20


def test_small_buckets_are_measured_in_rows_and_crowded_ones_by_cells(spark, monkeypatch):
    monkeypatch.setattr(places, "IN_ROW", 100)
    left, right = ([(p, k, float(k % 7), float(k // 7)) for p, n in ((1, 20), (2, 90)) for k in range(side, 2 * n, 2)] for side in (0, 1))
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    rows, large = places.in_rows(places._placed(a, b, ["p"]), ["p"], 1 << 16)
    assert [r.p for r in rows.collect()] == [1] and {r.p for r in large.select("p").distinct().collect()} == {2}
    plan = places.distance_extremes(a.filter("p = 1"), b.filter("p = 1"), ["p"])._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "_extremes(" in plan
    assert {r.p: r.pairs for r in places.distance_extremes(a, b, ["p"]).collect()} == {1: 400, 2: 8100}


def test_pair_classes_read_members_once(spark):
    from factweave.plans import set_versions

    plan = set_versions.d11_classes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bool_or" not in plan and "lineitem" not in plan
