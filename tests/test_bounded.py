"""Nearest items by bounds equal those of all pairs."""

import math
import random

import numpy as np
import pytest

from tidewater.operators import bounded
from tidewater.operators import similarity as sim

SCHEMA = "doc_id long, term string, weight double"


def catalog(n, terms, seed, common=True, copies=3):
    rng, rows = random.Random(seed), []
    for d in range(0, n, copies):
        v = {f"t{int(rng.paretovariate(0.6)) % terms}": rng.random() + 0.05 for _ in range(4)} | ({"common": 0.3} if common else {})
        norm = math.sqrt(sum(w * w for w in v.values()))
        rows += [((d + c) * 7 % (2 * n), t, w / norm) for c in range(rng.randint(1, copies)) for t, w in v.items()]
    return rows


def brute(rows, k):
    vec = {}
    for d, t, w in rows:
        vec.setdefault(d, {})[t] = w
    out = {}
    for d, v in vec.items():
        s = ((sum(w * u.get(t, 0.0) for t, w in v.items()), e) for e, u in vec.items() if e != d and not set(v).isdisjoint(u))
        out[d] = [(e, round(x, 6)) for x, e in sorted(s, key=lambda p: (-math.floor(p[0] * 1e9 + 0.5 + 1e-7), p[1]))[:k]]
    return out


@pytest.mark.parametrize("terms, common", [(40, True), (300, False)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, terms, common):
    for name, value in (("BLOCK", 16), ("TILE_ITEMS", 50), ("TILE_QUERIES", 60), ("GROUPS", 16), ("SLOTS", 64)):
        monkeypatch.setattr(bounded, name, value)
    rows = [*catalog(500, terms, terms, common), (10_001, "alone", 1.0)]
    got = {}
    for r in sim.content_neighbors(spark.createDataFrame([*rows, (None, "t1", 1.0)], SCHEMA), 6).collect():
        got.setdefault(r["item_i"], []).append((r["rank"], r["item_j"], round(r["sim"], 6)))
    want = brute(rows, 6)
    assert {d: [(e, x) for _, e, x in sorted(v)] for d, v in got.items()} == {d: v for d, v in want.items() if v}


def test_bounds_spare_most_groups(spark):
    rows = catalog(3000, 400, 9, common=True, copies=20)
    items = bounded.grouped(spark.createDataFrame(rows, SCHEMA)).cache()
    n = items.count()
    groups = items.groupBy("home").count().count()
    assert groups > 50
    floor = items.selectExpr("item_id", "terms", "w", "slots", "home", "cast(8e8 as long) AS floor")
    assert bounded.reach(floor, bounded.greatest_weights(items)).count() < 0.2 * n * groups


def test_best_keeps_ties_by_id():
    best = bounded.Best(np.full(1, -1), 3)
    best.add(np.array([0]), np.array([[0.5, 0.5, 0.0]]), np.array([8, 9, 10]))
    best.add(np.array([0]), np.array([[0.5 + 1e-13, 0.7, -1.0]]), np.array([1, 2, 3]))
    assert best.ids.tolist() == [[2, 1, 8]] and best.floor.tolist() == [500_000_000]


def test_no_items(spark):
    assert sim.content_neighbors(spark.createDataFrame([], SCHEMA), 3).count() == 0


def test_items_are_copied_by_the_queries_of_their_group(spark, monkeypatch):
    for name, value in (("TILE_ITEMS", 1000), ("TILE_QUERIES", 30), ("GROUPS", 64)):
        monkeypatch.setattr(bounded, name, value)
    items = bounded.grouped(spark.createDataFrame(catalog(1500, 400, 3, copies=10), SCHEMA)).cache()
    sizes = {r["home"]: r["count"] for r in items.groupBy("home").count().collect()}
    queries = items.selectExpr("item_id", "terms", "w", "home AS group", "0L AS floor")
    left, right = bounded.dealt(queries, items, sizes, sizes)
    assert left.count() == items.count()
    assert right.count() == sum(n * -(-n // 30) for n in sizes.values()) < 0.2 * items.count() * -(-items.count() // 30)
