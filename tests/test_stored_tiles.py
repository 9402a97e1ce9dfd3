"""Tiles that are stored once: shuffles that do not grow with their number, items over several files, several blends at once."""

import math

import numpy as np
import pytest
from tidewater.operators import blocks
from tidewater.operators import rankers as rk


@pytest.fixture
def many_files(monkeypatch):
    for name, n in (("USER_ROWS", 4), ("ITEM_ROWS", 3), ("TILE_USERS", 9), ("TILE_ITEMS", 5), ("PAIR_USERS", 6), ("PAIR_ITEMS", 5), ("TASKS_A_CORE", 0), ("TERMS_AT_ONCE", 2)):
        monkeypatch.setattr(blocks, name, n)


def parts(spark, seed=3, users=25, items=31):
    rng = np.random.default_rng(seed)
    p = [(u, f"t{t}", float(rng.integers(1, 5))) for u in range(users) for t in range(6) if rng.random() < 0.5]
    w = [(i, f"t{t}", float(rng.integers(1, 4))) for i in range(items) for t in range(8) if rng.random() < 0.4]
    rec = [(u, i, 1.0) for u in range(users + 3) for i in range(items) if rng.random() < 0.1]
    return (p, w, rec, spark.createDataFrame(p, "user_id long, term string, p double"), spark.createDataFrame(w, "doc_id long, term string, weight double"),
            spark.createDataFrame(rec, "user_id long, item_id long, seen double"), spark.createDataFrame([(u,) for u in range(users)], "user_id long"),
            spark.createDataFrame([(i,) for i in range(items)], "item_id long"))


@pytest.mark.parametrize("every_pair", [False, True])
def test_profiles_and_vectors_are_stored_and_not_copied_to_pairs_of_tiles(spark, many_files, every_pair):
    p, w, rec, prof, x, records, users, items = parts(spark)
    got = blocks.text_blocks(prof, x, items, users, records, blocks.unseen_kernel(), "user_id long, item_id long, score double", every_pair=every_pair)
    want = {(u, i): 0.0 for u in range(25) for i in range(31)}
    for u, t, a in p:
        for i, s, b in w:
            want[u, i] += a * b * (s == t)
    for u, i, _ in rec:
        want.pop((u, i), None)
    rows = [(r.user_id, r.item_id, r.score) for r in got.collect()]
    assert len(rows) == len(want) and all(math.isclose(want[u, i], s, abs_tol=1e-9) for u, i, s in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "pair" in plan and "terms" not in plan  # neither profiles nor vectors go to pairs of tiles


def test_best_over_files_of_a_task_keep_ties_in_order(spark, many_files):
    p, w, rec, prof, x, records, users, items = parts(spark, seed=4)
    got = blocks.text_blocks(prof, x, items, users, records.limit(0), blocks.best_unseen_kernel(4), "user_id long, item_id long, score double")
    score = {(u, i): 0.0 for u in range(25) for i in range(31)}
    for u, t, a in p:
        for i, s, b in w:
            score[u, i] += a * b * (s == t)
    found = {}
    for r in got.collect():
        found.setdefault(r.user_id, []).append((-r.score, r.item_id))
    for u in range(25):
        assert [i for _, i in sorted(found[u])[:4]] == [i for _, i in sorted((-score[u, i], i) for i in range(31))[:4]]


def test_items_are_stored_once_for_both_passes_and_all_blends(spark, many_files, monkeypatch):
    rng = np.random.default_rng(7)
    words = ["alpha beta", "beta gamma", "gamma delta", "delta alpha", "epsilon"]
    products = spark.createDataFrame([(i, f"p{i}", "cat", 1.0, words[i % 5] + f" w{i % 3}") for i in range(23)], "product_id long, product_name string, category string, price double, description string")
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(20) for i in range(23) if rng.random() < 0.3]
    scores = spark.createDataFrame(rows, "user_id long, item_id long, score double")
    popular = spark.createDataFrame([(1, 1), (2, 2)], "item_id long, pos int")
    keys, stored = [], blocks.stored
    monkeypatch.setattr(blocks, "stored", lambda rows, key, files: keys.append(key) or stored(rows, key, files))
    picks = rk.blended_picks(scores, products, 3, (0.0, 0.4, 0.8))
    assert keys == ["user_id", "item_id", "user_id"]  # one pass for the ranges, one for the picks of all blends
    for alpha in (0.0, 0.4, 0.8):
        got = rk.recommend_products(scores, products, popular, scores, 3, alpha, picks)
        want = rk.with_backfill(scores, rk.personal_top_k(rk.hybrid_scores(scores, products, alpha), 3), popular, 3)
        as_rows = lambda df, item: sorted((r.user_id, r["rank"], r[item], r.score, r.source) for r in df.collect())
        assert as_rows(got, "product_id") == as_rows(want, "item_id")
