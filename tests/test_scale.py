"""Joins by real sizes, and pair scores that are made in blocks and never shuffled."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import blocks
from tidewater.operators import notebook as nb
from tidewater.operators import rankers as rk


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    counted = df.groupBy().count()
    counted.collect()
    return counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_large_catalog_in_a_small_file_is_not_broadcast(spark, tmp_path):
    from tidewater.sources import views as V
    part = spark.range(400_000).select(F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name"), F.lit("Brand#7").alias("p_brand"),
                                       F.lit("LARGE").alias("p_type"), F.lit(1).alias("p_size"), F.lit(9.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    line = spark.range(2_000_000).select(
        F.xxhash64("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 50).alias("l_suppkey"), F.pmod(F.xxhash64("id"), F.lit(400_000)).alias("l_partkey"),
        F.lit("R").alias("l_returnflag"), F.rand(1).alias("l_quantity"), F.to_timestamp_ntz(F.lit("2024-01-01")).alias("l_shipdate"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = V.owner_interactions(spark, str(tmp_path)).groupBy("category").agg(F.sum("price").alias("p"), F.sum("quantity"), F.max("user_id"), F.max("interaction_timestamp"))
    assert df.collect()[0].p == 18_000_000
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("USER_ROWS", 4), ("ITEM_ROWS", 3), ("PAIR_USERS", 6), ("PAIR_ITEMS", 5), ("TERMS_AT_ONCE", 2), ("DENSE", 0.3)):
        monkeypatch.setattr(blocks, name, n)


def data(spark):
    rng = np.random.default_rng(8)
    words = ["alpha beta", "beta gamma", "gamma delta", None, "epsilon", "zeta"]
    products = spark.createDataFrame([(None if i == 4 else i - (i == 9), f"p{i}", "cat" if i % 3 else "dog", 1.0, words[i % 6]) for i in range(14)],
                                     "product_id long, product_name string, category string, price double, description string")
    rows = [(None if u == 0 else u, None if i == 13 else i, None if (u + i) % 5 == 0 or u == 7 else float(rng.integers(-1, 5)))
            for u in range(12) for i in range(14) if rng.random() < 0.3]
    return spark.createDataFrame(rows, "user_id long, item_id long, score double"), products


def rows_of(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def joined_content(r, x):
    prof = r.join(x, r.item_id == x.doc_id).groupBy("user_id", "term").agg(F.sum(F.col("score") * F.col("weight")).alias("p"))
    return prof.join(x.select("doc_id", "term", "weight"), "term").groupBy("user_id", F.col("doc_id").alias("item_id")).agg(F.sum(F.col("p") * F.col("weight")).alias("cb"))


def test_content_scores_equal_the_join_and_shuffle_no_pair(spark, small_blocks):
    scores, products = data(spark)
    r, x = rk.catalog_scores(scores, products), rk.product_tfidf(products).select("doc_id", "term", "weight")
    got = rk.content_scores(r, x)
    want = rows_of(joined_content(r, x))
    assert rows_of(got) == want and any(w[2] is None for w in want) and any(w[0] is None for w in want)
    assert "FlatMapCoGroupsInPandas" in final_plan(got)


def test_hybrid_scores_and_unseen_equal_the_join(spark, small_blocks):
    scores, products = data(spark)
    r, x = rk.catalog_scores(scores, products), rk.product_tfidf(products).select("doc_id", "term", "weight")
    cf, cb, n = rk.cf_scores(r), joined_content(r, x), products.count()
    seen = r.where("score > 0").select("user_id", "item_id", F.lit(True).alias("seen"))
    want = rk._blend(cf, cb, F.lit(n), 0.4).join(seen, ["user_id", "item_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    got = rk.hybrid_scores(scores, products, 0.4)
    assert rows_of(got) == rows_of(want)
    assert "FlatMapCoGroupsInPandas" in final_plan(got)
    reached = cf.select("user_id", "item_id").union(cb.select("user_id", "item_id")).distinct().join(seen, ["user_id", "item_id"], "left_anti")
    got = rk.unseen_candidates(scores, products)
    assert rows_of(got) == rows_of(reached)
    assert "FlatMapCoGroupsInPandas" in final_plan(got)


def test_content_rating_scores_equal_the_join(spark, small_blocks):
    scores, products = data(spark)
    ratings = scores.select("user_id", F.col("item_id").alias("movie_id"), F.col("score").alias("rating"))
    x = rk.product_tfidf(products)
    n = ratings.groupBy("user_id").agg(F.count("*").alias("n_u"))
    s = joined_content(scores, x.select("doc_id", "term", "weight")).withColumnRenamed("item_id", "movie_id")
    want = s.join(n, "user_id").select("user_id", "movie_id", F.col("cb") / F.col("n_u")).join(ratings.select("user_id", "movie_id"), ["user_id", "movie_id"], "left_anti")
    got = nb.content_rating_scores(ratings, x)
    assert rows_of(got) == rows_of(want)
    assert "FlatMapCoGroupsInPandas" in final_plan(got)


def test_scores_by_products_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    p, w = np.where(rng.random((9, 6)) < 0.5, rng.random((9, 6)), 0), np.where(rng.random((7, 6)) < 0.5, rng.random((7, 6)), 0)
    part = lambda m: blocks.entries(np.nonzero(m)[1], np.nonzero(m)[0], m[np.nonzero(m)], 0, len(m), len(m))
    for dense in (0.0, 0.2, 2.0):
        monkeypatch.setattr(blocks, "DENSE", dense)
        assert np.allclose(blocks.products(part(p), part(w), 6), p @ w.T, atol=1e-12)
        assert (blocks.reached(part(p), part(w), 6)[0] == ((p > 0).astype(int) @ (w > 0).T.astype(int) > 0)).all()


def test_best_over_blocks_of_rising_ids_keeps_ties_in_order():
    rng = np.random.default_rng(5)
    score, k, top, got = rng.integers(0, 40, (6, 400)) / 40, 3, {}, {u: [] for u in range(6)}
    looked = []
    for at in range(0, 400, 50):
        r, c, s = blocks.best(score[:, at : at + 50], k, 9, top)
        looked.append(len(r))
        for u, i, v in zip(r, c, s):
            got[int(u)].append((-float(v), int(i) + at))
    for u in range(6):
        want = sorted((-v, i) for i, v in enumerate(score[u]))[:k]
        assert all(a[1] == b[1] and math.isclose(a[0], b[0]) for a, b in zip(sorted(got[u])[:k], want))
    assert sum(looked[1:]) < 7 * 6 * k  # later blocks return only what is better than before


def test_neighbour_scores_are_summed_where_they_are_made(spark):
    rows = [(u, i, float(1 + (u + i) % 3)) for u in range(20) for i in range(u % 7)]
    qty = spark.createDataFrame(rows, "user_id long, item_id long, qty double")
    sims = [(i, j, 1 / (1 + abs(i - j))) for i in range(7) for j in range(9)]
    got = rk.knn_cf_scores(qty, spark.createDataFrame(sims, "item_i long, item_j long, sim double"))
    want = {}
    for u, i, q in rows:
        for a, j, s in sims:
            if a == i != j:
                want[u, j] = want.get((u, j), 0) + s * q
    most = {u: max(v for (w, _), v in want.items() if w == u) for u, _ in want}
    assert {(r.user_id, r.item_id): round(r.cf, 9) for r in got.collect()} == {(u, j): round(v / most[u], 9) for (u, j), v in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(user_id" in plan  # none of pairs


def _weekly_rows():
    import datetime as dt
    import random

    rng, start, rows = random.Random(4), dt.datetime(2024, 1, 3), []
    for u, i in [(1, 1), (1, 2), (2, 1), (None, 1), (3, None)]:
        rows += [(u, i, rng.choice(["purchase", "reorder", "view", None]), rng.choice([1, 5, 9, None]), start + dt.timedelta(days=rng.choice([0, 3, 8, 15, 60, 90, 97]) + rng.randrange(7))) for _ in range(30)]
    return [*rows, (1, 1, "purchase", 4, None)]


def test_weekly_grid_equals_a_dense_one_and_is_not_shuffled(spark, monkeypatch):
    import datetime as dt

    from tidewater import session
    from tidewater.operators import forecasting as fc

    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    rows = _weekly_rows()
    df = spark.createDataFrame(rows, "user_id long, item_id long, interaction_type string, quantity int, interaction_timestamp timestamp")
    want = set()
    for u, i in {(r[0], r[1]) for r in rows}:
        known, active = u is not None and i is not None, {}
        for r in rows:
            if r[:2] == (u, i) and r[2] in ("purchase", "reorder") and r[4] is not None:
                week = r[4].date() - dt.timedelta(days=r[4].weekday())
                active[week] = active.get(week, 0) + ((r[3] or 0) if known else 0)
        week, seen = min(active), []
        while week <= max(active):
            seen.append(float(active.get(week, 0)))
            lags = [seen[-1 - k] if len(seen) > k else None for k in (1, 2, 3)]
            some = [x for x in lags if x is not None]
            want.add((u, i, week, seen[-1], *lags, round(sum(some) / len(some), 9) if some else None))
            week += dt.timedelta(days=7)
    for n in (None, len(rows)):
        got = fc.weekly_lags(df, n)
        assert {(*r[:7], None if r[7] is None else round(r[7], 9)) for r in got.collect()} == want
        assert got.count() == len(want)
    plan = fc.weekly_lags(df, len(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("Exchange")  # nothing is shuffled above the grid


def test_neighbour_table_of_many_rows_is_sent_in_slices(spark, monkeypatch):
    from tidewater.operators import rankers as rk

    rows = [(u, (u * 7 + j * j) % 23, 1.0 + j) for u in range(40) for j in range(6)]
    r = spark.createDataFrame(rows, "user_id long, item_id long, score double").groupBy("user_id", "item_id").sum("score").toDF("user_id", "item_id", "score")
    values = lambda: {(x["user_id"], x["item_id"]): round(x["cf"], 9) for x in rk.cf_scores(r).collect()}
    want = values()
    monkeypatch.setattr(rk, "BROADCAST_ROWS", 60)
    assert values() == want
    assert "BroadcastHashJoin" in rk.cf_scores(r)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rk, "SLICES", 1)
    assert values() == want
