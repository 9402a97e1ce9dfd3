"""Hand-made frames for the operators: ties, nulls, unknown types, defaults, identities."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import evaluation as ev
from tidewater.operators import features as fe
from tidewater.operators import forecasting as fc
from tidewater.operators import rankers as rk
from tidewater.operators import validation as va

SCHEMA = ("interaction_id long, user_type string, user_id long, item_id long, item_type string, "
          "interaction_type string, category string, quantity int, price double, interaction_timestamp timestamp_ntz")


def ev_frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def t(d, h=0, m=0):
    return dt.datetime(2024, 1, d, h, m)


def test_interaction_weights_case_space_unknown_null(spark):
    rows = [(i, "customer", 1, 1, "product", ty, "A", 1, 1.0, t(1)) for i, ty in
            enumerate([" Purchase ", "VIEW", "add_to_cart", "mystery", None])]
    got = [r.interaction_weight for r in fe.with_interaction_weight(ev_frame(spark, rows)).orderBy("interaction_id").collect()]
    assert got == [5.0, 1.0, 3.0, 1.0, 1.0]


def test_raw_weight_is_case_sensitive(spark):
    rows = [(1, "c", 1, 1, "p", "purchase", "A", 1, 1.0, t(1)), (2, "c", 1, 1, "p", "Purchase", "A", 1, 1.0, t(1))]
    got = fe.raw_user_item_scores(ev_frame(spark, rows)).first()
    assert got.score == 5.0


def test_recency_decay_against_dataset_max(spark):
    rows = [(1, "c", 1, 1, "p", "view", "A", 1, 1.0, t(1)), (2, "c", 1, 1, "p", "view", "A", 1, 1.0, t(11))]
    d = {r.interaction_id: r.decay_weight for r in fe.with_recency_decay(ev_frame(spark, rows), 0.005).collect()}
    assert d[2] == 1.0 and math.isclose(d[1], math.exp(-0.05), rel_tol=1e-12)


def test_interval_days_telescopes_and_defaults(spark):
    rows = [(1, "o", 1, 1, "m", "purchase", "A", 1, 1.0, t(1)), (2, "o", 1, 2, "m", "view", "A", 1, 1.0, t(2)),
            (3, "o", 1, 1, "m", "reorder", "A", 1, 1.0, t(11)), (4, "o", 2, 1, "m", "purchase", "A", 1, 1.0, t(5))]
    got = {r.user_id: r.avg_procurement_interval_days for r in fe.owner_interval_days(ev_frame(spark, rows)).collect()}
    assert got == {1: 5.0, 2: 30.0}


def test_reorder_cycles_clamp_and_single(spark):
    rows = [(1, "o", 1, 1, "m", "purchase", "A", 1, 1.0, t(1)), (2, "o", 1, 1, "m", "reorder", "A", 1, 1.0, t(2)),
            (3, "o", 1, 2, "m", "purchase", "A", 1, 1.0, t(3)),
            (4, "o", 2, 1, "m", "purchase", "A", 1, 1.0, dt.datetime(2023, 1, 1)),
            (5, "o", 2, 1, "m", "purchase", "A", 1, 1.0, dt.datetime(2023, 8, 1))]
    got = {(r.user_id, r.item_id): r.cycle_days for r in fc.reorder_cycles(ev_frame(spark, rows)).collect()}
    assert got == {(1, 1): 3.0, (1, 2): 21.0, (2, 1): 90.0}


def test_top_categories_ties_and_missing(spark):
    rows = [(1, "c", 1, 1, "p", "view", "B", 1, 1.0, t(1)), (2, "c", 1, 2, "p", "view", "A", 1, 1.0, t(1)),
            (3, "c", 2, 1, "p", "click", "C", 1, 1.0, t(1))]
    s = fe.customer_event_scores(ev_frame(spark, rows))
    got = {r.user_id: (r.favorite_category_1, r.favorite_category_2, r.favorite_category_3)
           for r in fe.top_categories(s, 3, "favorite_category").collect()}
    assert got == {1: ("A", "B", None), 2: ("C", None, None)}


def test_profile_identities_match_dense_numpy(spark):
    """Identity A/B: CF and content scores from joins equal the dense matrix formulas."""
    rng = np.random.default_rng(7)
    n_u, n_i = 20, 15
    r = np.where(rng.random((n_u, n_i)) < 0.3, rng.integers(1, 6, (n_u, n_i)), 0).astype(float)
    cat = ["alpha beta", "beta gamma", "gamma delta", "delta alpha", "epsilon"]
    products = spark.createDataFrame([(i, f"p{i}", "cat", 1.0, cat[i % 5] + f" w{i % 3}") for i in range(n_i)], rk_products_schema())
    scores = spark.createDataFrame([(u, i, float(r[u, i])) for u in range(n_u) for i in range(n_i) if r[u, i] > 0],
                                   "user_id long, item_id long, score double")
    cf = {(x.user_id, x.item_id): x.cf for x in rk.cf_scores(rk.catalog_scores(scores, products)).collect()}
    col = r / np.where(np.linalg.norm(r, axis=0) == 0, 1, np.linalg.norm(r, axis=0))
    s = col.T @ col
    den = np.abs(s).sum(axis=1)
    den = np.where(den == 0, 1.0, den)
    dense = (r @ s) / den
    for (u, i), v in cf.items():
        assert math.isclose(v, dense[u, i], rel_tol=1e-9, abs_tol=1e-12)
    x = rk.product_tfidf(products).toPandas()
    xm = np.zeros((n_i, x.term.nunique()))
    terms = {tt: j for j, tt in enumerate(sorted(x.term.unique()))}
    for row in x.itertuples():
        xm[row.doc_id, terms[row.term]] = row.weight
    cb_dense = r @ (xm @ xm.T)
    cb = rk.content_scores(rk.catalog_scores(scores, products), rk.product_tfidf(products)).collect()
    for row in cb:
        assert math.isclose(row.cb, cb_dense[row.user_id, row.item_id], rel_tol=1e-9, abs_tol=1e-12)


def rk_products_schema():
    return "product_id long, product_name string, category string, price double, description string"


def test_validators_raise_on_injected_faults(spark):
    good = spark.createDataFrame([(1, 1, 1.0, 0.5)], "user_id long, item_id long, weighted_score double, recency_days double")
    assert va.assert_valid(good, "customer")
    bad = spark.createDataFrame([(1, 1, 1.0, 0.5), (1, 1, -1.0, 0.5), (-1, None, 1.0, -2.0)],
                                "user_id long, item_id long, weighted_score double, recency_days double")
    with pytest.raises(va.FeatureValidationError):
        va.assert_valid(bad, "customer")
    row = va.validation_counts(bad, "customer").first()
    assert (row.duplicate_pairs, row.negative_ids, row.negative_scores, row.null_item_ids, row.negative_recency) == (1, 1, 1, 1, 1)
    with pytest.raises(va.FeatureValidationError):
        va.validation_counts(good.drop("recency_days"), "customer")


def test_temporal_split_positions(spark):
    rows = [(i, "c", 1, 1, "p", "view", "A", 1, 1.0, t(1 + i % 3)) for i in range(20)]
    df = ev_frame(spark, rows)
    train, test = ev.temporal_split(df, ["interaction_timestamp", "interaction_id"], 0.85)
    tr = sorted(r.interaction_id for r in train.collect())
    expect = sorted(rows, key=lambda r: (r[9], r[0]))[:17]
    assert tr == sorted(r[0] for r in expect) and test.count() == 3


def test_ranking_metrics_hand_case(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20)], "user_id long, rank long, item_id long")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 21), (3, 30)], "user_id long, item_id long")
    m = {r.metric: r.value for r in ev.ranking_metrics(recs, rel, (5,)).collect()}
    assert math.isclose(m["precision_at_5"], (1 / 5) / 3)
    assert math.isclose(m["recall_at_5"], (1 / 2) / 3)
    idcg = 1 + 1 / math.log2(3)
    assert math.isclose(m["ndcg_at_5"], ((1 / math.log2(3)) / idcg) / 3)


def test_backfill_and_cold_start(spark):
    personal = spark.createDataFrame([(1, 5, 0.9, 1)], "user_id long, item_id long, score double, rank int")
    popular = spark.createDataFrame([(5, 1), (6, 2), (7, 3)], "item_id long, pos int")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {(r.user_id, r.rank): (r.item_id, r.source) for r in rk.with_backfill(users, personal, popular, 2).collect()}
    assert got == {(1, 1): (5, "personal"), (1, 2): (6, "popular"), (2, 1): (5, "popular"), (2, 2): (6, "popular")}


def test_ridge_solution_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((40, 6)) * 10
    y = x @ np.array([1.5, -2.0, 0.5, 0.0, 1.0, 3.0]) + 4 + rng.random(40)
    from tidewater.functions import FORECAST_FEATURES as feats
    df = spark.createDataFrame([tuple(map(float, r)) + (float(v),) for r, v in zip(x, y)],
                               ", ".join(f"{f} double" for f in feats) + ", quantity double")
    b0, coef = fc.solve_ridge(fc.ridge_moments(df).first().asDict())
    xc, yc = x - x.mean(0), y - y.mean()
    ref = np.linalg.solve(xc.T @ xc + np.eye(6), xc.T @ yc)
    assert np.allclose(coef, ref) and math.isclose(b0, y.mean() - x.mean(0) @ ref, rel_tol=1e-9)


def test_feature_store_versions_numeric_order(spark, tmp_path):
    from tidewater.sources.store import FeatureStore
    st = FeatureStore(spark, str(tmp_path))
    df = spark.range(3)
    for _ in range(10):
        st.save(df, "f")
    spark.range(1).write.parquet(str(tmp_path / "f" / "version=junk"))
    assert st.list_versions("f") == list(range(1, 11)) and st.latest_version("f") == 10
    with pytest.raises(FileNotFoundError):
        st.load("missing")


def test_svd_scores_match_numpy_truncated_svd(spark):
    from tidewater.operators import notebook as nb
    rng = np.random.default_rng(3)
    r = np.where(rng.random((30, 12)) < 0.5, rng.integers(1, 6, (30, 12)), 0).astype(float)
    df = spark.createDataFrame([(u, i, float(r[u, i])) for u in range(30) for i in range(12) if r[u, i] > 0],
                               "user_id long, movie_id long, rating double")
    k = 4
    got = {(x.user_id, x.movie_id): x.cf for x in nb.svd_scores(df, k).collect()}
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    rk_ = (u[:, :k] * s[:k]) @ vt[:k]
    assert got and all(math.isclose(v, rk_[a, b], abs_tol=1e-9) for (a, b), v in got.items())
    assert set(got) == {(a, b) for a in range(30) for b in range(12) if r[a, b] == 0}  # all unrated items are scored


def test_tiles_are_few_and_never_below_a_block():
    from tidewater.operators import blocks as b
    assert b.tiles(0, 0, 0, 8) == (1, 1)
    assert b.tiles(1500, 20_000, 10**5, 8) == (2, 3)  # blocks at most: too few for the cores anyway
    nu, ni = b.tiles(10**8, 10**6, 10**9, 4000)
    assert (nu, ni) == (-(-10**8 // b.TILE_USERS), -(-10**6 // b.TILE_ITEMS))  # 16 and 8 times fewer copies than blocks
    nu, ni = b.tiles(10**6, 10**6, 10**11, 100)
    assert nu * ni >= 10**11 / b.TILE_RECORDS
    nu, ni = b.tiles(40_000, 200_000, 10**6, 64)
    assert nu * ni >= 2 * 64 and nu <= 40 and ni <= 25


@pytest.mark.parametrize("tile_users, tile_items, records", [(7, 4, 10**9), (20, 9, 10**9), (10**6, 10**6, 10**9), (10**6, 10**6, 3)])
def test_blocked_picks_match_join_formulation(spark, monkeypatch, tile_users, tile_items, records):
    from tidewater.operators import blocks
    monkeypatch.setattr(blocks, "TILE_USERS", tile_users)  # pairs of tiles of one block, of several, one pair in all
    monkeypatch.setattr(blocks, "TILE_ITEMS", tile_items)
    monkeypatch.setattr(blocks, "TILE_RECORDS", records)
    monkeypatch.setattr(blocks, "TASKS_A_CORE", 0)
    monkeypatch.setattr(blocks, "USER_ROWS", 7)
    monkeypatch.setattr(blocks, "ITEM_ROWS", 4)  # several blocks of each
    rng = np.random.default_rng(11)
    cat = ["alpha beta", "beta gamma", "gamma delta", "delta alpha", "epsilon"]
    products = spark.createDataFrame([(i, f"p{i}", "cat", 1.0, cat[i % 5] + f" w{i % 3}") for i in range(15)], rk_products_schema())
    rows = [(u, i, (None if (u + i) % 11 == 0 else float(rng.integers(1, 6)))) for u in range(25) for i in range(15)
            if rng.random() < 0.3]
    scores = spark.createDataFrame(rows, "user_id long, item_id long, score double")
    a = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in rk.personal_picks(scores, products, 5).collect()}
    b = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in rk.personal_top_k(rk.hybrid_scores(scores, products), 5).collect()}
    assert a and a == b


def test_free_positions_are_the_first_gaps(spark):
    rng = np.random.default_rng(4)
    n, k = 40, 5
    taken = {u: set(map(int, rng.choice(np.arange(1, n + 1), m, replace=False))) for u, m in enumerate((0, 3, 30, 37, 40))}
    t_ = spark.createDataFrame([(u, p) for u, ps in taken.items() for p in ps], "user_id long, pos int")
    owners = spark.createDataFrame([(u,) for u in taken], "user_id long")
    got = {u: [] for u in taken}
    for r in rk.free_positions(t_, owners, F.lit(n), k).collect():
        got[r.user_id].append(r.pos)
    assert {u: sorted(v) for u, v in got.items()} == {u: [p for p in range(1, n + 1) if p not in ps][:k] for u, ps in taken.items()}


def test_rank_materials_equals_full_grid(spark):
    rng = np.random.default_rng(6)
    items, k = range(30), 6
    default = {i: float(rng.integers(0, 4)) / 4 for i in items}
    cand = {(u, i): float(rng.integers(0, 5)) / 4 for u in range(6) for i in items if u and rng.random() < u / 5}
    c = spark.createDataFrame([(u, i, v) for (u, i), v in cand.items()], "user_id long, item_id long, score double")
    d = spark.createDataFrame(list(default.items()), "item_id long, score double")
    o = spark.createDataFrame([(u,) for u in range(6)], "user_id long")
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in rk.rank_materials(c, d, o, k).collect()}
    for u in range(6):
        full = sorted(((-cand.get((u, i), default[i]), i) for i in items))[:k]
        assert [got[u, n + 1] for n in range(k)] == [(i, -s_) for s_, i in full]


def test_older_rankers_serve_users_without_history(spark):
    products = spark.createDataFrame([(i, f"p{i}", "A" if i < 3 else "B", "s", 1.0) for i in range(6)], "product_id long, name string, category string, subcategory string, price double")
    customers = spark.createDataFrame([(1, "A"), (2, "B")], "customer_id long, preferred_category string")
    qty = spark.createDataFrame([(1, 0, 2.0), (9, 0, 1.0)], "user_id long, item_id long, qty double")
    near = spark.createDataFrame([(0, 5, 0.5), (0, 0, 1.0)], "item_i long, item_j long, sim double")
    got = {}
    for r in rk.recommend_products_knn(qty, near, customers, products, qty.select("user_id"), 3).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.product_id, round(r.score, 9)))
    assert got[2] == [(3, 0.3), (4, 0.3), (5, 0.3)]  # no transactions: content alone
    assert got[1] == [(5, 0.79), (0, 0.3), (1, 0.3)]
    assert got[9] == [(5, 0.7)]  # no profile: collaborative part alone
    mats = spark.createDataFrame([(i, f"m{i}", "X", 2.0, "d") for i in range(4)], "material_id long, material_name string, category string, price double, description string")
    bought = spark.createDataFrame([(1, 0, 5, t(1), 1, 1, 1), (1, 1, 5, t(2), 1, 2, 1), (3, 1, 5, t(2), 2, 1, 1)], "owner_id long, material_id long, quantity int, date timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long")
    owners = spark.createDataFrame([(1, "I"), (2, "I"), (3, "J")], "owner_id long, industry string")
    rules = spark.createDataFrame([("I", "X")], "industry string, category string")
    co = spark.createDataFrame([(0, 2, 0.5), (1, 0, 0.4)], "item_i long, item_j long, sim double")
    rows = rk.recommend_materials_copurchase(bought, mats, owners, rules, co, 2).orderBy("user_id", "rank").collect()
    assert {r.user_id for r in rows} == {1, 2, 3}
    assert [(r.material_id, r.score, r.reason) for r in rows if r.user_id == 2] == [(1, 1.0, "Popular material"), (0, 1.0, "Popular material")]


def test_layout_violations_raise(spark):
    from tidewater.sources import sinks
    good = spark.createDataFrame([(1, "a", "d", 2.0, "A")], "material_id long, material_name string, description string, price double, category string")
    layout = sinks.materials_layout(good, F.current_timestamp())
    check = lambda df: sinks.assert_layout(sinks.validate_layout(df, sinks.MATERIAL_REQUIRED, sinks.MATERIAL_TYPES))
    assert check(layout).first().row_count == 1
    for bad in (layout.withColumn("Name", F.lit(None).cast("string")), layout.withColumn("IsAvailable", F.lit(1)), layout.drop("Unit")):
        with pytest.raises(ValueError):
            check(bad)


def test_gate_promotes_only_what_is_at_least_as_good():
    assert ev.should_promote(0.1) and ev.should_promote(0.1, 0.1)
    assert not ev.should_promote(0.1, 0.2) and not ev.should_promote(float("nan"))


def test_sparse_moments_equal_dense_grid(spark):
    rows = []
    i = 0
    for u, item, weeks in ((1, 1, [0, 1, 5, 9, 30]), (1, 2, [2]), (2, 1, [0, 3, 4, 12])):
        for w in weeks:
            i += 1
            rows.append((i, "o", u, item, "m", "purchase" if w % 2 else "reorder", "A", 3 + w, 1.0,
                         dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * w, hours=w)))
    rows.append((999, "o", 2, 1, "m", "view", "A", 50, 1.0, dt.datetime(2024, 2, 1)))
    df = ev_frame(spark, rows)
    a = fc.ridge_moments(fc.training_set(df)).first().asDict()
    b = fc.sparse_training_moments(df).first().asDict()
    assert a.keys() == b.keys() and all(math.isclose(a[k] or 0, b[k] or 0, rel_tol=1e-12, abs_tol=1e-9) for k in a)
