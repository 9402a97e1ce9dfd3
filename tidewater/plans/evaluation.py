"""Evaluation queries: splits, relevance, ranking metrics, forecast metrics, model info."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import HYBRID_ALPHA, POPULAR_MATERIALS_N, TRAIN_FRACTION, r6
from tidewater.operators import evaluation as ev
from tidewater.operators import features as fe
from tidewater.operators import forecasting as fc
from tidewater.operators import rankers as rk
from tidewater.plans import customer as pc
from tidewater.plans import rankers as pr
from tidewater.functions import POPULAR_MATERIALS_N
from tidewater.plans.forecast import CYC_SQL, NEXT_SQL, RIDGE_SQL
from tidewater.plans.registry import query
from tidewater.plans.sqlblocks import hybrid_sql, topk_backfill_sql
from tidewater.plans.sqlviews import VIEW_SQL, with_views
from tidewater.session import cut_lineage
from tidewater.sources import views as V

C_ORDER = ["interaction_timestamp", "interaction_id"]
O_ORDER = ["interaction_timestamp", "user_id", "item_id", "interaction_type", "quantity", "category", "price"]
D_ORDER = O_ORDER


def _retarget(sql: str, view: str, order: list[str]) -> str:
    """Rewrite a view CTE so ``view`` becomes its train part; ``{view}_TEST`` holds the rest."""
    body = VIEW_SQL[view][1]
    orig = f"{view} AS ({body}\n)"
    assert orig in sql, view
    cut = f"CAST(floor({TRAIN_FRACTION} * _n) AS BIGINT)"
    new = (f"{view}_ALL AS ({body}\n),\n"
           f"{view}_SPLIT AS (SELECT *, row_number() OVER (ORDER BY {', '.join(order)}) AS _pos, count(*) OVER () AS _n FROM {view}_ALL),\n"
           f"{view} AS (SELECT * EXCLUDE (_pos, _n) FROM {view}_SPLIT WHERE _pos <= {cut}),\n"
           f"{view}_TEST AS (SELECT * EXCLUDE (_pos, _n) FROM {view}_SPLIT WHERE _pos > {cut})")
    return sql.replace(orig, new, 1)


@query("temporal_split", _retarget(with_views("C", "C_products"), "C", C_ORDER) + """
SELECT interaction_id, 'train' AS split FROM C UNION ALL SELECT interaction_id, 'test' AS split FROM C_TEST""")
def temporal_split(spark, sf):
    train, test = ev.temporal_split(V.customer_interactions(spark, sf), C_ORDER, TRAIN_FRACTION)
    return train.select("interaction_id", F.lit("train").alias("split")).unionByName(
        test.select("interaction_id", F.lit("test").alias("split")))


@query("hash_split", with_views("P") + """
SELECT user_id, movie_id, CASE WHEN CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || '|' || CAST(movie_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 80
       THEN 'train' ELSE 'test' END AS split FROM P""")
def hash_split(spark, sf):
    train, test = ev.hash_split(V.ratings(spark, sf), ["user_id", "movie_id"], 80)
    return train.select("user_id", "movie_id", F.lit("train").alias("split")).unionByName(
        test.select("user_id", "movie_id", F.lit("test").alias("split")))


CUST_TRAIN_SQL = _retarget(pc.CUSTOMER_FEATURES_SQL, "C", C_ORDER)
REL_C_SQL = """
REL AS (SELECT DISTINCT user_id, item_id FROM C_TEST WHERE interaction_type IN ('purchase', 'click')
        AND user_id IN (SELECT user_id FROM CF))
"""


def customer_split(spark, sf):
    c = V.customer_interactions(spark, sf)
    train, test = ev.temporal_split(c, C_ORDER, TRAIN_FRACTION)
    feats = cut_lineage(fe.customer_features(train, V.products(spark, sf)))
    rel = ev.relevance(test, ("purchase", "click")).join(feats.select("user_id").distinct(), "user_id", "left_semi")
    return feats, rel


@query("relevance_sets", CUST_TRAIN_SQL + ", " + REL_C_SQL + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, count(*) AS n_items FROM REL GROUP BY user_id""")
def relevance_sets(spark, sf):
    """Relevant test items per eligible user, as a sorted joined string."""
    _, rel = customer_split(spark, sf)
    return rel.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string").cast("long"))).cast("array<string>"), ",").alias("items"),
        F.count("*").alias("n_items"))


@query("eval_users_semi", CUST_TRAIN_SQL + """
SELECT DISTINCT user_id FROM C_TEST WHERE interaction_type IN ('purchase', 'click') AND user_id IN (SELECT user_id FROM CF)""")
def eval_users_semi(spark, sf):
    """Test users with purchase/click who exist in the training features (left semi)."""
    _, rel = customer_split(spark, sf)
    return rel.select("user_id").distinct()


def _metrics_sql(ks, prefix: str, with_ndcg: bool) -> str:
    rows = []
    for k in ks:
        rows.append(f"SELECT '{prefix}precision_at_{k}' AS metric, round(COALESCE(avg(hits / {k}.0), 0.0), 6) AS value FROM MK WHERE k = {k}")
        rows.append(f"SELECT '{prefix}recall_at_{k}' AS metric, round(COALESCE(avg(hits / n_rel), 0.0), 6) AS value FROM MK WHERE k = {k}")
        if with_ndcg:
            rows.append(f"SELECT '{prefix}ndcg_at_{k}' AS metric, round(COALESCE(avg(dcg / idcg), 0.0), 6) AS value FROM MK WHERE k = {k}")
    ks_sql = ", ".join(f"({k})" for k in ks)
    return f""",
RN AS (SELECT user_id, count(*) AS n_rel FROM REL GROUP BY 1),
H AS (SELECT r.user_id, r.rank FROM RECS r JOIN REL USING (user_id, item_id)),
MK AS (SELECT ks.k, rn.user_id, rn.n_rel,
              CAST(count(h.rank) FILTER (WHERE h.rank <= ks.k) AS DOUBLE) AS hits,
              COALESCE(sum(1.0 / log2(h.rank + 1)) FILTER (WHERE h.rank <= ks.k), 0.0) AS dcg,
              (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(rn.n_rel, ks.k) + 1) t(i)) AS idcg
       FROM (VALUES {ks_sql}) ks(k) CROSS JOIN RN rn LEFT JOIN H h ON h.user_id = rn.user_id
       GROUP BY ks.k, rn.user_id, rn.n_rel)
""" + "\nUNION ALL\n".join(rows)


def eval_products_sql(alpha: float) -> str:
    return (CUST_TRAIN_SQL + ", " + REL_C_SQL + """, R0 AS (SELECT user_id, item_id, weighted_score AS score FROM CF),
""" + hybrid_sql("R0", "C_products", alpha) + ", " + pr.POPF_SQL + ", "
            + topk_backfill_sql("(SELECT DISTINCT user_id FROM REL)", "POPF", 10) + _metrics_sql((5, 10), "", True))


def list_metrics(recs, rel):
    """V1-V3 at 5 and 10 of ranked lists (user_id, rank, item_id) against the relevant pairs ``rel``."""
    return ev.ranking_metrics(recs, rel, (5, 10)).select("metric", r6(F.col("value")).alias("value"))


def product_metrics(spark, sf, alpha: float):
    """V1-V3 of the feature-path hybrid ranker with this blend on the temporal split."""
    feats, rel = customer_split(spark, sf)
    scores = feats.select("user_id", "item_id", F.col("weighted_score").alias("score"))
    users = rel.select("user_id").distinct()
    recs = rk.recommend_products(scores, V.products(spark, sf), rk.popular_from_features(feats), users, 10, alpha)
    return list_metrics(recs.select("user_id", "rank", F.col("product_id").alias("item_id")), rel)


MODEL_COLUMNS = ("part", "user_id", "item_id", "rank", "score", "source", "alpha")


def product_models(spark, sf, alphas: tuple[float, ...], feats, users):
    """For each blend its model (``MODEL_COLUMNS``), fitted on ``feats``: the score of every pair, the popular list and the
    10 best products of each of ``users``. Text scores and ranges are made once for all blends."""
    products = V.products(spark, sf)
    scores, popular = feats.select("user_id", "item_id", F.col("weighted_score").alias("score")), cut_lineage(rk.popular_from_features(feats))
    picks = cut_lineage(rk.blended_picks(scores, products, 10, alphas))
    for alpha in alphas:
        recs = rk.recommend_products(scores, products, popular, users, 10, alpha, picks)
        model = recs.select(F.lit("list").alias("part"), "user_id", F.col("product_id").alias("item_id"), "rank", "score", "source")
        model = model.unionByName(scores.select(F.lit("score").alias("part"), "user_id", "item_id", "score"), allowMissingColumns=True)
        model = model.unionByName(popular.select(F.lit("popular").alias("part"), "item_id", F.col("pos").cast("long").alias("rank")), allowMissingColumns=True)
        yield model.withColumn("alpha", F.lit(float(alpha))).select(*MODEL_COLUMNS)


@query("eval_products", eval_products_sql(HYBRID_ALPHA))
def eval_products(spark, sf):
    """V1-V3 on the 85/15 temporal split: P/R/NDCG at 5 and 10 of the feature-path hybrid ranker."""
    return product_metrics(spark, sf, HYBRID_ALPHA)


OWN_TRAIN_SQL = _retarget(pr.R5_SQL, "O", O_ORDER)


@query("eval_materials", OWN_TRAIN_SQL.replace("OWN AS (SELECT DISTINCT user_id FROM OF)", "OWN AS (SELECT DISTINCT user_id FROM REL)").replace(
    "HELD AS (", """REL AS (SELECT DISTINCT user_id, item_id FROM O_TEST WHERE interaction_type IN ('purchase', 'reorder')
        AND user_id IN (SELECT user_id FROM OF)),
HELD AS (""", 1) + """, RECS AS (SELECT user_id, rank, item_id FROM RKM)""" + _metrics_sql((5,), "owner_", False))
def eval_materials(spark, sf):
    """V5: owner precision / recall at 5 of the feature-path material ranker on the temporal split."""
    o = V.owner_interactions(spark, sf)
    train, test = ev.temporal_split(o, O_ORDER, TRAIN_FRACTION)
    mats = V.materials(spark, sf)
    feats = fe.owner_features(train, mats, rows=V.lines(spark, sf))
    rel = ev.relevance(test, ("purchase", "reorder")).join(feats.select("user_id").distinct(), "user_id", "left_semi")
    recs = rk.recommend_materials(feats, mats, rel.select("user_id"), 5)
    m = ev.ranking_metrics(recs.select("user_id", "rank", F.col("material_id").alias("item_id")), rel, (5,), "owner_")
    return m.where(~F.col("metric").startswith("owner_ndcg")).select("metric", r6(F.col("value")).alias("value"))


OWNER_INFO_SQL = with_views("OK") + ", " + CYC_SQL


FORECAST_TEST_SQL = _retarget(with_views("D"), "D", D_ORDER) + ", " + RIDGE_SQL + ", " + NEXT_SQL + """,
TW AS (SELECT user_id, item_id, CAST(date_trunc('week', interaction_timestamp) AS DATE) AS week, sum(quantity) AS quantity
       FROM D_TEST WHERE interaction_type IN ('purchase', 'reorder') GROUP BY 1, 2, 3),
ERR AS (SELECT CAST(t.quantity AS DOUBLE) - n.forecast_qty AS e FROM TW t JOIN NW n USING (user_id, item_id))
SELECT 'demand_forecast_rmse' AS metric, round(sqrt(avg(e * e)), 6) AS value FROM ERR
UNION ALL SELECT 'demand_forecast_mae', round(avg(abs(e)), 6) FROM ERR"""


@query("eval_forecast", FORECAST_TEST_SQL)
def eval_forecast(spark, sf):
    """V4: RMSE / MAE of next-week forecasts on all test weeks of pairs seen in training."""
    d = V.demand_interactions(spark, sf)
    train, test = ev.temporal_split(d, D_ORDER, TRAIN_FRACTION)
    # sums by pair and week are all that the fit and the forecasts read of the training rows: made once (lineage-backed)
    past = cut_lineage(fc.pair_weeks(train, V.lines(spark, sf)))
    model = fc.fit_demand(train, past)
    weeks = ev.sampled_weeks(fc.weekly_demand(test))
    pred = fc.forecast_next_week(train, None, model, past)  # of every pair seen in training
    j = weeks.join(pred, ["user_id", "item_id"]).select(F.col("quantity").cast("double").alias("actual"),
                                                         F.col("forecast_qty").alias("predicted"))
    return ev.forecast_metrics(j).select("metric", r6(F.col("value")).alias("value"))


@query("model_info", pc.CUSTOMER_FEATURES_SQL + ", " + pr.POPF_SQL + """
SELECT count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM C_products) AS n_items,
       (SELECT count(*) FROM POPF) AS n_popular, count(*) AS n_pairs FROM CF""")
def model_info(spark, sf):
    """V8: counts of users / catalog items / popular items / scored pairs of the product model."""
    p = V.products(spark, sf)
    f = fe.customer_features(V.customer_interactions(spark, sf), p)
    pop = rk.popular_from_features(f)
    return f.agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n_pairs")).select(
        "n_users", p.agg(F.count("*")).scalar().alias("n_items"), pop.agg(F.count("*")).scalar().alias("n_popular"), "n_pairs")


@query("model_info_owner", OWNER_INFO_SQL + """
SELECT (SELECT count(DISTINCT item_id) FROM OK) AS trained_materials, (SELECT count(*) FROM CYC) AS reorder_cycles_tracked,
       (SELECT least(count(DISTINCT item_id), 20) FROM OK) AS popular_materials, count(DISTINCT user_id) AS n_owners FROM OK""")
def model_info_owner(spark, sf):
    """V8: counts of materials, tracked reorder cycles, popular materials and owners of the material model."""
    o = V.owner_interactions_k(spark, sf)
    cycles = fc.reorder_cycles(o).agg(F.count("*")).scalar()
    popular = o.groupBy("item_id").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "item_id").limit(POPULAR_MATERIALS_N)
    return o.agg(F.countDistinct("item_id").alias("trained_materials"), F.countDistinct("user_id").alias("n_owners")).select(
        "trained_materials", cycles.alias("reorder_cycles_tracked"),
        popular.agg(F.count("*")).scalar().alias("popular_materials"), "n_owners")
