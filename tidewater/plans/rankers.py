"""Ranker queries: hybrid products (feature and raw paths), cold start, popularity, material rankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import HYBRID_ALPHA, POPULAR_PRODUCTS_N, r6
from tidewater.operators import features as fe
from tidewater.operators import rankers as rk
from tidewater.plans.customer import CUSTOMER_FEATURES_SQL
from tidewater.plans.registry import query
from tidewater.plans.sqlblocks import hybrid_sql, topk_backfill_sql
from tidewater.plans.sqlviews import raw_weight_sql, with_views
from tidewater.session import cut_lineage
from tidewater.sources import views as V
from tidewater.sources.tables import read_table

K = 5


def _features(spark, sf, keep: bool = False):
    f = fe.customer_features(V.customer_interactions(spark, sf), V.products(spark, sf))
    # the ranker reads the frame three times (scores, popular list, users); keep one copy
    return cut_lineage(f) if keep else f


def _feature_scores(spark, sf):
    return _features(spark, sf).select("user_id", "item_id", F.col("weighted_score").alias("score"))


FEAT_HY = CUSTOMER_FEATURES_SQL + """, R0 AS (SELECT user_id, item_id, weighted_score AS score FROM CF),
""" + hybrid_sql("R0", "C_products", HYBRID_ALPHA)

POPF_SQL = f"""
POPF AS (SELECT item_id, row_number() OVER (ORDER BY max(item_interaction_count) DESC, item_id) AS pos
         FROM CF GROUP BY item_id QUALIFY pos <= {POPULAR_PRODUCTS_N})
"""


@query("cf_scores", FEAT_HY + "SELECT user_id, item_id, round(cf, 6) AS cf FROM CFS")
def cf_scores(spark, sf):
    r = cut_lineage(rk.catalog_scores(_feature_scores(spark, sf), V.products(spark, sf)))  # read for the cosines and the sums
    return rk.cf_scores(r, 4 * r.count()).select("user_id", "item_id", r6(F.col("cf")).alias("cf"))


@query("content_scores", FEAT_HY + "SELECT user_id, item_id, round(cb, 6) AS cb FROM CBS")
def content_scores(spark, sf):
    p = V.products(spark, sf)
    r = rk.catalog_scores(_feature_scores(spark, sf), p)
    return rk.content_scores(r, rk.product_tfidf(p)).select("user_id", "item_id", r6(F.col("cb")).alias("cb"))


@query("hybrid_scores", FEAT_HY + """
SELECT user_id, item_id, round(cf, 6) AS cf, round(cb, 6) AS cb, round(hybrid, 6) AS hybrid, seen FROM HY""")
def hybrid_scores(spark, sf):
    h = rk.hybrid_scores(_feature_scores(spark, sf), V.products(spark, sf))
    return h.select("user_id", "item_id", r6(F.col("cf")).alias("cf"), r6(F.col("cb")).alias("cb"),
                    r6(F.col("hybrid")).alias("hybrid"), "seen")


@query("unseen_candidates", FEAT_HY + "SELECT user_id, item_id FROM HY WHERE NOT seen")
def unseen_candidates(spark, sf):
    return rk.unseen_candidates(_feature_scores(spark, sf), V.products(spark, sf))


@query("popular_products", CUSTOMER_FEATURES_SQL + ", " + POPF_SQL + "SELECT item_id, CAST(pos AS BIGINT) AS pos FROM POPF")
def popular_products(spark, sf):
    p = rk.popular_from_features(_features(spark, sf))
    return p.select("item_id", F.col("pos").cast("long").alias("pos"))


POPR_SQL = f"""
POPR AS (SELECT item_id, count(*) FILTER (WHERE interaction_type = 'purchase') AS purchase_count,
                count(*) AS total_interactions,
                row_number() OVER (ORDER BY count(*) FILTER (WHERE interaction_type = 'purchase') DESC, count(*) DESC, item_id) AS pos
         FROM C GROUP BY item_id QUALIFY pos <= {POPULAR_PRODUCTS_N})
"""


@query("popularity_raw", with_views("C", "C_products") + ", " + POPR_SQL + """
SELECT item_id, purchase_count, total_interactions, CAST(pos AS BIGINT) AS pos FROM POPR""")
def popularity_raw(spark, sf):
    p = rk.popular_from_events(V.customer_interactions(spark, sf))
    return p.select("item_id", "purchase_count", "total_interactions", F.col("pos").cast("long").alias("pos"))


REC_COLS = """SELECT r.user_id, r.rank, r.item_id AS product_id, p.product_name, p.category, p.price, p.description,
       r.score, r.source FROM RECS r LEFT JOIN C_products p ON r.item_id = p.product_id"""


@query("recommend_products", FEAT_HY + ", " + POPF_SQL + ", " + topk_backfill_sql("R0", "POPF", K) + REC_COLS)
def recommend_products(spark, sf):
    """Flagship R3/R4 (feature path): top-5 hybrid picks for every customer in the feature frame."""
    f = _features(spark, sf, keep=True)
    scores = f.select("user_id", "item_id", F.col("weighted_score").alias("score"))
    return rk.recommend_products(scores, V.products(spark, sf), rk.popular_from_features(f), f.select("user_id"), K)


RAW_HY = with_views("C", "C_products") + f""", R0 AS (SELECT user_id, item_id, sum({raw_weight_sql()}) AS score FROM C GROUP BY 1, 2),
""" + hybrid_sql("R0", "C_products", HYBRID_ALPHA)


@query("recommend_products_raw", RAW_HY + ", " + POPR_SQL + ", " + topk_backfill_sql("R0", "POPR", K) + REC_COLS)
def recommend_products_raw(spark, sf):
    """Raw path: weights view/click/purchase (case-sensitive), popularity by purchases then events."""
    c = V.customer_interactions(spark, sf)
    scores = fe.raw_user_item_scores(c)
    return rk.recommend_products(scores, V.products(spark, sf), rk.popular_from_events(c), c.select("user_id"), K)


@query("recommend_cold_start", CUSTOMER_FEATURES_SQL + ", " + POPF_SQL + f""",
COLD AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM CF))
SELECT c.user_id, CAST(p.pos AS BIGINT) AS rank, p.item_id AS product_id, 0.5 AS score, 'popular' AS source
FROM COLD c CROSS JOIN POPF p WHERE p.pos <= {K}""")
def recommend_cold_start(spark, sf):
    """Customers of the customer table without any interaction get the first k popular items."""
    f = _features(spark, sf)
    cust = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    cold = cust.join(f.select("user_id").distinct(), "user_id", "left_anti")
    empty = f.limit(0).select("user_id", "item_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    recs = rk.with_backfill(cold, empty, rk.popular_from_features(f), K)
    return recs.select("user_id", "rank", F.col("item_id").alias("product_id"), "score", "source")


# ---------------------------------------------------------------- materials
from tidewater.functions import POPULAR_MATERIALS_N  # noqa: E402
from tidewater.operators import forecasting as fc  # noqa: E402
from tidewater.plans.forecast import NEXT_SQL, RIDGE_SQL, URG_SQL  # noqa: E402
from tidewater.plans.owner import OWNER_FEATURES_SQL  # noqa: E402
from tidewater.plans.sqlblocks import tfidf_sql  # noqa: E402


def _owner_features(spark, sf, keep: bool = False):
    f = fe.owner_features(V.owner_interactions(spark, sf), V.materials(spark, sf), rows=V.lines(spark, sf))
    return cut_lineage(f) if keep else f


MAT_COLS = """SELECT r.user_id, CAST(r.rank AS BIGINT) AS rank, r.item_id AS material_id, m.material_name, m.category, m.price,
       m.description, r.demand AS predicted_demand_qty, CAST(r.elapsed AS BIGINT) AS urgency_days_elapsed,
       CAST(r.cycle AS BIGINT) AS urgency_cycle_days, r.score FROM RKM r JOIN O_materials m ON r.item_id = m.material_id"""

R5_SQL = OWNER_FEATURES_SQL + ", " + tfidf_sql(
    "SELECT material_id AS doc_id, category || ' ' || description AS txt FROM O_materials", "MX") + f""",
HELD AS (SELECT DISTINCT user_id, item_id FROM OF WHERE item_id IN (SELECT doc_id FROM MX)),
MM AS (SELECT user_id, count(*) AS m FROM HELD GROUP BY 1),
PRO AS (SELECT h.user_id, x.term, sum(x.weight) / max(mm.m) AS p FROM HELD h JOIN MX x ON h.item_id = x.doc_id JOIN MM mm USING (user_id) GROUP BY 1, 2),
SIMS AS (SELECT p.user_id, x.doc_id AS item_id, sum(p.p * x.weight) AS sim FROM PRO p JOIN MX x USING (term) GROUP BY 1, 2),
OWN AS (SELECT DISTINCT user_id FROM OF),
GRID AS (SELECT o.user_id, m.material_id AS item_id FROM OWN o CROSS JOIN O_materials m),
SC AS (SELECT g.user_id, g.item_id,
         round(0.3 * COALESCE(least(1.0, CAST(f.procurement_count AS DOUBLE) / 15.0), 0.0)
             + 0.3 * (CASE WHEN f.user_id IS NULL THEN 0.0 WHEN f.avg_procurement_interval_days > 0 THEN least(1.0, 7.0 / f.avg_procurement_interval_days) ELSE 0.5 END)
             + 0.2 * (CASE WHEN COALESCE(f.avg_procurement_quantity, 0.0) > 0 THEN least(1.0, f.avg_procurement_quantity / 200.0) ELSE 0.0 END)
             + 0.2 * COALESCE(s.sim, 0.0), 4) AS score,
         round(COALESCE(f.avg_procurement_quantity, 0.0), 1) AS demand,
         CASE WHEN f.user_id IS NOT NULL THEN 7 ELSE 0 END AS elapsed,
         CASE WHEN f.user_id IS NOT NULL THEN CAST(trunc(f.avg_procurement_interval_days) AS BIGINT) ELSE 0 END AS cycle
       FROM GRID g LEFT JOIN OF f USING (user_id, item_id) LEFT JOIN SIMS s USING (user_id, item_id)),
RKM AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM SC QUALIFY rank <= {K})
"""


@query("recommend_materials", R5_SQL + MAT_COLS)
def recommend_materials(spark, sf):
    """R5 (feature path): every supplier in the owner feature frame, scored over the whole catalog."""
    f = _owner_features(spark, sf)
    mats = V.materials(spark, sf)
    return rk.recommend_materials(f, mats, f.select("user_id"), K)


POPM_SQL = f"""
POPM AS (SELECT item_id, row_number() OVER (ORDER BY max(material_interaction_count) DESC, item_id) AS pos
         FROM OF GROUP BY item_id QUALIFY pos <= {POPULAR_MATERIALS_N})
"""


@query("popular_materials", OWNER_FEATURES_SQL + ", " + POPM_SQL + "SELECT item_id, CAST(pos AS BIGINT) AS pos FROM POPM")
def popular_materials(spark, sf):
    p = rk.popular_materials_from_features(_owner_features(spark, sf), POPULAR_MATERIALS_N)
    return p.select("item_id", F.col("pos").cast("long").alias("pos"))


@query("recommend_materials_cold_start", OWNER_FEATURES_SQL + ", " + POPM_SQL + f""",
COLD AS (SELECT s_suppkey AS user_id FROM supplier WHERE s_suppkey NOT IN (SELECT user_id FROM OF)),
RKM AS (SELECT c.user_id, p.pos AS rank, p.item_id, 0.5 AS score, 50.0 AS demand, 7 AS elapsed, 14 AS cycle
        FROM COLD c CROSS JOIN POPM p WHERE p.pos <= {K})
""" + MAT_COLS)
def recommend_materials_cold_start(spark, sf):
    """Suppliers without any interaction (supplier table minus feature owners)."""
    f = _owner_features(spark, sf)
    sup = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    cold = sup.join(f.select("user_id").distinct(), "user_id", "left_anti")
    return rk.recommend_materials_cold_start(cold, rk.popular_materials_from_features(f, POPULAR_MATERIALS_N),
                                             V.materials(spark, sf), K)


R6_SQL = with_views("OK", "OK_materials") + ", D AS (SELECT * FROM OK), " + RIDGE_SQL + ", " + NEXT_SQL + ", " + URG_SQL + ", " + tfidf_sql(
    "SELECT material_id AS doc_id, category || ' ' || description AS txt FROM OK_materials", "MX") + f""",
HELD AS (SELECT DISTINCT user_id, item_id FROM OK WHERE item_id IN (SELECT doc_id FROM MX)),
MM AS (SELECT user_id, count(*) AS m FROM HELD GROUP BY 1),
PRO AS (SELECT h.user_id, x.term, sum(x.weight) / max(mm.m) AS p FROM HELD h JOIN MX x ON h.item_id = x.doc_id JOIN MM mm USING (user_id) GROUP BY 1, 2),
SIMS AS (SELECT p.user_id, x.doc_id AS item_id, sum(p.p * x.weight) AS sim FROM PRO p JOIN MX x USING (term) GROUP BY 1, 2),
RGRID AS (SELECT o.user_id, m.material_id AS item_id FROM (SELECT DISTINCT user_id FROM OK) o CROSS JOIN OK_materials m),
RQ AS (SELECT g.user_id, g.item_id, COALESCE(n.forecast_qty, im.material_mean_qty, 10.0) AS q, u.n_purchases, u.days_elapsed, u.cycle_days, s.sim
       FROM RGRID g LEFT JOIN NW n USING (user_id, item_id) LEFT JOIN IM im USING (item_id) LEFT JOIN URG u USING (user_id, item_id) LEFT JOIN SIMS s USING (user_id, item_id)),
RSC AS (SELECT user_id, item_id,
          round(0.3 * COALESCE(least(1.0, n_purchases / 15.0), 0.0) + 0.3 * COALESCE(least(1.0, greatest(0.0, days_elapsed / cycle_days)), 0.0)
              + 0.2 * (CASE WHEN q > 0 THEN least(1.0, q / 200.0) ELSE 0.0 END) + 0.2 * COALESCE(sim, 0.0), 4) AS score,
          round(q, 1) AS demand, COALESCE(days_elapsed, 0) AS elapsed, COALESCE(CAST(trunc(cycle_days) AS BIGINT), 0) AS cycle FROM RQ),
RKM AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM RSC QUALIFY rank <= {K})
"""


@query("recommend_materials_raw", R6_SQL + MAT_COLS.replace("O_materials", "OK_materials"))
def recommend_materials_raw(spark, sf):
    """R6 (raw path) on view OK: reorder urgency + ridge forecast + similarity, every catalog key."""
    ev = V.owner_interactions_k(spark, sf)
    # sums by pair and week feed the ridge fit, the records and the profiles: made once (lineage-backed)
    weeks = cut_lineage(fc.pair_weeks(ev, V.lines(spark, sf), times=True))
    model = fc.fit_demand(ev, weeks)
    return rk.recommend_materials_raw(ev, V.materials_k(spark, sf), weeks.select("user_id"), model, K, weeks)


# ---------------------------------------------------------------- older tree (views T, M)
from tidewater.functions import KNN_NEIGHBORS  # noqa: E402
from tidewater.operators import similarity as simop  # noqa: E402
from tidewater.plans.sqlblocks import colcos_sql  # noqa: E402

TV = with_views("T", "T_products", "T_customers")


def _knn_inputs(spark, sf):
    t = V.transactions(spark, sf)
    # the sums are read for the cosines, the scores and the users: one copy is kept
    ui = cut_lineage(t.groupBy(F.col("customer_id").alias("user_id"), F.col("product_id").alias("item_id")).agg(
        F.sum("quantity").cast("double").alias("qty")))
    nb = simop.top_neighbors(simop.column_cosine(ui, "user_id", "item_id", "qty"), KNN_NEIGHBORS, include_self=True)
    return ui, nb, 4 * ui.count()  # scores: a few an item bought


KNN_SQL = TV + ", " + colcos_sql("T", "customer_id", "product_id", "quantity") + f""",
NB AS (SELECT item_i, item_j, sim FROM (SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS rk FROM SIM)
       WHERE rk <= {KNN_NEIGHBORS} AND item_i <> item_j),
UI AS (SELECT customer_id AS user_id, product_id AS item_id, CAST(sum(quantity) AS DOUBLE) AS qty FROM T GROUP BY 1, 2),
RAWK AS (SELECT u.user_id, n.item_j AS item_id, sum(n.sim * u.qty) AS cf FROM UI u JOIN NB n ON u.item_id = n.item_i WHERE u.qty > 0 GROUP BY 1, 2),
KC AS (SELECT user_id, item_id, CASE WHEN max(cf) OVER (PARTITION BY user_id) > 0 THEN cf / max(cf) OVER (PARTITION BY user_id) ELSE cf END AS cf FROM RAWK)
"""


@query("knn_cf_scores", KNN_SQL + "SELECT user_id, item_id, round(cf, 6) AS cf FROM KC WHERE cf > 0")
def knn_cf_scores(spark, sf):
    """R7 CF part: neighbour-weighted purchase quantities, max-normalised per customer."""
    ui, nb, sums = _knn_inputs(spark, sf)
    return rk.knn_cf_scores(ui, nb, sums).select("user_id", "item_id", r6(F.col("cf")).alias("cf"))


@query("preferred_category_scores", TV + """
SELECT c.customer_id AS user_id, p.product_id AS item_id, 1.0 AS content FROM T_customers c JOIN T_products p ON c.preferred_category = p.category""")
def preferred_category_scores(spark, sf):
    """R11 sparse form: 1.0 for preferred-category products (all others default to 0.3)."""
    return rk.preferred_category_scores(V.customers_t(spark, sf), V.products_k(spark, sf))


@query("recommend_products_knn", KNN_SQL + f""",
USERS AS (SELECT customer_id AS user_id FROM T_customers),
SCK AS (SELECT u.user_id, p.product_id AS item_id,
               round(0.7 * COALESCE(kc.cf, 0.0) + 0.3 * CASE WHEN p.category = c.preferred_category THEN 1.0 ELSE 0.3 END, 9) AS score
        FROM USERS u CROSS JOIN T_products p JOIN T_customers c ON u.user_id = c.customer_id
        LEFT JOIN KC kc ON kc.user_id = u.user_id AND kc.item_id = p.product_id),
RKK AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM SCK QUALIFY rank <= {K})
SELECT r.user_id, CAST(r.rank AS BIGINT) AS rank, r.item_id AS product_id, p.name, p.category, p.subcategory, p.price,
       round(r.score, 6) AS score FROM RKK r JOIN T_products p ON r.item_id = p.product_id""")
def recommend_products_knn(spark, sf):
    """Every customer, KNN CF + preferred-category content, bought items eligible."""
    ui, nb, sums = _knn_inputs(spark, sf)
    out = rk.recommend_products_knn(ui, nb, V.customers_t(spark, sf), V.products_k(spark, sf), ui.select("user_id"), K, sums)
    return out.withColumn("score", r6(F.col("score")))


MV = with_views("M", "OK_materials", "M_owners", "RULES")


@query("industry_category_scores", MV + """
SELECT o.owner_id AS user_id, k.material_id AS item_id, 0.5 AS score
FROM M_owners o JOIN RULES r ON o.industry = r.industry JOIN OK_materials k ON k.category = r.category""")
def industry_category_scores(spark, sf):
    """Rule score 0.5 for materials in the owner's industry categories."""
    return rk.industry_category_scores(V.brand_owners(spark, sf), V.industry_rules(spark), V.materials_k(spark, sf))


@query("owner_history", MV + """
SELECT owner_id, count(*) AS n_purchases, CAST(sum(quantity) AS BIGINT) AS total_quantity,
       first(material_id ORDER BY date, l_orderkey, l_linenumber, l_partkey) AS first_material_id,
       min(date) AS first_date, max(date) AS last_date FROM M GROUP BY owner_id""")
def owner_history(spark, sf):
    """Per-owner purchase history summary (the parts of the history list the ranker reads)."""
    return rk.owner_history_summary(V.owner_purchases(spark, sf))


@query("owner_history_list", MV + """
SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY date, l_orderkey, l_linenumber, l_partkey, quantity) AS nth,
       material_id, quantity, date FROM M""")
def owner_history_list(spark, sf):
    """The history list itself, in long form."""
    return rk.owner_history(V.owner_purchases(spark, sf))


@query("popular_purchases", MV + f"""
SELECT material_id, count(*) AS n, 1.0 AS score, 'Popular material' AS reason FROM M GROUP BY 1 ORDER BY n DESC, material_id LIMIT {K}""")
def popular_purchases(spark, sf):
    """Cold-start list: most purchased materials (purchase rows), score 1.0."""
    from tidewater.operators import profiling as pf
    from tidewater.functions import REASON_POPULAR
    t = pf.top_n(V.owner_purchases(spark, sf), "material_id", K)
    return t.select("material_id", "n", F.lit(1.0).alias("score"), F.lit(REASON_POPULAR).alias("reason"))


COP_SQL = MV + """,
DM AS (SELECT DISTINCT owner_id, material_id FROM M),
CO AS (SELECT a.material_id AS ma, b.material_id AS mb, count(*) AS n FROM DM a JOIN DM b ON a.owner_id = b.owner_id GROUP BY 1, 2),
""" + colcos_sql("CO", "mb", "ma", "n") + f""",
CNT AS (SELECT owner_id AS user_id, material_id AS item_id, count(*) AS c FROM M GROUP BY 1, 2),
HO AS (SELECT DISTINCT user_id FROM CNT),
SSC AS (SELECT c.user_id, s.item_j AS item_id, sum(c.c * s.sim) AS s FROM CNT c JOIN SIM s ON c.item_id = s.item_i GROUP BY 1, 2),
IND AS (SELECT o.owner_id AS user_id, k.material_id AS item_id, 0.25 AS ind
        FROM M_owners o JOIN RULES r ON o.industry = r.industry JOIN OK_materials k ON k.category = r.category
        WHERE o.owner_id IN (SELECT user_id FROM HO)),
GR AS (SELECT h.user_id, k.material_id AS item_id FROM HO h CROSS JOIN OK_materials k),
SCO AS (SELECT g.user_id, g.item_id, round(CASE WHEN c.user_id IS NULL THEN COALESCE(ss.s, 0.0) ELSE 0.0 END + COALESCE(i.ind, 0.0), 9) AS score, c.user_id IS NOT NULL AS bought
        FROM GR g LEFT JOIN SSC ss USING (user_id, item_id) LEFT JOIN IND i USING (user_id, item_id) LEFT JOIN CNT c USING (user_id, item_id)
        WHERE c.user_id IS NULL OR i.ind IS NOT NULL),
RKC AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM SCO QUALIFY rank <= {K}),
FM AS (SELECT owner_id AS user_id, first(material_id ORDER BY date, l_orderkey, l_linenumber, l_partkey) AS fm FROM M GROUP BY 1)
SELECT r.user_id, CAST(r.rank AS BIGINT) AS rank, r.item_id AS material_id, k.material_name, k.category, k.price AS unit_cost,
       round(r.score, 6) AS score,
       CASE WHEN r.bought THEN 'Based on production trends' ELSE 'Similar to ' || f.material_name END AS reason
FROM RKC r JOIN OK_materials k ON r.item_id = k.material_id JOIN FM ON FM.user_id = r.user_id
JOIN OK_materials f ON f.material_id = FM.fm
UNION ALL
SELECT o.owner_id, p.pos, k.material_id, k.material_name, k.category, k.price, 1.0, 'Popular material'
FROM M_owners o CROSS JOIN (SELECT material_id, row_number() OVER (ORDER BY count(*) DESC, material_id) AS pos FROM M GROUP BY 1 QUALIFY pos <= {K}) p
JOIN OK_materials k ON k.material_id = p.material_id WHERE o.owner_id NOT IN (SELECT user_id FROM HO)""".replace("{K}", str(K))


@query("recommend_materials_copurchase", COP_SQL)
def recommend_materials_copurchase(spark, sf):
    """Co-purchase similarity over every purchase row + industry rules, with reasons."""
    mats = V.materials_k(spark, sf)
    m = V.owner_purchases(spark, sf)
    co = simop.cooccurrence(m, "owner_id", "material_id").withColumn("n", F.col("n_owners").cast("double"))
    co_sim = simop.column_cosine(co, "item_b", "item_a", "n")
    return rk.recommend_materials_copurchase(m, mats, V.brand_owners(spark, sf), V.industry_rules(spark), co_sim, K)
