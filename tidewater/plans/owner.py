"""Owner-side feature queries on view O (lineitem x part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import OWNER_DECAY, r6
from tidewater.operators import features as fe
from tidewater.operators import validation as va
from tidewater.plans.customer import CUSTOMER_FEATURES_SQL, _round_features
from tidewater.plans.registry import query
from tidewater.plans.sqlviews import days_sql, scored_sql, with_views
from tidewater.sources import views as V

OV = with_views("O", "O_materials")
OS = OV + ", " + scored_sql("O", OWNER_DECAY, True) + "\n"


def _scored(spark, sf):
    return fe.owner_event_scores(V.owner_interactions(spark, sf))


@query("recency_decay_owner", OS + """
SELECT user_id, item_id, interaction_type, quantity, interaction_timestamp,
       round(decay_weight, 6) AS decay_weight, round(event_score, 6) AS event_score FROM S""")
def recency_decay_owner(spark, sf):
    s = _scored(spark, sf)
    return s.select("user_id", "item_id", "interaction_type", "quantity", "interaction_timestamp",
                    r6(F.col("decay_weight")).alias("decay_weight"), r6(F.col("event_score")).alias("event_score"))


@query("procurement_stats", OS + """
SELECT user_id, item_id, round(sum(event_score), 6) AS weighted_score,
       round(avg(quantity), 6) AS avg_procurement_quantity,
       CAST(sum(quantity) AS BIGINT) AS total_quantity_procured, count(quantity) AS procurement_count
FROM S GROUP BY user_id, item_id""")
def procurement_stats(spark, sf):
    return _round_features(fe.procurement_stats(_scored(spark, sf)))


INTERVAL_SQL = f"""
IV AS (SELECT user_id, COALESCE(CASE WHEN count(interaction_timestamp) >= 2 THEN
          {days_sql('min(interaction_timestamp)', 'max(interaction_timestamp)')} / (count(interaction_timestamp) - 1) END,
          30.0::DOUBLE) AS avg_procurement_interval_days
       FROM O GROUP BY user_id)
"""


@query("owner_interval_days", OV + ", " + INTERVAL_SQL + """
SELECT user_id, round(avg_procurement_interval_days, 6) AS avg_procurement_interval_days FROM IV""")
def owner_interval_days(spark, sf):
    i = fe.owner_interval_days(V.owner_interactions(spark, sf))
    return i.select("user_id", r6(F.col("avg_procurement_interval_days")).alias("avg_procurement_interval_days"))


@query("owner_interval_lag_check", OV + """
, G AS (SELECT user_id, interaction_timestamp AS t,
        lag(interaction_timestamp) OVER (PARTITION BY user_id ORDER BY interaction_timestamp) AS p FROM O)
SELECT user_id, round(COALESCE(avg((epoch_us(t) - epoch_us(p)) / 86400000000.0), 30.0), 6) AS avg_procurement_interval_days
FROM G GROUP BY user_id""")
def owner_interval_lag_check(spark, sf):
    """Cross-check of the telescoped interval against the lag-window definition (oracle side)."""
    return owner_interval_days(spark, sf)


SEASON_SQL = """
MV AS (SELECT user_id, month(interaction_timestamp) AS month, count(*) AS month_order_count FROM O GROUP BY 1, 2),
SEASON AS (SELECT user_id, month, month_order_count,
                  sum(month_order_count) OVER (PARTITION BY user_id) AS total_user_orders,
                  month_order_count / sum(month_order_count) OVER (PARTITION BY user_id) AS seasonal_procurement_index,
                  first_value(month) OVER (PARTITION BY user_id ORDER BY month_order_count DESC, month ASC) AS peak_procurement_month
           FROM MV)
"""


@query("owner_seasonality", OV + ", " + SEASON_SQL + """
SELECT user_id, CAST(month AS INTEGER) AS month, month_order_count, CAST(total_user_orders AS BIGINT) AS total_user_orders,
       round(seasonal_procurement_index, 6) AS seasonal_procurement_index,
       CAST(peak_procurement_month AS INTEGER) AS peak_procurement_month FROM SEASON""")
def owner_seasonality(spark, sf):
    s = fe.owner_seasonality(V.owner_interactions(spark, sf))
    return s.select("user_id", "month", "month_order_count", F.col("total_user_orders").cast("long").alias("total_user_orders"),
                    r6(F.col("seasonal_procurement_index")).alias("seasonal_procurement_index"), "peak_procurement_month")


AFF_SQL = """
CATS AS (SELECT user_id, category, sum(event_score) AS s FROM S GROUP BY user_id, category),
RK AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, category ASC NULLS FIRST) AS rk FROM CATS),
AFF AS (SELECT user_id,
          max(CASE WHEN rk = 1 THEN category END) AS supplier_affinity_category_1,
          max(CASE WHEN rk = 2 THEN category END) AS supplier_affinity_category_2
        FROM RK WHERE rk <= 2 GROUP BY user_id)
"""


@query("supplier_affinity", OS + ", " + AFF_SQL + "SELECT * FROM AFF")
def supplier_affinity(spark, sf):
    return fe.top_categories(_scored(spark, sf), 2, "supplier_affinity_category")


MAT_SQL = """
MPOP AS (SELECT item_id, count(event_score) AS c, sum(event_score) AS su FROM S GROUP BY item_id),
MATS AS (SELECT m.material_id AS item_id, m.category AS material_category, m.price,
                CAST(COALESCE(MPOP.c, 0) AS BIGINT) AS material_interaction_count,
                COALESCE(MPOP.su, 0.0) AS material_demand_score
         FROM O_materials m LEFT JOIN MPOP ON m.material_id = MPOP.item_id)
"""


@query("material_demand", OS + ", " + MAT_SQL + """
SELECT item_id, material_category, price, material_interaction_count,
       round(material_demand_score, 6) AS material_demand_score FROM MATS""")
def material_demand(spark, sf):
    i = fe.item_popularity(_scored(spark, sf), V.materials(spark, sf), "material_id", "material_category",
                           "material_interaction_count", "material_demand_score")
    return i.withColumn("material_demand_score", r6(F.col("material_demand_score")))


OWNER_FEATURES_SQL = OS + ", " + INTERVAL_SQL + ", " + SEASON_SQL + ", " + AFF_SQL + ", " + MAT_SQL + """,
PAIRS AS (SELECT user_id, item_id, sum(event_score) AS weighted_score, avg(quantity) AS avg_procurement_quantity,
                 CAST(sum(quantity) AS BIGINT) AS total_quantity_procured, count(quantity) AS procurement_count,
                 count(*) FILTER (WHERE lower(interaction_type) = 'reorder') AS reorder_count
          FROM S GROUP BY user_id, item_id),
PEAK AS (SELECT DISTINCT user_id, peak_procurement_month FROM SEASON),
OF AS (
SELECT p.user_id, p.item_id, p.weighted_score, p.avg_procurement_quantity, p.total_quantity_procured,
       p.procurement_count, iv.avg_procurement_interval_days, CAST(pk.peak_procurement_month AS INTEGER) AS peak_procurement_month,
       a.supplier_affinity_category_1, a.supplier_affinity_category_2, m.material_category, m.price,
       m.material_interaction_count, m.material_demand_score, p.reorder_count
FROM PAIRS p LEFT JOIN IV iv ON p.user_id = iv.user_id LEFT JOIN PEAK pk ON p.user_id = pk.user_id
LEFT JOIN AFF a ON p.user_id = a.user_id LEFT JOIN MATS m ON p.item_id = m.item_id)
"""


@query("owner_features", OWNER_FEATURES_SQL + """
SELECT user_id, item_id, round(weighted_score, 6) AS weighted_score, round(avg_procurement_quantity, 6) AS avg_procurement_quantity,
       total_quantity_procured, procurement_count, round(avg_procurement_interval_days, 6) AS avg_procurement_interval_days,
       peak_procurement_month, supplier_affinity_category_1, supplier_affinity_category_2, material_category,
       round(price, 6) AS price, material_interaction_count, round(material_demand_score, 6) AS material_demand_score,
       reorder_count FROM OF""")
def owner_features(spark, sf):
    return _round_features(fe.owner_features(V.owner_interactions(spark, sf), V.materials(spark, sf), rows=V.lines(spark, sf)))


@query("validate_customer_features", CUSTOMER_FEATURES_SQL + """
SELECT count(*) AS row_count, count(*) - count(DISTINCT (user_id, item_id)) AS duplicate_pairs,
       count(*) FILTER (WHERE user_id < 0 OR item_id < 0) AS negative_ids,
       count(*) FILTER (WHERE weighted_score < 0) AS negative_scores,
       count(*) FILTER (WHERE user_id IS NULL) AS null_user_ids,
       count(*) FILTER (WHERE item_id IS NULL) AS null_item_ids,
       count(*) FILTER (WHERE recency_days < 0) AS negative_recency FROM CF""")
def validate_customer_features(spark, sf):
    f = fe.customer_features(V.customer_interactions(spark, sf), V.products(spark, sf))
    return va.validation_counts(f, "customer")


@query("validate_owner_features", OWNER_FEATURES_SQL + """
SELECT count(*) AS row_count, count(*) - count(DISTINCT (user_id, item_id)) AS duplicate_pairs,
       count(*) FILTER (WHERE user_id < 0 OR item_id < 0) AS negative_ids,
       count(*) FILTER (WHERE weighted_score < 0) AS negative_scores,
       count(*) FILTER (WHERE avg_procurement_quantity < 0) AS negative_quantity,
       count(*) FILTER (WHERE avg_procurement_interval_days < 0) AS negative_interval FROM OF""")
def validate_owner_features(spark, sf):
    lines = V.lines(spark, sf)
    f = fe.owner_features(V.owner_interactions(spark, sf), V.materials(spark, sf), rows=lines)
    return va.validation_counts(f, "owner", lines)


@query("drop_incomplete_features", CUSTOMER_FEATURES_SQL + """
SELECT user_id, item_id, round(weighted_score, 6) AS weighted_score, favorite_category_3 FROM CF
WHERE favorite_category_1 IS NOT NULL AND favorite_category_2 IS NOT NULL AND favorite_category_3 IS NOT NULL
  AND product_category IS NOT NULL""")
def drop_incomplete_features(spark, sf):
    f = fe.customer_features(V.customer_interactions(spark, sf), V.products(spark, sf))
    f = va.drop_incomplete(f)
    return f.select("user_id", "item_id", r6(F.col("weighted_score")).alias("weighted_score"), "favorite_category_3")
