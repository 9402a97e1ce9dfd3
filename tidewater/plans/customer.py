"""Customer-side feature queries on view C (events x product catalog)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import CUSTOMER_DECAY, r6
from tidewater.operators import features as fe
from tidewater.plans.registry import query
from tidewater.plans.sqlviews import days_sql, raw_weight_sql, scored_sql, weight_sql, with_views
from tidewater.sources import views as V

CV = with_views("C", "C_products")
CS = CV + ", " + scored_sql("C", CUSTOMER_DECAY, False) + "\n"


def _scored(spark, sf):
    return fe.customer_event_scores(V.customer_interactions(spark, sf))


@query("scan_filter_user_type", CV + """
SELECT interaction_id, user_type, user_id, item_id, item_type, interaction_type, category, quantity,
       price, interaction_timestamp FROM C WHERE user_type = 'customer'""")
def scan_filter_user_type(spark, sf):
    return V.customer_interactions(spark, sf).where(F.col("user_type") == "customer")


@query("interaction_weighting", CV + f"""
SELECT interaction_id, interaction_type, {weight_sql()} AS interaction_weight FROM C""")
def interaction_weighting(spark, sf):
    c = fe.with_interaction_weight(V.customer_interactions(spark, sf))
    return c.select("interaction_id", "interaction_type", "interaction_weight")


@query("recency_decay_customer", CS + """
SELECT interaction_id, interaction_timestamp, round(decay_weight, 6) AS decay_weight FROM S""")
def recency_decay_customer(spark, sf):
    c = fe.with_recency_decay(V.customer_interactions(spark, sf), CUSTOMER_DECAY)
    return c.select("interaction_id", "interaction_timestamp", r6(F.col("decay_weight")).alias("decay_weight"))


@query("event_scores", CS + """
SELECT interaction_id, interaction_weight, round(event_score, 6) AS event_score FROM S""")
def event_scores(spark, sf):
    return _scored(spark, sf).select("interaction_id", "interaction_weight", r6(F.col("event_score")).alias("event_score"))


@query("user_item_affinity", CS + """
SELECT user_id, item_id, round(sum(event_score), 6) AS weighted_score FROM S GROUP BY user_id, item_id""")
def user_item_affinity(spark, sf):
    a = fe.user_item_affinity(_scored(spark, sf))
    return a.select("user_id", "item_id", r6(F.col("weighted_score")).alias("weighted_score"))


@query("raw_user_item_scores", CV + f"""
SELECT user_id, item_id, round(sum({raw_weight_sql()}), 6) AS score FROM C GROUP BY user_id, item_id""")
def raw_user_item_scores(spark, sf):
    r = fe.raw_user_item_scores(V.customer_interactions(spark, sf))
    return r.select("user_id", "item_id", r6(F.col("score")).alias("score"))


@query("user_spend", CV + """
SELECT user_id, round(avg(price), 6) AS avg_spend, count(price) AS purchase_count
FROM C WHERE lower(interaction_type) = 'purchase' GROUP BY user_id""")
def user_spend(spark, sf):
    u = fe.user_spend(V.customer_interactions(spark, sf))
    return u.select("user_id", r6(F.col("avg_spend")).alias("avg_spend"), "purchase_count")


@query("user_recency", CV + f"""
SELECT user_id, round({days_sql('max(interaction_timestamp)', '(SELECT max(interaction_timestamp) FROM C)')}, 6) AS recency_days
FROM C GROUP BY user_id""")
def user_recency(spark, sf):
    u = fe.user_recency(V.customer_interactions(spark, sf))
    return u.select("user_id", r6(F.col("recency_days")).alias("recency_days"))


FAV_SQL = """
CATS AS (SELECT user_id, category, sum(event_score) AS s FROM S GROUP BY user_id, category),
RK AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, category ASC NULLS FIRST) AS rk FROM CATS),
FAV AS (SELECT user_id,
          max(CASE WHEN rk = 1 THEN category END) AS favorite_category_1,
          max(CASE WHEN rk = 2 THEN category END) AS favorite_category_2,
          max(CASE WHEN rk = 3 THEN category END) AS favorite_category_3
        FROM RK WHERE rk <= 3 GROUP BY user_id)
"""


@query("favorite_categories", CS + ", " + FAV_SQL + "SELECT * FROM FAV")
def favorite_categories(spark, sf):
    return fe.top_categories(_scored(spark, sf), 3, "favorite_category")


ITEMS_SQL = """
POP AS (SELECT item_id, count(event_score) AS c, sum(event_score) AS su FROM S GROUP BY item_id),
ITEMS AS (SELECT p.product_id AS item_id, p.category AS product_category, p.price,
                 CAST(COALESCE(POP.c, 0) AS BIGINT) AS item_interaction_count,
                 COALESCE(POP.su, 0.0) AS item_score_sum
          FROM C_products p LEFT JOIN POP ON p.product_id = POP.item_id)
"""


@query("item_popularity", CS + ", " + ITEMS_SQL + """
SELECT item_id, product_category, price, item_interaction_count, round(item_score_sum, 6) AS item_score_sum FROM ITEMS""")
def item_popularity(spark, sf):
    i = fe.item_popularity(_scored(spark, sf), V.products(spark, sf), "product_id", "product_category",
                           "item_interaction_count", "item_score_sum")
    return i.withColumn("item_score_sum", r6(F.col("item_score_sum")))


@query("repeat_purchases", CV + """
SELECT user_id, item_id, count(*) AS repeated_purchase_count FROM C
WHERE lower(interaction_type) = 'purchase' GROUP BY user_id, item_id""")
def repeat_purchases(spark, sf):
    return fe.repeat_counts(V.customer_interactions(spark, sf), "purchase", "repeated_purchase_count")


CUSTOMER_FEATURES_SQL = CS + ", " + FAV_SQL + ", " + ITEMS_SQL + f""",
PAIRS AS (SELECT user_id, item_id, sum(event_score) AS weighted_score,
                 count(*) FILTER (WHERE lower(interaction_type) = 'purchase') AS repeated_purchase_count
          FROM S GROUP BY user_id, item_id),
USERS AS (SELECT user_id,
                 {days_sql('max(interaction_timestamp)', '(SELECT max(interaction_timestamp) FROM S)')} AS recency_days,
                 COALESCE(avg(price) FILTER (WHERE lower(interaction_type) = 'purchase'), 0.0) AS avg_spend,
                 count(price) FILTER (WHERE lower(interaction_type) = 'purchase') AS purchase_count
          FROM S GROUP BY user_id),
CF AS (
SELECT p.user_id, p.item_id, p.weighted_score, u.recency_days,
       f.favorite_category_1, f.favorite_category_2, f.favorite_category_3,
       u.avg_spend, u.purchase_count, i.product_category, i.price,
       i.item_interaction_count, i.item_score_sum, p.repeated_purchase_count
FROM PAIRS p LEFT JOIN USERS u ON p.user_id = u.user_id
LEFT JOIN FAV f ON p.user_id = f.user_id
LEFT JOIN ITEMS i ON p.item_id = i.item_id)
"""


def _round_features(df):
    dbl = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select(*[r6(F.col(c)).alias(c) if c in dbl else F.col(c) for c in df.columns])


@query("customer_features", CUSTOMER_FEATURES_SQL + """
SELECT user_id, item_id, round(weighted_score, 6) AS weighted_score, round(recency_days, 6) AS recency_days,
       favorite_category_1, favorite_category_2, favorite_category_3, round(avg_spend, 6) AS avg_spend,
       purchase_count, product_category, round(price, 6) AS price, item_interaction_count,
       round(item_score_sum, 6) AS item_score_sum, repeated_purchase_count FROM CF""")
def customer_features(spark, sf):
    f = fe.customer_features(V.customer_interactions(spark, sf), V.products(spark, sf))
    return _round_features(f)
