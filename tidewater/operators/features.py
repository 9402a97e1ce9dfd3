"""Feature engineering: weights, decay, affinities, customer/owner feature frames.

Grain discipline: each frame is produced by one aggregate per grain
((user,item), user, (user,category), item) with conditional aggregates in
place of the reference's filter-then-merge steps, so every grain costs one
shuffle and every aggregate combines map-side (hot keys stay cheap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import (
    CUSTOMER_DECAY, DEFAULT_INTERVAL_DAYS, OWNER_DECAY, days_between, interaction_weight,
    raw_weight, scalar_max,
)
from tidewater.session import dealt, looked_up

TS = "interaction_timestamp"
#: Tasks that a user's pairs are dealt to.
SHARES = 16


def with_interaction_weight(events: DataFrame, type_col: str = "interaction_type") -> DataFrame:
    return events.withColumn("interaction_weight", interaction_weight(F.col(type_col)))


def with_recency_decay(events: DataFrame, rate: float, ts_col: str = TS) -> DataFrame:
    """decay = exp(-rate * days since the newest event of the whole input); 1.0 without timestamps."""
    if ts_col not in events.columns:
        return events.withColumn("decay_weight", F.lit(1.0))
    newest = scalar_max(events, ts_col)
    return events.withColumn("decay_weight", F.exp(F.lit(-rate) * days_between(F.col(ts_col), newest)))


def customer_event_scores(events: DataFrame, rate: float = CUSTOMER_DECAY) -> DataFrame:
    df = with_recency_decay(with_interaction_weight(events), rate)
    return df.withColumn("event_score", F.col("interaction_weight") * F.col("decay_weight"))


def owner_event_scores(events: DataFrame, rate: float = OWNER_DECAY) -> DataFrame:
    df = with_recency_decay(with_interaction_weight(events), rate)
    return df.withColumn("event_score", F.col("interaction_weight") * F.col("decay_weight") * F.col("quantity"))


def _is(type_value: str) -> Column:
    return F.lower(F.col("interaction_type")) == type_value


def user_item_affinity(scored: DataFrame) -> DataFrame:
    return scored.groupBy("user_id", "item_id").agg(F.sum("event_score").alias("weighted_score"))


def raw_user_item_scores(events: DataFrame) -> DataFrame:
    """Raw path: sum of case-sensitive weights (unknown types contribute null)."""
    return (events.withColumn("score", raw_weight(F.col("interaction_type")))
            .groupBy("user_id", "item_id").agg(F.sum("score").alias("score")))


def user_spend(scored: DataFrame) -> DataFrame:
    p = scored.where(_is("purchase"))
    return p.groupBy("user_id").agg(F.avg("price").alias("avg_spend"), F.count("price").alias("purchase_count"))


def user_recency(scored: DataFrame) -> DataFrame:
    newest = scalar_max(scored, TS)
    return scored.groupBy("user_id").agg(F.max(TS).alias("last_ts")).select(
        "user_id", days_between(F.col("last_ts"), newest).alias("recency_days"))


def top_categories(scored: DataFrame, n: int, prefix: str) -> DataFrame:
    """Top-n categories per user by summed event score (ties: category ascending), pivoted.

    The (user, category) aggregate is bounded by the category domain per user,
    so the rank window sorts at most |categories| rows per user.
    """
    cat = scored.groupBy("user_id", "category").agg(F.sum("event_score").alias("s"))
    w = Window.partitionBy("user_id").orderBy(F.round("s", 9).desc(), F.col("category").asc_nulls_first())
    ranked = cat.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)
    return ranked.groupBy("user_id").agg(
        *[F.max(F.when(F.col("rk") == k, F.col("category"))).alias(f"{prefix}_{k}") for k in range(1, n + 1)])


def item_popularity(scored: DataFrame, catalog: DataFrame, id_col: str, cat_name: str,
                    count_name: str, sum_name: str) -> DataFrame:
    """Catalog left-joined with event count / score sum (0 for items without events)."""
    pop = scored.groupBy("item_id").agg(F.count("event_score").alias(count_name), F.sum("event_score").alias(sum_name))
    info = looked_up(catalog.select(F.col(id_col).alias("item_id"), F.col("category").alias(cat_name), "price"))
    return info.join(pop, "item_id", "left").select(
        "item_id", cat_name, "price",
        F.coalesce(F.col(count_name), F.lit(0)).cast("long").alias(count_name),
        F.coalesce(F.col(sum_name), F.lit(0.0)).alias(sum_name))


def repeat_counts(scored: DataFrame, type_value: str, name: str) -> DataFrame:
    return scored.where(_is(type_value)).groupBy("user_id", "item_id").agg(F.count("*").alias(name))


def customer_features(events: DataFrame, products: DataFrame, rate: float = CUSTOMER_DECAY) -> DataFrame:
    """one row per (user, item) with user, item and pair features."""
    s = customer_event_scores(events, rate)
    newest = scalar_max(s, TS)
    is_p = _is("purchase")
    pairs = s.groupBy("user_id", "item_id").agg(
        F.sum("event_score").alias("weighted_score"),
        F.count_if(is_p).alias("repeated_purchase_count"))
    users = s.groupBy("user_id").agg(
        F.max(TS).alias("last_ts"),
        F.avg(F.when(is_p, F.col("price"))).alias("avg_spend"),
        F.count(F.when(is_p, F.col("price"))).alias("purchase_count"))
    users = users.select(
        "user_id", days_between(F.col("last_ts"), newest).alias("recency_days"),
        F.coalesce("avg_spend", F.lit(0.0)).alias("avg_spend"),
        F.col("purchase_count").cast("long").alias("purchase_count"))
    users = users.join(top_categories(s, 3, "favorite_category"), "user_id", "left")
    items = item_popularity(s, products, "product_id", "product_category",
                                                 "item_interaction_count", "item_score_sum")
    out = pairs.join(users, "user_id", "left").join(items, "item_id", "left")
    return out.select(
        "user_id", "item_id", "weighted_score", "recency_days",
        "favorite_category_1", "favorite_category_2", "favorite_category_3",
        "avg_spend", "purchase_count", "product_category", "price",
        "item_interaction_count", "item_score_sum",
        F.col("repeated_purchase_count").cast("long").alias("repeated_purchase_count"))


def procurement_stats(scored: DataFrame) -> DataFrame:
    return scored.groupBy("user_id", "item_id").agg(
        F.sum("event_score").alias("weighted_score"),
        F.avg("quantity").alias("avg_procurement_quantity"),
        F.sum("quantity").cast("long").alias("total_quantity_procured"),
        F.count("quantity").alias("procurement_count"))


def owner_interval_days(events: DataFrame) -> DataFrame:
    """Mean gap between consecutive events of a user (all items, all types), in days.

    The mean of consecutive differences of a sorted sequence telescopes to
    (last - first) / (n - 1), so this is a plain partial aggregate instead of
    a per-user sort: a user holding a third of all rows costs no single task.
    Users with one event get 30.0.
    """
    g = events.where(F.col(TS).isNotNull()).groupBy("user_id").agg(
        F.min(TS).alias("t0"), F.max(TS).alias("t1"), F.count(TS).alias("n"))
    all_users = events.select("user_id").distinct()
    mean_gap = F.when(F.col("n") >= 2, days_between(F.col("t0"), F.col("t1")) / (F.col("n") - 1))
    return all_users.join(g, "user_id", "left").select(
        "user_id", F.coalesce(mean_gap, F.lit(DEFAULT_INTERVAL_DAYS)).alias("avg_procurement_interval_days"))


def owner_seasonality(events: DataFrame) -> DataFrame:
    """Per (user, month): share of the user's events; peak month = highest share, lowest month on ties."""
    m = events.withColumn("month", F.month(TS)).groupBy("user_id", "month").agg(F.count("*").alias("month_order_count"))
    w = Window.partitionBy("user_id")
    total = F.sum("month_order_count").over(w)
    peak = F.max(F.struct(F.col("month_order_count").alias("c"), (-F.col("month")).alias("nm"))).over(w)
    return m.select(
        "user_id", "month", "month_order_count", total.alias("total_user_orders"),
        (F.col("month_order_count") / total).alias("seasonal_procurement_index"),
        (-peak.getField("nm")).alias("peak_procurement_month"))


def peak_month(events: DataFrame) -> DataFrame:
    m = events.withColumn("month", F.month(TS)).groupBy("user_id", "month").agg(F.count("*").alias("c"))
    best = m.groupBy("user_id").agg(F.max(F.struct("c", (-F.col("month")).alias("neg_month"))).alias("b"))
    return best.select("user_id", (-F.col("b.neg_month")).alias("peak_procurement_month"))


def with_users(pairs: DataFrame, users: DataFrame, rows: int | None) -> DataFrame:
    """``pairs`` with their users' features. ``rows``: about the number of pairs, where known; tasks are then dealt by it, a
    user's pairs over ``SHARES``, to each of which the user's row goes."""
    if rows is None:
        return pairs.join(users, "user_id", "left")
    share = F.pmod(F.xxhash64("item_id"), F.lit(SHARES)).cast("int")
    pairs = dealt(pairs.withColumn("share", share), ["user_id", "share"], rows)
    users = users.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return pairs.join(users, ["user_id", "share"], "left").drop("share")


def owner_features(events: DataFrame, materials: DataFrame, rate: float = OWNER_DECAY, rows: int | None = None) -> DataFrame:
    """one row per (owner, material) with owner, material and pair features. ``rows``: about the number of events, where known."""
    s = owner_event_scores(events, rate)
    pairs = s.groupBy("user_id", "item_id").agg(
        F.sum("event_score").alias("weighted_score"),
        F.avg("quantity").alias("avg_procurement_quantity"),
        F.sum("quantity").cast("long").alias("total_quantity_procured"),
        F.count("quantity").alias("procurement_count"),
        F.count_if(_is("reorder")).cast("long").alias("reorder_count"))
    users = (owner_interval_days(s)
             .join(peak_month(s), "user_id", "left")
             .join(top_categories(s, 2, "supplier_affinity_category"), "user_id", "left"))
    items = item_popularity(s, materials, "material_id", "material_category",
                                                 "material_interaction_count", "material_demand_score")
    # items first: pairs of a view joined by item lie by item already
    out = with_users(pairs.join(items, "item_id", "left"), users, rows)
    return out.select(
        "user_id", "item_id", "weighted_score", "avg_procurement_quantity", "total_quantity_procured",
        "procurement_count", "avg_procurement_interval_days", "peak_procurement_month",
        "supplier_affinity_category_1", "supplier_affinity_category_2", "material_category", "price",
        "material_interaction_count", "material_demand_score", "reorder_count")
