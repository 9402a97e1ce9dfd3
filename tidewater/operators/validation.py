"""Feature-frame validation (F3/F4): violation counts in one job, then raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import dealt

CUSTOMER_REQUIRED = ("user_id", "item_id", "weighted_score", "recency_days")
OWNER_REQUIRED = ("user_id", "item_id", "weighted_score", "avg_procurement_interval_days")


class FeatureValidationError(ValueError):
    pass


def validation_counts(df: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """One row of violation counts. ``kind`` is ``customer`` or ``owner``; ``rows``: about the number of rows, where known,
    by which tasks are then dealt.

    Duplicates are counted as extra copies of a (user_id, item_id) pair via a
    partial aggregate (no single-task gather); every other check is a
    conditional count in the same pass over the pair aggregate.
    """
    required = CUSTOMER_REQUIRED if kind == "customer" else OWNER_REQUIRED
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise FeatureValidationError(f"Missing required feature columns: {missing}")
    checks = {
        "negative_ids": (F.col("user_id") < 0) | (F.col("item_id") < 0),
        "negative_scores": F.col("weighted_score") < 0,
    }
    if kind == "customer":
        checks["null_user_ids"] = F.col("user_id").isNull()
        checks["null_item_ids"] = F.col("item_id").isNull()
        checks["negative_recency"] = F.col("recency_days") < 0
    else:
        if "avg_procurement_quantity" in df.columns:
            checks["negative_quantity"] = F.col("avg_procurement_quantity") < 0
        checks["negative_interval"] = F.col("avg_procurement_interval_days") < 0
    flags = df.select("user_id", "item_id", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    per_pair = dealt(flags, ["user_id", "item_id"], rows).groupBy("user_id", "item_id").agg(
        F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in checks])
    return per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_pairs"),
        *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in checks])


def assert_valid(df: DataFrame, kind: str) -> bool:
    row = validation_counts(df, kind).first().asDict()
    bad = {k: v for k, v in row.items() if k != "row_count" and v}
    if bad:
        raise FeatureValidationError(f"{kind} feature validation failed: {bad}")
    return True


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """``dropna`` (any null, optionally over a subset)."""
    return df.na.drop("any", subset=subset)
