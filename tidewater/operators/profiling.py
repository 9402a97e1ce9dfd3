"""Profiling / EDA aggregates (everything the reference plotted or dumped, as tables)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


SAMPLES = 10


def _kind(f: T.StructField) -> str:
    if isinstance(f.dataType, NUMERIC):
        return "numeric"
    if isinstance(f.dataType, DATETIME) or "timestamp" in f.name.lower() or "date" in f.name.lower():
        return "datetime"
    return "text_or_other"


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: nulls, %, exact distinct count, numeric or datetime stats, samples.

    One plain aggregate gives all but the distinct counts. Distinct values are
    taken column by column, each from a scan of its own column alone, so no
    row is multiplied by the number of columns; of them the count and, for
    text, the ``SAMPLES`` least go on. Text columns named after a timestamp or
    date get the range of the values that are one ("datetime_invalid": none).
    """
    aggs = [F.count("*").alias("__n")]
    kinds = {f.name: _kind(f) for f in df.schema.fields}
    when = lambda c: F.col(c).try_cast("timestamp_ntz")
    for c, k in kinds.items():
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if k == "numeric":
            x = F.col(c).cast("double")
            aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.avg(x).alias(f"{c}__mean"),
                     F.stddev_samp(x).alias(f"{c}__std")]
        if k == "datetime":
            aggs += [F.min(when(c)).alias(f"{c}__tmin"), F.max(when(c)).alias(f"{c}__tmax")]
    a = df.agg(*aggs)
    rows, found = [], None
    for c, k in kinds.items():
        num, dt = k == "numeric", k == "datetime"
        tmin = F.col(f"{c}__tmin") if dt else F.lit(None).cast("timestamp_ntz")
        tmax = F.col(f"{c}__tmax") if dt else F.lit(None).cast("timestamp_ntz")
        name = F.when(tmin.isNull() & (F.col("__n") > 0), F.lit("datetime_invalid")).otherwise(F.lit(k)) if dt else F.lit(k)
        rows.append(F.struct(
            F.lit(c).alias("column_name"), name.alias("data_type"),
            F.col(f"{c}__nulls").alias("null_count"),
            F.when(F.col("__n") > 0, F.col(f"{c}__nulls") * 100.0 / F.col("__n")).alias("null_percentage"),
            *[(F.col(f"{c}__{s}") if num else F.lit(None).cast("double")).alias(s) for s in ("min", "max", "mean", "std")],
            tmin.alias("min_timestamp"), tmax.alias("max_timestamp"),
            (F.floor((tmax - tmin).cast("interval second").cast("decimal(24,6)") / 86400).cast("double") if dt
             else F.lit(None).cast("double")).alias("range_days")))
        one = distinct_values(df, c, k == "text_or_other")
        found = one if found is None else found.unionByName(one)
    out = a.select(F.explode(F.array(*rows)).alias("r")).select("r.*").join(found, "column_name")
    return out.select("column_name", "data_type", "null_count", "null_percentage", "unique_values_count", "min", "max", "mean", "std",
                      "min_timestamp", "max_timestamp", "range_days", "unique_samples")


def distinct_values(df: DataFrame, c: str, samples: bool) -> DataFrame:
    """(column_name, unique_values_count, unique_samples): exact, the least values joined by ``|``."""
    values = df.select(F.col(c).alias("v")).where(F.col("v").isNotNull()).distinct()
    out = values.agg(F.lit(c).alias("column_name"), F.count("*").alias("unique_values_count"))
    if not samples:
        return out.withColumn("unique_samples", F.lit(None).cast("string"))
    least = values.select(F.col("v").cast("string").alias("v")).orderBy("v").limit(SAMPLES).agg(F.array_sort(F.collect_list("v")).alias("s"))
    return out.withColumn("unique_samples", least.select(F.when(F.size("s") > 0, F.array_join("s", "|"))).scalar())


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows (extra copies of identical rows) and their percentage."""
    g = df.groupBy(*df.columns).agg(F.count("*").alias("c"))
    return g.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("total_rows"),
                 F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicate_rows")).select(
        "total_rows", "duplicate_rows",
        F.when(F.col("total_rows") > 0, F.col("duplicate_rows") * 100.0 / F.col("total_rows")).otherwise(0.0).alias("duplicate_percentage"))


def signal_counts(events: DataFrame) -> DataFrame:
    """Totals, exact distinct users/items/categories, sparsity = 1 - n/(users*items).

    Each distinct count reads its own column; rows are not multiplied."""
    held = lambda c: events.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*")).scalar()
    a = events.agg(F.count("*").alias("total_interactions"))
    for c, name in (("user_id", "unique_users"), ("item_id", "unique_items"), ("category", "unique_categories")):
        a = a.withColumn(name, held(c))
    cells = F.col("unique_users") * F.col("unique_items")
    return a.withColumn("sparsity_ratio", F.when(cells > 0, 1 - F.col("total_interactions") / cells).otherwise(F.lit(1.0)))


def signal_distribution(events: DataFrame) -> DataFrame:
    """Counts and percentage per (user_type, interaction_type)."""
    g = events.groupBy("user_type", "interaction_type").agg(F.count("*").alias("n"))
    tot = F.sum("n").over(Window.partitionBy("user_type"))  # one row per type: tiny window
    return g.select("user_type", "interaction_type", "n", (F.col("n") * 100.0 / tot).alias("percentage"))


def repeat_purchase_rate(events: DataFrame) -> DataFrame:
    """Purchase pairs bought more than once and reorder_rate = pairs / purchases * 100."""
    p = events.where(F.lower("interaction_type") == "purchase").groupBy("user_id", "item_id").agg(F.count("*").alias("c"))
    a = p.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("purchases_count"),
              F.count_if(F.col("c") > 1).alias("repeated_purchases_count"))
    return a.withColumn("reorder_rate", F.when(F.col("purchases_count") > 0,
                                               F.col("repeated_purchases_count") * 100.0 / F.col("purchases_count")).otherwise(0.0))


def top_n(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """Value counts, top n by count then key (TakeOrderedAndProject)."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), F.col(key).asc()).limit(n)


def activity_heatmap(events: DataFrame, ts: str = "interaction_timestamp") -> DataFrame:
    """Weekday x hour counts, 24 fixed hour columns zero-filled, Monday first."""
    e = events.select(F.date_format(ts, "EEEE").alias("weekday"), ((F.dayofweek(ts) + 5) % 7).alias("weekday_index"),
                      F.hour(ts).alias("hour"))
    p = e.groupBy("weekday", "weekday_index").pivot("hour", list(range(24))).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("weekday", "weekday_index", *[F.col(str(h)).cast("long").alias(f"h{h:02d}") for h in range(24)])


def null_counts(df: DataFrame) -> DataFrame:
    a = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"))
                                        for c in df.columns])).alias("r")).select("r.*")


#: Bins of one pass of ``order_statistics``.
BINS = 1024


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values at these places (from 0) of the sorted non-null ``col``, exact.

    Each place keeps a bracket of values. A pass counts the rows of all brackets in ``BINS`` equal bins
    each, with the least and greatest value of a bin, and the bin of the place becomes its bracket; a
    bracket of one value is the answer. Passes grow with the digits of the values, not with the rows, and
    a task holds at most ``BINS`` counts a place.
    """
    x = F.col(col).cast("double")
    ends = df.where(x.isNotNull()).agg(F.min(x), F.max(x)).first()
    todo = {r: (ends[0], ends[1], 0) for r in set(ranks)}  # bracket, and rows below it
    out = {}
    while todo:
        for r in [r for r, (lo, hi, _) in todo.items() if lo == hi]:
            out[r] = todo.pop(r)[0]
        if not todo:
            break
        brackets = {(lo, hi) for lo, hi, _ in todo.values()}
        # halves keep the width finite for any two finite ends
        slots = [F.when(x.between(lo, hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.least(F.lit(BINS - 1), F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)).alias("bin"), x.alias("x"))) for lo, hi in sorted(brackets)]
        rows = df.where(x.isNotNull()).select(F.explode(F.array_compact(F.array(*slots))).alias("s")).select("s.*")
        bins = rows.groupBy("lo", "hi", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()  # at most BINS rows a bracket
        for r, (lo, hi, below) in list(todo.items()):
            for b in sorted((b for b in bins if (b["lo"], b["hi"]) == (lo, hi)), key=lambda b: b["bin"]):
                if r < below + b["n"]:
                    todo[r] = (b["a"], b["b"], below)
                    break
                below += b["n"]
    return out


def describe(df: DataFrame, col: str) -> DataFrame:
    """count/mean/std/min/quartiles/max (linear-interpolated quartiles, as pandas describe)."""
    df = cut_lineage(df.select(col))
    x = F.col(col)
    a = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    last = a.first()["count"] - 1
    places = [q * last for q in (0.25, 0.5, 0.75)]
    at = order_statistics(df, col, [r for p in places for r in (math.floor(p), math.ceil(p))]) if last >= 0 else {}
    for name, p in zip(("p25", "p50", "p75"), places):
        low, high = at.get(math.floor(p)), at.get(math.ceil(p))
        a = a.withColumn(name, F.lit(None if low is None else low + (high - low) * (p - math.floor(p))).cast("double"))
    return a.select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin)."""
    lo = df.agg(F.min(col)).scalar()
    hi = df.agg(F.max(col)).scalar()
    b = F.least(F.width_bucket(F.col(col), lo, hi, F.lit(bins)), F.lit(bins))
    b = F.when(hi == lo, F.lit(1)).otherwise(b)
    g = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return g.select(F.col("bin").cast("long").alias("bin"), "n")


def boxplot_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, 1.5 IQR whisker bounds (clipped to data) and outlier count.

    One scan: everything follows from the counts of the distinct values.
    """
    v = cut_lineage(df.groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n")))
    q = v.where(F.col("v").isNotNull()).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q")).scalar()
    q1, med, q3 = (F.get(q, F.lit(i)) for i in range(3))
    inside = (F.col("v") >= q1 - 1.5 * (q3 - q1)) & (F.col("v") <= q3 + 1.5 * (q3 - q1))
    return v.agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
                 F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("long").alias("outliers")).select(
        q1.alias("q1"), med.alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"), "whisker_low", "whisker_high", "outliers")
