"""Weekly demand forecasting: Monday week grid, lags, baselines, ridge fit, next-week forecast.

The ridge model is fitted from one aggregate of the normal-equation moments
(sum x x^T, sum x, sum x y, sum y, n); only that 6x6 system reaches the
driver. Sums by pair and week (``pair_weeks``) are all that the fit and the
predictions read of the events; kept once, they serve both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage, dealt, sent
from tidewater.functions import (
    CYCLE_MAX, CYCLE_MIN, CYCLE_SINGLE, DEFAULT_MEAN_QTY, FORECAST_FEATURES, RIDGE_ALPHA,
    days_between, scalar_max, week_start,
)

TS = "interaction_timestamp"
PROCUREMENT = ("purchase", "reorder")
#: Tasks that a pair's events are counted in.
SHARES = 16


def procurements(events: DataFrame) -> DataFrame:
    return events.where(F.col("interaction_type").isin(*PROCUREMENT))


def weekly_demand(events: DataFrame) -> DataFrame:
    """(user_id, item_id, week, quantity) summed over purchase/reorder, weeks start Monday."""
    return (procurements(events).withColumn("week", week_start(F.col(TS)))
            .groupBy("user_id", "item_id", "week").agg(F.sum("quantity").cast("long").alias("quantity")))


def pair_weeks(events: DataFrame, rows: int | None = None, times: bool = False) -> DataFrame:
    """(user_id, item_id, week, demand, procured, total, n): sums by pair and week over procurements and over all events.

    ``rows``: about the number of events, where known; tasks are then dealt by it, a frequent pair's events over ``SHARES``.
    With ``times`` also the first and last time of procurements and the last of all events.
    """
    pair, bought = ["user_id", "item_id"], F.col("interaction_type").isin(*PROCUREMENT)
    ev = events.select(*pair, week_start(F.col(TS)).alias("week"), "quantity", F.coalesce(bought, F.lit(False)).alias("bought"),
                       F.pmod(F.xxhash64(TS, "quantity"), F.lit(SHARES)).cast("tinyint").alias("share"), *([TS] if times else []))
    sums = [F.sum(F.when(F.col("bought"), F.col("quantity"))).alias("demand"), F.count_if("bought").alias("procured"), F.sum("quantity").alias("total"), F.count("quantity").alias("n")]
    again = [F.sum(c).alias(c) for c in ("demand", "procured", "total", "n")]
    if times:
        sums += [F.min(F.when(F.col("bought"), F.col(TS))).alias("first_ts"), F.max(F.when(F.col("bought"), F.col(TS))).alias("last_purchase"), F.max(TS).alias("last_ts")]
        again += [F.min("first_ts").alias("first_ts"), F.max("last_purchase").alias("last_purchase"), F.max("last_ts").alias("last_ts")]
    if rows is None:
        return ev.groupBy(*pair, "week").agg(*sums)
    part = dealt(ev, [*pair, "share"], rows).groupBy(*pair, "week", "share").agg(*sums)
    return dealt(part, pair, rows).groupBy(*pair, "week").agg(*again)


def _active(weeks: DataFrame) -> DataFrame:
    """Active weeks (``w_0``, ``q_0``) of a pair with the three before (``w_i``, ``q_i``), the next and the first one, and the pair's mean
    (``owner_mean_qty``)."""
    known = F.col("user_id").isNotNull() & F.col("item_id").isNotNull()  # rows without a key join no demand and no mean
    w = Window.partitionBy("user_id", "item_id").orderBy("week")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = weeks.withColumn("owner_mean_qty", F.when(known, F.sum("total").over(all_) / F.nullif(F.sum("n").over(all_), F.lit(0))))
    a = a.where((F.col("procured") > 0) & F.col("week").isNotNull())
    a = a.select("user_id", "item_id", "owner_mean_qty", F.col("week").alias("w_0"), F.when(known, F.coalesce(F.col("demand").cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("double").alias("q_0"))
    w = Window.partitionBy("user_id", "item_id").orderBy("w_0")
    back = [F.lag(c, i).over(w).alias(f"{c[0]}_{i}") for i in (1, 2, 3) for c in ("w_0", "q_0")]
    return a.select("*", *back, F.lead("w_0").over(w).alias("next"), F.first("w_0").over(w).alias("first"))


def _demand_at(day: Column, back: int) -> Column:
    """Demand on ``day``, a Monday that no active week but ``w_0`` and the ``back`` before it can be."""
    out = F.lit(0.0)
    for i in reversed(range(back + 1)):
        out = F.when(F.col(f"w_{i}") == day, F.col(f"q_{i}")).otherwise(out)
    return out


def _grid(weeks: DataFrame) -> DataFrame:
    """Every week of a pair from its first to its last active one, with lags and the pair's mean (``owner_mean_qty``).

    Only active weeks are sorted. Each spans the idle weeks up to the next one, and no lag of these reaches further back than
    three active weeks, so a row of the grid comes from one row of the window; grid rows are neither shuffled nor sorted.
    """
    a = _active(weeks)
    g = a.withColumn("week", F.explode(F.sequence("w_0", F.coalesce(F.date_sub("next", 7), F.col("w_0")), F.expr("INTERVAL 7 DAYS"))))

    def at(k: int) -> Column:
        day = F.date_sub("week", 7 * k)
        return F.when(day >= F.col("first"), _demand_at(day, k))

    lags = [at(k).alias(f"lag_{k}") for k in (1, 2, 3)]
    g = g.select("user_id", "item_id", "week", at(0).alias("quantity"), *lags, "owner_mean_qty")
    total = sum((F.coalesce(f"lag_{k}", F.lit(0.0)) for k in (1, 2, 3)), F.lit(0.0))
    full = sum((F.col(f"lag_{k}").isNotNull().cast("int") for k in (1, 2, 3)), F.lit(0))
    return g.withColumn("rolling_mean_3", total / F.nullif(full, F.lit(0)))


def weekly_lags(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Dense Monday grid per pair (first..last active week), lags 1-3, rolling mean of lag_1.

    Weeks per pair are bounded by the date range, so the per-pair window
    sorts a bounded number of rows however hot the pair is.
    """
    return _grid(pair_weeks(events, rows)).select("user_id", "item_id", "week", "quantity", "lag_1", "lag_2", "lag_3", "rolling_mean_3")


def demand_baselines(events: DataFrame) -> DataFrame:
    """Mean quantity per (user, item) and per item over all interaction types."""
    pair = events.groupBy("user_id", "item_id").agg(F.avg("quantity").alias("owner_mean_qty"))
    item = events.groupBy("item_id").agg(F.avg("quantity").alias("material_mean_qty"))
    return pair.join(item, "item_id").select("user_id", "item_id", "owner_mean_qty", "material_mean_qty")


def _by_pair(weeks: DataFrame) -> DataFrame:
    """``weeks`` (counted, so best checkpointed) dealt by pair for windows over them."""
    return dealt(weeks, ["user_id", "item_id"], weeks.count())


def item_means(weeks: DataFrame) -> DataFrame:
    """(item_id, material_mean_qty) over all events of ``pair_weeks``; with times also the last one (``last_ts``)."""
    last = [F.max("last_ts").alias("last_ts")] if "last_ts" in weeks.columns else []
    return weeks.groupBy("item_id").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("material_mean_qty"), *last)


def _with_item_mean(history: DataFrame, weeks: DataFrame) -> DataFrame:
    """``history`` with the item's mean as ``im``; pairs, of which there are many, stay where they are if items are few."""
    means = cut_lineage(item_means(weeks).select("item_id", F.col("material_mean_qty").alias("im")))
    return history.join(sent(means), "item_id", "left")


def training_set(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Weekly samples with complete lags plus pair / item baselines (default 10.0). ``rows`` as in ``pair_weeks``."""
    weeks = cut_lineage(pair_weeks(events, rows))  # read for the grid and for the items' means
    item = item_means(weeks)
    t = _grid(dealt(weeks, ["user_id", "item_id"], None if rows is None else weeks.count()))
    t = t.where(F.col("lag_3").isNotNull()).join(item, "item_id", "left")
    return t.select("user_id", "item_id", "week", "lag_1", "lag_2", "lag_3", "rolling_mean_3",
                    F.coalesce("owner_mean_qty", F.lit(DEFAULT_MEAN_QTY)).alias("owner_mean_qty"),
                    F.coalesce("material_mean_qty", F.lit(DEFAULT_MEAN_QTY)).alias("material_mean_qty"),
                    "quantity")


def ridge_moments(samples: DataFrame, features=FORECAST_FEATURES, label: str = "quantity") -> DataFrame:
    """One-row aggregate of the sums needed by the normal equations."""
    aggs = [F.count("*").alias("n"), F.sum(label).alias("sy")]
    for i, a in enumerate(features):
        aggs.append(F.sum(a).alias(f"s_{a}"))
        aggs.append(F.sum(F.col(a) * F.col(label)).alias(f"sy_{a}"))
        for b in features[i:]:
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}__{b}"))
    return samples.agg(*aggs)


def solve_ridge(m: dict, features=FORECAST_FEATURES, alpha: float = RIDGE_ALPHA) -> tuple[float, list[float]]:
    """Centered ridge with unpenalised intercept; fewer than 5 samples -> predict the mean."""
    n = int(m["n"] or 0)
    if n < 5:
        return (float(m["sy"]) / n if n else DEFAULT_MEAN_QTY), [0.0] * len(features)
    p = len(features)
    sx = np.array([m[f"s_{a}"] for a in features], dtype=float)
    sxy = np.array([m[f"sy_{a}"] for a in features], dtype=float)
    xx = np.zeros((p, p))
    for i, a in enumerate(features):
        for j in range(i, p):
            xx[i, j] = xx[j, i] = m[f"s_{a}__{features[j]}"]
    mx, my = sx / n, float(m["sy"]) / n
    a_mat = xx - n * np.outer(mx, mx) + alpha * np.eye(p)
    b_vec = sxy - n * mx * my
    coef = np.linalg.solve(a_mat, b_vec)
    return float(my - mx @ coef), [float(c) for c in coef]


def fit_demand(events: DataFrame, weeks: DataFrame | None = None) -> tuple[float, list[float]]:
    """D2 fit from the sparse moment computation (equal to the dense training-set moments). ``weeks``: the events' ``pair_weeks``, where kept."""
    row = sparse_training_moments(events, weeks).first().asDict()
    return solve_ridge(row)


def pair_history(weeks: DataFrame) -> DataFrame:
    """One row a pair of ``pair_weeks``: demand of its last three dense weeks (``lag_1`` .. 3, null without procurements), the mean ``pm``
    over all events, and with times the first and last procurement and their number.

    lag_k = demand of the week (last active week - 7(k-1) days), 0 if idle: no grid needed. Weeks are best dealt by pair.
    """
    pair, bought = ["user_id", "item_id"], F.col("procured") > 0
    last = F.max(F.when(bought, F.col("week"))).over(Window.partitionBy(*pair))
    gap = F.datediff(last, F.col("week"))
    h = weeks.withColumn("gap", F.when(bought, gap))
    lags = [F.when(F.max(bought), F.coalesce(F.sum(F.when(F.col("gap") == 7 * (k - 1), F.col("demand").cast("long"))), F.lit(0))).cast("double").alias(f"lag_{k}")
            for k in (1, 2, 3)]
    times = []
    if "last_purchase" in weeks.columns:
        times = [F.min("first_ts").alias("first_ts"), F.max("last_purchase").alias("last_purchase"),
                 F.sum(F.when(F.col("week").isNotNull(), F.col("procured")).otherwise(F.lit(0))).alias("n_purchases")]
    return h.groupBy(*pair).agg(*lags, (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("pm"), *times)


def with_features(history: DataFrame) -> DataFrame:
    """``history`` (lag_1 .. 3, pair mean ``pm``, item mean ``im``) with the model's features."""
    return history.withColumns({
        "rolling_mean_3": (F.col("lag_1") + F.col("lag_2") + F.col("lag_3")) / 3.0,
        "owner_mean_qty": F.coalesce("pm", F.lit(DEFAULT_MEAN_QTY)),
        "material_mean_qty": F.coalesce("im", F.lit(DEFAULT_MEAN_QTY))})


def forecast_features(events: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """W6/D3 inputs per pair with procurement history: last three dense weeks (0-padded) and baselines."""
    weeks = cut_lineage(pair_weeks(events)) if weeks is None else weeks
    h = pair_history(_by_pair(weeks)).where(F.col("lag_1").isNotNull() & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    return with_features(_with_item_mean(h, weeks)).select("user_id", "item_id", *FORECAST_FEATURES)


def linear(intercept: float, coef: list[float], features=FORECAST_FEATURES) -> Column:
    e = F.lit(intercept)
    for c, f in zip(coef, features):
        e = e + F.lit(c) * F.col(f)
    return e


def with_forecast(history: DataFrame, model: tuple[float, list[float]]) -> DataFrame:
    """``history`` (lag_1 .. 3, ``pm``, ``im``) with ``forecast_qty``: max(0, model) with history, else pair mean -> item mean -> 10."""
    pred = F.greatest(F.lit(0.0), linear(*model))
    cold = F.coalesce(F.col("pm"), F.col("im"), F.lit(DEFAULT_MEAN_QTY))
    return with_features(history).withColumn("forecast_qty", F.when(F.col("lag_1").isNotNull(), pred).otherwise(cold))


def forecast_next_week(events: DataFrame, pairs: DataFrame | None, model: tuple[float, list[float]], weeks: DataFrame | None = None) -> DataFrame:
    """D3 for every requested (user_id, item_id): max(0, model) with history, else pair mean -> item mean -> 10.

    Without ``pairs``, for every pair of the events that has both keys. ``weeks``: the events' ``pair_weeks``, where kept.
    """
    weeks = cut_lineage(pair_weeks(events)) if weeks is None else weeks
    h = pair_history(_by_pair(weeks)).where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    if pairs is not None:
        h = pairs.select("user_id", "item_id").distinct().join(h, ["user_id", "item_id"], "left")
    return with_forecast(_with_item_mean(h, weeks), model).select("user_id", "item_id", "forecast_qty")


def with_cycle(history: DataFrame) -> DataFrame:
    """``history`` (first_ts, last_purchase, n_purchases) with ``cycle_days``: mean gap clamped to [3, 90], 21 for one purchase."""
    mean_gap = days_between(F.col("first_ts"), F.col("last_purchase")) / (F.col("n_purchases") - 1)
    cyc = F.when(F.col("n_purchases") >= 2, F.least(F.lit(CYCLE_MAX), F.greatest(F.lit(CYCLE_MIN), mean_gap))).otherwise(F.lit(CYCLE_SINGLE))
    return history.withColumn("cycle_days", cyc)


def with_urgency(cycles: DataFrame, newest: Column) -> DataFrame:
    """``cycles`` with ``days_elapsed`` (floor days from the last purchase to ``newest``) and ``urgency``, clamp(elapsed / cycle, 0, 1)."""
    c = cycles.withColumn("days_elapsed", F.floor(days_between(F.col("last_purchase"), newest)).cast("long"))
    return c.withColumn("urgency", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("days_elapsed") / F.col("cycle_days"))))


def reorder_cycles(events: DataFrame) -> DataFrame:
    """Per pair with purchases/reorders: mean gap (days) clamped to [3, 90], 21 for one purchase; last ts.

    Mean of consecutive gaps = (last - first) / (n - 1): a partial aggregate.
    """
    g = procurements(events).groupBy("user_id", "item_id").agg(
        F.min(TS).alias("first_ts"), F.max(TS).alias("last_purchase"), F.count(TS).alias("n_purchases"))
    return with_cycle(g).select("user_id", "item_id", "n_purchases", "last_purchase", "cycle_days")


def reorder_urgency(events: DataFrame) -> DataFrame:
    """R6 urgency: elapsed = floor days from last purchase to the dataset max; clamp(elapsed / cycle, 0, 1)."""
    return with_urgency(reorder_cycles(events), scalar_max(events, TS))


def sparse_training_moments(events: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """Exactly ``ridge_moments(training_set(events))`` without materialising the dense week grid.

    A kept grid row t (t >= first week + 3 weeks) has x = (q[t-1], q[t-2], q[t-3],
    their mean, pair mean, item mean) and y = q[t] (weeks as steps). Only the weeks up to
    three after an active one can be non-zero in the first four features or y; the
    idle ones from there to the next active week are (0,0,0,0,pm,im) with y = 0 and go in as
    one row with their number. All come from one row of the window, so work is proportional to
    active weeks, of which one row each is shuffled once; an item's mean goes into its row of sums.
    ``weeks``: the events' ``pair_weeks``, where kept.
    """
    weeks = cut_lineage(pair_weeks(events)) if weeks is None else weeks  # read for the sums and for the items' means
    last = F.coalesce(F.date_sub("next", 7), F.col("w_0"))  # the last week before the next active one
    a = _active(_by_pair(weeks)).withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(4))))
    a = a.withColumn("t", F.expr("date_add(w_0, 7 * ahead)")).where((F.col("t") <= last) & (F.col("t") >= F.date_add("first", 21)))
    idle = F.col("ahead") == 4
    lag = lambda k: F.when(idle, F.lit(0.0)).otherwise(_demand_at(F.date_sub("t", 7 * k), k))
    a = a.select("item_id", F.when(idle, F.datediff(last, "t") / 7 + 1).otherwise(F.lit(1.0)).alias("c"),
                 *[lag(k).alias(f"lag_{k}") for k in (1, 2, 3)], F.coalesce("owner_mean_qty", F.lit(DEFAULT_MEAN_QTY)).alias("owner_mean_qty"),
                 lag(0).alias("quantity"))
    per_row = [f for f in FORECAST_FEATURES if f != "material_mean_qty"]
    a = a.withColumn("rolling_mean_3", (F.col("lag_1") + F.col("lag_2") + F.col("lag_3")) / 3.0)
    sums = [F.sum("c").alias("n"), F.sum("quantity").alias("sy")]  # no idle week has a quantity
    for i, f in enumerate(per_row):
        sums += [F.sum(F.col("c") * F.col(f)).alias(f"s_{f}"), F.sum(F.col(f) * F.col("quantity")).alias(f"sy_{f}")]
        sums += [F.sum(F.col("c") * F.col(f) * F.col(g)).alias(f"s_{f}__{g}") for g in per_row[i:]]
    by_item = a.groupBy("item_id").agg(*sums).join(item_means(weeks), "item_id", "left")
    m = F.coalesce("material_mean_qty", F.lit(DEFAULT_MEAN_QTY))

    def total(name: str) -> Column:
        means = name.count("material_mean_qty")
        if not means:
            return F.col(name)
        rest = {f"s_{f}__material_mean_qty": f"s_{f}" for f in per_row} | {"sy_material_mean_qty": "sy"}
        return F.col(rest.get(name, "n")) * (m * m if means == 2 else m)

    names = ["n", "sy"]
    for i, f in enumerate(FORECAST_FEATURES):
        names += [f"s_{f}", f"sy_{f}", *[f"s_{f}__{g}" for g in FORECAST_FEATURES[i:]]]
    out = by_item.agg(*[F.coalesce(F.sum(total(c)), F.lit(0.0)).alias(c) for c in names])
    return out.withColumn("n", F.col("n").cast("long"))
