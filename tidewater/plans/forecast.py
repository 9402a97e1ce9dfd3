"""Forecasting queries on view D (supplier x category weekly series) and reorder cycles on view OK."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import FORECAST_FEATURES, RIDGE_ALPHA, r4, r6
from tidewater.operators import forecasting as fc
from tidewater.plans.registry import query
from tidewater.plans.sqlviews import days_sql, with_views
from tidewater.session import cut_lineage
from tidewater.sources import views as V

DV = with_views("D")
WK_SQL = """
WK AS (SELECT user_id, item_id, CAST(date_trunc('week', interaction_timestamp) AS DATE) AS week, CAST(sum(quantity) AS BIGINT) AS quantity
       FROM D WHERE interaction_type IN ('purchase', 'reorder') GROUP BY 1, 2, 3)
"""
LAG_SQL = WK_SQL + """,
SPAN AS (SELECT user_id, item_id, min(week) AS w0, max(week) AS w1 FROM WK GROUP BY 1, 2),
GRID AS (SELECT user_id, item_id, CAST(unnest(generate_series(CAST(w0 AS TIMESTAMP), CAST(w1 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM SPAN),
G AS (SELECT g.user_id, g.item_id, g.week, CAST(COALESCE(w.quantity, 0) AS DOUBLE) AS quantity
      FROM GRID g LEFT JOIN WK w USING (user_id, item_id, week)),
L0 AS (SELECT *, lag(quantity, 1) OVER w AS lag_1, lag(quantity, 2) OVER w AS lag_2, lag(quantity, 3) OVER w AS lag_3
       FROM G WINDOW w AS (PARTITION BY user_id, item_id ORDER BY week)),
LAGS AS (SELECT *, avg(lag_1) OVER (PARTITION BY user_id, item_id ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean_3 FROM L0)
"""
BASE_SQL = """
PM AS (SELECT user_id, item_id, avg(quantity) AS owner_mean_qty FROM D GROUP BY 1, 2),
IM AS (SELECT item_id, avg(quantity) AS material_mean_qty FROM D GROUP BY 1)
"""
TRAIN_SQL = LAG_SQL + ", " + BASE_SQL + """,
TS AS (SELECT l.user_id, l.item_id, l.week, l.lag_1, l.lag_2, l.lag_3, l.rolling_mean_3,
              COALESCE(pm.owner_mean_qty, 10.0) AS owner_mean_qty, COALESCE(im.material_mean_qty, 10.0) AS material_mean_qty, l.quantity
       FROM LAGS l LEFT JOIN PM pm USING (user_id, item_id) LEFT JOIN IM im USING (item_id)
       WHERE l.lag_1 IS NOT NULL AND l.lag_2 IS NOT NULL AND l.lag_3 IS NOT NULL AND l.quantity IS NOT NULL)
"""


def _weeks(spark, sf, events):
    """Sums by pair and week, kept: read for the fit, the pairs and the items' means."""
    return cut_lineage(fc.pair_weeks(events, V.lines(spark, sf)))


def _wk(df):
    return df.withColumn("week", F.col("week").cast("string"))


@query("weekly_demand", DV + ", " + WK_SQL + "SELECT user_id, item_id, CAST(week AS VARCHAR) AS week, quantity FROM WK")
def weekly_demand(spark, sf):
    return _wk(fc.weekly_demand(V.demand_interactions(spark, sf)))


@query("weekly_lags", DV + ", " + LAG_SQL + """
SELECT user_id, item_id, CAST(week AS VARCHAR) AS week, quantity, lag_1, lag_2, lag_3, round(rolling_mean_3, 6) AS rolling_mean_3 FROM LAGS""")
def weekly_lags(spark, sf):
    return _wk(fc.weekly_lags(V.demand_interactions(spark, sf), V.lines(spark, sf)).withColumn("rolling_mean_3", r6(F.col("rolling_mean_3"))))


@query("demand_baselines", DV + ", " + BASE_SQL + """
SELECT pm.user_id, pm.item_id, round(pm.owner_mean_qty, 6) AS owner_mean_qty, round(im.material_mean_qty, 6) AS material_mean_qty
FROM PM pm JOIN IM im USING (item_id)""")
def demand_baselines(spark, sf):
    b = fc.demand_baselines(V.demand_interactions(spark, sf))
    return b.select("user_id", "item_id", r6(F.col("owner_mean_qty")).alias("owner_mean_qty"),
                    r6(F.col("material_mean_qty")).alias("material_mean_qty"))


@query("forecast_training_set", DV + ", " + TRAIN_SQL + """
SELECT user_id, item_id, CAST(week AS VARCHAR) AS week, lag_1, lag_2, lag_3, round(rolling_mean_3, 6) AS rolling_mean_3,
       round(owner_mean_qty, 6) AS owner_mean_qty, round(material_mean_qty, 6) AS material_mean_qty, quantity FROM TS""")
def forecast_training_set(spark, sf):
    t = _wk(fc.training_set(V.demand_interactions(spark, sf), V.lines(spark, sf)))
    return t.select(*[r6(F.col(c)).alias(c) if c in ("rolling_mean_3", "owner_mean_qty", "material_mean_qty") else F.col(c)
                      for c in t.columns])


def _moments_sql() -> str:
    cols = ["count(*) AS n", "round(sum(quantity), 0) AS sy"]
    for i, a in enumerate(FORECAST_FEATURES):
        cols.append(f"round(sum({a}), 0) AS s_{a}")
        cols.append(f"round(sum({a} * quantity), 0) AS sy_{a}")
        for b in FORECAST_FEATURES[i:]:
            cols.append(f"round(sum({a} * {b}), 0) AS s_{a}__{b}")
    return DV + ", " + TRAIN_SQL + "SELECT " + ", ".join(cols) + " FROM TS"


@query("forecast_ridge_moments", _moments_sql())
def forecast_ridge_moments(spark, sf):
    d = V.demand_interactions(spark, sf)
    m = fc.sparse_training_moments(d, _weeks(spark, sf, d))
    return m.select(*[F.col(c) if c == "n" else F.round(F.col(c), 0).alias(c) for c in m.columns])


def ridge_ctes(samples: str = "TS") -> str:
    """RIDGE(b0, c_0 ... c_5): centred ridge by Gauss-Jordan elimination, one one-row step a feature."""
    f, p = FORECAST_FEATURES, len(FORECAST_FEATURES)
    cols = ["avg(quantity) AS my", *[f"avg({a}) AS m_{i}" for i, a in enumerate(f)]]
    for i, a in enumerate(f):
        cols += [f"sum({a} * {b}) - count(*) * avg({a}) * avg({b}) + {RIDGE_ALPHA if i == j else 0.0} AS a_{i}_{j}" for j, b in enumerate(f)]
        cols.append(f"sum({a} * quantity) - count(*) * avg({a}) * avg(quantity) AS b_{i}")
    steps = [f"E0 AS (SELECT {', '.join(cols)} FROM {samples})"]
    keep = ["my", *[f"m_{i}" for i in range(p)]]
    for k in range(p):
        cols = list(keep)
        for i in range(p):
            for j, (name, pivot) in enumerate([*[(f"a_{i}_{j}", f"a_{k}_{j}") for j in range(p)], (f"b_{i}", f"b_{k}")]):
                cols.append(f"{pivot} / a_{k}_{k} AS {name}" if i == k else f"{name} - a_{i}_{k} * {pivot} / a_{k}_{k} AS {name}")
        steps.append(f"E{k + 1} AS (SELECT {', '.join(cols)} FROM E{k})")
    mean = " - ".join(["my", *[f"m_{i} * b_{i}" for i in range(p)]])
    steps.append(f"RIDGE AS (SELECT {mean} AS b0, {', '.join(f'b_{i} AS c_{i}' for i in range(p))} FROM E{p})")
    return ",\n".join(steps)


RIDGE_SQL = TRAIN_SQL + ", " + ridge_ctes()
NEXT_SQL = """
LW AS (SELECT user_id, item_id, max(week) AS last_week FROM WK GROUP BY 1, 2),
LG AS (SELECT w.user_id, w.item_id,
              CAST(COALESCE(sum(CASE WHEN date_diff('day', w.week, l.last_week) = 0 THEN w.quantity END), 0) AS DOUBLE) AS lag_1,
              CAST(COALESCE(sum(CASE WHEN date_diff('day', w.week, l.last_week) = 7 THEN w.quantity END), 0) AS DOUBLE) AS lag_2,
              CAST(COALESCE(sum(CASE WHEN date_diff('day', w.week, l.last_week) = 14 THEN w.quantity END), 0) AS DOUBLE) AS lag_3
       FROM WK w JOIN LW l USING (user_id, item_id) GROUP BY 1, 2),
NW AS (SELECT pm.user_id, pm.item_id,
              CASE WHEN g.lag_1 IS NULL THEN pm.owner_mean_qty
                   ELSE greatest(0.0, b0 + c_0 * g.lag_1 + c_1 * g.lag_2 + c_2 * g.lag_3 + c_3 * (g.lag_1 + g.lag_2 + g.lag_3) / 3.0
                                      + c_4 * pm.owner_mean_qty + c_5 * im.material_mean_qty) END AS forecast_qty
       FROM PM pm JOIN IM im USING (item_id) LEFT JOIN LG g USING (user_id, item_id) CROSS JOIN RIDGE)
"""


@query("forecast_ridge_fit", DV + ", " + RIDGE_SQL + " SELECT 'intercept' AS term, round(b0, 4) AS coefficient FROM RIDGE" + "".join(
    f" UNION ALL SELECT '{a}', round(c_{i}, 4) FROM RIDGE" for i, a in enumerate(FORECAST_FEATURES)))
def forecast_ridge_fit(spark, sf):
    """Intercept + 6 coefficients from the centred normal equations (driver-side 6x6 solve)."""
    d = V.demand_interactions(spark, sf)
    b0, coef = fc.fit_demand(d, _weeks(spark, sf, d))
    rows = [("intercept", b0)] + list(zip(FORECAST_FEATURES, coef))
    return spark.createDataFrame(rows, "term string, coefficient double").withColumn("coefficient", r4(F.col("coefficient")))


@query("forecast_features", DV + ", " + WK_SQL + ", " + BASE_SQL + """,
LW AS (SELECT user_id, item_id, max(week) AS last_week FROM WK GROUP BY 1, 2),
LG AS (SELECT w.user_id, w.item_id,
              CAST(COALESCE(sum(CASE WHEN date_diff('day', w.week, l.last_week) = 0 THEN w.quantity END), 0) AS DOUBLE) AS lag_1,
              CAST(COALESCE(sum(CASE WHEN date_diff('day', w.week, l.last_week) = 7 THEN w.quantity END), 0) AS DOUBLE) AS lag_2,
              CAST(COALESCE(sum(CASE WHEN date_diff('day', w.week, l.last_week) = 14 THEN w.quantity END), 0) AS DOUBLE) AS lag_3
       FROM WK w JOIN LW l USING (user_id, item_id) GROUP BY 1, 2)
SELECT g.user_id, g.item_id, g.lag_1, g.lag_2, g.lag_3, round((g.lag_1 + g.lag_2 + g.lag_3) / 3.0, 6) AS rolling_mean_3,
       round(COALESCE(pm.owner_mean_qty, 10.0), 6) AS owner_mean_qty, round(COALESCE(im.material_mean_qty, 10.0), 6) AS material_mean_qty
FROM LG g LEFT JOIN PM pm USING (user_id, item_id) LEFT JOIN IM im USING (item_id)""")
def forecast_features(spark, sf):
    d = V.demand_interactions(spark, sf)
    f = fc.forecast_features(d, _weeks(spark, sf, d))
    return f.select(*[r6(F.col(c)).alias(c) if c in ("rolling_mean_3", "owner_mean_qty", "material_mean_qty") else F.col(c)
                      for c in f.columns])


@query("forecast_next_week", DV + ", " + RIDGE_SQL + ", " + NEXT_SQL + "SELECT user_id, item_id, round(forecast_qty, 4) AS forecast_qty FROM NW")
def forecast_next_week(spark, sf):
    """D3 for every observed (supplier, category) pair, model fitted on the same series."""
    d = V.demand_interactions(spark, sf)
    weeks = _weeks(spark, sf, d)
    model = fc.fit_demand(d, weeks)
    return fc.forecast_next_week(d, weeks.select("user_id", "item_id"), model, weeks).withColumn(
        "forecast_qty", r4(F.col("forecast_qty")))


OKV = with_views("OK")
CYC_SQL = f"""
CYC AS (SELECT user_id, item_id, count(interaction_timestamp) AS n_purchases, max(interaction_timestamp) AS last_purchase,
               CASE WHEN count(interaction_timestamp) >= 2 THEN
                 least(90.0, greatest(3.0, {days_sql('min(interaction_timestamp)', 'max(interaction_timestamp)')} / (count(interaction_timestamp) - 1)))
               ELSE 21.0 END AS cycle_days
        FROM OK WHERE interaction_type IN ('purchase', 'reorder') GROUP BY 1, 2)
"""


@query("reorder_cycles", OKV + ", " + CYC_SQL + """
SELECT user_id, item_id, n_purchases, last_purchase, round(cycle_days, 6) AS cycle_days FROM CYC""")
def reorder_cycles(spark, sf):
    return fc.reorder_cycles(V.owner_interactions_k(spark, sf)).withColumn("cycle_days", r6(F.col("cycle_days")))


URG_SQL = CYC_SQL + f""",
URG AS (SELECT *, CAST(floor({days_sql('last_purchase', '(SELECT max(interaction_timestamp) FROM OK)')}) AS BIGINT) AS days_elapsed FROM CYC)
"""


@query("reorder_urgency", OKV + ", " + URG_SQL + """
SELECT user_id, item_id, n_purchases, last_purchase, round(cycle_days, 6) AS cycle_days, days_elapsed,
       round(least(1.0, greatest(0.0, days_elapsed / cycle_days)), 6) AS urgency FROM URG""")
def reorder_urgency(spark, sf):
    u = fc.reorder_urgency(V.owner_interactions_k(spark, sf))
    return u.select("user_id", "item_id", "n_purchases", "last_purchase", r6(F.col("cycle_days")).alias("cycle_days"),
                    "days_elapsed", r6(F.col("urgency")).alias("urgency"))
