"""Fit, forecasts and the raw ranker from sums by pair and week kept once."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import forecasting as fc
from tidewater.operators import rankers as rk
from tidewater.plans import evaluation as pe

SCHEMA = "user_id long, item_id long, interaction_type string, category string, quantity int, price double, interaction_timestamp timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def row(user, item, kind, quantity, week, hour=0):
    at = None if week is None else START + dt.timedelta(days=7 * week, hours=hour)
    return user, item, kind, f"c{item}", quantity, 1.0, at


ROWS = [row(1, 1, "purchase", 3, 0), row(1, 1, "reorder", 4, 1), row(1, 1, "purchase", 2, 9, 30), row(1, 1, "view", 50, 40), row(1, 1, "purchase", 7, 11),
        row(1, 2, "purchase", 5, 2), row(1, 2, "purchase", None, 30), row(2, 1, "reorder", 9, 0), row(2, 1, "reorder", 1, 14), row(2, 1, "reorder", 6, 14, 5),
        row(2, 3, "view", 8, 3), row(3, 2, "purchase", 4, None), row(None, 2, "purchase", 11, 1), row(None, 2, "purchase", 12, 20), row(4, 1, "view", None, 5)]


@pytest.fixture()
def events(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def unread(events):
    """The same columns, but an error if a row is read."""
    return events.withColumn("quantity", F.raise_error(F.lit("events were read again")).cast("int")).withColumn("user_id", F.raise_error(F.lit("read")).cast("long"))


def close(a, b):
    return a is None and b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_fit_reads_kept_weeks_alone_and_equals_the_dense_grid(events):
    weeks = session.cut_lineage(fc.pair_weeks(events, len(ROWS)))
    dense = fc.ridge_moments(fc.training_set(events)).first().asDict()
    sparse = fc.sparse_training_moments(unread(events), weeks).first().asDict()
    assert dense.keys() == sparse.keys() and all(close(dense[k] or 0, sparse[k]) for k in dense)
    assert all(close(a, b) for a, b in zip(fc.fit_demand(unread(events), weeks)[1], fc.solve_ridge(dense)[1]))
    nothing = fc.sparse_training_moments(events.limit(0)).first().asDict()
    assert nothing["n"] == 0 and not any(nothing.values())


def test_forecasts_read_kept_weeks_alone(events):
    weeks, model = session.cut_lineage(fc.pair_weeks(events, len(ROWS))), (0.5, [0.25, 0.5, 0.125, 0.0, 1.0, 0.0])
    got = {(r.user_id, r.item_id): r.forecast_qty for r in fc.forecast_next_week(unread(events), None, model, weeks).collect()}
    m11, m12, m21 = 66 / 5, 5.0, 16 / 3
    want = {(1, 1): 0.5 + 0.25 * 7 + 0.125 * 2 + m11, (1, 2): 0.5 + m12, (2, 1): 0.5 + 0.25 * 7 + m21, (2, 3): 8.0, (3, 2): 0.5 + 4.0,
            (4, 1): (66 + 16) / 8}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    spark = events.sparkSession
    asked = spark.createDataFrame([(1, 1), (9, 3), (9, 77), (None, 2)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): r.forecast_qty for r in fc.forecast_next_week(events, asked, model).collect()}
    want = {(1, 1): want[1, 1], (9, 3): 8.0, (9, 77): 10.0, (None, 2): 32 / 4}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)


def test_raw_ranker_reads_kept_weeks_alone(spark, events):
    materials = spark.createDataFrame([(i, f"m{i}", f"c{i}", 2.0 * i, f"word{i}") for i in (1, 2, 3, 4)],
                                      "material_id long, material_name string, category string, price double, description string")
    weeks, model = session.cut_lineage(fc.pair_weeks(events, len(ROWS), times=True)), (1.0, [0.1, 0.0, 0.0, 0.0, 0.5, 0.25])
    out = rk.recommend_materials_raw(unread(events), materials, weeks.select("user_id"), model, 4, weeks).collect()
    forecast = {(r.user_id, r.item_id): r.forecast_qty for r in fc.forecast_next_week(events, None, model).collect()}
    urgency = {(r.user_id, r.item_id): r for r in fc.reorder_urgency(events).collect() if r.user_id is not None}
    mean = {1: 82 / 8, 2: 32 / 4, 3: 8.0, 4: 10.0}
    assert len(out) == 4 * 4 and {r.user_id for r in out} == {1, 2, 3, 4}
    held = {u: {i for v, i, *_ in ROWS if v == u} for u in (1, 2, 3, 4)}
    for r in out:
        key = r.user_id, r.material_id
        u, q = urgency.get(key), forecast.get(key, mean[r.material_id])
        sim = 1 / len(held[r.user_id]) if r.material_id in held[r.user_id] else 0.0  # no two items share a word
        score = 0.3 * min(1, u.n_purchases / 15) + 0.3 * u.urgency if u else 0.0
        assert abs(r.score - (score + 0.2 * min(1, q / 200) + 0.2 * sim)) < 6e-5
        assert r.predicted_demand_qty == round(q + 1e-12, 1)
        assert (r.urgency_days_elapsed, r.urgency_cycle_days) == ((u.days_elapsed or 0, int(u.cycle_days)) if u else (0, 0))


def test_forecast_is_evaluated_from_few_reads_of_the_lines(spark, tmp_path, monkeypatch):
    lines = [(o, o % 3, o % 4, "RN"[o % 2], float(1 + o % 7), dt.datetime(2024, 1, 1) + dt.timedelta(days=5 * o % 400)) for o in range(200)]
    spark.createDataFrame([(o, 1, s, p, f, q, d) for o, s, p, f, q, d in lines], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, "
                          "l_returnflag string, l_quantity double, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(p, f"t{p % 2}", 1.0) for p in range(4)], "p_partkey long, p_type string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    fitted = []
    fit = fc.fit_demand
    monkeypatch.setattr(fc, "fit_demand", lambda events, *a: fitted.append(a) or fit(unread(events), *a))
    out = pe.eval_forecast(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") and plan.count("Relation [l_orderkey") <= 2  # the test weeks only: beyond the cut and its ties
    assert len(fitted) == 1 and all(r.value > 0 for r in out.collect())
