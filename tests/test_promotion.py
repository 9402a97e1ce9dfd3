"""The promotion gate: models are kept as versions, and measured and logged as kept."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewater.operators import evaluation as ev
from tidewater.plans import evaluation as pe
from tidewater.plans import io as pio
from tidewater.sources.store import FeatureStore


def tables(spark, path):
    rng = random.Random(6)
    words = ["ring", "bolt", "cog", "nut"]
    part = [(i, f"large {words[i % 4]}", f"Brand#{i % 3}", "LARGE" if i % 2 else "SMALL", 1, 900.0 + i) for i in range(30)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    start = dt.datetime(2024, 1, 1)
    rows = [(e, start + dt.timedelta(hours=e), rng.randrange(12), rng.choice(["click", "view", "purchase"]), 1.0, '{"k": %d}' % rng.randrange(20)) for e in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")


def test_each_candidate_keeps_its_model_and_is_measured_from_it(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path / "in")
    scratch = pio.files.shared_scratch
    monkeypatch.setattr(pio.files, "shared_scratch", lambda spark, name: f"{tmp_path}/{name}" if name in ("promotion", "runs") else scratch(spark, name))
    got = {r.run_id: r for r in pio.promote_if_better(spark, str(tmp_path / "in")).collect()}
    store = FeatureStore(spark, f"{tmp_path}/promotion")
    assert store.list_versions("customer_model") == [1, 2] and store.list_versions("customer_features") == [1]
    feats, rel = pe.customer_split(spark, str(tmp_path / "in"))
    log = spark.read.parquet(f"{tmp_path}/runs")
    for n, alpha in enumerate(pio.CANDIDATE_ALPHAS, 1):
        model = store.load("customer_model", n)
        assert model.where("part = 'score'").count() == feats.count() > 0
        assert model.where("part = 'popular'").count() > 0 and model.select("alpha").distinct().collect() == [(alpha,)]
        lists = model.where("part = 'list'")
        assert lists.select("user_id").distinct().count() == rel.select("user_id").distinct().count()
        alone = {r.metric: r.value for r in pe.product_metrics(spark, str(tmp_path / "in"), alpha).collect()}
        assert {r.metric: r.value for r in pe.list_metrics(lists.select("user_id", "rank", "item_id"), rel).collect()} == alone
        assert got[f"candidate-{n}"].precision_at_5 == alone["precision_at_5"]
        run = {r.name: r.value for r in log.where(F.col("run_id") == f"candidate-{n}").collect()}
        assert run["model_version"] == str(n) and float(run["precision_at_5"]) == alone["precision_at_5"] and run["duplicate_pairs"] == "0.0"
    one, two = got["candidate-1"], got["candidate-2"]
    assert (one.baseline, one.promoted, two.baseline) == (0.0, True, one.precision_at_5)
    assert two.promoted == two.current == ev.should_promote(two.precision_at_5, one.precision_at_5) and one.current != two.current
    at = store.load("customer_pointer").first()
    assert got[at.run_id].current and at.version == int(at.run_id[-1])
