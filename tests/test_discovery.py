import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import discovery, rankers
from tidewater.operators import profiling as pf
from tidewater.operators import similarity as sim


def rows_with_a_hot_key(n_items=300):
    rng = random.Random(2)
    rows = [("all", i, float(i % 5 + 1)) for i in range(n_items)]
    for u in range(40):
        rows += [(f"u{u}", i, float(rng.randint(1, 5))) for i in rng.sample(range(n_items), 12)]
    return rows


@pytest.mark.parametrize("segment", [7, 64, 5000])
def test_pair_products_with_a_key_of_all_items(spark, segment):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame([*rows, (None, 1, 9.0), ("x", None, 9.0)], "u string, i long, v double").repartition(6)
    keys = sorted({r[0] for r in rows})
    m = np.zeros((len(keys), 300))
    for u, i, v in rows:
        m[keys.index(u), i] = v
    g = m.T @ m
    got = sim.pair_products(df, "u", "i", "v", segment).collect()
    assert len(got) == int((np.triu(g) > 0).sum())
    assert all(r["item_i"] <= r["item_j"] and abs(g[r["item_i"], r["item_j"]] - r["g"]) < 1e-9 for r in got)


def test_no_row_of_work_exceeds_its_segments(spark):
    df = spark.createDataFrame(rows_with_a_hot_key(3000), "u string, i long, v double")
    work = sim.segment_pairs(df, "u", "i", "v", 100).select("k", (F.size("a") * F.size("b")).alias("n"), "p", "q").collect()
    hot = [r["n"] for r in work if r["k"] == "all"]
    assert len(hot) == 30 * 31 // 2 and max(hot) <= 3 * sorted(hot)[len(hot) // 2]
    assert sum(r["n"] * (1 if r["p"] == r["q"] else 2) for r in work if r["k"] == "all") == 3000**2


def test_cosine_has_both_orders(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 10, 3.0), (2, 10, 1.0)], "u long, i long, v double")
    got = {(r["item_i"], r["item_j"]): r["sim"] for r in sim.column_cosine(df, "u", "i", "v").collect()}
    want = 2 / (math.sqrt(1 + 16) * 2)
    assert got.keys() == {(10, 10), (10, 11), (11, 10), (11, 11)} and abs(got[10, 11] - want) < 1e-12 and abs(got[11, 10] - want) < 1e-12


def test_content_neighbours_with_a_common_term(spark):
    rng = random.Random(5)
    rows = []
    for d in range(60):
        terms = {"common": 0.3, **{f"t{rng.randrange(12)}": rng.random() for _ in range(3)}}
        norm = math.sqrt(sum(w * w for w in terms.values()))
        rows += [(d, t, w / norm) for t, w in terms.items()]
    rows.append((99, "alone", 1.0))
    got = {}
    for r in sim.content_neighbors(spark.createDataFrame(rows, "doc_id long, term string, weight double"), 4).collect():
        got.setdefault(r["item_i"], []).append((r["rank"], r["item_j"], r["sim"]))
    vec = {}
    for d, t, w in rows:
        vec.setdefault(d, {})[t] = w
    for d, v in vec.items():
        s = sorted(((-round(sum(w * u.get(t, 0) for t, w in v.items()), 9), e) for e, u in vec.items() if e != d and set(u) & set(v)))
        near = sorted(got.get(d, []))
        assert [(i, j) for i, j, _ in near] == [(i + 1, e) for i, (_, e) in enumerate(s[:4])]
        assert all(abs(x + y) < 1e-8 for (_, _, x), (y, _) in zip(near, s))


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], [random.Random(1).lognormvariate(0, 4) for _ in range(501)], [-1e300, -1.0, 0.0, 1e-300, 1e300], [0.1 * (i % 7) for i in range(400)], []])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    r = pf.describe(df, "x").first()
    want = np.percentile(values, [25, 50, 75]) if values else [None] * 3
    for w, g in zip(want, (r["p25"], r["p50"], r["p75"])):
        assert g == w or math.isclose(g, w, rel_tol=1e-12)
    assert r["count"] == len(values)
    if values:
        ranks = sorted({0, len(values) // 3, len(values) - 1})
        assert pf.order_statistics(df, "x", ranks) == {k: sorted(values)[k] for k in ranks}


def test_profile_of_text_dates_and_samples(spark):
    rows = [(i, f"w{i % 13:02d}", ["2024-01-03", "2024-02-01 10:00:00", "no date", None][i % 4], "never", None) for i in range(26)]
    p = {r["column_name"]: r for r in pf.profile_table(spark.createDataFrame(rows, "id long, word string, ship_date string, date_bad string, nothing string")).collect()}
    assert p["word"]["unique_samples"] == "|".join(f"w{i:02d}" for i in range(10)) and p["word"]["unique_values_count"] == 13
    d = p["ship_date"]
    assert (d["data_type"], str(d["min_timestamp"]), str(d["max_timestamp"]), d["range_days"]) == ("datetime", "2024-01-03 00:00:00", "2024-02-01 10:00:00", 29.0)
    assert p["date_bad"]["data_type"] == "datetime_invalid" and p["date_bad"]["range_days"] is None
    assert p["nothing"]["unique_samples"] is None and p["nothing"]["unique_values_count"] == 0 and p["id"]["unique_values_count"] == 26


def test_profile_multiplies_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a long, b string, c double")
    assert "Expand" not in pf.profile_table(df)._jdf.queryExecution().executedPlan().toString()


def test_keys_and_paths_of_the_fixture(spark):
    from tidewater.plans import profiling as plan
    sf = "/root/testdata/sf0.001"
    keys = {(r["table_name"], r["key_columns"]) for r in plan.discovered_keys(spark, sf).collect()}
    assert {("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("nation", "n_nationkey")} <= keys
    paths = {(r["child"], r["parent"]) for r in plan.discovered_join_paths(spark, sf).collect()}
    assert {(f"{c}.{fk}", f"{p}.{pk}") for c, fk, p, pk in plan.FKS} <= paths


def test_composite_keys_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(a, b, None if a else 1, a * 3 + b) for a in range(3) for b in range(3)], "a int, b int, c int, d int")
    got = discovery.unique_columns(df.drop("d"), "t").collect()
    assert [(r["key_columns"], r["row_count"]) for r in got] == [("a, b", 9)]
    assert [r["key_columns"] for r in discovery.unique_columns(df, "t").collect()] == ["d", "a, b"]
    assert discovery.unique_columns(df.limit(0), "t").count() == 0
    assert {(r["child"], r["parent"]) for r in discovery.inclusions({"x": df.select("a"), "y": df.select(F.col("d").alias("k"))}).collect()} == {("x.a", "y.k")}
    assert [r["non_null"] for r in discovery.column_counts(df, "t").orderBy("column_name").collect()] == [9, 9, 3, 9]


def test_numbering_by_ranges(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("v"), F.lit("x").alias("y"))
    out = rankers.numbered(df, [F.col("v").desc()], "pos").collect()
    assert sorted((r["pos"], r["v"]) for r in out) == [(i + 1, 499 - i) for i in range(500)]
    assert rankers.numbered(df.limit(0), [F.col("v")], "pos").count() == 0


def test_inclusions_with_a_frequent_value(spark):
    a = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)], "k long, f int")
    b = spark.createDataFrame([(i,) for i in range(0, 300, 3)] + [(7,), (None,)], "k long")
    got = {(r["child"], r["parent"], r["child_values"], r["parent_values"]) for r in discovery.inclusions({"a": a, "b": b}).collect()}
    assert got == {("a.f", "a.k", 101, 300), ("a.f", "b.k", 101, 101), ("b.k", "a.k", 101, 300)}


def test_partitions_follow_rows_not_bytes(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 1000)
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.lit(1).alias("i"), F.lit(1.0).alias("v"))
    assert session.dealt(df, ["k"], 20_000).rdd.getNumPartitions() == 20
    # narrow rows that adaptive execution would merge into one task
    work = sim.segment_pairs(df.distinct(), "k", "i", "v", counted=True)
    assert work.select(F.spark_partition_id().alias("p")).distinct().count() == 5
    with_pairs = discovery.inclusions({"t": df.select("k")})
    assert with_pairs.count() == 0
