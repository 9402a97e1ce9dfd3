"""The data-source contract: declared columns, pushed filters, fallback table by table."""

import re

import pytest
from pyspark.sql import functions as F

from tidewater.sources import contract as C

ROWS = [
    (1, "customer", 10, 100, "product", "view", "a", 1, 2.0, "2024-01-01 00:00:00", "x"),
    (2, "owner", 11, 101, "raw_material", "purchase", "b", 2, 3.0, "2024-02-01 00:00:00", "y"),
    (3, "customer", 10, 101, "product", "purchase", None, None, None, "2024-03-01 00:00:00", None),
    (4, None, 12, 100, "product", "view", "a", 1, 2.0, None, "z"),
    (3, "customer", 10, 101, "product", "purchase", None, None, None, "2024-03-01 00:00:00", None),
]
NAMES = [*C.INTERACTIONS.names, "extra"]


def events(spark):
    types = "long string long long string string string int double string string".split()
    return spark.createDataFrame(ROWS, ", ".join(f"{n} {t}" for n, t in zip(NAMES, types))).select(*NAMES[::-1])


def ids(df):
    return sorted(r["interaction_id"] for r in df.collect())


def store(spark, tmp_path):
    s = C.TableStore(spark, str(tmp_path / "store"))
    s.save("interactions", events(spark))
    return s


def test_a_type_is_a_pruned_scan(spark, tmp_path):
    s = store(spark, tmp_path)
    got = s.interactions("customer")
    assert got.schema.names == C.INTERACTIONS.names and ids(got) == [1, 3, 3] and ids(s.load("interactions")) == [1, 2, 3, 3, 4]
    late = got.where(F.col("interaction_timestamp") > F.lit("2024-02-15").cast("timestamp_ntz")).select("item_id")
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*user_type[^\]]*customer", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(interaction_timestamp", plan)
    assert re.search(r"ReadSchema: struct<item_id:bigint,interaction_timestamp:timestamp_ntz>", plan)
    assert [r["item_id"] for r in late.collect()] == [101, 101]
    assert all("user_type=customer" in f for f in got.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def test_columns_are_declared(spark, tmp_path):
    with pytest.raises(ValueError, match="no column quantity"):
        C.TableStore(spark, str(tmp_path / "s")).save("interactions", events(spark).drop("quantity"))
    s = store(spark, tmp_path)
    with pytest.raises(Exception, match="already exists"):
        s.save("interactions", events(spark))
    assert len(ids(s.load("interactions"))) == 5


def test_fallback_by_table(spark, tmp_path):
    s = store(spark, tmp_path)
    s.save("products", spark.createDataFrame([(1, "p", "a", 1.0, "d")], C.PRODUCTS))
    s.save("materials", spark.createDataFrame([(2, "m", "a", 1.0, "d")], C.MATERIALS))
    root = tmp_path / "json"
    spark.createDataFrame([(7, "q", "b", 2.0, "e")], C.PRODUCTS).write.json(str(root / "products"))
    spark.createDataFrame([], C.MATERIALS).write.json(str(root / "materials"))  # there, but without a row
    both = C.Fallback(C.JsonExport(spark, str(root)), s)
    assert [r["product_id"] for r in both.products().collect()] == [7]
    assert [r["material_id"] for r in both.materials().collect()] == [2]
    assert ids(both.interactions("owner")) == [2]  # no such folder
    plan = both.interactions("owner")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_type" in plan  # through the fallback too
    with pytest.raises(FileNotFoundError):
        C.Fallback(C.JsonExport(spark, str(root)), C.TableStore(spark, str(tmp_path / "none"))).load("interactions")


def test_empty_store(spark, tmp_path):
    s = C.TableStore(spark, str(tmp_path / "store"))
    s.save("interactions", events(spark).limit(0))
    assert s.interactions("customer").count() == 0 and s.load("interactions").schema.names == C.INTERACTIONS.names
