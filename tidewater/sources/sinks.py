"""Sinks: sample export, operational layout conversion and its validation, bulk load, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BULK_BATCH_ROWS = 2000


def export_sample(df: DataFrame, order_cols: list[str], n: int = 100, source: str = "") -> DataFrame:
    """First n rows in key order (TakeOrderedAndProject) with the export envelope columns."""
    s = df.orderBy(*order_cols).limit(n)
    exported = s.agg(F.count("*")).scalar()
    return s.select(F.lit(source).alias("source"), F.lit(n).cast("long").alias("rows_requested"),
                    exported.alias("rows_exported"), *df.columns)


def write_json_export(df: DataFrame, order_cols: list[str], path: str, n: int = 100, source: str = "") -> None:
    """One JSON document with the envelope and the first ``n`` rows, timestamps in ISO form."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    cols = [F.date_format(f.name, iso).alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.col(f.name) for f in df.schema.fields]
    s = df.orderBy(*order_cols).limit(n).select(F.struct(*cols).alias("row"))
    doc = s.agg(F.lit(source).alias("source"), F.lit(n).alias("rows_requested"), F.count("*").alias("rows_exported"), F.collect_list("row").alias("rows"))
    doc.write.json(path)


def _require_category(cid: F.Column, name: F.Column, key: F.Column) -> F.Column:
    return F.when(cid.isNull(), F.raise_error(F.concat(F.lit("Unknown product category: '"), name, F.lit("' for product ID "),
                                                       key.cast("string")))).otherwise(cid)


def products_layout(products: DataFrame, category_ids: DataFrame, as_of: F.Column) -> DataFrame:
    """Catalog -> operational Products layout (constants, casts, category lookup that fails on unknown)."""
    j = products.join(category_ids.withColumnRenamed("p_type", "category"), "category", "left")
    cid = _require_category(F.col("category_id"), F.col("category"), F.col("product_id"))
    null_s, null_ts, null_d = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("double")
    return j.select(
        F.col("product_id").alias("Id"), F.col("product_name").alias("Name"),
        F.coalesce(F.col("description"), F.lit("")).alias("Description"), F.col("price").cast("decimal(18,2)").alias("Price"),
        as_of.alias("CreatedAt"), null_ts.alias("UpdatedAt"), null_s.alias("CreatedBy"), null_s.alias("UpdatedBy"),
        F.lit(False).alias("IsDeleted"), null_ts.alias("DeletedAt"), as_of.alias("ApprovedAt"), F.lit("SystemSeeder").alias("ApprovedBy"),
        F.lit(1).alias("BusinessOwnerProfileId"), cid.cast("int").alias("CategoryId"), null_s.alias("RejectionReason"),
        F.lit(1).alias("Status"), F.lit(100).alias("StockQuantity"), null_s.alias("Tags"), null_d.alias("AvgRating"),
        F.lit(0).alias("CartAddCount"), null_d.alias("DemandForecastQty"), null_ts.alias("DemandForecastUpdatedAt"),
        null_d.alias("DescriptionQualityScore"), F.lit(False).alias("LowStockFlag"), F.lit(0).alias("PurchaseCount"),
        F.lit(0.0).cast("decimal(18,2)").alias("RevenueTotal"), F.lit(0).alias("ViewCount"), null_s.alias("DeletedBy"),
        F.lit(True).alias("IsVisible"), F.lit(0).alias("FeaturedOrder"), F.lit(False).alias("IsFeatured"))


def materials_layout(materials: DataFrame, as_of: F.Column) -> DataFrame:
    """Raw materials -> operational RawMaterials layout."""
    null_s, null_ts = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    return materials.select(
        F.col("material_id").alias("Id"), F.col("material_name").alias("Name"),
        F.coalesce(F.col("description"), F.lit("")).alias("Description"), F.col("price").cast("decimal(18,2)").alias("Price"),
        F.lit("pcs").alias("Unit"), F.lit(1).alias("MinimumOrderQuantity"), F.lit(100).alias("StockQuantity"),
        F.lit(True).alias("IsAvailable"), F.col("category").alias("Category"), null_s.alias("PictureUrl"),
        F.lit(1).alias("SupplierId"), as_of.alias("CreatedAt"), null_ts.alias("UpdatedAt"), null_s.alias("CreatedBy"),
        null_s.alias("UpdatedBy"), F.lit(False).alias("IsDeleted"), null_ts.alias("DeletedAt"), null_s.alias("DeletedBy"),
        F.lit(0).alias("OrderFrequency"), F.lit("").alias("PriceTrend"))


# --- fixed values: columns that the operational tables declare non-nullable, and checked types
PRODUCT_REQUIRED = (
    "Id", "Name", "Description", "Price", "CreatedAt", "IsDeleted", "BusinessOwnerProfileId", "CategoryId", "Status",
    "StockQuantity", "CartAddCount", "LowStockFlag", "PurchaseCount", "RevenueTotal", "ViewCount", "IsVisible", "FeaturedOrder", "IsFeatured",
)
MATERIAL_REQUIRED = (
    "Id", "Name", "Description", "Price", "Unit", "MinimumOrderQuantity", "StockQuantity", "IsAvailable", "Category",
    "SupplierId", "CreatedAt", "IsDeleted", "OrderFrequency", "PriceTrend",
)
PRODUCT_TYPES = {"Id": ("bigint", "int"), "Price": ("decimal", "double", "bigint", "int"), "IsDeleted": ("boolean",)}
MATERIAL_TYPES = {"Id": ("bigint", "int"), "Price": ("decimal", "double", "bigint", "int"), "IsAvailable": ("boolean",)}


def validate_layout(layout: DataFrame, required, types: dict[str, tuple[str, ...]], n_categories: int | None = None) -> DataFrame:
    """one row of violation counts (nulls in required columns, CategoryId range, type mismatches).

    A missing required column raises ``ValueError``.
    """
    missing = [c for c in required if c not in layout.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    have = {f.name: f.dataType.simpleString() for f in layout.schema.fields}
    bad_types = sum(1 for c, ok in types.items() if not have[c].startswith(ok))
    bad = F.lit(0).cast("long") if n_categories is None else F.count_if(~F.col("CategoryId").between(1, n_categories))
    return layout.agg(
        F.count("*").alias("row_count"),
        sum((F.count_if(F.col(c).isNull()) for c in required), F.lit(0).cast("long")).alias("null_required"),
        bad.alias("bad_category"),
    ).withColumn("type_mismatches", F.lit(bad_types))


def assert_layout(counts: DataFrame) -> DataFrame:
    """``counts`` if they are all zero, else ``ValueError`` with the counts."""
    row = counts.first()
    if row.null_required or row.bad_category or row.type_mismatches:
        raise ValueError(f"layout violations: {row.asDict()}")
    return counts


def bulk_load(df: DataFrame, path: str) -> None:
    """Append to a Parquet folder; files follow the partitions."""
    df.write.mode("append").parquet(path)


def bulk_load_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = BULK_BATCH_ROWS, **options: str) -> None:
    """Append to a database table in batches of ``batch_rows`` rows, one transaction a partition."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch_rows, **options).save()


def append_run(spark: SparkSession, path: str, run_id: str, kind: str, params: dict, metrics: DataFrame) -> DataFrame:
    """Append long-form (run_id, kind, name, value, type) rows; ``metrics`` is (metric, value)."""
    p = spark.createDataFrame([(k, str(v)) for k, v in params.items()], "name string, value string")
    rows = p.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "name", "value", F.lit("param").alias("type")).unionByName(
        metrics.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.col("metric").alias("name"),
                       F.col("value").cast("string").alias("value"), F.lit("metric").alias("type")))
    rows.write.mode("append").parquet(path)
    return rows
