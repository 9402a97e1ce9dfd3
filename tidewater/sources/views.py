"""Marketplace views rebuilt on the driver tables.

* ``customer_interactions`` (C) / ``products`` (C_products)
* ``owner_interactions`` (O) / ``materials`` (O_materials)
* ``demand_interactions`` (D): owner events at category grain
* ``coarse_keys`` (K), ``owner_interactions_k`` (OK) / ``materials_k``
* ``transactions`` (T), ``owner_purchases`` (M) and their catalogs
* ``ratings`` / ``rated_items`` (P)

Every view keeps the interaction schema of the reference so the operators
take them unchanged. The planner and adaptive execution choose the joins, but for
catalogs of many rows, which are not broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import BROADCAST_ROWS, dealt, looked_up
from tidewater.sources.tables import read_table

# --- fixed values: lineitem return flag -> owner interaction type
RETURNFLAG_TYPES = {"R": "reorder", "N": "purchase", "A": "view"}

# --- fixed values: industry (market segment) -> material categories rule table
INDUSTRY_RULES = {
    "AUTOMOBILE": ["LARGE", "STANDARD"],
    "BUILDING": ["ECONOMY", "LARGE", "MEDIUM"],
    "FURNITURE": ["MEDIUM", "PROMO"],
    "HOUSEHOLD": ["PROMO", "SMALL"],
    "MACHINERY": ["ECONOMY", "SMALL", "STANDARD"],
}


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("description"),
    )


def customer_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").try_cast("long").alias("k"),
    )
    cat = products(spark, sf_dir).select("product_id", "category", "price")
    return ev.join(looked_up(cat), ev.k == cat.product_id, "left").select(
        F.col("event_id").alias("interaction_id"),
        F.lit("customer").alias("user_type"),
        F.col("user_id"),
        F.col("k").alias("item_id"),
        F.lit("product").alias("item_type"),
        F.col("event_type").alias("interaction_type"),
        F.col("category"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 4 + 1).otherwise(F.lit(1)).cast("int").alias("quantity"),
        F.col("price"),
        F.col("ts").alias("interaction_timestamp"),
    )


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("material_id"),
        F.col("p_name").alias("material_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("description"),
    )


def _returnflag_type() -> F.Column:
    c = F.col("l_returnflag")
    expr = None
    for flag, name in RETURNFLAG_TYPES.items():
        expr = (F.when(c == flag, name) if expr is None else expr.when(c == flag, name))
    return expr


def _owner_rows(li: DataFrame, item_col: F.Column) -> DataFrame:
    return li.select(
        F.lit("owner").alias("user_type"),
        F.col("l_suppkey").alias("user_id"),
        item_col.alias("item_id"),
        F.lit("raw_material").alias("item_type"),
        _returnflag_type().alias("interaction_type"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").alias("price"),
        F.col("l_shipdate").alias("interaction_timestamp"),
    )


def _met(rows: DataFrame, key: str, n: int, others: int) -> DataFrame:
    """``rows`` (``n``) as they join a table of ``others`` rows by ``key``: dealt by their number unless that table may be broadcast."""
    return dealt(rows, [key], n) if others > BROADCAST_ROWS else rows


def _lineitem_part(spark: SparkSession, sf_dir: str, part_cols: list[str]) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", *part_cols)
    parts = part.count()
    li = _met(li, "l_partkey", li.count(), parts)
    return li.join(looked_up(part, parts), li.l_partkey == part.p_partkey, "inner")


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of lineitem (read from the file's footers): about those of the views O, D, OK, T and M."""
    return read_table(spark, sf_dir, "lineitem").count()


def owner_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lineitem_part(spark, sf_dir, ["p_type", "p_retailprice"])
    return _owner_rows(j, F.col("l_partkey"))


def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 1..n id per distinct p_type in alphabetical order (n = category domain)."""
    types = read_table(spark, sf_dir, "part").select("p_type").distinct()
    return types.select("p_type", F.row_number().over(Window.orderBy("p_type")).cast("long").alias("category_id"))


def demand_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View D: owner events with item = category position (supplier x category series)."""
    j = _lineitem_part(spark, sf_dir, ["p_type", "p_retailprice"])
    ids = category_ids(spark, sf_dir).withColumnRenamed("p_type", "cid_type")
    j = j.join(ids, j.p_type == ids.cid_type, "inner")
    return _owner_rows(j, F.col("category_id"))


def coarse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View K: dense id over distinct (p_brand, p_type) plus catalog attributes."""
    g = read_table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("price"))
    return g.select(
        F.row_number().over(Window.orderBy("p_brand", "p_type")).cast("long").alias("kid"),
        "p_brand", "p_type", "price",
    )


def materials_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = coarse_keys(spark, sf_dir)
    return k.select(
        F.col("kid").alias("material_id"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("material_name"),
        F.col("p_type").alias("category"),
        F.col("price"),
        F.col("p_brand").alias("description"),
    )


def _part_to_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = coarse_keys(spark, sf_dir).select("kid", F.col("p_brand").alias("k_brand"), F.col("p_type").alias("k_type"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    pk = part.join(k, (part.p_brand == k.k_brand) & (part.p_type == k.k_type), "inner").drop("k_brand", "k_type")
    return looked_up(pk, part.count())


def owner_interactions_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_shipdate")
    li = _met(li, "l_partkey", li.count(), read_table(spark, sf_dir, "part").count())
    pk = _part_to_k(spark, sf_dir)
    j = li.join(pk, li.l_partkey == pk.p_partkey, "inner")
    return _owner_rows(j, F.col("kid"))


def _order_lines_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pk = _part_to_k(spark, sf_dir).select("p_partkey", "kid")
    n = li.count()
    j = _met(li, "l_orderkey", n, orders.count()).join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    j = _met(j, "l_partkey", n, read_table(spark, sf_dir, "part").count())
    return j.join(pk, j.l_partkey == pk.p_partkey, "inner")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View T: older customer transactions at coarse item grain."""
    j = _order_lines_k(spark, sf_dir)
    return j.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("kid").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("o_orderdate").alias("timestamp"),
    )


def products_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = coarse_keys(spark, sf_dir)
    return k.select(
        F.col("kid").alias("product_id"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("price"),
    )


def customers_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with preferred category = category at position c_custkey % n (0-based, alphabetical)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey")
    ids = category_ids(spark, sf_dir)
    n = ids.agg(F.count("*")).scalar()
    cust = cust.withColumn("position", F.pmod(F.col("c_custkey"), n) + 1)
    return cust.join(ids, F.col("position") == F.col("category_id"), "inner").select(
        F.col("c_custkey").alias("customer_id"), F.col("p_type").alias("preferred_category"))


def owner_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View M: older owner purchase history at coarse material grain."""
    j = _order_lines_k(spark, sf_dir)
    return j.select(
        F.col("o_custkey").alias("owner_id"),
        F.col("kid").alias("material_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("o_orderdate").alias("date"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def brand_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("industry"))


def industry_rules(spark: SparkSession) -> DataFrame:
    rows = [(ind, cat) for ind, cats in INDUSTRY_RULES.items() for cat in cats]
    return spark.createDataFrame(rows, "industry string, category string")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View P: one rating per (user, item) from the lowest event id; rating = 1 + floor(value) % 5."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.get_json_object("props", "$.k").try_cast("long").alias("movie_id"))
    ev = ev.withColumn("rating", (F.pmod(F.floor("value"), F.lit(5)) + 1).cast("int"))
    return dedupe_first(ev, ["user_id", "movie_id"], "event_id").select("user_id", "movie_id", "rating")


def dedupe_first(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Keep the row with the smallest ``order_col`` per key (deterministic keep-first).

    ``min_by`` over a struct is a partial (map-side) aggregate, so a hot key
    never gathers its rows in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(F.col(order_col), *[F.col(c).alias(f"__{c}") for c in others if c != order_col]))
    g = df.groupBy(*keys).agg(packed.alias("__first"))
    return g.select(*keys, F.col(f"__first.{order_col}").alias(order_col),
                    *[F.col(f"__first.__{c}").alias(c) for c in others if c != order_col])


def rated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("movie_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("genre"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("description"),
    )
