"""Profiling / EDA queries over the interaction views and base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import r6
from tidewater.operators import discovery
from tidewater.operators import profiling as pf
from tidewater.plans.registry import query
from tidewater.plans.sqlviews import with_views
from tidewater.sources import views as V
from tidewater.sources.tables import TABLES, read_table

CV = with_views("C", "C_products")
OV = with_views("O")
CO = with_views("C", "C_products", "O")


def _c(spark, sf):
    return V.customer_interactions(spark, sf)


def _o(spark, sf):
    return V.owner_interactions(spark, sf)


def _prof_sql(cols, head=CV, view="C"):
    parts = []
    for c, k in cols:
        num = k == "numeric"
        dt = k == "datetime"
        least = f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {view} WHERE {c} IS NOT NULL ORDER BY v LIMIT 10))"
        parts.append(f"""SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) END AS null_percentage,
  count(DISTINCT {c}) AS unique_values_count,
  {f'min(CAST({c} AS DOUBLE))' if num else 'CAST(NULL AS DOUBLE)'} AS min, {f'max(CAST({c} AS DOUBLE))' if num else 'CAST(NULL AS DOUBLE)'} AS max,
  {f'round(avg(CAST({c} AS DOUBLE)), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS mean, {f'round(stddev_samp(CAST({c} AS DOUBLE)), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS std,
  {f'min({c})' if dt else 'CAST(NULL AS TIMESTAMP)'} AS min_timestamp, {f'max({c})' if dt else 'CAST(NULL AS TIMESTAMP)'} AS max_timestamp,
  {f"CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) AS DOUBLE)" if dt else 'CAST(NULL AS DOUBLE)'} AS range_days,
  {least if k == 'text_or_other' else 'CAST(NULL AS VARCHAR)'} AS unique_samples
FROM {view}""")
    return head + "\n" + "\nUNION ALL\n".join(parts)


C_KINDS = [("interaction_id", "numeric"), ("user_type", "text_or_other"), ("user_id", "numeric"), ("item_id", "numeric"),
           ("item_type", "text_or_other"), ("interaction_type", "text_or_other"), ("category", "text_or_other"),
           ("quantity", "numeric"), ("price", "numeric"), ("interaction_timestamp", "datetime")]


@query("profile_table", _prof_sql(C_KINDS))
def profile_table(spark, sf):
    p = pf.profile_table(_c(spark, sf))
    return p.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


ORDER_KINDS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text_or_other"), ("o_totalprice", "numeric"),
               ("o_orderdate", "datetime"), ("o_orderpriority", "text_or_other")]


@query("profile_orders", _prof_sql(ORDER_KINDS, "", "orders"))
def profile_orders(spark, sf):
    """E1 over orders whose dates are text: a column named date gets the range of its values."""
    p = pf.profile_table(read_table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string")))
    return p.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query("profile_duplicates", OV + """
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM O)) AS duplicate_rows,
       round(CASE WHEN count(*) > 0 THEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM O))) * 100.0 / count(*) ELSE 0 END, 6) AS duplicate_percentage
FROM O""")
def profile_duplicates(spark, sf):
    return pf.duplicate_rows(_o(spark, sf)).withColumn("duplicate_percentage", r6(F.col("duplicate_percentage")))


def _signal_sql(v):
    return f"""SELECT count(*) AS total_interactions, count(DISTINCT user_id) AS unique_users, count(DISTINCT item_id) AS unique_items,
       count(DISTINCT category) AS unique_categories,
       round(CASE WHEN count(DISTINCT user_id) * count(DISTINCT item_id) > 0
             THEN 1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) ELSE 1.0 END, 6) AS sparsity_ratio FROM {v}"""


def _signals(df):
    return pf.signal_counts(df).withColumn("sparsity_ratio", r6(F.col("sparsity_ratio")))


@query("signal_profile_customer", CV + """, RP AS (SELECT user_id, item_id, count(*) AS c FROM C WHERE lower(interaction_type) = 'purchase' GROUP BY 1, 2),
RR AS (SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) AS purchases_count, count(*) FILTER (WHERE c > 1) AS repeated_purchases_count FROM RP)
SELECT s.*, r.purchases_count, r.repeated_purchases_count,
       round(CASE WHEN r.purchases_count > 0 THEN r.repeated_purchases_count * 100.0 / r.purchases_count ELSE 0.0 END, 6) AS reorder_rate
FROM (""" + _signal_sql("C") + ") s, RR r")
def signal_profile_customer(spark, sf):
    c = _c(spark, sf)
    r = pf.repeat_purchase_rate(c)
    s = _signals(c)
    return s.select("*", r.select("purchases_count").scalar().alias("purchases_count"),
                    r.select("repeated_purchases_count").scalar().alias("repeated_purchases_count"),
                    r6(r.select("reorder_rate").scalar()).alias("reorder_rate"))


@query("signal_profile_owner", OV + _signal_sql("O"))
def signal_profile_owner(spark, sf):
    return _signals(_o(spark, sf))


@query("matrix_sparsity", CO + f"""
SELECT 'customer' AS user_type, sparsity_ratio FROM ({_signal_sql('C')}) UNION ALL
SELECT 'owner' AS user_type, sparsity_ratio FROM ({_signal_sql('O')})""")
def matrix_sparsity(spark, sf):
    a = _signals(_c(spark, sf)).select(F.lit("customer").alias("user_type"), "sparsity_ratio")
    b = _signals(_o(spark, sf)).select(F.lit("owner").alias("user_type"), "sparsity_ratio")
    return a.unionByName(b)


@query("reorder_rate", CV + """, RP AS (SELECT user_id, item_id, count(*) AS c FROM C WHERE lower(interaction_type) = 'purchase' GROUP BY 1, 2)
SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) AS purchases_count, count(*) FILTER (WHERE c > 1) AS repeated_purchases_count,
       round(CASE WHEN sum(c) > 0 THEN count(*) FILTER (WHERE c > 1) * 100.0 / sum(c) ELSE 0.0 END, 6) AS reorder_rate FROM RP""")
def reorder_rate(spark, sf):
    return pf.repeat_purchase_rate(_c(spark, sf)).withColumn("reorder_rate", r6(F.col("reorder_rate")))


@query("signal_distribution", CO + """, U AS (SELECT user_type, interaction_type FROM C UNION ALL SELECT user_type, interaction_type FROM O),
G AS (SELECT user_type, interaction_type, count(*) AS n FROM U GROUP BY 1, 2)
SELECT user_type, interaction_type, n, round(n * 100.0 / sum(n) OVER (PARTITION BY user_type), 6) AS percentage FROM G""")
def signal_distribution(spark, sf):
    u = _c(spark, sf).select("user_type", "interaction_type").unionByName(_o(spark, sf).select("user_type", "interaction_type"))
    return pf.signal_distribution(u).withColumn("percentage", r6(F.col("percentage")))


@query("interaction_frequencies", CO + """
SELECT interaction_type, user_type, count(*) AS n FROM (SELECT user_type, interaction_type FROM C UNION ALL
  SELECT user_type, interaction_type FROM O) GROUP BY 1, 2""")
def interaction_frequencies(spark, sf):
    u = _c(spark, sf).select("user_type", "interaction_type").unionByName(_o(spark, sf).select("user_type", "interaction_type"))
    return u.groupBy("interaction_type", "user_type").agg(F.count("*").alias("n"))


@query("monthly_procurement", OV + """
SELECT strftime(interaction_timestamp, '%B') AS month_name, count(*) AS n FROM O
WHERE lower(interaction_type) IN ('purchase', 'reorder') GROUP BY 1""")
def monthly_procurement(spark, sf):
    """Procurement events per month name (ordered by frequency when displayed)."""
    o = _o(spark, sf).where(F.lower("interaction_type").isin("purchase", "reorder"))
    return o.groupBy(F.date_format("interaction_timestamp", "MMMM").alias("month_name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


@query("top_products", CV + "SELECT item_id, count(*) AS n FROM C GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10")
def top_products(spark, sf):
    return pf.top_n(_c(spark, sf), "item_id", 10)


@query("category_distribution", CV + "SELECT category, count(*) AS n FROM C GROUP BY 1 ORDER BY n DESC, category LIMIT 8")
def category_distribution(spark, sf):
    return pf.top_n(_c(spark, sf), "category", 8)


@query("top_active_users", CV + "SELECT user_id, count(*) AS n FROM C GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_active_users(spark, sf):
    return pf.top_n(_c(spark, sf), "user_id", 10)


@query("top_materials", OV + """SELECT item_id, count(*) AS n FROM O WHERE interaction_type IN ('purchase', 'reorder')
GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10""")
def top_materials(spark, sf):
    return pf.top_n(_o(spark, sf).where(F.col("interaction_type").isin("purchase", "reorder")), "item_id", 10)


@query("reorder_trends", OV + """SELECT CAST(CAST(interaction_timestamp AS DATE) AS VARCHAR) AS date, interaction_type, count(*) AS n
FROM O WHERE lower(interaction_type) IN ('purchase', 'reorder') GROUP BY 1, 2""")
def reorder_trends(spark, sf):
    o = _o(spark, sf).where(F.lower("interaction_type").isin("purchase", "reorder"))
    return o.groupBy(F.to_date("interaction_timestamp").cast("string").alias("date"), "interaction_type").agg(F.count("*").alias("n"))


@query("activity_heatmap", CV + """, E AS (SELECT strftime(interaction_timestamp, '%A') AS weekday, CAST(isodow(interaction_timestamp) - 1 AS INTEGER) AS weekday_index,
  hour(interaction_timestamp) AS h FROM C)
SELECT weekday, weekday_index, """ + ", ".join(f"count(*) FILTER (WHERE h = {h}) AS h{h:02d}" for h in range(24)) + """
FROM E GROUP BY 1, 2""")
def activity_heatmap(spark, sf):
    return pf.activity_heatmap(_c(spark, sf))


@query("hourly_activity", CV + "SELECT CAST(hour(interaction_timestamp) AS INTEGER) AS hour, count(*) AS n FROM C GROUP BY 1")
def hourly_activity(spark, sf):
    return _c(spark, sf).groupBy(F.hour("interaction_timestamp").alias("hour")).agg(F.count("*").alias("n"))


@query("null_counts", CV + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM C" for c, _ in C_KINDS))
def null_counts(spark, sf):
    return pf.null_counts(_c(spark, sf))


SPEND_SQL = CV + ", SP AS (SELECT user_id, sum(price) AS spend FROM C WHERE interaction_type = 'purchase' GROUP BY 1)\n"


def _spend(spark, sf):
    return _c(spark, sf).where(F.col("interaction_type") == "purchase").groupBy("user_id").agg(F.sum("price").alias("spend"))


@query("spend_describe", SPEND_SQL + """SELECT count(spend) AS count, round(avg(spend), 6) AS mean, round(stddev_samp(spend), 6) AS std,
  round(min(spend), 6) AS min, round(quantile_cont(spend, 0.25), 6) AS p25, round(quantile_cont(spend, 0.5), 6) AS p50,
  round(quantile_cont(spend, 0.75), 6) AS p75, round(max(spend), 6) AS max FROM SP""")
def spend_describe(spark, sf):
    d = pf.describe(_spend(spark, sf), "spend")
    return d.select("count", *[r6(F.col(c)).alias(c) for c in d.columns if c != "count"])


@query("spend_histogram", SPEND_SQL + """, B AS (SELECT min(spend) AS lo, max(spend) AS hi FROM SP)
SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(30, CAST(floor((spend - lo) / ((hi - lo) / 30)) AS BIGINT) + 1) END AS BIGINT) AS bin,
       count(*) AS n FROM SP, B GROUP BY 1""")
def spend_histogram(spark, sf):
    return pf.histogram(_spend(spark, sf), "spend", 30)


@query("quantity_boxplot", OV + """, Q AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.5) AS median,
  quantile_cont(quantity, 0.75) AS q3 FROM O)
SELECT q1, median, q3, q3 - q1 AS iqr,
  min(CAST(quantity AS DOUBLE)) FILTER (WHERE quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(CAST(quantity AS DOUBLE)) FILTER (WHERE quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM O, Q GROUP BY q1, median, q3""")
def quantity_boxplot(spark, sf):
    return pf.boxplot_stats(_o(spark, sf), "quantity")


KEYS = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"),
        ("nation", "n_nationkey"), ("region", "r_regionkey"), ("lineitem", "l_orderkey, l_linenumber")]


@query("key_uniqueness", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_columns, count(*) AS row_count, "
    f"(SELECT count(*) FROM (SELECT DISTINCT {k} FROM {t})) AS distinct_keys FROM {t}" for t, k in KEYS))
def key_uniqueness(spark, sf):
    """E13 re-aimed: key uniqueness per table (Spark has no PK metadata)."""
    out = None
    for t, k in KEYS:
        cols = [c.strip() for c in k.split(",")]
        d = read_table(spark, sf, t)
        g = d.groupBy(*cols).agg(F.count("*").alias("c"))
        r = g.agg(F.sum("c").cast("long").alias("row_count"), F.count("*").alias("distinct_keys")).select(
            F.lit(t).alias("table_name"), F.lit(k).alias("key_columns"), "row_count", "distinct_keys")
        out = r if out is None else out.unionByName(r)
    return out


FKS = [("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
       ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]


@query("join_path_integrity", with_views("C_products") + ", EK AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)\n" + "\nUNION ALL\n".join(
    [f"SELECT '{c}.{fk}' AS path, count(*) AS child_rows, count(*) FILTER (WHERE {fk} NOT IN (SELECT {pk} FROM {p})) AS orphans FROM {c}"
     for c, fk, p, pk in FKS]
    + ["SELECT 'events.props.k' AS path, count(*) AS child_rows, count(*) FILTER (WHERE k IS NULL OR k NOT IN (SELECT product_id FROM C_products)) AS orphans FROM EK"]))
def join_path_integrity(spark, sf):
    """J12 re-aimed: orphan counts of each implicit foreign key (left anti joins)."""
    out = None
    for c, fk, p, pk in FKS:
        child = read_table(spark, sf, c).select(F.col(fk).alias("k"))
        parent = read_table(spark, sf, p).select(F.col(pk).alias("k")).distinct()
        orphans = child.join(parent, "k", "left_anti")
        r = child.agg(F.count("*").alias("child_rows")).select(
            F.lit(f"{c}.{fk}").alias("path"), "child_rows", orphans.agg(F.count("*")).scalar().alias("orphans"))
        out = r if out is None else out.unionByName(r)
    ev = read_table(spark, sf, "events").select(F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    prods = V.products(spark, sf).select(F.col("product_id").alias("k"))
    orph = ev.join(prods, "k", "left_anti")
    r = ev.agg(F.count("*").alias("child_rows")).select(F.lit("events.props.k").alias("path"), "child_rows",
                                                          orph.agg(F.count("*")).scalar().alias("orphans"))
    return out.unionByName(r)


#: The relational tables whose keys and join paths are looked for.
SEARCHED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
_TYPE_SQL = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SPARK_TYPES.items()) + " ELSE lower(column_type) END"


@query("catalog_columns", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, d.column_name, {_TYPE_SQL} AS data_type, true AS nullable, (SELECT count(*) FROM {t}) AS row_count, u.n AS non_null
FROM (SELECT column_name, column_type FROM (DESCRIBE {t})) d
JOIN (SELECT name, n FROM (SELECT count(COLUMNS(*)) FROM {t}) UNPIVOT (n FOR name IN (COLUMNS(*)))) u ON u.name = d.column_name""" for t in TABLES))
def catalog_columns(spark, sf):
    """(table, column, type, nullable, rows, non-null values) for every driver table, counted over its rows."""
    out = None
    for t in TABLES:
        c = discovery.column_counts(read_table(spark, sf, t), t)
        out = c if out is None else out.unionByName(c)
    return out


_INTEGERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def _keys_sql():
    single = [f"""SELECT '{t}' AS table_name, '{c}' AS key_columns, count(*) AS row_count FROM {t}
HAVING count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*)""" for t, cs in _INTEGERS.items() for c in cs]
    double = [f"""SELECT '{t}' AS table_name, '{a}, {b}' AS key_columns, count(*) AS row_count FROM {t}
HAVING count(*) > 0 AND count({a}) = count(*) AND count({b}) = count(*) AND (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) = count(*)
  AND count(DISTINCT {a}) < count(*) AND count(DISTINCT {b}) < count(*)""" for t, cs in _INTEGERS.items() for i, a in enumerate(cs) for b in cs[i + 1:]]
    return "\nUNION ALL\n".join(single + double)


@query("discovered_keys", _keys_sql())
def discovered_keys(spark, sf):
    """The least sets of one or two whole-number columns that no two rows of a table share."""
    out = None
    for t in SEARCHED:
        k = discovery.unique_columns(read_table(spark, sf, t), t)
        out = k if out is None else out.unionByName(k)
    return out


_VALUES = "\nUNION ALL\n".join(f"SELECT '{t}.{c}' AS c, CAST({c} AS BIGINT) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in _INTEGERS.items() for c in cs)


@query("discovered_join_paths", f"""WITH VALS AS ({_VALUES}),
ND AS (SELECT c, count(*) AS d, max(n) AS most FROM VALS GROUP BY c),
SHARED AS (SELECT a.c AS child, b.c AS parent, count(*) AS both FROM VALS a JOIN VALS b USING (v) WHERE a.c <> b.c GROUP BY 1, 2)
SELECT s.child, s.parent, k.d AS child_values, p.d AS parent_values FROM SHARED s JOIN ND k ON k.c = s.child JOIN ND p ON p.c = s.parent
WHERE s.both = k.d AND p.most = 1""")
def discovered_join_paths(spark, sf):
    """Every whole-number column whose values all lie in a column without repeats (implicit foreign keys)."""
    return discovery.inclusions({t: read_table(spark, sf, t) for t in SEARCHED})
