"""Source / sink queries: file scans, fallback, snapshots, feature store, export, layouts, run log, entity lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import TRAIN_FRACTION, r6
from tidewater.operators import evaluation as ev
from tidewater.operators import features as fe
from tidewater.operators import validation
from tidewater.plans import evaluation as pe
from tidewater.plans.customer import CUSTOMER_FEATURES_SQL, _round_features
from tidewater.plans.registry import query
from tidewater.plans.sqlviews import with_views
from tidewater.session import cut_lineage
from tidewater.sources import contract, files, loads, sinks
from tidewater.sources import views as V
from tidewater.sources.store import FeatureStore
from tidewater.sources.tables import read_table

PRODUCT_SCHEMA = "product_id long, product_name string, category string, price double, description string"
CPV = with_views("C_products")
CV = with_views("C", "C_products")
OV = with_views("O")


@query("scan_json_roundtrip", CPV + "SELECT * FROM C_products")
def scan_json_roundtrip(spark, sf):
    """S3: catalog written as JSON records to the shared scratch folder, read back with a fixed schema."""
    path = files.shared_scratch(spark, "json")
    V.products(spark, sf).write.json(path)
    return files.read_json_records(spark, path, PRODUCT_SCHEMA, multiline=False)


@query("scan_csv_roundtrip", CPV + "SELECT * FROM C_products")
def scan_csv_roundtrip(spark, sf):
    """Catalog written as CSV with header, read back with a fixed schema."""
    path = files.shared_scratch(spark, "csv")
    V.products(spark, sf).write.option("header", True).csv(path)
    return files.read_csv(spark, path, PRODUCT_SCHEMA)


@query("scan_with_fallback", CPV + "SELECT * FROM C_products")
def scan_with_fallback(spark, sf):
    """Primary (a missing JSON export) fails -> secondary (the catalog table) is used."""
    missing = files.shared_scratch(spark, "missing")
    return files.with_fallback(lambda: files.read_json_records(spark, missing, PRODUCT_SCHEMA),
                               lambda: V.products(spark, sf))


def _store(spark, sf):
    """Interactions of both sides and both catalogs as one table store."""
    store = contract.TableStore(spark, files.shared_scratch(spark, "store"))
    owner = V.owner_interactions(spark, sf).withColumn("interaction_id", F.lit(None).cast("long"))
    store.save("interactions", V.customer_interactions(spark, sf).unionByName(owner))
    store.save("products", V.products(spark, sf))
    store.save("materials", V.materials(spark, sf))
    return store


@query("source_customer_interactions", CV + "SELECT * FROM C")
def source_customer_interactions(spark, sf):
    """The customer rows of the store; the type is a partition filter, so owner files are not read."""
    return _store(spark, sf).interactions("customer")


@query("source_owner_demand", OV + """SELECT user_id, item_id, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS n FROM O
WHERE interaction_type = 'purchase' GROUP BY user_id, item_id""")
def source_owner_demand(spark, sf):
    """Owner rows of the store with a filter and a choice of columns that reach the Parquet reader."""
    rows = _store(spark, sf).interactions("owner").where(F.col("interaction_type") == "purchase")
    return rows.groupBy("user_id", "item_id").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))


@query("source_fallback_catalogs", CPV + """, O_materials_ AS (SELECT p_partkey AS id, p_name AS name, p_type AS category FROM part)
SELECT 'product' AS kind, product_id AS id, product_name AS name, category FROM C_products
UNION ALL SELECT 'material' AS kind, id, name, category FROM O_materials_""")
def source_fallback_catalogs(spark, sf):
    """S5 by table: the export holds products; materials, whose export has no row, come from the store."""
    store = _store(spark, sf)
    root = files.shared_scratch(spark, "export")
    store.products().write.json(f"{root}/products")
    store.materials().where(F.lit(False)).write.json(f"{root}/materials")
    both = contract.Fallback(contract.JsonExport(spark, root), store)
    p = both.products().select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), F.col("product_name").alias("name"), "category")
    m = both.materials().select(F.lit("material").alias("kind"), F.col("material_id").alias("id"), F.col("material_name").alias("name"), "category")
    return p.unionByName(m)


@query("refresh_snapshot", with_views("C", "C_products") + "SELECT *, 2 AS snapshot_version FROM C")
def refresh_snapshot(spark, sf):
    """Snapshot v1 from the interactions; an empty refresh keeps v1; a non-empty one writes v2."""
    base = files.shared_scratch(spark, "snapshot")
    c = V.customer_interactions(spark, sf)
    v, _ = files.refresh_snapshot(c, base, 0)
    v, _ = files.refresh_snapshot(c.where(F.lit(False)), base, v)
    v, path = files.refresh_snapshot(c, base, v)
    return spark.read.parquet(path).withColumn("snapshot_version", F.lit(v))


def _cf_round(spark, sf):
    return _round_features(fe.customer_features(V.customer_interactions(spark, sf), V.products(spark, sf)))


@query("feature_store_save_load", CUSTOMER_FEATURES_SQL + """
SELECT user_id, item_id, round(weighted_score, 6) AS weighted_score, round(recency_days, 6) AS recency_days,
       favorite_category_1, favorite_category_2, favorite_category_3, round(avg_spend, 6) AS avg_spend,
       purchase_count, product_category, round(price, 6) AS price, item_interaction_count,
       round(item_score_sum, 6) AS item_score_sum, repeated_purchase_count FROM CF""")
def feature_store_save_load(spark, sf):
    """Save the customer feature frame (v1), load the latest version."""
    store = FeatureStore(spark, files.shared_scratch(spark, "store"))
    store.save(_cf_round(spark, sf), "customer_features")
    return store.load("customer_features")


@query("feature_store_versions", CUSTOMER_FEATURES_SQL + """
SELECT CAST(v AS BIGINT) AS version, (SELECT count(*) FROM CF) AS row_count FROM range(1, 4) t(v)""")
def feature_store_versions(spark, sf):
    """Three saves plus a junk folder -> versions 1..3 (numeric order), row count of each."""
    base = files.shared_scratch(spark, "store")
    store = FeatureStore(spark, base)
    f = _cf_round(spark, sf).select("user_id", "item_id", "weighted_score")
    for _ in range(3):
        store.save(f, "customer_features")
    f.limit(1).write.parquet(f"{base}/customer_features/version=latest_backup")
    out = None
    for v in store.list_versions("customer_features"):
        r = store.load("customer_features", v).agg(F.count("*").alias("row_count")).select(
            F.lit(v).cast("long").alias("version"), "row_count")
        out = r if out is None else out.unionByName(r)
    return out


@query("export_table_sample", with_views("C", "C_products") + """
SELECT 'interactions' AS source, CAST(100 AS BIGINT) AS rows_requested, (SELECT least(count(*), 100) FROM C) AS rows_exported,
       * FROM (SELECT * FROM C ORDER BY interaction_id LIMIT 100)""")
def export_table_sample(spark, sf):
    """First 100 interactions by key with the export envelope."""
    return sinks.export_sample(V.customer_interactions(spark, sf), ["interaction_id"], 100, "interactions")


@query("export_sample_json", with_views("C", "C_products") + """
SELECT 'interactions' AS source, CAST(100 AS BIGINT) AS rows_requested, (SELECT least(count(*), 100) FROM C) AS rows_exported,
       interaction_id, user_id, item_id, interaction_type, price, strftime(interaction_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS interaction_timestamp
FROM (SELECT * FROM C ORDER BY interaction_id LIMIT 100)""")
def export_sample_json(spark, sf):
    """The export envelope as one JSON document with ISO timestamps (S3: its array of records read back)."""
    path = files.shared_scratch(spark, "export")
    sinks.write_json_export(V.customer_interactions(spark, sf), ["interaction_id"], path, 100, "interactions")
    rows = "rows array<struct<interaction_id: long, user_id: long, item_id: long, interaction_type: string, price: double, interaction_timestamp: string>>"
    doc = files.read_json_records(spark, path, f"source string, rows_requested long, rows_exported long, {rows}")
    return doc.select("source", "rows_requested", "rows_exported", F.inline("rows"))


@query("report_json", with_views("C", "C_products") + """
SELECT interaction_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM C GROUP BY 1""")
def report_json(spark, sf):
    """Signal counts as a JSON report, read back."""
    path = files.shared_scratch(spark, "report")
    c = V.customer_interactions(spark, sf)
    total = c.agg(F.count("*")).scalar()
    g = c.groupBy("interaction_type").agg(F.count("*").alias("n"))
    g.select("interaction_type", "n", r6(100.0 * F.col("n") / total).alias("pct")).write.json(path)
    return files.read_json_records(spark, path, "interaction_type string, n long, pct double", multiline=False)


def _decimals_as_double(df):
    """Query output carries money as double (2 places); the layout itself is decimal(18,2)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
                       for f in df.schema.fields])


LAYOUT_SQL = with_views("C_products", "CATIDS", "C")


@query("convert_products_layout", LAYOUT_SQL + """, AS_OF AS (SELECT max(interaction_timestamp) AS t FROM C)
SELECT p.product_id AS Id, p.product_name AS Name, COALESCE(p.description, '') AS Description, CAST(CAST(p.price AS DECIMAL(18,2)) AS DOUBLE) AS Price,
  (SELECT t FROM AS_OF) AS CreatedAt, CAST(NULL AS TIMESTAMP) AS UpdatedAt, CAST(NULL AS VARCHAR) AS CreatedBy, CAST(NULL AS VARCHAR) AS UpdatedBy,
  false AS IsDeleted, CAST(NULL AS TIMESTAMP) AS DeletedAt, (SELECT t FROM AS_OF) AS ApprovedAt, 'SystemSeeder' AS ApprovedBy,
  1 AS BusinessOwnerProfileId, CAST(c.category_id AS INTEGER) AS CategoryId, CAST(NULL AS VARCHAR) AS RejectionReason, 1 AS Status,
  100 AS StockQuantity, CAST(NULL AS VARCHAR) AS Tags, CAST(NULL AS DOUBLE) AS AvgRating, 0 AS CartAddCount,
  CAST(NULL AS DOUBLE) AS DemandForecastQty, CAST(NULL AS TIMESTAMP) AS DemandForecastUpdatedAt, CAST(NULL AS DOUBLE) AS DescriptionQualityScore,
  false AS LowStockFlag, 0 AS PurchaseCount, CAST(0 AS DOUBLE) AS RevenueTotal, 0 AS ViewCount, CAST(NULL AS VARCHAR) AS DeletedBy,
  true AS IsVisible, 0 AS FeaturedOrder, false AS IsFeatured
FROM C_products p LEFT JOIN CATIDS c ON p.category = c.p_type""")
def convert_products_layout(spark, sf):
    """Product catalog -> operational layout; CreatedAt = newest interaction (deterministic as-of)."""
    as_of = V.customer_interactions(spark, sf).agg(F.max("interaction_timestamp")).scalar()
    return _decimals_as_double(sinks.products_layout(V.products(spark, sf), V.category_ids(spark, sf), as_of))


@query("convert_materials_layout", with_views("O_materials", "O") + """, AS_OF AS (SELECT max(interaction_timestamp) AS t FROM O)
SELECT material_id AS Id, material_name AS Name, COALESCE(description, '') AS Description, CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) AS Price,
  'pcs' AS Unit, 1 AS MinimumOrderQuantity, 100 AS StockQuantity, true AS IsAvailable, category AS Category,
  CAST(NULL AS VARCHAR) AS PictureUrl, 1 AS SupplierId, (SELECT t FROM AS_OF) AS CreatedAt, CAST(NULL AS TIMESTAMP) AS UpdatedAt,
  CAST(NULL AS VARCHAR) AS CreatedBy, CAST(NULL AS VARCHAR) AS UpdatedBy, false AS IsDeleted, CAST(NULL AS TIMESTAMP) AS DeletedAt,
  CAST(NULL AS VARCHAR) AS DeletedBy, 0 AS OrderFrequency, '' AS PriceTrend FROM O_materials""")
def convert_materials_layout(spark, sf):
    as_of = V.owner_interactions(spark, sf).agg(F.max("interaction_timestamp")).scalar()
    return _decimals_as_double(sinks.materials_layout(V.materials(spark, sf), as_of))


@query("validate_layout", LAYOUT_SQL + """, L AS (SELECT p.product_id AS Id, p.product_name AS Name, p.price AS Price, c.category_id AS CategoryId
  FROM C_products p LEFT JOIN CATIDS c ON p.category = c.p_type)
SELECT count(*) AS row_count,
  count(*) FILTER (WHERE Id IS NULL) + count(*) FILTER (WHERE Name IS NULL) + count(*) FILTER (WHERE Price IS NULL)
  + count(*) FILTER (WHERE CategoryId IS NULL) AS null_required,
  count(*) FILTER (WHERE NOT CategoryId BETWEEN 1 AND (SELECT count(*) FROM CATIDS)) AS bad_category, 0 AS type_mismatches FROM L""")
def validate_layout(spark, sf):
    """violation counts of the converted product layout; raises if there are any."""
    ids = V.category_ids(spark, sf)
    as_of = V.customer_interactions(spark, sf).agg(F.max("interaction_timestamp")).scalar()
    layout = sinks.products_layout(V.products(spark, sf), ids, as_of)
    return sinks.assert_layout(sinks.validate_layout(layout, sinks.PRODUCT_REQUIRED, sinks.PRODUCT_TYPES, ids.count()))


@query("validate_materials_layout", with_views("O_materials") + """
SELECT count(*) AS row_count, count(*) FILTER (WHERE material_id IS NULL) + count(*) FILTER (WHERE material_name IS NULL)
  + count(*) FILTER (WHERE price IS NULL) + count(*) FILTER (WHERE category IS NULL) AS null_required, 0 AS bad_category, 0 AS type_mismatches FROM O_materials""")
def validate_materials_layout(spark, sf):
    """the same for the raw-material layout, which has no category range."""
    as_of = V.owner_interactions(spark, sf).agg(F.max("interaction_timestamp")).scalar()
    layout = sinks.materials_layout(V.materials(spark, sf), as_of)
    return sinks.assert_layout(sinks.validate_layout(layout, sinks.MATERIAL_REQUIRED, sinks.MATERIAL_TYPES))


@query("bulk_load_interactions", with_views("C", "C_products") + "SELECT * FROM C")
def bulk_load_interactions(spark, sf):
    """Interactions appended by a committed load, which is then repeated; read back."""
    path = files.shared_scratch(spark, "bulk")
    c = V.customer_interactions(spark, sf)
    for _ in range(2):
        loads.load(spark, path, {"interactions": c}, "seed")
    return loads.loaded(spark, path, "interactions", c.schema)


@query("bulk_load_history", with_views("C", "C_products", "O") + """SELECT 'customers' AS load_id, 'interactions' AS table_name, count(*) AS row_count FROM C
UNION ALL SELECT 'customers', 'products', count(*) FROM C_products UNION ALL SELECT 'owners', 'interactions', count(*) FROM O""")
def bulk_load_history(spark, sf):
    """Two loads of one or two tables each, a third one taken back; rows by load as the manifests have them."""
    path = files.shared_scratch(spark, "bulk")
    c, o = V.customer_interactions(spark, sf), V.owner_interactions(spark, sf)
    loads.load(spark, path, {"interactions": c, "products": V.products(spark, sf)}, "customers")
    loads.load(spark, path, {"interactions": o}, "owners")
    loads.load(spark, path, {"interactions": o}, "mistake")
    loads.rollback(spark, path, "mistake")
    rows = [(i, t, v["rows"]) for i, m in loads.manifests(spark, path).items() for t, v in m["tables"].items()]
    return spark.createDataFrame(rows, "load_id string, table_name string, row_count long")


@query("run_log_append", CUSTOMER_FEATURES_SQL + """,
ENTRIES AS (SELECT 'alpha' AS name, '0.4' AS value, 'param' AS type UNION ALL SELECT 'train_fraction', '0.85', 'param'
  UNION ALL SELECT 'n_users', CAST(CAST(count(DISTINCT user_id) AS DOUBLE) AS VARCHAR), 'metric' FROM CF
  UNION ALL SELECT 'n_pairs', CAST(CAST(count(*) AS DOUBLE) AS VARCHAR), 'metric' FROM CF)
SELECT r.run_id, 'customer' AS kind, e.name, e.value, e.type FROM ENTRIES e CROSS JOIN (SELECT unnest(['run-1', 'run-2']) AS run_id) r""")
def run_log_append(spark, sf):
    """Two runs appended to the run log (params + metrics), read back."""
    path = files.shared_scratch(spark, "runs")
    c = V.customer_interactions(spark, sf)
    f = fe.customer_features(c, V.products(spark, sf))
    m = f.agg(F.countDistinct("user_id").cast("double").alias("n_users"), F.count("*").cast("double").alias("n_pairs"))
    metrics = m.select(F.explode(F.array(F.struct(F.lit("n_users").alias("metric"), F.col("n_users").alias("value")),
                                         F.struct(F.lit("n_pairs").alias("metric"), F.col("n_pairs").alias("value")))).alias("x")).select("x.*")
    for i in (1, 2):
        sinks.append_run(spark, path, f"run-{i}", "customer", {"alpha": 0.4, "train_fraction": 0.85}, metrics)
    return spark.read.parquet(path)


CANDIDATE_ALPHAS = (0.4, 0.8)


def _gate_sql() -> str:
    """Precision of each candidate, then the gate: at least the precision promoted before."""
    runs = " UNION ALL ".join(f"SELECT {i} AS nth, {a} AS alpha, (SELECT value FROM ({pe.eval_products_sql(a)}) WHERE metric = 'precision_at_5') AS p5"
                              for i, a in enumerate(CANDIDATE_ALPHAS, 1))
    return f"""WITH RUNS AS ({runs}),
G AS (SELECT *, COALESCE(max(p5) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS baseline FROM RUNS)
SELECT 'candidate-' || nth AS run_id, CAST(alpha AS DOUBLE) AS alpha, p5 AS precision_at_5, CAST(baseline AS DOUBLE) AS baseline, p5 >= baseline AS promoted,
       (SELECT max(nth) FROM G WHERE p5 >= baseline) = nth AS current FROM G"""


@query("promote_if_better", _gate_sql())
def promote_if_better(spark, sf):
    """Two candidates (blends), each with its model table as a version; the pointer moves to a
    candidate whose precision@5 on the temporal split is at least that of the promoted one.

    As a training run does: the training features are kept as a version and checked (violations go to the run log and
    stop nothing), each candidate's model is kept as a version and measured as loaded from it, and its parameters and
    metrics are a run of the log, from which the gate takes both precisions."""
    store, runs = FeatureStore(spark, files.shared_scratch(spark, "promotion")), files.shared_scratch(spark, "runs")
    feats, rel = pe.customer_split(spark, sf)
    trained = store.save(feats, "customer_features")
    feats, rel = store.load("customer_features", trained), cut_lineage(rel)
    checks = validation.validation_counts(feats, "customer")
    checks = checks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in checks.columns])).alias("x")).select("x.*")
    checks = cut_lineage(checks)
    logged = lambda run: {r["name"]: r["value"] for r in spark.read.parquet(runs).where((F.col("run_id") == run) & (F.col("type") == "metric")).collect()}
    decisions, promoted = [], None
    models = pe.product_models(spark, sf, CANDIDATE_ALPHAS, feats, rel.select("user_id").distinct())
    for i, (alpha, model) in enumerate(zip(CANDIDATE_ALPHAS, models), 1):
        version, run = store.save(model, "customer_model"), f"candidate-{i}"
        lists = store.load("customer_model", version).where(F.col("part") == "list").select("user_id", "rank", "item_id")
        params = {"alpha": alpha, "train_fraction": TRAIN_FRACTION, "feature_version": trained, "model_version": version}
        sinks.append_run(spark, runs, run, "customer", params, pe.list_metrics(lists, rel).unionByName(checks))
        p5, baseline = float(logged(run)["precision_at_5"]), float(logged(promoted)["precision_at_5"]) if promoted else 0.0
        ok = ev.should_promote(p5, baseline)
        if ok:
            store.save(spark.createDataFrame([(version, run)], "version int, run_id string"), "customer_pointer")
            promoted = store.load("customer_pointer").first()["run_id"]
        decisions.append((version, run, alpha, p5, baseline, ok))
    pointer = store.load("customer_pointer").select(F.col("version").alias("at"))
    rows = spark.createDataFrame(decisions, "version int, run_id string, alpha double, precision_at_5 double, baseline double, promoted boolean")
    current = rows.join(pointer, rows.version == pointer["at"], "left")
    return current.select("run_id", "alpha", "precision_at_5", "baseline", "promoted", F.col("at").isNotNull().alias("current"))


@query("entity_list_customers", """SELECT c.c_custkey AS customer_id, c.c_name AS name, n.n_name AS nation
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1""")
def entity_list_customers(spark, sf):
    """Customers joined with their nation, restricted to one region (the role constant)."""
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation").where(F.col("n_regionkey") == 1)
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


@query("entity_list_owners", """SELECT CAST(s_suppkey AS VARCHAR) AS owner_id, s_name AS name FROM supplier WHERE s_acctbal >= 0""")
def entity_list_owners(spark, sf):
    """Active (non-negative balance) suppliers, id cast to string."""
    s = read_table(spark, sf, "supplier").where(F.col("s_acctbal") >= 0)
    return s.select(F.col("s_suppkey").cast("string").alias("owner_id"), F.col("s_name").alias("name"))
