"""Text and similarity queries: TF-IDF, content / collaborative similarity, neighbours, co-purchase."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import KNN_NEIGHBORS, r6
from tidewater.operators import features as fe
from tidewater.operators import rankers as rk
from tidewater.operators import similarity as sim
from tidewater.operators import text
from tidewater.plans.customer import CUSTOMER_FEATURES_SQL
from tidewater.plans.registry import query
from tidewater.plans.sqlblocks import STOP_SQL, colcos_sql, tfidf_sql
from tidewater.plans.sqlviews import with_views
from tidewater.sources import views as V

TOP_SIMILAR = 10
PRODUCT_DOCS = "SELECT product_id AS doc_id, category || ' ' || description AS txt FROM C_products"


@query("tfidf_weights", with_views("C_products") + ", " + tfidf_sql(PRODUCT_DOCS) + """
SELECT doc_id AS item_id, term, tf, round(idf, 6) AS idf, round(weight, 6) AS weight FROM X""")
def tfidf_weights(spark, sf):
    x = rk.product_tfidf(V.products(spark, sf))
    return x.select(F.col("doc_id").alias("item_id"), "term", "tf", r6(F.col("idf")).alias("idf"),
                    r6(F.col("weight")).alias("weight"))


@query("content_similar_items", with_views("C_products") + ", " + tfidf_sql(PRODUCT_DOCS) + f""",
S AS (SELECT a.doc_id AS item_i, b.doc_id AS item_j, sum(a.weight * b.weight) AS sim FROM X a JOIN X b USING (term) GROUP BY 1, 2)
SELECT item_i AS item_id, item_j AS similar_item_id, round(sim, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS rank FROM S WHERE item_i <> item_j)
WHERE rank <= {TOP_SIMILAR}""")
def content_similar_items(spark, sf):
    p = V.products(spark, sf)
    t = sim.content_neighbors(rk.product_tfidf(p), TOP_SIMILAR)
    return t.select(F.col("item_i").alias("item_id"), F.col("item_j").alias("similar_item_id"),
                    r6(F.col("sim")).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("cf_similar_items", CUSTOMER_FEATURES_SQL + ", " + colcos_sql("CF", "user_id", "item_id", "weighted_score") + f"""
SELECT item_i AS item_id, item_j AS similar_item_id, round(sim, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS rank FROM SIM WHERE item_i <> item_j)
WHERE rank <= {TOP_SIMILAR}""")
def cf_similar_items(spark, sf):
    p = V.products(spark, sf)
    f = fe.customer_features(V.customer_interactions(spark, sf), p)
    s = sim.column_cosine(f, "user_id", "item_id", "weighted_score")
    t = sim.top_neighbors(s, TOP_SIMILAR, include_self=False)
    return t.select(F.col("item_i").alias("item_id"), F.col("item_j").alias("similar_item_id"),
                    r6(F.col("sim")).alias("similarity"), F.col("rank").cast("long").alias("rank"))


TQ = with_views("T", "T_products")


@query("knn_neighbors", TQ + ", " + colcos_sql("T", "customer_id", "product_id", "quantity") + f"""
SELECT item_i AS product_id, item_j AS neighbor_id, round(sim, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS rank FROM SIM)
WHERE rank <= {KNN_NEIGHBORS}""")
def knn_neighbors(spark, sf):
    """M5: 20 nearest products (self included) by cosine of customer-quantity columns."""
    t = V.transactions(spark, sf)
    s = sim.column_cosine(t, "customer_id", "product_id", "quantity")
    n = sim.top_neighbors(s, KNN_NEIGHBORS, include_self=True)
    return n.select(F.col("item_i").alias("product_id"), F.col("item_j").alias("neighbor_id"),
                    r6(F.col("sim")).alias("similarity"), F.col("rank").cast("long").alias("rank"))


BIGRAM_SQL = TQ + f""",
D AS (SELECT product_id AS doc_id, name || ' ' || category || ' ' || subcategory AS txt FROM T_products),
TK AS (SELECT doc_id, list_filter(regexp_extract_all(lower(txt), '\\b\\w\\w+\\b'), lambda x: x NOT IN ({STOP_SQL})) AS t FROM D),
G AS (SELECT doc_id, unnest(t) AS term FROM TK
      UNION ALL
      SELECT doc_id, t[i] || ' ' || t[i + 1] AS term FROM TK, range(1, len(t)) r(i)),
FQ AS (SELECT term, count(*) AS corpus_tf, count(DISTINCT doc_id) AS df FROM G GROUP BY term)
"""


@query("tfidf_bigrams_top100", BIGRAM_SQL + """
SELECT term, corpus_tf, df FROM FQ ORDER BY corpus_tf DESC, term LIMIT 100""")
def tfidf_bigrams_top100(spark, sf):
    """M4: unigram+bigram vocabulary capped at 100 features by corpus frequency (older catalog text)."""
    p = V.products_k(spark, sf)
    docs = p.select("product_id", F.concat_ws(" ", "name", "category", "subcategory").alias("txt"))
    return text.bigram_vocabulary(docs, "product_id", "txt", 100)


@query("tfidf_bigram_weights", BIGRAM_SQL + """, VO AS (SELECT term, df FROM FQ ORDER BY corpus_tf DESC, term LIMIT 100),
RW AS (SELECT doc_id, term, count(*) * (ln((1.0 + (SELECT count(*) FROM D)) / (1 + max(df))) + 1) AS raw FROM G JOIN VO USING (term) GROUP BY 1, 2)
SELECT doc_id AS item_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM RW""")
def tfidf_bigram_weights(spark, sf):
    """M4: TF-IDF weights over the capped unigram + bigram vocabulary."""
    p = V.products_k(spark, sf)
    docs = p.select("product_id", F.concat_ws(" ", "name", "category", "subcategory").alias("txt"))
    w = text.bigram_tfidf(docs, "product_id", "txt", 100)
    return w.select(F.col("doc_id").alias("item_id"), "term", r6(F.col("weight")).alias("weight"))


MQ = with_views("M", "OK_materials")


@query("copurchase_counts", MQ + """,
DM AS (SELECT DISTINCT owner_id, material_id FROM M)
SELECT a.material_id AS material_a, b.material_id AS material_b, count(*) AS n_owners
FROM DM a JOIN DM b ON a.owner_id = b.owner_id GROUP BY 1, 2""")
def copurchase_counts(spark, sf):
    c = sim.cooccurrence(V.owner_purchases(spark, sf), "owner_id", "material_id")
    return c.select(F.col("item_a").alias("material_a"), F.col("item_b").alias("material_b"), "n_owners")


@query("copurchase_similarity", MQ + """,
DM AS (SELECT DISTINCT owner_id, material_id FROM M),
CO AS (SELECT a.material_id AS ma, b.material_id AS mb, count(*) AS n FROM DM a JOIN DM b ON a.owner_id = b.owner_id GROUP BY 1, 2),
""" + colcos_sql("CO", "mb", "ma", "n") + """
SELECT item_i AS material_a, item_j AS material_b, round(sim, 6) AS similarity FROM SIM""")
def copurchase_similarity(spark, sf):
    """M7: cosine between co-purchase rows (row scaling cancels in the cosine)."""
    c = sim.cooccurrence(V.owner_purchases(spark, sf), "owner_id", "material_id")
    s = sim.column_cosine(c.withColumn("n", F.col("n_owners").cast("double")), "item_b", "item_a", "n")
    return s.select(F.col("item_i").alias("material_a"), F.col("item_j").alias("material_b"), r6(F.col("sim")).alias("similarity"))
