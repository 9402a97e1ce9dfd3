"""TF-IDF over catalog text (smooth idf, raw tf, L2-normalised rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import STOP_WORDS, TOKEN_PATTERN


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term) rows: lower-cased ``\\b\\w\\w+\\b`` tokens minus English stop words."""
    t = docs.select(F.col(id_col).alias("doc_id"),
                    F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)).alias("term"))
    return t.where(~F.col("term").isin(STOP_WORDS))


def tfidf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf, idf, weight) with idf = ln((1+n)/(1+df)) + 1 and unit-length rows.

    n counts every document, including ones without tokens. The document
    frequency table has one row a term.
    """
    tf = tokens(docs, id_col, text_col).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*")).scalar()
    dfreq = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = dfreq.select("term", (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    # idf: one row per vocabulary term
    w = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return w.join(norm, "doc_id").select(
        "doc_id", "term", "tf", "idf", (F.col("raw") / F.col("norm")).alias("weight"))


def _grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term) rows of unigrams and bigrams after stop-word removal."""
    toks = docs.select(F.col(id_col).alias("doc_id"),
                       F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0).alias("t"))
    toks = toks.select("doc_id", F.filter("t", lambda x: ~x.isin(STOP_WORDS)).alias("t"))
    return toks.select("doc_id", F.explode(F.concat(
        F.col("t"),
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))),
                    lambda i: F.when(F.size("t") > 1, F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))),
    )).alias("term")).where(F.col("term").isNotNull())


def bigram_vocabulary(docs: DataFrame, id_col: str, text_col: str, max_features: int) -> DataFrame:
    """Top ``max_features`` unigrams+bigrams (after stop-word removal) by corpus frequency.

    Ties on frequency are broken by term (alphabetical), as a vectorizer's
    vocabulary is alphabetical. Returns (term, corpus_tf, df).
    """
    grams = _grams(docs, id_col, text_col)
    freq = grams.groupBy("term").agg(F.count("*").alias("corpus_tf"), F.countDistinct("doc_id").alias("df"))
    return freq.orderBy(F.col("corpus_tf").desc(), F.col("term").asc()).limit(max_features)


def bigram_tfidf(docs: DataFrame, id_col: str, text_col: str, max_features: int) -> DataFrame:
    """M4: (doc_id, term, weight) of the capped vocabulary: smooth idf, raw tf, unit rows."""
    vocabulary = bigram_vocabulary(docs, id_col, text_col, max_features)
    n = docs.agg(F.count("*")).scalar()
    idf = vocabulary.select("term", (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    tf = _grams(docs, id_col, text_col).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return w.join(norm, "doc_id").select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))
