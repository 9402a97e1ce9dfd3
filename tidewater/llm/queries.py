"""Registered queries of the operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import chat, cross_tokens, decontaminate, kneser_ney, mixing, near_dedup, quality_knn, quality_rules, secrets, toxicity, url_rules, warc, whitening
from tidewater.llm.common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_knn.label_fold(3)
    out = quality_knn.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold != 1)
    held_out = F.coalesce(fold == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = toxicity.label_fold(4)
    out = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold != 2)
    held_out = F.coalesce(fold == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.formatted(chat.chained(rows.unionByName(more)))).drop("rank")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexities(read_table(spark, sf_dir, "documents"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.alignment(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality_knn, op3_toxicity, op4_chat_format, op5_warc, op6_near_dedup, op7_quality_rules, op8_mixing, op9_url_rules, op10_secrets, op11_whitening, op12_kneser_ney, op13_cross_tokens)}
#: The other queries rest on trained models, seeded draws, mined rules or a token vocabulary.
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op4_chat_format": chat.ORACLE, "op5_warc": warc.ORACLE, "op6_near_dedup": near_dedup.ORACLE}
