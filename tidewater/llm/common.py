"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut_lineage, ensure_checkpoint_dir
from tidewater.sources.tables import read_table

__all__ = ["read_table", "checkpointed", "written", "text_key", "bounded_batches", "pick_ids", "scratch_path", "words_count"]

#: Rows in one Arrow batch sent to a Python worker. Texts average some kB, so a batch stays in the
#: low MB; a batch of very long texts is cut further inside the task (textkit.chunks).
ARROW_ROWS = 500

#: At most this many ids (8 to 24 bytes each) are broadcast; more go through a shuffle join.
BROADCAST_IDS = 500_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; an even smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for frames that a loop joins again and again.

    A checkpoint keeps the planner's size estimate, which joins multiply; after some rounds the number
    alone would take the driver minutes. A table has the size of its files.
    """
    path = scratch_path(df.sparkSession, "loop")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_key(text: Column | str) -> Column:
    """16-byte identity of a text (MD5 of its UTF-8 bytes); null counts as the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))


def words_count(text: Column | str) -> Column:
    """Number of maximal runs of characters other than space, tab, LF, VT, FF, CR; null: 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def pick_ids(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` marked for broadcast when at most ``limit`` rows, else left to a shuffle join.

    ``ids`` should be checkpointed or otherwise cheap to count.
    """
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
