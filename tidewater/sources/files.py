"""File sources: JSON array / CSV scans with fixed schemas, fallback scan, snapshot refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from tidewater.session import ensure_checkpoint_dir


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tidewater-io/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_json_records(spark: SparkSession, path: str, schema, multiline: bool = True) -> DataFrame:
    """S3: JSON array-of-records (multiLine) or JSON lines with a declared schema; missing path -> FileNotFoundError."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"JSON source not found: {path}")
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header and a declared schema (no inference)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"CSV source not found: {path}")
    return spark.read.schema(schema).option("header", True).csv(path)


def with_fallback(primary, secondary) -> DataFrame:
    """Use ``primary()`` if it loads and is non-empty, else ``secondary()`` (driver-side choice, no union)."""
    try:
        df = primary()
        if not df.isEmpty():
            return df
    except (AnalysisException, FileNotFoundError, OSError):
        pass
    return secondary()


def refresh_snapshot(latest: DataFrame, base: str, current_version: int) -> tuple[int, str]:
    """Write ``latest`` as a new snapshot version only when it has rows; else keep the current one.

    Writes go to a new version folder (never overwriting a path being read);
    returns (version, path) of the snapshot to use.
    """
    if latest.isEmpty():
        return current_version, f"{base}/version={current_version}"
    v = current_version + 1
    latest.write.mode("errorifexists").parquet(f"{base}/version={v}")
    return v, f"{base}/version={v}"
