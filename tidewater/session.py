"""Session helpers: a local session for tests/bench and lineage-cut locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidewater") -> SparkSession:
    """Session used by tests and bench; a cluster submits its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEWATER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    A cluster sets ``spark.checkpoint.dir`` to a shared filesystem. Only a
    session whose driver and executors are one process may do without it and
    gets a scratch folder of its own; any other session is refused.
    """
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        cp = spark.sparkContext._jsc.sc().getCheckpointDir()
        cp = cp.get() if cp.isDefined() else None
    if not cp and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not cp:
        cp = tempfile.mkdtemp(prefix="tidewater-cp-")
        spark.conf.set("spark.checkpoint.dir", cp)
    spark.sparkContext.setCheckpointDir(cp)
    return cp


#: Rows above which a table that others look up is not broadcast, whatever its size on disk.
BROADCAST_ROWS = 100_000


def looked_up(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table``, kept from being broadcast if it has many rows (``rows`` where known): a file of a few MB can hold millions, and the
    planner, which knows the file's size alone, would gather them in the driver. For joins by its key."""
    return table.hint("merge") if (table.count() if rows is None else rows) > BROADCAST_ROWS else table


def sent(table: DataFrame) -> DataFrame:
    """``table`` (best checkpointed, as it is counted), broadcast if it has few rows, whatever the planner expects of what it
    was made from, and kept from it otherwise."""
    rows = table.count()
    return looked_up(table, rows) if rows > BROADCAST_ROWS else table.hint("broadcast")


#: Rows of a task where partitions are dealt by rows: some 100 MB a sort.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, keys: list[str], rows: int | None) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its ``rows`` (about, where known) ask for. Adaptive execution merges
    partitions by compressed bytes, and narrow rows that compress well fill a task's memory with tens of millions; a
    number that is given stays."""
    if rows is None:
        return df
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, -(-rows // ROWS_A_TASK), min(most, -(-rows // 20_000))), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
