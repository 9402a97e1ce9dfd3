"""Columns, keys and join paths found in the rows of tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import dealt

#: Tasks that count a value which many rows of a column hold.
SHARES = 16

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_counts(df: DataFrame, name: str) -> DataFrame:
    """One row a column: table, column, type, nullable, rows and non-null values, from one aggregate."""
    row = df.agg(F.count("*").alias("rows_"), *[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
    cells = [F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                      F.lit(f.nullable).alias("nullable"), F.col("rows_").alias("row_count"), F.col(f"`{f.name}`").alias("non_null")) for f in df.schema.fields]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def whole_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, WHOLE)]


def unique_columns(df: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """(table_name, key_columns, row_count): least sets of up to ``depth`` whole-number columns without
    nulls that no two rows share.

    Level by level: a set is tried if no part of it is a key and the product of its columns' distinct
    counts reaches the number of rows. A trial is a two-level count by the set's own columns alone.
    """
    columns = whole_columns(df)
    full = df.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n = full["n"]
    columns = [c for i, c in enumerate(columns) if full[f"c{i}"] == n]
    distinct, keys = {}, []
    for size in range(1, depth + 1):
        for group in combinations(columns, size) if n else ():
            if any(set(k) <= set(group) for k in keys):
                continue
            most = 1
            for c in group:
                most *= distinct.get((c,), n)
            if most < n:
                continue
            distinct[group] = df.select(*group).distinct().count()
            if distinct[group] == n:
                keys.append(group)
    rows = [(name, ", ".join(k), n) for k in keys]
    return df.sparkSession.createDataFrame(rows, "table_name string, key_columns string, row_count long")


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, child_values, parent_values): columns all of whose values a column without repeats holds.

    Every value meets the set of columns that hold it, at most one entry a column; a column lies in
    another if as many of its values meet the other as it has. One shuffle by value for all pairs, after one that
    counts a frequent value in ``SHARES`` tasks; columns go by number, and both are dealt by the number of rows.
    """
    held, rows, names = None, 0, []
    for name, df in tables.items():
        columns = whole_columns(df)
        rows += df.count() * len(columns)
        share = F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("tinyint").alias("share")
        for c in columns:
            one = df.select(F.lit(len(names)).alias("c"), F.col(c).cast("long").alias("v"), share).where(F.col("v").isNotNull())
            held = one if held is None else held.unionByName(one)
            names.append(f"{name}.{c}")
    name_of = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1).alias(c)
    held = dealt(held, ["v", "share"], rows).groupBy("c", "v", "share").agg(F.count("*").alias("n"))
    held = dealt(held, ["v"], rows).groupBy("c", "v").agg(F.sum("n").alias("n"))
    by_value = held.groupBy("v").agg(F.collect_list(F.struct("c", "n")).alias("in"))
    pairs = by_value.select("in", F.explode("in").alias("a")).select(F.col("a.c").alias("child"), F.explode("in").alias("b"))
    pairs = pairs.groupBy("child", F.col("b.c").alias("parent")).agg(F.count("*").alias("both"), F.max("b.n").alias("most"))
    own = pairs.where(F.col("child") == F.col("parent")).select(F.col("child").alias("c"), F.col("both").alias("d"), F.col("most").alias("repeats"))
    child = own.select(F.col("c").alias("child"), F.col("d").alias("child_values"))
    parent = own.where(F.col("repeats") == 1).select(F.col("c").alias("parent"), F.col("d").alias("parent_values"))
    found = pairs.where(F.col("child") != F.col("parent")).join(child, "child").join(parent, "parent").where(F.col("both") == F.col("child_values"))
    return found.select(name_of("child"), name_of("parent"), "child_values", "parent_values")
