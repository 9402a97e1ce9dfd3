"""Data-source contract: the marketplace tables by name, from whichever store holds them.

A source gives ``interactions(user_type)``, ``products()`` and ``materials()`` with the columns and
types declared here, whatever its store holds: further columns are left out, a missing one is an error.
``TableStore`` keeps interactions in Parquet folders by user type, so a load of one type lists and reads
the files of that type alone, and further filters and column choices reach the Parquet reader.
``JsonExport`` reads JSON lines. ``Fallback`` takes each table from its first source that can be read and
has rows; which one that is, is settled once a table, by one row.

Null user types are kept (folder of the null value) and loaded by no type; an empty store gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.files import path_exists, read_json_records, with_fallback


def declared(columns: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    out = T.StructType()
    for column in columns.split(", "):
        out.add(*column.split(" "))
    return out


INTERACTIONS = declared(
    "interaction_id long, user_type string, user_id long, item_id long, item_type string, interaction_type string, "
    "category string, quantity integer, price double, interaction_timestamp timestamp_ntz")
PRODUCTS = declared("product_id long, product_name string, category string, price double, description string")
MATERIALS = declared("material_id long, material_name string, category string, price double, description string")
TABLES = {"interactions": INTERACTIONS, "products": PRODUCTS, "materials": MATERIALS}


def conform(df: DataFrame, schema: T.StructType, table: str = "table") -> DataFrame:
    """The declared columns of ``df`` with the declared types; ValueError if one is missing."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


class Source:
    """Loads by table name; a store says in ``scan`` how a table is read."""

    def scan(self, table: str) -> DataFrame:
        raise NotImplementedError

    def load(self, table: str) -> DataFrame:
        return conform(self.scan(table), TABLES[table], table)

    def interactions(self, user_type: str) -> DataFrame:
        return self.load("interactions").where(F.col("user_type") == user_type)

    def products(self) -> DataFrame:
        return self.load("products")

    def materials(self) -> DataFrame:
        return self.load("materials")


class TableStore(Source):
    """Parquet folders below ``root``, interactions partitioned by user type."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def scan(self, table: str) -> DataFrame:
        if not path_exists(self.spark, self.path(table)):
            raise FileNotFoundError(f"no table {table} below {self.root}")
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))

    def save(self, table: str, df: DataFrame) -> None:
        """Write a table that is not there yet; rows are written where they lie, so a hot type keeps all its tasks."""
        out = conform(df, TABLES[table], table).write.mode("errorifexists")
        (out.partitionBy("user_type") if table == "interactions" else out).parquet(self.path(table))


class JsonExport(Source):
    """JSON lines below ``root``, one folder a table, read with the declared types."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def scan(self, table: str) -> DataFrame:
        return read_json_records(self.spark, f"{self.root}/{table}", TABLES[table], multiline=False)


class Fallback(Source):
    """Each table from ``primary`` if it can be read and has rows, else from ``secondary``."""

    def __init__(self, primary: Source, secondary: Source):
        self.primary, self.secondary, self.chosen = primary, secondary, {}

    def scan(self, table: str) -> DataFrame:
        if table not in self.chosen:
            self.chosen[table] = self.primary
            with_fallback(lambda: self.primary.load(table), lambda: self.chosen.__setitem__(table, self.secondary))
        return self.chosen[table].load(table)
