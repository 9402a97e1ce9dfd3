"""Append loads that are visible as a whole or not at all.

A load writes its tables to folders of its own below ``data`` and is committed by one small manifest
file that names them; readers take what manifests name and nothing else. So a load that fails, or whose
driver or executors are lost, leaves no row; repeating a committed load id adds none; and all tables of
a load appear at the same moment. The manifest is renamed into place, which fails if it is there, on any
Hadoop file system with an atomic rename. One driver at a time may run a given load id.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._-]*")


class Folder:
    """Files below ``root`` through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, old: str, new: str) -> None:
        """Rename; an error if ``new`` is there."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.path(old), self.path(new), self.gateway.new_array(kind, 0))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifests(spark: SparkSession, root: str) -> dict[str, dict]:
    """Committed loads by id: ``{"tables": {table: {"folder": ..., "rows": ...}}}``; one small file each."""
    f = Folder(spark, root)
    return {n.removesuffix(".json"): json.loads(f.read(f"manifest/{n}")) for n in f.names("manifest") if n.endswith(".json") and not n.startswith(".")}


def load(spark: SparkSession, root: str, tables: dict[str, DataFrame], load_id: str) -> dict[str, int]:
    """Append all ``tables`` under ``load_id`` and return their rows; a committed id is left as it is.

    A failure removes what the load has written and is raised again.
    """
    for name in (load_id, *tables):
        if not NAME.fullmatch(name):
            raise ValueError(f"not a name of letters, digits and . _ -: {name!r}")
    f = Folder(spark, root)
    done = f"manifest/{load_id}.json"
    if not f.fs.exists(f.path(done)):
        abandon(spark, root, load_id)
        attempt = uuid.uuid4().hex
        held = {t: {"folder": f"data/{t}/{load_id}/{attempt}"} for t in tables}
        try:
            for t, df in tables.items():
                df.write.parquet(f"{f.root}/{held[t]['folder']}")
                held[t]["rows"] = spark.read.schema(df.schema).parquet(f"{f.root}/{held[t]['folder']}").count()
            own = f"manifest/.{load_id}.{attempt}"
            f.write(own, json.dumps({"tables": held}, sort_keys=True))
            f.rename_new(own, done)
        except BaseException:
            if not f.fs.exists(f.path(done)):
                abandon(spark, root, load_id)
            raise
    return {t: v["rows"] for t, v in json.loads(f.read(done))["tables"].items()}


def abandon(spark: SparkSession, root: str, load_id: str) -> None:
    """Delete what attempts of an uncommitted load have left."""
    f = Folder(spark, root)
    if f.fs.exists(f.path(f"manifest/{load_id}.json")):
        raise ValueError(f"load {load_id} is committed")
    for t in f.names("data"):
        f.delete(f"data/{t}/{load_id}")
    for n in f.names("manifest"):
        if n.startswith(f".{load_id}."):
            f.delete(f"manifest/{n}")


def rollback(spark: SparkSession, root: str, load_id: str) -> None:
    """Take a committed load back: its manifest goes first, then its files."""
    Folder(spark, root).delete(f"manifest/{load_id}.json")
    abandon(spark, root, load_id)


def loaded(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """All rows of the committed loads of ``table``; no rows of ``schema`` if there are none."""
    folders = [m["tables"][table]["folder"] for m in manifests(spark, root).values() if table in m["tables"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{x}" for x in folders])
