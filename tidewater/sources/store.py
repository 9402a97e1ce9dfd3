"""Versioned Parquet feature store: ``<base>/<name>/version=<N>``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"^version=(\d+)$")


class FeatureStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def list_versions(self, name: str) -> list[int]:
        """Numbers of the committed versions, sorted; other folders and half-written versions are ignored."""
        fs, p = self._fs(f"{self.base}/{name}")
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            m = _VERSION.match(st.getPath().getName())
            done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
            if m and st.isDirectory() and fs.exists(done):
                out.append(int(m.group(1)))
        return sorted(out)

    def latest_version(self, name: str) -> int:
        v = self.list_versions(name)
        return v[-1] if v else 0

    def next_version(self, name: str) -> int:
        """One more than any version folder, committed or not; the write fails if another writer took it."""
        fs, p = self._fs(f"{self.base}/{name}")
        names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
        return max([int(m.group(1)) for m in map(_VERSION.match, names) if m], default=0) + 1

    def save(self, df: DataFrame, name: str) -> int:
        """Next version = latest + 1; never overwrites an existing version."""
        v = self.next_version(name)
        df.write.mode("errorifexists").parquet(f"{self.base}/{name}/version={v}")
        return v

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """Explicit version or latest; error when none exists."""
        v = version if version is not None else self.latest_version(name)
        if not v or v not in self.list_versions(name):
            raise FileNotFoundError(f"feature set {name!r} has no version {version if version is not None else '(any)'}")
        return self.spark.read.parquet(f"{self.base}/{name}/version={v}")
