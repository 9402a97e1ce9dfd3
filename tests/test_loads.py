import pytest
from pyspark.sql import functions as F

from tidewater.sources import loads

SCHEMA = "id long, name string"


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], SCHEMA).repartition(3)


def broken(spark):
    """Some partitions are written before one fails."""
    return spark.range(0, 40, 1, 8).select("id", F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("name"))


def ids(spark, root, table="t"):
    return sorted(r["id"] for r in loads.loaded(spark, root, table, SCHEMA).collect())


def left(tmp_path):
    return [p for p in (tmp_path / "data").rglob("*.parquet")] if (tmp_path / "data").exists() else []


def test_repeated_load_adds_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert loads.load(spark, root, {"t": frame(spark, 1, 2)}, "a") == {"t": 2}
    assert loads.load(spark, root, {"t": frame(spark, 7, 8, 9)}, "a") == {"t": 2}
    assert loads.load(spark, root, {"t": frame(spark, 3)}, "b") == {"t": 1}
    assert ids(spark, root) == [1, 2, 3] and sorted(loads.manifests(spark, root)) == ["a", "b"]


def test_failed_load_leaves_nothing_of_any_table(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Exception, match="lost"):
        loads.load(spark, root, {"t": frame(spark, 1), "u": broken(spark)}, "a")
    assert ids(spark, root) == ids(spark, root, "u") == [] and not left(tmp_path)
    assert loads.load(spark, root, {"t": frame(spark, 1), "u": frame(spark, 5)}, "a") == {"t": 1, "u": 1}
    assert ids(spark, root) == [1] and ids(spark, root, "u") == [5]


def test_killed_driver_leaves_no_visible_row(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for step in ("write", "rename_new"):  # killed before the manifest is written, and before it is in place
        with monkeypatch.context() as m:
            m.setattr(loads.Folder, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            m.setattr(loads, "abandon", lambda *a: None)  # a killed driver cleans nothing up
            with pytest.raises(KeyboardInterrupt):
                loads.load(spark, root, {"t": frame(spark, 1, 2)}, "a")
        assert ids(spark, root) == [] and left(tmp_path)
    assert loads.load(spark, root, {"t": frame(spark, 4)}, "a") == {"t": 1}
    assert ids(spark, root) == [4] and len({p.parent for p in left(tmp_path)}) == 1


def test_rollback_and_names(spark, tmp_path):
    root = str(tmp_path)
    loads.load(spark, root, {"t": frame(spark, 1)}, "a")
    loads.load(spark, root, {"t": frame(spark).limit(0)}, "empty")
    with pytest.raises(ValueError):
        loads.abandon(spark, root, "a")
    loads.rollback(spark, root, "a")
    assert ids(spark, root) == [] and loads.manifests(spark, root)["empty"]["tables"]["t"]["rows"] == 0
    for bad in ("../x", "", ".a", "a/b"):
        with pytest.raises(ValueError):
            loads.load(spark, root, {"t": frame(spark, 1)}, bad)


def test_manifest_in_place_is_not_overwritten(spark, tmp_path):
    f = loads.Folder(spark, str(tmp_path))
    f.write("manifest/x", "1")
    f.write("manifest/y", "2")
    with pytest.raises(Exception):
        f.rename_new("manifest/x", "manifest/y")
    assert f.read("manifest/y") == "2"
