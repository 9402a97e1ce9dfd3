"""Owner features dealt by rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidewater import session
from tidewater.operators import features as fe
from tidewater.operators import validation as va

SCHEMA = "user_id long, item_id long, interaction_type string, category string, quantity int, price double, interaction_timestamp timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def row(user, item, kind, quantity, week, hour=0):
    at = None if week is None else START + dt.timedelta(days=7 * week, hours=hour)
    return user, item, kind, f"c{item}", quantity, 1.0, at


ROWS = [row(2, 3, "view", 8, 3), row(3, 2, "purchase", 4, None), row(None, 2, "purchase", 11, 1), row(4, 1, "view", None, 5)]


def close(a, b):
    return a is None and b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_owner_features_dealt_by_rows_equal_those_that_are_not(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    rows = [row(7 if i % 3 else i % 5, i % 61, "purchase" if i % 2 else "reorder", 1 + i % 9, i % 50) for i in range(400)] + ROWS
    events = spark.createDataFrame(rows, SCHEMA)
    materials = spark.createDataFrame([(i, f"c{i}", 2.0) for i in range(50)], "material_id long, category string, price double")
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[:2])
    dealt, plain = (sorted(fe.owner_features(events, materials, rows=n).collect(), key=key) for n in (len(rows), None))
    assert len(dealt) == len(plain)
    for a, b in zip(dealt, plain):
        assert all(close(x, y) if isinstance(x, float) else x == y for x, y in zip(a, b))
    f = fe.owner_features(events, materials, rows=len(rows))
    parts = f.where("user_id = 7").select(F.spark_partition_id()).distinct().count()
    assert parts > 4  # the pairs of a frequent owner are not one task's
    assert f.rdd.getNumPartitions() == -(-len(rows) // 20)
    assert va.validation_counts(f, "owner", len(rows)).first() == va.validation_counts(f, "owner").first()
