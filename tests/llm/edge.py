"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(seed: int, n: int) -> str:
    """``n`` made-up words, the same for the same seed."""
    out, x = [], seed * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append("".join("aeioubdglmnrst"[(x >> s) % 14] for s in (4, 8, 12, 16, 20)))
    return " ".join(out)


LONG = words(77, 60_000)


def docs(spark: SparkSession, rows=()) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows and ids, then ``rows``."""
    base = [
        (None, words(1, 30), None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", "", "", 3),
        (4, LONG, "en", "a", len(LONG)), (5, "one", "en", "a", 3), (6, "É è — “ü” \U0001f600", "fr", "b", 9),
        (7, words(2, 40), "en", "b", 10), (7, words(2, 40), "en", "b", 10), (7, words(3, 40), "en", "b", 10), (None, None, None, None, None),
    ]
    return spark.createDataFrame([*base, *rows], DOCS)


def with_clashes(df: DataFrame) -> DataFrame:
    """More columns, with names that operators use for results or helpers."""
    for name in ("score", "fp", "class_id", "n", "size", "copies", "nth", "copy_", "hits", "label", "body", "key", "k0", "spans", "a", "b"):
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame([(None, 1, 1), (1, None, None), (7, 1, 0), (7, 0, 1), (999, 1, 1), *rows], LABELS)


def collected(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
