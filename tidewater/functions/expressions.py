"""Column-expression helpers. All are JVM built-ins (codegen-friendly, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.constants import INTERACTION_WEIGHTS, RAW_WEIGHTS, UNKNOWN_WEIGHT

__all__ = [
    "micros_between", "days_between", "interaction_weight", "raw_weight", "lit_map",
    "r6", "r4", "scalar_max", "week_start",
]


def lit_map(d: dict) -> Column:
    """A literal MAP<k, v> column (folded to a constant by Catalyst)."""
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def micros_between(start: Column, end: Column) -> Column:
    """Exact microseconds from ``start`` to ``end`` (timestamp_ntz safe, no zone involved)."""
    secs = (end - start).cast("interval second").cast("decimal(24,6)")
    return (secs * F.lit(1000000)).cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days (micros / 86 400 000 000), as the reference's total_seconds / 86400."""
    return micros_between(start, end) / F.lit(86400000000.0)


def interaction_weight(type_col: Column) -> Column:
    """Feature-path weight: lower(trim(type)) looked up, unknown or null -> 1.0."""
    return F.coalesce(
        F.try_element_at(lit_map(INTERACTION_WEIGHTS), F.lower(F.trim(type_col))), F.lit(UNKNOWN_WEIGHT)
    )


def raw_weight(type_col: Column) -> Column:
    """Raw-path weight: exact-case lookup, unknown -> null (ignored by sums)."""
    return F.try_element_at(lit_map(RAW_WEIGHTS), type_col)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r4(c: Column) -> Column:
    return F.round(c, 4)


def scalar_max(df: DataFrame, col: str) -> Column:
    """Whole-input maximum as a scalar subquery (one extra aggregate job, no cross join)."""
    return df.agg(F.max(col)).scalar()



def week_start(ts: Column) -> Column:
    """Monday of the ISO week containing ``ts`` as DATE."""
    return F.date_trunc("week", ts).cast("date")
