"""Query registry: every key maps to a Spark plan and (when SQL-expressible) a DuckDB oracle."""

from tidewater.plans.registry import ORACLES, REGISTRY, load_all  # noqa: F401
