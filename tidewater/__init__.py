"""tidewater: marketplace analytics and recommendation as Spark DataFrame jobs.

Sub-packages
------------
functions  fixed constants and column-expression helpers (JVM built-ins only)
sources    driver tables, the marketplace views over them, file/feature-store I/O
operators  feature engineering, text, similarity, rankers, forecasting,
           evaluation, profiling, validation
plans      the query registry used by ``__spark_entry__`` and its DuckDB oracles
llm        training-data operators (optional: nothing else imports it)
"""

__all__ = ["session"]
