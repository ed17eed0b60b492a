"""Dataset-level validation helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_NAMES = ("invoice",)


class InvalidRecords(ValueError):
    """Raised when a dataset that must be fully valid is not."""


def assert_no_invalid(report: DataFrame, column: str = "n_invalid") -> DataFrame:
    """Fail the job when the one-row report counts invalid records; otherwise
    return the report. ``raise_error`` keeps the check inside the plan."""
    return report.withColumn(column, F.when(F.col(column) == 0, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit("invalid records: "), F.col(column).cast("string"))).cast("bigint")))


def request_defaults(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """Extraction requests: text of at least one character, schema name
    defaulting to (and restricted to) ``invoice``, stream off, cache on."""
    out = requests
    for name, default in (("schema_name", "invoice"), ("stream", False), ("use_cache", True)):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in requests.columns
                             else F.lit(default))
    return out.filter((F.length(text_col) >= 1) & F.col("schema_name").isin(*SCHEMA_NAMES))
