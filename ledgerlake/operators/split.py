"""Reproducible train / validation / test split.

Order is a seeded hash of the id (sha256 of ``seed:id``, ties by id) -- the
same permutation on any cluster and in SQL. Slicing needs exact ranks, and a
global ``row_number`` would pull every row into one task, so ranks are
computed distributively:

1. bucket = leading hex digits of the hash (uniform, so buckets are balanced);
2. per-bucket counts (a partial aggregate) -> prefix offsets over that small
   table (at most 16**digits rows; broadcast with that proven bound);
3. only buckets whose offset is below the requested total are ranked, with a
   ``row_number`` inside each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
TARGET_BUCKET_ROWS = 50_000
MAX_DIGITS = 5


class SplitTooSmall(ValueError):
    """Fewer records than the requested split sizes."""


def rank_key(id_col: str, seed: int) -> F.Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def bucket_digits(n: int) -> int:
    """Hex digits so that a bucket holds about TARGET_BUCKET_ROWS rows."""
    if n <= TARGET_BUCKET_ROWS:
        return 1
    return min(MAX_DIGITS, max(1, math.ceil(math.log(n / TARGET_BUCKET_ROWS, 16))))


def seeded_split(df: DataFrame, id_col: str, train: int, val: int, test: int, seed: int = 0,
                 n_records: int | None = None) -> DataFrame:
    """Rows that land in a split, with ``split`` and ``rank`` columns.

    Raises ``SplitTooSmall`` (after one count) when there are fewer records
    than ``train + val + test``; the remaining records are unused.
    """
    total = train + val + test
    n = df.count() if n_records is None else n_records
    if n < total:
        raise SplitTooSmall(f"need {total} records for the requested split, have {n}")
    digits = bucket_digits(n)
    keyed = df.withColumn("_h", rank_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # <= 16**digits rows: a bounded, single-partition prefix sum.
    offsets = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_off")).fillna(0, ["_off"]).filter(F.col("_off") < total)
    ranked = keyed.join(F.broadcast(offsets), "_b", "inner")
    w = Window.partitionBy("_b").orderBy("_h", id_col)
    ranked = ranked.withColumn("rank", (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
    ranked = ranked.filter(F.col("rank") < total)
    split = (F.when(F.col("rank") < train, F.lit("train"))
             .when(F.col("rank") < train + val, F.lit("val")).otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("_h", "_b", "_off")


def size_report(df: DataFrame, train: int, val: int, test: int) -> DataFrame:
    """One row: records available, requested, shortfall (0 when enough)."""
    total = train + val + test
    return df.agg(F.count(F.lit(1)).alias("n_records")).select(
        "n_records", F.lit(total).cast("bigint").alias("requested"),
        F.greatest(F.lit(total) - F.col("n_records"), F.lit(0)).cast("bigint").alias("shortfall"))


def disjoint_report(splits: DataFrame, id_col: str) -> DataFrame:
    """Ids in more than one split (must be 0) and the size of each split,
    from one partial+final aggregate per id and one global aggregate."""
    per_id = splits.groupBy(id_col).agg(
        F.countDistinct("split").alias("k"),
        *[F.sum(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"c_{s}") for s in SPLITS])
    return per_id.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("bigint").alias("n_in_several"),
        *[F.sum(f"c_{s}").cast("bigint").alias(f"n_{s}") for s in SPLITS])
