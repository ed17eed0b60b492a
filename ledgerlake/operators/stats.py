"""Exact order statistics without gathering a column into one task.

``percentile`` (exact) keeps every distinct value of its group in one
aggregation buffer; at scale that buffer is the whole column. Here the column
is counted by value, the distinct values are range-partitioned once, and the
partition totals tell in which partition each wanted rank lies. Only those
partitions are walked. The same steps run at every size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.sources.io import roundtrip_parquet


def values_at_ranks(df: DataFrame, col: str, ranks) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the sorted non-null column.

    ``ranks`` maps the number of non-null values to the ranks wanted. The
    driver sees one row per range partition and one per rank; a value that
    many rows share is one counted row.
    """
    counts = (df.select(F.col(col).cast("double").alias("x")).where("x is not null")
              .groupBy("x").agg(F.count(F.lit(1)).alias("c")))
    ranged = roundtrip_parquet(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("part").agg(F.sum("c").alias("c"), F.min("x").alias("low")).orderBy("low").collect()
    wanted = sorted(set(ranks(sum(p["c"] for p in parts))))
    # each wanted rank inside its partition
    places, below = [], 0
    for p in parts:
        places += [(k, p["part"], k - below) for k in wanted if below <= k < below + p["c"]]
        below += p["c"]
    if not places:
        return {}
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("x"))
    walked = ranged.where(F.col("part").isin(*{p for _, p, _ in places})).withColumn("upto", upto)
    hit = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"), F.lit(r).alias("r")) for k, part, r in places])
    rows = (walked.withColumn("w", F.explode(hit))
            .where("part = w.part and upto > w.r and upto - c <= w.r").select("w.k", "x").collect())
    return {r["k"]: r["x"] for r in rows}


def exact_percentiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Linear-interpolated percentiles (the usual ``percentile_cont``), all
    read in one pass."""
    total = 0

    def ranks(n: int) -> list[int]:
        nonlocal total
        total = n
        return [min(k, n - 1) for p in shares for k in (math.floor((n - 1) * p), math.floor((n - 1) * p) + 1) if n]

    found = values_at_ranks(df, col, ranks)
    out = []
    for p in shares:
        if not total:
            out.append(None)
            continue
        place = (total - 1) * p
        low, high = found[math.floor(place)], found[min(math.floor(place) + 1, total - 1)]
        out.append(low + (place - math.floor(place)) * (high - low))
    return out


#: Items that a quantile sketch keeps at its base; up to so many values its quantiles are exact.
SKETCH_K = 4096
#: Rank error that a sketch of that size keeps with 99 % probability (single rank).
RANK_ERROR = 0.001


def sketch_by(df: DataFrame, by: list[str], col: str, k: int = SKETCH_K) -> DataFrame:
    """(by, sketch, n): a mergeable quantile sketch of ``col`` per group; nulls are left out.

    The sketch is the aggregate's state, so a group of a third of all rows ships one sketch per task; stored sketches of
    days merge to those of longer spans by ``merge_sketches`` without reading values again.
    """
    x = F.col(col).cast("double")
    return df.where(x.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches (sketch, n) of finer groups as those of ``by``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantile(sketch: str, share: float):
    """The value of that rank share, one of the values seen (the smallest with at least that share at or below it)."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(share))
