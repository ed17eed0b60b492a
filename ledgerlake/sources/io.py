"""JSON-lines and parquet sources and sinks.

Sinks write under a caller path; the round-trip helpers write to a fresh
folder under the session's shared checkpoint directory (never a machine-local
temp folder on a cluster) and read the result back with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.session import scratch_path, shuffles_dropped


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", compression: str = "gzip") -> None:
    """One JSON object per line, in compressed files; nulls written as null, not dropped.

    A partitioned overwrite replaces only the partitions that ``df`` has rows
    for, so the report of one run leaves those of other runs in place.
    """
    w = df.write.mode(mode).option("ignoreNullFields", "false").option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON-lines file with a declared schema; blank lines are
    skipped and any malformed line fails the job (FAILFAST)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, line): lines of a file, or of a folder's files in the order of their names, from 0; blank ones are skipped.

    No sort: a line's place is its place in its block of a file (one reader reads a block from the top) plus the lines of
    all blocks before. Only the blocks, one row each, are put in order.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.where(F.trim("line") != "").withColumn("row", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "start", "first", F.coalesce(ahead, F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "start"]).select((F.col("before") + F.col("row") - F.col("first")).alias("position"), "line")


def read_jsonl_head(spark: SparkSession, path: str, schema: T.StructType, n: int) -> DataFrame:
    """The first ``n`` records of JSON lines in file order, with their ``position``; a malformed one fails the job."""
    head = numbered_lines(spark, path).where(F.col("position") < n)
    return head.select("position", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("position", "r.*")


def roundtrip_json(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_jsonl(df, path, partition_by)
    return read_jsonl(df.sparkSession, path, df.schema)


def roundtrip_parquet(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
