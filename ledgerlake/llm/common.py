"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import scratch_path

SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table, as stored."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python worker is handed at once: of texts, and of matrix blocks.
TEXT_ROWS, BLOCK_ROWS = 500, 8


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hand Python workers few rows at a time from now on, so that long texts do not add up in their memory."""
    if int(spark.conf.get(ARROW_ROWS)) > rows or int(spark.conf.get(ARROW_ROWS)) <= 0:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for what runs inside."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``write_table`` made, once nothing reads it any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stray_columns(df: DataFrame, used: set[str]) -> list[str]:
    """Input columns that pass through, i.e. those the operator does not itself return."""
    low = {c.lower() for c in used}
    return [c for c in df.columns if c.lower() not in low]


def masked(df: DataFrame, through: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns that pass through under names that no operator uses, and the selection that gives them theirs again."""
    return [F.col(quoted(c)).alias(f"__in{i}") for i, c in enumerate(through)], [F.col(f"__in{i}").alias(c) for i, c in enumerate(through)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the undirected ``links`` (a, b); a component's name is its smallest node.

    Min-label propagation with pointer jumping: each round every node takes the smallest label among its
    own, its neighbours' and its label's label. Messages are pre-aggregated, so a hub costs one row per task.
    Each round is written to the shared folder. Raises if the labels still move after ``max_rounds``.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(
        links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).where("src is not null and dst is not null")
    both, both_path = write_table(both.distinct(), "links")
    labels, path = write_table(both.groupBy(F.col("src").alias("node")).agg(
        F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    for _ in range(max_rounds):
        told = both.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "component")
        best = labels.unionByName(told).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = best.join(jump, "component", "left").select(
            "node", F.coalesce(F.least("component", "further"), "component").alias("component"))
        after, after_path = write_table(moved, "labels")
        changed = after.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1)
        still = bool(changed.take(1))
        drop_table(spark, path)
        labels, path = after, after_path
        if not still:
            drop_table(spark, both_path)
            return labels
    raise RuntimeError(f"components still moving after {max_rounds} rounds")
