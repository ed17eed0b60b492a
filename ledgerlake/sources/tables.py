"""Readers for the supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Session setting: deal every table to so many partitions after the scan.
#: Unset (the default), tables are read as they are stored. It is meant for
#: test files of one row group, which one task must read.
SCAN_PARTITIONS = "ledgerlake.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table; timestamps become session-zone TIMESTAMP.

    The files store zone-less timestamps (read as TIMESTAMP_NTZ). Watermarks
    and interval arithmetic want TIMESTAMP, and with the session pinned to UTC
    the cast is value-preserving.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    dealt = spark.conf.get(SCAN_PARTITIONS, None)
    if dealt:
        df = df.repartition(int(dealt))
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df
