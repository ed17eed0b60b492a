"""An upserted table of keys that a batch changes in place, bucket by bucket.

Keys are dealt to buckets by their leading characters (keys are digests). A batch rewrites the buckets it has keys of, as
files of its own version, and commits by writing the list of buckets and their versions; Spark's success marker is the
last file of it. Files of other buckets stay as they are. Readers take the latest committed list, so they see whole
batches; files that a failed batch left behind are in no list. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("version", T.LongType())])


class KeyedStore:
    """Rows by key at ``path``: the last write by ``order`` wins, columns in ``counters`` add up.

    ``digits`` leading characters of the key name a bucket: at most 16^digits buckets for hexadecimal keys. Null keys are
    refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str], counters: list[str] | None = None, digits: int = 2):
        self.spark, self.path, self.schema, self.key, self.order, self.counters, self.digits = spark, path.rstrip("/"), schema, key, order, counters or [], digits

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        found = [int(s.getPath().getName()) for s in fs.listStatus(hadoop)]
        return sorted(v for v in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{v}/_SUCCESS")))

    def buckets(self, version: int | None = None) -> dict[str, int]:
        """Bucket to the version that wrote it, as of ``version`` (default: the latest); at most 16^digits."""
        every = self.versions()
        if version is None:
            version = every[-1] if every else -1
        if version not in every:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema(LIST).parquet(f"{self.path}/commits/{version}").collect()}

    def read(self, version: int | None = None, only: list[str] | None = None) -> DataFrame:
        held = self.buckets(version)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, batch: DataFrame) -> int:
        """Merge a batch (columns of the schema) and commit; the new version. Work and files follow the touched buckets."""
        key = F.col(self.key)
        every = self.versions()
        number = every[-1] + 1 if every else 0
        held = self.buckets()
        rows = batch.select(*self.schema.names)
        rows = rows.withColumn(self.key, F.when(key.isNotNull(), key).otherwise(F.raise_error(F.lit("a store has no row without key")).cast(self.schema[self.key].dataType)))
        bucket = F.substring(key, 1, self.digits)
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most 16^digits
        merged = self.merge(self.read(only=touched).unionByName(rows))
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        held |= {b: number for b in touched}
        self.spark.createDataFrame(sorted(held.items()), LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")
        return number

    def merge(self, rows: DataFrame) -> DataFrame:
        """One row per key; partial aggregates, so a key of very many writes ships one row per task."""
        payload = [c for c in self.schema.names if c != self.key and c not in self.counters]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*payload), F.struct(*self.order)).alias("_w"), *[F.sum(c).alias(c) for c in self.counters])
        return best.select(*[F.col(c) if c == self.key or c in self.counters else F.col(f"_w.{c}").alias(c) for c in self.schema.names])
