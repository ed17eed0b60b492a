"""Deltas of cumulative texts in tasks of bounded size."""

from pyspark.sql import functions as F

from ledgerlake.operators import extract as X


def test_deltas_are_dealt_to_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_BYTES", 1000)
    steps = spark.range(200).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"))
    steps = steps.select("k", F.col("step").cast("int").alias("step"), F.repeat(F.lit("x"), F.col("step") * 10).alias("cumulative"))
    out = X.cumulative_to_delta(steps, ["k"])
    assert out.rdd.getNumPartitions() > 40
    assert out.count() == 600 and out.where(F.length("delta") != 10).count() == 0
