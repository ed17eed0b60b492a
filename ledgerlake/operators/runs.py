"""Run-level reports: tagging, alignment and baseline-vs-tuned comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED_METRICS = ["field_f1", "field_precision", "field_recall", "exact_match_rate",
                    "schema_validity_rate", "invalid_json_syntax_rate"]


def run_report(report: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach run metadata (model, include_schema) to the per-tag report; a
    tag without metadata keeps its report, with nulls."""
    return report.join(runs, "tag", "left")


def require_aligned(report: DataFrame) -> None:
    """Raise if ``alignment_report`` found unmatched ids in any run."""
    bad = [f"{r['tag']}: {r['n_unmatched']}" for r in report.where("n_unmatched > 0").orderBy("tag").limit(20).collect()]
    if bad:
        raise ValueError("predictions and targets do not pair up; unmatched ids by run: " + ", ".join(bad))


def alignment_report(predictions: DataFrame, gold_ids: DataFrame, tags: list[str]) -> DataFrame:
    """Per run tag: predictions, gold rows and unmatched ids on either side.

    The reference pairs outputs by position and raises on a length mismatch;
    pairing here is by id with a full outer join, and this report is the check.
    """
    gold_tagged = gold_ids.select("id", F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag"),
                                  F.lit(True).alias("g"))
    pred = predictions.select("tag", "id").withColumn("p", F.lit(True))
    j = gold_tagged.join(pred, ["tag", "id"], "full_outer")
    return j.groupBy("tag").agg(
        F.count("p").cast("bigint").alias("n_predictions"),
        F.count("g").cast("bigint").alias("n_gold"),
        F.sum(F.when(F.col("p").isNull() | F.col("g").isNull(), 1).otherwise(0)).cast("bigint")
        .alias("n_unmatched"))


def compare_runs(report: DataFrame, baseline: str = "baseline", tuned: str = "tuned") -> DataFrame:
    """Long form per metric: baseline value, tuned value and the delta."""
    long = report.unpivot("tag", COMPARED_METRICS, "metric", "v")
    wide = long.groupBy("metric").pivot("tag", [baseline, tuned]).agg(F.first("v"))
    return wide.select("metric", F.col(baseline).alias("baseline"), F.col(tuned).alias("tuned"),
                       F.round(F.col(tuned) - F.col(baseline), 4).alias("delta"))
