"""Document identity: keys, fingerprints and resubmission groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import text as T


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Collapse documents that are identical after normalization.

    One row per exact key with the smallest id as representative and the
    group size. The aggregate is partial+final (map-side combine), so a key
    holding a large share of rows still shuffles one row per map task.
    """
    keyed = df.select(id_col, T.exact_key(text_col).alias("exact_key"))
    return keyed.groupBy("exact_key").agg(
        F.min(id_col).alias("rep_doc_id"),
        F.count(F.lit(1)).alias("n_docs"),
    )
