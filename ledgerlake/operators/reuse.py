"""Answer reuse: a stored-answers table probed by incoming documents.

The reference answers one document at a time against a key-value store and a
vector index. Here a probe table meets a store table:

1. exact tier: equi-join on the normalized-text key;
2. semantic tier (only for exact misses): top-1 cosine over the store,
   accepted at ``similarity >= threshold``;
3. numeric guard: the top-1 is refused when its number fingerprint differs.

Outcomes: ``exact``, ``semantic``, ``guard_rejected`` (counted as a miss too)
and ``miss``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.functions.vectors import l2_normalize
from ledgerlake.operators.embed import hash_embed, keys_and_words, summed
from ledgerlake.operators.similarity import nearest
from ledgerlake.sources.io import roundtrip_parquet

DEFAULT_THRESHOLD = 0.95
DEFAULT_TTL_SECONDS = 86_400


def keyed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by exact key, number fingerprint and ``raw``, the text as it is.

    Narrow projection only; ``raw`` is for vectors and is pruned where no
    vector is wanted.
    """
    return (df.withColumn("exact_key", T.exact_key(text_col))
            .withColumn("digits", T.numeric_fingerprint(text_col))
            .withColumn("raw", F.col(text_col))
            .drop(text_col))


def vectors(keyed_rows: DataFrame) -> DataFrame:
    """(exact_key, embedding) of ``keyed`` rows. Rows of one key have one text,
    so their summed counts have the direction of a single one."""
    return hash_embed(keyed_rows.select("exact_key", T.normalize_text("raw").alias("norm")), "exact_key", "norm")


def described(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by exact key, number fingerprint and ``words``, its ``word_counts``: one narrow pass over the texts, each
    of which is normalized once."""
    return keys_and_words(df.withColumn("digits", T.numeric_fingerprint(text_col)), text_col)


def entry_vectors(rows: DataFrame, id_col: str, wanted: DataFrame, counts: bool = False) -> DataFrame:
    """(exact_key, embedding) for ``wanted`` (exact_key and the id of one row that has it) from ``described`` rows, which are
    joined by id. With ``counts`` the word counts instead of unit vectors."""
    some = rows.select(F.col(id_col).alias("_id"), "words").join(wanted.select("exact_key", F.col(id_col).alias("_id")), "_id")
    found = summed(some, "exact_key", "words")
    return found if counts else found.select("exact_key", l2_normalize("embedding").alias("embedding"))


def text_vectors(texts: DataFrame, id_col: str, text_col: str, wanted: DataFrame, counts: bool = False) -> DataFrame:
    """``entry_vectors`` of rows with texts: a text becomes word counts before it is joined by id."""
    return entry_vectors(keys_and_words(texts.select(id_col, text_col), text_col).drop("exact_key"), id_col, wanted, counts)


def unexpired(store: DataFrame, now: Column | None, ttl_seconds: int | None, written_at: str = "written_at") -> DataFrame:
    """Entries that may still answer at ``now``: those written less than
    ``ttl_seconds`` before. Without ``now`` or with a falsy ttl, all of them."""
    if now is None or not ttl_seconds:
        return store
    return store.where(now < F.col(written_at) + F.make_interval(secs=F.lit(ttl_seconds)))


def store_upsert(writes: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Last write per key wins (both tiers are keyed by the exact key).

    ``max_by`` over a struct is a partial aggregate: a key written by a third
    of all rows still shuffles one row per map task.
    """
    latest = writes.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order])).alias("w"),
        F.count(F.lit(1)).alias("n_writes"))
    return latest.select(key, *[F.col(f"w.{c}").alias(c) for c in payload], "n_writes")


def exact_lookup(probes: DataFrame, store: DataFrame, probe_id: str = "probe_id", now: Column | None = None,
                 ttl_seconds: int | None = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Probes joined to stored answers on the exact key (left join); with
    ``now`` an entry past its ``ttl_seconds`` is no answer."""
    s = unexpired(store, now, ttl_seconds).select("exact_key", F.col("answer").alias("stored_answer"))
    j = probes.select(probe_id, "exact_key").join(s, "exact_key", "left")
    hit = F.col("stored_answer").isNotNull()
    return j.select(probe_id, F.when(hit, F.lit("exact")).alias("tier"),
                    F.when(hit, F.lit(1.0)).alias("similarity"),
                    F.col("stored_answer").alias("answer"))


def lookup_miss(probes: DataFrame, store: DataFrame) -> DataFrame:
    """Probes without an exact answer (they go on to the semantic tier)."""
    return probes.join(store.select("exact_key"), "exact_key", "left_anti")


def semantic_candidates(probe_vectors: DataFrame, store: DataFrame, store_vectors: DataFrame, probe_id: str = "probe_id",
                        threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Top-1 store entry per probe vector (probe_id, embedding), kept when
    similarity >= threshold, with the stored fingerprint and answer joined
    back by key (payload stays out of the similarity stage).
    ``store_vectors`` (exact_key, embedding) may hold keys the store lacks."""
    held = store_vectors.join(store.select("exact_key"), "exact_key", "left_semi")
    top = nearest(probe_vectors.select(probe_id, "embedding"), held, probe_id, "exact_key", "embedding", threshold)
    meta = store.select(F.col("exact_key").alias("match_key"), F.col("digits").alias("match_digits"),
                        "answer")
    return top.join(meta, "match_key", "left")


def two_tier_lookup(probes: DataFrame, store: DataFrame, store_vectors: DataFrame, probe_id: str = "probe_id",
                    threshold: float = DEFAULT_THRESHOLD, require_numeric_match: bool = True,
                    semantic_enabled: bool = True, now: Column | None = None,
                    ttl_seconds: int | None = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Outcome per probe: probe_id, outcome, tier, similarity, match_key, answer.

    ``probes`` are ``keyed`` or ``described`` rows, ``store`` has exact_key, digits and answer
    (and written_at, if ``now`` is given: an entry past its ``ttl_seconds``
    answers in neither tier), ``store_vectors`` its ``vectors`` or their counts. Keys and
    answers are written once (shared folder); vectors are made only for
    the keys that the exact tier leaves open.
    """
    rows = probes
    probes = roundtrip_parquet(probes.select(probe_id, "exact_key", "digits"), "lookup-probes")
    store = roundtrip_parquet(unexpired(store, now, ttl_seconds).select("exact_key", "digits", "answer"), "lookup-store")
    ex = probes.select(probe_id, "exact_key").join(
        store.select("exact_key", "answer"), "exact_key", "inner")
    exact = ex.select(probe_id, F.lit("exact").alias("outcome"), F.lit("exact").alias("tier"),
                      F.lit(1.0).alias("similarity"), F.col("exact_key").alias("match_key"), "answer")
    misses = lookup_miss(probes, store)
    if not semantic_enabled:
        rest = misses.select(probe_id, F.lit("miss").alias("outcome"), F.lit(None).cast("string").alias("tier"),
                             F.lit(None).cast("double").alias("similarity"),
                             F.lit(None).cast("string").alias("match_key"),
                             F.lit(None).cast("string").alias("answer"))
        return exact.unionByName(rest)
    # The semantic outcome depends only on the normalized text (embedding and
    # numbers), so search once per distinct missing key: a document resubmitted
    # a million times costs one search. The smallest id keeps it deterministic; a
    # partial aggregate, so a hot key ships one row per map task.
    keys = misses.groupBy("exact_key").agg(F.min(F.struct(probe_id, "digits")).alias("first")).select("exact_key", "first.*")
    keys = roundtrip_parquet(keys, "lookup-keys")
    # counts: the search makes units of them, and they are shipped as small numbers
    asked = entry_vectors(rows, probe_id, keys, counts=True) if "words" in rows.columns else text_vectors(rows, probe_id, "raw", keys, counts=True)
    probe_vectors = asked.withColumnRenamed("exact_key", "probe_key")
    cand = semantic_candidates(probe_vectors, store, store_vectors, "probe_key", threshold)
    cand = cand.join(keys.select(F.col("exact_key").alias("probe_key"), "digits"), "probe_key", "inner")
    agree = F.col("digits").eqNullSafe(F.col("match_digits"))
    passes = agree if require_numeric_match else F.lit(True)
    per_key = cand.select(
        F.col("probe_key").alias("exact_key"),
        F.when(passes, F.lit("semantic")).otherwise(F.lit("guard_rejected")).alias("outcome"),
        F.when(passes, F.lit("semantic")).alias("tier"),
        "similarity", "match_key", F.when(passes, F.col("answer")).alias("answer"))
    # Back to probes: one row per key on the right, so a skewed probe key is a
    # skewed equi-join that AQE splits.
    resolved = misses.select(probe_id, "exact_key").join(per_key, "exact_key", "left")
    sem = resolved.select(
        probe_id, F.coalesce(F.col("outcome"), F.lit("miss")).alias("outcome"), "tier", "similarity",
        "match_key", "answer")
    return exact.unionByName(sem)


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """Counters as the reference keeps them: a guard rejection also counts as
    a miss."""
    o = F.col("outcome")

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    return outcomes.agg(
        n(o == "exact").alias("exact_hits"), n(o == "semantic").alias("semantic_hits"),
        n(o.isin("miss", "guard_rejected")).alias("misses"),
        n(o == "guard_rejected").alias("guard_rejections"))


def hit_ratio(stats: DataFrame) -> Column:
    hits = F.col("exact_hits") + F.col("semantic_hits")
    total = hits + F.col("misses")
    return F.when(total > 0, F.round(hits / total, 4)).otherwise(F.lit(0.0))


def cache_snapshot(stats: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return stats.select("*", hit_ratio(stats).alias("hit_ratio"), F.lit(float(threshold)).alias("threshold"))


def live_entries(writes: DataFrame, key: str, written_at: str, now: Column,
                 ttl_seconds: int | None = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Entries alive at ``now``: the latest write per key, valid for
    ``ttl_seconds`` from that write (reads never extend it). A falsy ttl
    means entries never expire."""
    latest = writes.groupBy(key).agg(F.max(written_at).alias("written_at"))
    if not ttl_seconds:
        return latest.withColumn("expires_at", F.lit(None).cast("timestamp"))
    exp = F.col("written_at") + F.make_interval(secs=F.lit(ttl_seconds))
    return latest.withColumn("expires_at", exp).filter(now < F.col("expires_at"))


def clear_store(spark: SparkSession, path: str) -> None:
    """Empty the stored table at ``path``; its schema stays. Counters restart
    from the next lookup's outcomes, so nothing else needs resetting."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
