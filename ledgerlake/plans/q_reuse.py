"""Queries for embedding and answer reuse (2.5).

Store and probes come from ``documents``: doc_id mod 5 = 0 are probes, the
rest are writes in doc_id order whose answer is (doc_id, source). The same
split by vec_id is used on ``embeddings``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.functions.vectors import cosine
from ledgerlake.operators import reuse as R
from ledgerlake.operators.embed import count_vectors, hash_embed, model_embed, slot_counts
from ledgerlake.operators.graph import components
from ledgerlake.operators.similarity import block_batches, collision_pairs, collisions, nearest
from ledgerlake.operators.store import KeyedStore
from ledgerlake.operators.temporal import asof_join, asof_lookup, ttl_replay
from ledgerlake.plans.q_identity import sql_fp, sql_norm
from ledgerlake.plans.registry import register
from ledgerlake.session import scratch_path
from ledgerlake.sources.io import roundtrip_parquet
from ledgerlake.sources.tables import table

THRESHOLD = 0.95
VEC_THRESHOLD = 0.4
TTL = 86_400


def _docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return R.keyed(docs)


def _store(keyed):
    writes = _writes(keyed).withColumn("answer", F.to_json(F.struct("doc_id", "source")))
    return R.store_upsert(writes, "exact_key", ["doc_id"], ["doc_id", "answer", "digits"])


def _writes(keyed):
    return keyed.filter(F.pmod("doc_id", F.lit(5)) != 0)


def _probes(keyed):
    return keyed.filter(F.pmod("doc_id", F.lit(5)) == 0).withColumnRenamed("doc_id", "probe_id")


def _described(spark, sf_dir):
    """Keys, numbers and word counts of the documents, stored: their texts are read once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    with block_batches(spark, 256):
        return roundtrip_parquet(R.described(docs), "described")


def _stored(rows):
    """The store, stored, and the word counts of its entries."""
    store = roundtrip_parquet(_store(rows), "store")
    return store, R.entry_vectors(rows, "doc_id", store, counts=True)


def _lookup(spark, sf_dir, rows=None, **opts):
    rows = _described(spark, sf_dir) if rows is None else rows
    return R.two_tier_lookup(_probes(rows), *_stored(rows), "probe_id", **opts)


REUSE_WITH = f"""
WITH d AS (
  SELECT doc_id, source, sha256({sql_norm('text')}) AS exact_key, {sql_fp('text')} AS digits,
         {sql_norm('text')} AS norm
  FROM documents),
tok AS (SELECT doc_id, unnest(list_filter(string_split(norm, ' '), lambda t: t <> '')) AS t FROM d),
cnt AS (SELECT doc_id, CAST(('0x' || substr(sha1(t), 1, 8)) AS BIGINT) % 64 AS dim, CAST(count(*) AS DOUBLE) AS c
        FROM tok GROUP BY ALL),
vec AS (SELECT doc_id, dim, c, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS w FROM cnt),
store AS (
  SELECT exact_key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, arg_max(digits, doc_id) AS digits,
         '{{"doc_id":' || max(doc_id) || ',"source":' || to_json(arg_max(source, doc_id)) || '}}' AS answer,
         count(*) AS n_writes
  FROM d WHERE doc_id % 5 <> 0 GROUP BY exact_key),
probes AS (SELECT doc_id AS probe_id, exact_key, digits FROM d WHERE doc_id % 5 = 0),
exact AS (SELECT p.probe_id, s.exact_key AS match_key, s.answer FROM probes p JOIN store s USING (exact_key)),
misses AS (SELECT * FROM probes p WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.exact_key = p.exact_key)),
sims AS (
  SELECT m.probe_id, s.exact_key AS match_key, round(sum(vp.w * vs.w), 9) AS sim
  FROM misses m JOIN vec vp ON vp.doc_id = m.probe_id
  JOIN vec vs ON vs.dim = vp.dim JOIN store s ON s.doc_id = vs.doc_id
  GROUP BY m.probe_id, s.exact_key),
top1 AS (
  SELECT probe_id, match_key, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, match_key) AS rn FROM sims)
  WHERE rn = 1),
cand AS (
  SELECT t.probe_id, t.match_key, t.sim, s.answer, s.digits AS match_digits, m.digits
  FROM top1 t JOIN store s ON s.exact_key = t.match_key JOIN misses m ON m.probe_id = t.probe_id
  WHERE t.sim >= {THRESHOLD})"""


def _outcomes_sql(guard: bool = True, semantic: bool = True) -> str:
    ok = "c.digits IS NOT DISTINCT FROM c.match_digits" if guard else "true"
    if not semantic:
        return REUSE_WITH + """,
outcomes AS (
  SELECT probe_id, 'exact' AS outcome, 'exact' AS tier, CAST(1.0 AS DOUBLE) AS similarity, match_key, answer FROM exact
  UNION ALL
  SELECT probe_id, 'miss', NULL, NULL, NULL, NULL FROM misses)"""
    return REUSE_WITH + f""",
outcomes AS (
  SELECT probe_id, 'exact' AS outcome, 'exact' AS tier, CAST(1.0 AS DOUBLE) AS similarity, match_key, answer FROM exact
  UNION ALL
  SELECT c.probe_id, CASE WHEN {ok} THEN 'semantic' ELSE 'guard_rejected' END,
         CASE WHEN {ok} THEN 'semantic' END, c.sim, c.match_key, CASE WHEN {ok} THEN c.answer END
  FROM cand c
  UNION ALL
  SELECT m.probe_id, 'miss', NULL, NULL, NULL, NULL FROM misses m
  WHERE m.probe_id NOT IN (SELECT probe_id FROM cand))"""


OUTCOME_COLS = "probe_id, outcome, tier, round(similarity, 6) AS similarity, match_key, answer"


def _outcome_cols(df):
    return df.select("probe_id", "outcome", "tier", F.round("similarity", 6).alias("similarity"),
                     "match_key", "answer")


@register("hash_embed", REUSE_WITH + "\nSELECT doc_id, CAST(dim AS INT) AS dim, CAST(c AS BIGINT) AS count FROM vec")
def q_hash_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    norm = docs.select("doc_id", T.normalize_text("text").alias("norm"))
    return slot_counts(norm, "doc_id", "norm").select("doc_id", "dim", F.col("c").alias("count"))


@register("l2_normalize", REUSE_WITH + "\nSELECT doc_id, CAST(dim AS INT) AS dim, round(w, 6) AS value FROM vec")
def q_l2_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    v = hash_embed(docs.select("doc_id", T.normalize_text("text").alias("norm")), "doc_id", "norm")
    e = v.select("doc_id", F.posexplode("embedding").alias("dim", "w"))
    return e.filter("w <> 0").select("doc_id", "dim", F.round("w", 6).alias("value"))


@register("cosine_similarity", REUSE_WITH + """,
ids AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS next FROM (SELECT DISTINCT doc_id FROM vec)),
dots AS (SELECT i.doc_id AS doc_a, sum(a.w * b.w) AS dot FROM ids i JOIN vec a ON a.doc_id = i.doc_id JOIN vec b ON b.doc_id = i.next AND b.dim = a.dim
         GROUP BY i.doc_id)
SELECT i.doc_id AS doc_a, i.next AS doc_b, round(coalesce(dots.dot, 0.0), 6) AS cosine
FROM ids i LEFT JOIN dots ON dots.doc_a = i.doc_id WHERE i.next IS NOT NULL""")
def q_cosine_similarity(spark, sf_dir):
    """Every document (that has words) with the next one by id, whatever ids are missing between them."""
    docs = table(spark, sf_dir, "documents")
    v = count_vectors(docs.select("doc_id", T.normalize_text("text").alias("norm")), "doc_id", "norm", name="v")
    v = roundtrip_parquet(v, "document-vectors")
    # the next id is the last one below, counted backwards
    ids = v.select(F.lit(0).alias("all"), "doc_id", (-F.col("doc_id")).alias("back"), F.lit(0).cast("bigint").alias("seq"))
    pairs = asof_join(ids.withColumn("back", F.col("back") - 1), ids, ["all"], "back", "seq", ["doc_id"], bucket_seconds=1)
    pairs = pairs.select(F.col("doc_id").alias("doc_a"), F.col("v_doc_id").alias("doc_b")).where("doc_b IS NOT NULL")
    j = pairs.join(v.select(F.col("doc_id").alias("doc_a"), F.col("v").alias("va")), "doc_a").join(v.select(F.col("doc_id").alias("doc_b"), F.col("v").alias("vb")), "doc_b")
    return j.select("doc_a", "doc_b", F.round(cosine("va", "vb"), 6).alias("cosine"))


def _numpy_hash_encoder():
    """Stand-in for a user's model: numpy hashed character trigrams (32 dims)."""
    import hashlib

    def encode(texts):
        out = np.zeros((len(texts), 32))
        for r, t in enumerate(texts):
            low = t.lower()
            for k in range(max(0, len(low) - 2)):
                out[r, hashlib.md5(low[k:k + 3].encode()).digest()[0] % 32] += 1.0
        return out
    return encode


@register("model_embed")
def q_model_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    emb = model_embed(_numpy_hash_encoder, 32)(F.col("text"))
    v = docs.select("doc_id", emb.alias("v"))
    return v.select("doc_id", F.size("v").alias("dims"),
                    F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@register("exact_lookup", REUSE_WITH + """
SELECT p.probe_id, CASE WHEN s.answer IS NOT NULL THEN 'exact' END AS tier,
       CASE WHEN s.answer IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS similarity, s.answer
FROM probes p LEFT JOIN store s USING (exact_key)""")
def q_exact_lookup(spark, sf_dir):
    keyed = _docs(spark, sf_dir)
    return R.exact_lookup(_probes(keyed), _store(keyed))


@register("lookup_miss", REUSE_WITH + "\nSELECT probe_id FROM misses")
def q_lookup_miss(spark, sf_dir):
    keyed = _docs(spark, sf_dir)
    return R.lookup_miss(_probes(keyed), _store(keyed)).select("probe_id")


@register("semantic_top1", f"""
WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 = 0),
s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 <> 0),
sims AS (SELECT p.vec_id AS probe_id, s.vec_id AS match_id,
                round(list_dot_product(p.e, s.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(s.e, s.e))), 9) AS sim
         FROM p, s),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, match_id) AS rn FROM sims)
SELECT probe_id, match_id, round(sim, 6) AS similarity FROM r WHERE rn = 1 AND sim >= {VEC_THRESHOLD}""")
def q_semantic_top1(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    probes = emb.filter(F.pmod("vec_id", F.lit(5)) == 0).select(F.col("vec_id").alias("probe_id"), "embedding")
    store = emb.filter(F.pmod("vec_id", F.lit(5)) != 0)
    top = nearest(probes, store, "probe_id", "vec_id", "embedding", VEC_THRESHOLD)
    return top.select("probe_id", F.col("match_key").alias("match_id"),
                      F.round("similarity", 6).alias("similarity"))


def _candidates(spark, sf_dir):
    """Probes without an exact answer, and their best store entry; one search per distinct text."""
    rows = _described(spark, sf_dir)
    store, held = _stored(rows)
    misses = roundtrip_parquet(R.lookup_miss(_probes(rows).select("probe_id", "exact_key", "digits"), store), "lookup-misses")
    keys = misses.groupBy("exact_key").agg(F.min("probe_id").alias("doc_id"))
    asked = R.entry_vectors(rows, "doc_id", keys, counts=True).withColumnRenamed("exact_key", "probe_key")
    found = R.semantic_candidates(asked, store, held, "probe_key", THRESHOLD)
    return misses, misses.select("probe_id", F.col("exact_key").alias("probe_key")).join(found, "probe_key")


@register("similarity_threshold", REUSE_WITH + "\nSELECT probe_id, match_key, round(sim, 6) AS similarity FROM cand")
def q_similarity_threshold(spark, sf_dir):
    _, cand = _candidates(spark, sf_dir)
    return cand.select("probe_id", "match_key", F.round("similarity", 6).alias("similarity"))


@register("numeric_guard", REUSE_WITH + """
SELECT probe_id, match_key, digits IS NOT DISTINCT FROM match_digits AS guard_ok FROM cand""")
def q_numeric_guard(spark, sf_dir):
    misses, cand = _candidates(spark, sf_dir)
    cand = cand.join(misses.select("probe_id", "digits"), "probe_id")
    return cand.select("probe_id", "match_key",
                       F.col("digits").eqNullSafe(F.col("match_digits")).alias("guard_ok"))


@register("two_tier_lookup", _outcomes_sql() + f"\nSELECT {OUTCOME_COLS} FROM outcomes")
def q_two_tier_lookup(spark, sf_dir):
    return _outcome_cols(_lookup(spark, sf_dir, threshold=THRESHOLD))


@register("exact_only_lookup", _outcomes_sql(semantic=False) + f"\nSELECT {OUTCOME_COLS} FROM outcomes")
def q_exact_only_lookup(spark, sf_dir):
    return _outcome_cols(_lookup(spark, sf_dir, threshold=THRESHOLD, semantic_enabled=False))


@register("unguarded_lookup", _outcomes_sql(guard=False) + f"\nSELECT {OUTCOME_COLS} FROM outcomes")
def q_unguarded_lookup(spark, sf_dir):
    return _outcome_cols(_lookup(spark, sf_dir, threshold=THRESHOLD, require_numeric_match=False))


STATS_SQL = """,
stats AS (
  SELECT CAST(count(*) FILTER (WHERE outcome = 'exact') AS BIGINT) AS exact_hits,
         CAST(count(*) FILTER (WHERE outcome = 'semantic') AS BIGINT) AS semantic_hits,
         CAST(count(*) FILTER (WHERE outcome IN ('miss', 'guard_rejected')) AS BIGINT) AS misses,
         CAST(count(*) FILTER (WHERE outcome = 'guard_rejected') AS BIGINT) AS guard_rejections
  FROM outcomes),
snap AS (
  SELECT *, CASE WHEN exact_hits + semantic_hits + misses > 0
                 THEN round((exact_hits + semantic_hits) / (exact_hits + semantic_hits + misses), 4)
                 ELSE 0.0 END AS hit_ratio
  FROM stats)"""


@register("cache_stats", _outcomes_sql() + STATS_SQL + "\nSELECT exact_hits, semantic_hits, misses, guard_rejections FROM stats")
def q_cache_stats(spark, sf_dir):
    return R.cache_stats(_lookup(spark, sf_dir, threshold=THRESHOLD))


@register("hit_ratio", _outcomes_sql() + STATS_SQL + "\nSELECT hit_ratio FROM snap")
def q_hit_ratio(spark, sf_dir):
    stats = R.cache_stats(_lookup(spark, sf_dir, threshold=THRESHOLD))
    return stats.select(R.hit_ratio(stats).alias("hit_ratio"))


@register("cache_snapshot", _outcomes_sql() + STATS_SQL + f"\nSELECT *, CAST({THRESHOLD} AS DOUBLE) AS threshold FROM snap")
def q_cache_snapshot(spark, sf_dir):
    return R.cache_snapshot(R.cache_stats(_lookup(spark, sf_dir, threshold=THRESHOLD)), THRESHOLD)


COLLISION_SQL = REUSE_WITH + f""",
svec AS (SELECT s.exact_key, s.digits, v.dim, v.w, v.c FROM store s JOIN vec v ON v.doc_id = s.doc_id),
form AS (SELECT exact_key, any_value(digits) AS digits, list({{'d': dim, 'c': c}} ORDER BY dim) AS form FROM svec GROUP BY exact_key),
class AS (SELECT exact_key, min(exact_key) OVER (PARTITION BY form, digits) AS class_key FROM form),
pairs AS MATERIALIZED (SELECT a.exact_key AS a, b.exact_key AS b, round(sum(a.w * b.w), 9) AS sim
  FROM svec a JOIN svec b ON a.dim = b.dim AND a.digits IS DISTINCT FROM b.digits GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= {THRESHOLD}),
reach AS (SELECT DISTINCT a AS src, a AS dst FROM pairs UNION SELECT r.src, p.b FROM reach r JOIN pairs p ON p.a = r.dst),
family AS (SELECT src, min(dst) AS family_key FROM reach GROUP BY src),
report AS (SELECT p.a AS exact_key, any_value(c.class_key) AS class_key, count(*) AS n_collisions, round(max(p.sim), 6) AS closest, any_value(f.family_key) AS family_key
  FROM pairs p JOIN class c ON c.exact_key = p.a JOIN family f ON f.src = p.a GROUP BY p.a)"""
COLLISION_SQL = COLLISION_SQL.replace("WITH d AS", "WITH RECURSIVE d AS", 1)


def _collision_entries(spark, sf_dir):
    store, held = _stored(_described(spark, sf_dir))
    return roundtrip_parquet(store.select("exact_key", "digits").join(held, "exact_key"), "collision-entries")


def _collision_report(spark, sf_dir):
    """A row for every entry that some other entry of other numbers is alike to: its class, how many such entries
    there are, the closest similarity, and the family it reaches through such entries (by its smallest key)."""
    entries = _collision_entries(spark, sf_dir)
    classes, links = collisions(entries, "exact_key", "embedding", "digits", THRESHOLD)
    named = entries.groupBy("embedding", "digits").agg(F.min("exact_key").alias("class_key"))
    named = entries.join(named, ["embedding", "digits"]).select("exact_key", "class_key")
    family = components(links).select(F.col("node").alias("class_key"), F.col("component").alias("family_key"))
    return named.join(classes.join(family, "class_key"), "class_key").select(
        "exact_key", "class_key", "n_collisions", F.round("closest", 6).alias("closest"), "family_key")


@register("guard_collision_report", REUSE_WITH + f""",
svec AS (SELECT s.exact_key, v.dim, v.w FROM store s JOIN vec v ON v.doc_id = s.doc_id),
pairs AS (SELECT a.exact_key AS key_a, b.exact_key AS key_b, round(sum(a.w * b.w), 9) AS sim
          FROM svec a JOIN svec b ON a.dim = b.dim AND a.exact_key < b.exact_key GROUP BY 1, 2)
SELECT p.key_a, p.key_b, round(p.sim, 6) AS similarity
FROM pairs p JOIN store sa ON sa.exact_key = p.key_a JOIN store sb ON sb.exact_key = p.key_b
WHERE p.sim >= {THRESHOLD} AND sa.digits IS DISTINCT FROM sb.digits""")
def q_guard_collision_report(spark, sf_dir):
    """Every pair of entries that are alike and that only the numeric guard tells apart."""
    pairs = collision_pairs(_collision_entries(spark, sf_dir), "exact_key", "embedding", "digits", THRESHOLD)
    return pairs.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), F.round("similarity", 6).alias("similarity"))


@register("guard_collision_families", COLLISION_SQL + """
SELECT family_key, count(*) AS n_entries, count(DISTINCT class_key) AS n_classes, CAST(sum(n_collisions) / 2 AS BIGINT) AS n_collisions, max(closest) AS closest
FROM report GROUP BY family_key""")
def q_guard_collision_families(spark, sf_dir):
    """Families of entries that only their numbers tell apart: entries, classes and colliding pairs of each."""
    return _collision_report(spark, sf_dir).groupBy("family_key").agg(
        F.count("*").alias("n_entries"), F.countDistinct("class_key").alias("n_classes"), (F.sum("n_collisions") / 2).cast("bigint").alias("n_collisions"), F.max("closest").alias("closest"))


@register("store_upsert", REUSE_WITH + "\nSELECT exact_key, doc_id, answer, CAST(n_writes AS BIGINT) AS n_writes FROM store")
def q_store_upsert(spark, sf_dir):
    return _store(_docs(spark, sf_dir)).select("exact_key", "doc_id", "answer", "n_writes")


@register("store_batches", REUSE_WITH + "\nSELECT exact_key, doc_id, answer, CAST(n_writes AS BIGINT) AS n_writes FROM store")
def q_store_batches(spark, sf_dir):
    """The same store from two batches of writes, the second of which rewrites only the buckets it has keys of."""
    writes = _writes(_docs(spark, sf_dir)).select("exact_key", "doc_id", F.to_json(F.struct("doc_id", "source")).alias("answer"), F.lit(1).cast("bigint").alias("n_writes"))
    store = KeyedStore(spark, scratch_path(spark, "keyed-store"), writes.schema, "exact_key", ["doc_id"], ["n_writes"], digits=1)
    late = F.pmod("doc_id", F.lit(10)) == 9
    store.upsert(writes.where(~late))
    store.upsert(writes.where(late))
    return store.read()


@register("store_clear", REUSE_WITH + "\nSELECT exact_key, doc_id, answer FROM store WHERE false")
def q_store_clear(spark, sf_dir):
    """A stored table, cleared: overwritten by an empty one and read back."""
    path = scratch_path(spark, "store")
    _store(_docs(spark, sf_dir)).select("exact_key", "doc_id", "answer").write.parquet(path)
    R.clear_store(spark, path)
    return spark.read.parquet(path)


EXPIRY_NOW, EXPIRY_TTL = "2024-01-03 00:00:00", 86_400


@register("expiring_lookup", REUSE_WITH + f""",
live AS (SELECT * FROM store WHERE TIMESTAMP '{EXPIRY_NOW}' < TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 4) DAY + INTERVAL (EXPIRES) SECOND)
SELECT p.probe_id, CASE WHEN s.answer IS NOT NULL THEN 'exact' END AS tier,
       CASE WHEN s.answer IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS similarity, s.answer
FROM probes p LEFT JOIN live s USING (exact_key)""".replace("(EXPIRES)", str(EXPIRY_TTL)))
def q_expiring_lookup(spark, sf_dir):
    """Exact lookups when half of the entries, written on four successive
    days, have expired; their probes are misses."""
    keyed = _docs(spark, sf_dir)
    written = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(days=F.pmod("doc_id", F.lit(4)).cast("int"))
    store = _store(keyed).withColumn("written_at", written)
    return R.exact_lookup(_probes(keyed), store, now=F.to_timestamp(F.lit(EXPIRY_NOW)), ttl_seconds=EXPIRY_TTL)


@register("ttl_expire", f"""
WITH w AS (SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS key, ts FROM events),
now_t AS (SELECT max(ts) AS now FROM events),
latest AS (SELECT key, max(ts) AS written_at FROM w GROUP BY key)
SELECT key, epoch_us(written_at) AS written_at_us, epoch_us(written_at + INTERVAL {TTL} SECOND) AS expires_at_us
FROM latest, now_t WHERE now < written_at + INTERVAL {TTL} SECOND""")
def q_ttl_expire(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    writes = ev.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
                       F.col("ts"))
    # "now" is passed in: one scalar aggregate, never a row set, reaches the driver.
    now = ev.agg(F.max("ts")).first()[0]
    live = R.live_entries(writes, "key", "ts", F.lit(now).cast("timestamp"), TTL)
    return live.select("key", F.unix_micros("written_at").alias("written_at_us"),
                       F.unix_micros("expires_at").alias("expires_at_us"))


@register("asof_lookup", f"""
WITH w AS (SELECT event_id, user_id, ts, value FROM events WHERE event_id % 3 = 0),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 <> 0),
j AS (SELECT r.event_id, r.ts, l.write_id, l.written_at, l.value FROM r LEFT JOIN LATERAL (
        SELECT w.event_id AS write_id, w.ts AS written_at, w.value FROM w
        WHERE w.user_id = r.user_id AND (w.ts < r.ts OR (w.ts = r.ts AND w.event_id <= r.event_id)) ORDER BY w.ts DESC, w.event_id DESC LIMIT 1) l ON true)
SELECT event_id, write_id, value, CASE WHEN write_id IS NULL THEN 'miss' WHEN ts < written_at + INTERVAL {TTL} SECOND THEN 'hit' ELSE 'expired' END AS outcome FROM j""")
def q_asof_lookup(spark, sf_dir):
    """Reads answered by what their key holds at their own time; events of ids divisible by three are the writes."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    write = F.pmod("event_id", F.lit(3)) == 0
    found = asof_lookup(ev.where(~write).drop("value"), ev.where(write), ["user_id"], "ts", "event_id", ["value"], TTL)
    return found.select("event_id", F.col("v_event_id").alias("write_id"), F.col("v_value").alias("value"), "outcome")


@register("ttl_replay", f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, event_type, rn, ts AS filled_at, event_id AS fill_id, event_id FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.rn, CASE WHEN e.ts >= r.filled_at + INTERVAL {TTL} SECOND THEN e.ts ELSE r.filled_at END,
         CASE WHEN e.ts >= r.filled_at + INTERVAL {TTL} SECOND THEN e.event_id ELSE r.fill_id END, e.event_id
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_id, fill_id, CASE WHEN event_id = fill_id THEN 'filled' ELSE 'hit' END AS outcome FROM r""")
def q_ttl_replay(spark, sf_dir):
    """Every event read in order through a cache that fills on a miss and forgets an entry a day after its fill."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = ttl_replay(ev, ["user_id", "event_type"], "ts", "event_id", TTL)
    return out.select("event_id", F.col("v_event_id").alias("fill_id"), "outcome")
