"""Streaming queries, run with an available-now trigger and
read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.plans import q_reuse as QR
from ledgerlake.plans.registry import register
from ledgerlake.streaming import streams as S

TTL = 86_400


@register("stream_exact_lookup", QR.REUSE_WITH + """
SELECT p.probe_id, CASE WHEN s.answer IS NOT NULL THEN 'exact' END AS tier,
       CASE WHEN s.answer IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS similarity, s.answer
FROM probes p LEFT JOIN store s USING (exact_key)""")
def q_stream_exact_lookup(spark, sf_dir):
    store = QR._store(QR._docs(spark, sf_dir))
    docs = S.stream_table(spark, sf_dir, "documents")
    probes = (docs.filter(F.pmod("doc_id", F.lit(5)) == 0)
              .select(F.col("doc_id").alias("probe_id"), T.exact_key("text").alias("exact_key")))
    return S.run_available_now(S.stream_exact_lookup(probes, store), "exact_lookup")


@register("stream_ttl_dedup", f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, ts,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, event_type, rn, ts AS anchor, event_id, ts, true AS first_sight FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.rn,
         CASE WHEN e.ts >= r.anchor + INTERVAL {TTL} SECOND THEN e.ts ELSE r.anchor END,
         e.event_id, e.ts, e.ts >= r.anchor + INTERVAL {TTL} SECOND
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT user_id, event_type, event_id, epoch_us(ts) AS ts_us FROM r WHERE first_sight""")
def q_stream_ttl_dedup(spark, sf_dir):
    ev = S.stream_table(spark, sf_dir, "events", max_files_per_trigger=64).select("user_id", "event_type", "event_id", "ts")
    out = S.sights_in_batches(ev, ["user_id", "event_type"], TTL, 86_400, "ttl_dedup")
    return out.select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("ts_us"))


@register("stream_metrics", """
WITH q AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
         sum(CAST(value AS DECIMAL(18, 4))) AS value_sum, min(ts) FILTER (WHERE event_type = 'view') AS started, min(ts) FILTER (WHERE event_type = 'click') AS first_token,
         max(ts) FILTER (WHERE event_type = 'purchase') AS finished, sum(CAST(floor(value) AS BIGINT)) AS tokens, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS hit
  FROM events GROUP BY ALL),
r AS (SELECT *, CASE WHEN first_token >= started THEN epoch_us(first_token) - epoch_us(started) END AS wait,
             CASE WHEN finished > first_token THEN epoch_us(finished) - epoch_us(first_token) END AS decode FROM q),
w AS (SELECT window_start, sum(n_events) AS n_events, sum(n_errors) AS n_errors, sum(value_sum) AS value_sum, count(*) AS n_requests, sum(hit) AS n_hits,
             sum(wait) AS wait, count(wait) AS waits, sum(decode) AS decode, sum(tokens) FILTER (WHERE decode IS NOT NULL) AS decoded FROM r GROUP BY window_start),
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS watermark FROM events)
SELECT epoch_us(window_start) AS window_start_us, CAST(n_events AS BIGINT) AS n_events, CAST(n_errors AS BIGINT) AS n_errors, CAST(value_sum AS DOUBLE) AS value_sum,
       CAST(n_requests AS BIGINT) AS n_requests, CAST(n_hits AS BIGINT) AS n_hits, round(n_hits / n_requests, 4) AS hit_ratio,
       CASE WHEN waits > 0 THEN round(wait / waits / 1000.0, 3) END AS mean_ttft_ms, CASE WHEN decode > 0 THEN round(decoded / (decode / 1e6), 6) END AS tokens_per_s
FROM w, wm WHERE window_start + INTERVAL 1 HOUR <= watermark""")
def q_stream_metrics(spark, sf_dir):
    """Events as marks of requests: a request is what one user does in one hour."""
    kind = F.create_map(*[F.lit(x) for pair in (("view", S.STARTED), ("click", S.FIRST_TOKEN), ("purchase", S.FINISHED), ("signup", S.HIT), ("error", S.ERROR)) for x in pair])
    marks = S.stream_table(spark, sf_dir, "events").select("user_id", "ts", F.try_element_at(kind, F.col("event_type")).alias("mark"), F.floor("value").alias("tokens"), "value")
    out = S.run_available_now(S.request_windows(marks, ["user_id"]), "metrics")
    return out.select(F.unix_micros("window_start").alias("window_start_us"), "n_events", "n_errors", F.col("value_sum").cast("double").alias("value_sum"),
                      "n_requests", F.col("n_hits").cast("bigint").alias("n_hits"), "hit_ratio", "mean_ttft_ms", "tokens_per_s")
