"""Queries for batch extraction and request data.

Requests are ``documents``; canned engine answers exist for doc_id mod 3 = 0.
Token streams are ``conversations.text`` cut into 16-character chunks.
Request marks are ``events`` grouped by user and day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import extract as X
from ledgerlake.operators.stats import exact_percentiles, merge_sketches, sketch_by, sketch_quantile
from ledgerlake.plans import q_reuse as QR
from ledgerlake.plans.registry import register
from ledgerlake.plans.sql_invoice import lit
from ledgerlake.session import ensure_checkpoint_dir, scratch_path
from ledgerlake.sources.io import roundtrip_parquet
from ledgerlake.sources.tables import table


def _responses(docs):
    return docs.filter(F.pmod("doc_id", F.lit(3)) == 0).select(
        "text", F.to_json(F.struct("doc_id", "source")).alias("response"))


def _engine_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return X.lookup_engine(docs.select("doc_id", "text"), _responses(docs))


ENGINE_SQL = f"""
WITH resp AS (SELECT sha256(text) AS k, max('{{"doc_id":' || doc_id || ',"source":' || to_json(source) || '}}') AS r
              FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
eng AS (SELECT d.doc_id, d.text, coalesce(resp.r, {lit(X.FALLBACK)}) AS payload
        FROM documents d LEFT JOIN resp ON resp.k = sha256(d.text))"""


@register("lookup_engine", ENGINE_SQL + "\nSELECT doc_id, payload FROM eng")
def q_lookup_engine(spark, sf_dir):
    return _engine_out(spark, sf_dir).select("doc_id", "payload")


@register("token_estimate", ENGINE_SQL + """
SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS prompt_tokens,
       CAST(greatest(1, floor(length(payload) / 4)) AS BIGINT) AS completion_tokens FROM eng""")
def q_token_estimate(spark, sf_dir):
    e = _engine_out(spark, sf_dir)
    return e.select("doc_id", X.token_estimate(F.col("text")).alias("prompt_tokens"),
                    X.token_estimate(F.col("payload")).alias("completion_tokens"))


@register("engine_calls", QR._outcomes_sql() + """
SELECT CAST(count(*) AS BIGINT) AS engine_calls,
       CAST(count(DISTINCT p.exact_key) AS BIGINT) AS distinct_keys
FROM outcomes o JOIN probes p USING (probe_id) WHERE o.outcome IN ('miss', 'guard_rejected')""")
def q_engine_calls(spark, sf_dir):
    rows = QR._described(spark, sf_dir)
    probes = QR._probes(rows)
    out = QR._lookup(spark, sf_dir, rows, threshold=QR.THRESHOLD)
    missed = out.filter(F.col("outcome").isin("miss", "guard_rejected")).join(
        probes.select("probe_id", "exact_key"), "probe_id")
    return missed.agg(F.count(F.lit(1)).alias("engine_calls"),
                      F.countDistinct("exact_key").alias("distinct_keys"))


@register("read_through_fill", QR._outcomes_sql() + f""",
resp AS (SELECT sha256(text) AS k, max('{{"doc_id":' || doc_id || ',"source":' || to_json(source) || '}}') AS r
         FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
missed AS (SELECT p.exact_key, min(o.probe_id) AS probe_id FROM outcomes o JOIN probes p USING (probe_id)
           WHERE o.outcome IN ('miss', 'guard_rejected') GROUP BY p.exact_key),
filled AS (SELECT m.exact_key, coalesce(resp.r, {lit(X.FALLBACK)}) AS answer
           FROM missed m JOIN documents d ON d.doc_id = m.probe_id LEFT JOIN resp ON resp.k = sha256(d.text))
SELECT exact_key, answer, 'stored' AS origin FROM store WHERE exact_key NOT IN (SELECT exact_key FROM filled)
UNION ALL SELECT exact_key, answer, 'filled' FROM filled""")
def q_read_through_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = QR._described(spark, sf_dir)
    probes, store = QR._probes(rows), QR._store(rows)
    out = QR._lookup(spark, sf_dir, rows, threshold=QR.THRESHOLD)
    # One engine call per distinct missing key (lowest probe id's text).
    missed = (out.filter(F.col("outcome").isin("miss", "guard_rejected"))
              .join(probes.select("probe_id", "exact_key"), "probe_id")
              .groupBy("exact_key").agg(F.min("probe_id").alias("doc_id")))
    calls = missed.join(docs.select("doc_id", "text"), "doc_id")
    filled = X.lookup_engine(calls, _responses(docs)).select("exact_key", F.col("payload").alias("answer"))
    kept = store.select("exact_key", "answer").join(filled.select("exact_key"), "exact_key", "left_anti")
    return (kept.withColumn("origin", F.lit("stored"))
            .unionByName(filled.withColumn("origin", F.lit("filled"))))


@register("batch_extract", ENGINE_SQL + "\nSELECT doc_id, payload AS raw_output, CAST(NULL AS VARCHAR) AS error FROM eng")
def q_batch_extract(spark, sf_dir):
    """Answers of a table of canned responses, asked once per distinct document in four waves; the run stops after two
    of them and is started again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger, engine = scratch_path(spark, "ledger"), X.table_engine(_responses(table(spark, sf_dir, "documents")))
    X.resumable_extract(docs, "text", ledger, engine, waves=4, only=2)
    return X.resumable_extract(docs, "text", ledger, engine, waves=4).select("doc_id", "raw_output", "error")


CHUNK_SQL = """
WITH chunks AS (
  SELECT conv_id, turn, text, CAST(i AS INT) AS seq, substr(text, i * 16 + 1, 16) AS chunk
  FROM (SELECT conv_id, turn, text, unnest(range(CAST(ceil(length(text) / 16) AS BIGINT))) AS i FROM conversations))"""


def _chunks(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return X.chunk_text(conv, "text")


@register("chunk_text", CHUNK_SQL + "\nSELECT conv_id, turn, seq, chunk FROM chunks")
def q_chunk_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("conv_id", "turn", "seq", "chunk")


@register("chunk_reassemble", CHUNK_SQL + """
SELECT c.conv_id, c.turn, string_agg(chunk, '' ORDER BY seq) AS text, CAST(count(*) AS INT) AS n_chunks,
       string_agg(chunk, '' ORDER BY seq) = any_value(c.text) AS matches
FROM chunks c GROUP BY c.conv_id, c.turn""")
def q_chunk_reassemble(spark, sf_dir):
    ch = _chunks(spark, sf_dir)
    back = X.reassemble(ch, ["conv_id", "turn"])
    orig = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("orig"))
    j = back.join(orig, ["conv_id", "turn"])
    return j.select("conv_id", "turn", "text", "n_chunks", (F.col("text") == F.col("orig")).alias("matches"))


STEPS_SQL = CHUNK_SQL + """,
steps AS (
  SELECT conv_id, turn, CAST(seq * 2 AS INT) AS step, substr(text, 1, (seq + 1) * 16) AS cumulative FROM chunks
  UNION ALL
  SELECT conv_id, turn, CAST(seq * 2 + 1 AS INT), substr(text, 1, (seq + 1) * 16) FROM chunks WHERE seq % 3 = 1),
deltas AS (
  SELECT conv_id, turn, step, cumulative,
         coalesce(max(length(cumulative)) OVER (PARTITION BY conv_id, turn ORDER BY step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM steps)"""


@register("cumulative_to_delta", STEPS_SQL + """
SELECT conv_id, turn, step, substr(cumulative, prev + 1) AS delta FROM deltas WHERE length(cumulative) > prev""")
def q_cumulative_to_delta(spark, sf_dir):
    ch = _chunks(spark, sf_dir)
    cum = F.expr("substring(text, 1, (seq + 1) * 16)")
    steps = ch.select("conv_id", "turn", F.explode(F.when(
        F.pmod("seq", F.lit(3)) == 1, F.array(F.col("seq") * 2, F.col("seq") * 2 + 1))
        .otherwise(F.array(F.col("seq") * 2))).alias("step"), cum.alias("cumulative"))
    steps = steps.withColumn("step", F.col("step").cast("int"))
    return X.cumulative_to_delta(steps, ["conv_id", "turn"])


METRICS_SQL = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, value,
                  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn
           FROM events),
m AS (SELECT user_id, day, min(ts) AS started, max(ts) AS finished, count(*) AS completion_tokens,
             CAST(round(sum(CAST(value AS DECIMAL(18, 2)))) AS BIGINT) AS prompt_tokens, max(ts) FILTER (WHERE rn = 2) AS first_token
      FROM r GROUP BY user_id, day),
metrics AS (
  SELECT user_id, strftime(day, '%Y-%m-%d') AS day,
         floor((epoch_us(first_token) - epoch_us(started) + 5) / 10) / 100.0 AS ttft_ms,
         floor((epoch_us(finished) - epoch_us(started) + 5) / 10) / 100.0 AS total_ms,
         prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens,
         round(CASE WHEN first_token IS NOT NULL AND (epoch_us(finished) - epoch_us(first_token)) > 0
                    THEN completion_tokens / ((epoch_us(finished) - epoch_us(first_token)) / 1e6) ELSE 0.0 END, 2)
           AS tokens_per_second,
         started, finished
  FROM m)"""


def _metrics(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    marks = X.request_marks(ev, ["user_id", "day"], tokens=F.round(F.sum(F.col("value").cast("decimal(18,2)"))).cast("bigint"))
    return X.request_metrics(marks)


@register("request_metrics", METRICS_SQL + """
SELECT user_id, day, ttft_ms, total_ms, prompt_tokens, completion_tokens, tokens_per_second FROM metrics""")
def q_request_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("user_id", "day", "ttft_ms", "total_ms", "prompt_tokens",
                                          "completion_tokens", "tokens_per_second")


@register("latency_summary", METRICS_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_requests,
       round(quantile_cont(ttft_ms, 0.5), 4) AS p50_ttft_ms, round(quantile_cont(ttft_ms, 0.99), 4) AS p99_ttft_ms,
       round(count(*) / ((epoch_us(max(finished)) - epoch_us(min(started))) / 1e6), 6) AS requests_per_s,
       round(sum(completion_tokens) / ((epoch_us(max(finished)) - epoch_us(min(started))) / 1e6), 6) AS tokens_per_s,
       round(avg(total_ms), 4) AS mean_total_ms, round(max(total_ms), 4) AS max_total_ms
FROM metrics""")
def q_latency_summary(spark, sf_dir):
    # Materialized once in the shared checkpoint folder: the percentile
    # passes and the final aggregate all read it.
    ensure_checkpoint_dir(spark)
    m = _metrics(spark, sf_dir).checkpoint()
    p50, p99 = exact_percentiles(m, "ttft_ms", [0.5, 0.99])
    span = (F.unix_micros(F.max("finished")) - F.unix_micros(F.min("started"))) / 1e6
    return m.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.round(F.lit(p50).cast("double"), 4).alias("p50_ttft_ms"),
        F.round(F.lit(p99).cast("double"), 4).alias("p99_ttft_ms"),
        F.round(F.count(F.lit(1)) / span, 6).alias("requests_per_s"),
        F.round(F.sum("completion_tokens") / span, 6).alias("tokens_per_s"),
        F.round(F.avg("total_ms"), 4).alias("mean_total_ms"), F.round(F.max("total_ms"), 4).alias("max_total_ms"))


@register("latency_windows", METRICS_SQL + """
SELECT day, count(ttft_ms) AS n, quantile_disc(ttft_ms, 0.5) AS p50_ttft_ms, quantile_disc(ttft_ms, 0.99) AS p99_ttft_ms FROM metrics WHERE ttft_ms IS NOT NULL GROUP BY day
UNION ALL
SELECT 'week ' || CAST(day_of_month // 7 AS VARCHAR), count(ttft_ms), quantile_disc(ttft_ms, 0.5), quantile_disc(ttft_ms, 0.99)
FROM (SELECT *, CAST(substr(day, 9, 2) AS INTEGER) AS day_of_month FROM metrics) WHERE ttft_ms IS NOT NULL GROUP BY 1""")
def q_latency_windows(spark, sf_dir):
    """Latency quantiles per day from sketches, and per week from the days' stored sketches."""
    days = roundtrip_parquet(sketch_by(_metrics(spark, sf_dir), ["day"], "ttft_ms"), "sketches")
    week = F.concat(F.lit("week "), F.floor(F.substring("day", 9, 2).cast("int") / 7).cast("string"))
    weeks = merge_sketches(days.withColumn("week", week), ["week"]).withColumnRenamed("week", "day")
    return days.select("day", "sketch", "n").unionByName(weeks.select("day", "sketch", "n")).select(
        "day", "n", sketch_quantile("sketch", 0.5).alias("p50_ttft_ms"), sketch_quantile("sketch", 0.99).alias("p99_ttft_ms"))
