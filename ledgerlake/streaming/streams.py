"""Structured Streaming jobs: continuous lookup, TTL dedup, windowed metrics.

Each job reads a file source, keeps its progress in a checkpoint location
under the session's shared checkpoint folder (so a restarted driver or a
lost executor resumes exactly once), and appends to a parquet sink there.
``run_available_now`` processes what is available and stops; callers read
the sink back as a batch table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlake.operators.temporal import first_sights
from ledgerlake.session import scratch_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """One supplied table as a streaming source (zone-less timestamps cast to
    session-zone TIMESTAMP so watermarks accept them)."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a glob of one name: the stream source takes it for a single file as well as for a folder of part files
    df = reader.parquet(f"{root}/{{{name}}}.parquet")
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available, then read its parquet
    sink back as a batch DataFrame."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    query = (stream.writeStream.format("parquet").outputMode(output_mode)
             .option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
             .trigger(availableNow=True).queryName(f"{name}_{abs(hash(out)) % 10**8}").start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_exact_lookup(probes: DataFrame, store: DataFrame, probe_id: str = "probe_id") -> DataFrame:
    """Arriving documents answered from a static store (stream-static left
    join on the exact key)."""
    s = store.select("exact_key", F.col("answer").alias("stored_answer"))
    j = probes.select(probe_id, "exact_key").join(s, "exact_key", "left")
    hit = F.col("stored_answer").isNotNull()
    return j.select(probe_id, F.when(hit, F.lit("exact")).alias("tier"),
                    F.when(hit, F.lit(1.0)).alias("similarity"), F.col("stored_answer").alias("answer"))


ANCHOR_STATE = "anchor_us long"


def ttl_first_sights(events: DataFrame, keys: list[str], ttl_seconds: int, watermark: str) -> DataFrame:
    """First sight per key passes; repeats within ``ttl_seconds`` of the
    anchor (the first sight's event time) are hits and dropped; the first
    event at or after anchor + ttl passes and becomes the new anchor. A hit
    never extends the entry.

    State per key is one long (the anchor). An event-time timeout at
    anchor + ttl evicts it once the watermark passes, so state is bounded by
    the keys active within one ttl. Rows of one key in one micro-batch are
    sorted inside the function; batch size is bounded by the source's
    trigger options.
    """
    ttl_us = ttl_seconds * 1_000_000
    columns = [*keys, "event_id", "ts"]
    schema = events.select(*columns).schema

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        ts_us = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        keep = []
        for t in ts_us:
            if anchor is None or t >= anchor + ttl_us:
                anchor = int(t)
                keep.append(True)
            else:
                keep.append(False)
        state.update((anchor,))
        state.setTimeoutTimestamp(int(anchor // 1000 + ttl_us // 1000))
        out = rows[keep][columns]
        if len(out):
            yield out

    return (events.withWatermark("ts", watermark).groupBy(*keys)
            .applyInPandasWithState(step, schema, ANCHOR_STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def sights_in_batches(events: DataFrame, keys: list[str], ttl_seconds: int, delay_seconds: int, name: str) -> DataFrame:
    """``ttl_first_sights`` as micro-batches that are replayed by joins, and what they let pass.

    Each micro-batch goes through ``first_sights`` from the anchors (last sight per key) that the batch before left,
    so a key's rows are split over tasks by time and never stand in one frame. Anchors and results are tables of the
    batch's number in the shared folder; a batch that is run again after a failure rewrites its own and reads the
    same anchors. Rows more than ``delay_seconds`` behind the latest time of the batches before are late and left out;
    anchors a ttl behind it are forgotten, as no row in time can meet them. The batch size is that of the source's
    trigger.
    """
    spark = events.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    schema = events.select(*keys, "event_id", "ts").schema
    anchor_schema = T.StructType([*events.select(*keys, "ts").schema.fields, T.StructField("latest", T.TimestampType())])

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.select(*keys, "event_id", "ts").where("ts IS NOT NULL")
        if number:
            before = session.read.schema(anchor_schema).parquet(f"{out}/anchors/{number - 1}")
            latest = before.agg(F.max("latest").alias("latest")).first()["latest"]
        else:
            before, latest = session.createDataFrame([], anchor_schema), None
        if latest is not None:
            batch = batch.where(F.col("ts") >= F.lit(latest) - F.make_interval(secs=F.lit(delay_seconds)))
        known = before.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, "ts")
        sights = first_sights(batch, keys, "ts", "event_id", ttl_seconds, known)
        sights.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        sights = session.read.schema(schema).parquet(f"{out}/data/batch={number}")
        now = batch.agg(F.max("ts").alias("t")).first()["t"]
        now = max((t for t in (now, latest) if t is not None), default=None)
        anchors = known.unionByName(sights.select(*keys, "ts")).groupBy(*keys).agg(F.max("ts").alias("ts")).withColumn("latest", F.lit(now).cast("timestamp"))
        if now is not None:
            anchors = anchors.where(F.unix_micros("ts") + F.lit((ttl_seconds + delay_seconds) * 1_000_000) > F.unix_micros(F.lit(now)))
        # a row without key keeps the latest time where no anchor is left
        mark = session.createDataFrame([tuple([None] * (len(keys) + 1) + [now])], anchor_schema)
        anchors.unionByName(mark).write.mode("overwrite").parquet(f"{out}/anchors/{number}")

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(schema).parquet(f"{out}/data").select(*schema.names)


#: What a mark of a request may be; others count as events only.
STARTED, FIRST_TOKEN, FINISHED, HIT, ERROR = "started", "first_token", "finished", "hit", "error"


def request_windows(marks: DataFrame, request: list[str], window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Per tumbling event-time window over marks of requests (``request``, ts, mark, tokens, value): events, errors, value sum,
    requests, hits and hit ratio, mean time to first token and tokens per second of decoding.

    Two stateful steps in one query: marks become requests (the marks of one ``request`` in one window: earliest start and
    first token, latest finish, tokens, whether a cache hit answered it), and these become windows. The first step
    hands its window's time on, so the second closes by the same watermark. State holds a row per request and per
    window; marks are combined before the shuffle. Emitted once the watermark closes a window (append mode).
    """
    def when(kind: str):
        return F.when(F.col("mark") == kind, F.col("ts"))

    each = marks.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), *request).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.when(F.col("mark") == ERROR, 1).otherwise(0)).alias("n_errors"),
        F.sum(F.col("value").cast("decimal(18,4)")).alias("value_sum"), F.min(when(STARTED)).alias("started"), F.min(when(FIRST_TOKEN)).alias("first_token"),
        F.max(when(FINISHED)).alias("finished"), F.sum("tokens").alias("tokens"), F.max((F.col("mark") == HIT).cast("int")).alias("hit"))
    wait = F.unix_micros("first_token") - F.unix_micros("started")
    decode = F.unix_micros("finished") - F.unix_micros("first_token")
    each = each.select(F.window_time("w").alias("at"), "n_events", "n_errors", "value_sum", "hit", F.when(wait >= 0, wait).alias("wait"),
                       F.when(decode > 0, decode).alias("decode"), F.when(decode > 0, F.col("tokens")).alias("decoded"))
    whole = each.groupBy(F.window("at", window).alias("w")).agg(
        F.sum("n_events").alias("n_events"), F.sum("n_errors").alias("n_errors"), F.sum("value_sum").cast("decimal(28,4)").alias("value_sum"), F.count(F.lit(1)).alias("n_requests"),
        F.sum("hit").alias("n_hits"), F.sum("wait").alias("wait"), F.count("wait").alias("waits"), F.sum("decode").alias("decode"), F.sum("decoded").alias("decoded"))
    return whole.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "n_errors", "value_sum", "n_requests", "n_hits",
                        F.round(F.col("n_hits") / F.col("n_requests"), 4).alias("hit_ratio"), F.when(F.col("waits") > 0, F.round(F.col("wait") / F.col("waits") / 1000.0, 3)).alias("mean_ttft_ms"),
                        F.when(F.col("decode") > 0, F.round(F.col("decoded") / (F.col("decode") / 1e6), 6)).alias("tokens_per_s"))


def windowed_metrics(events: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Per tumbling event-time window: events, errors, error rate and value
    sum; emitted once the watermark closes the window (append mode)."""
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("n_errors"),
        F.sum(F.col("value").cast("decimal(18,4)")).alias("value_sum"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_events", "n_errors", "value_sum")
