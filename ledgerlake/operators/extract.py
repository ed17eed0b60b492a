"""Batch extraction through a pluggable engine, plus request/stream data.

The engine is user code (a model server client, an in-process model, or a
lookup table); Spark partitions the documents and builds one engine per task.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the answer the lookup engine gives for unknown documents.
FALLBACK = ('{"vendor":"Mock Vendor Inc.","invoice_number":"INV-0000-00000","invoice_date":"2024-01-01",'
            '"line_items":[],"subtotal":0.0,"tax":0.0,"total":0.0,"currency":"USD"}')
CHUNK_SIZE = 16
MAX_ATTEMPTS = 3
# What one task sorts of cumulative texts, about, and what a row takes besides its text.
TASK_BYTES, ROW_BYTES = 256 << 20, 64


def batch_extract(df: DataFrame, text_col: str, engine_factory: Callable[[], Callable[[str], str]],
                  max_attempts: int = MAX_ATTEMPTS, backoff_seconds: float = 0.0) -> DataFrame:
    """Raw model output per document through any engine.

    ``engine_factory()`` runs once per task (model load / client creation);
    the returned callable maps one document to raw output text. A document
    that still fails after ``max_attempts`` gets empty output, which scores
    as unparseable. Adds ``raw_output``, ``attempts`` and ``error``.
    Batch size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    out_schema = T.StructType(df.schema.fields + [
        T.StructField("raw_output", T.StringType()), T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = engine_factory()
        for pdf in batches:
            outs, tries, errors = [], [], []
            for doc in pdf[text_col].tolist():
                err = None
                for attempt in range(1, max_attempts + 1):
                    try:
                        outs.append(engine(doc) or "")
                        err = None
                        break
                    except Exception as exc:  # noqa: BLE001 - engine failures are data here
                        err = f"{type(exc).__name__}: {exc}"
                        if attempt < max_attempts and backoff_seconds:
                            time.sleep(backoff_seconds * 2 ** (attempt - 1))
                else:
                    outs.append("")
                tries.append(attempt)
                errors.append(err)
            yield pdf.assign(raw_output=outs, attempts=tries, error=errors)

    return df.mapInPandas(run, out_schema)


def document_key(text: Column) -> Column:
    """Equality key for whole documents: SHA-256 of the exact text."""
    return F.sha2(text, 256)


def lookup_engine(requests: DataFrame, responses: DataFrame, text_col: str = "text",
                  response_col: str = "response", fallback: str = FALLBACK) -> DataFrame:
    """Canned answer per exact document text, else the fallback invoice.

    An equi-join on the SHA-256 of the text (never on the text itself), so
    AQE can pick broadcast when ``responses`` is measured small and
    sort-merge otherwise.
    """
    resp = responses.select(document_key(F.col(text_col)).alias("_k"), F.col(response_col).alias("_r"))
    resp = resp.groupBy("_k").agg(F.max("_r").alias("_r"))
    req = requests.withColumn("_k", document_key(F.col(text_col)))
    j = req.join(resp, "_k", "left")
    return j.withColumn("payload", F.coalesce(F.col("_r"), F.lit(fallback))).drop("_k", "_r")


def called(engine_factory: Callable[[], Callable[[str], str]], max_attempts: int = MAX_ATTEMPTS, workers: int = 8,
           backoff_seconds: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """An engine for ``resumable_extract`` that calls a model client: (key, text) to (key, raw_output, error).

    One client per task, up to ``workers`` calls at a time; a call that fails is tried up to ``max_attempts`` times.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = engine_factory()

        def one(doc: str) -> tuple[str, str | None]:
            for attempt in range(1, max_attempts + 1):
                try:
                    return engine(doc) or "", None
                except Exception as exc:  # noqa: BLE001 - engine failures are data here
                    error = f"{type(exc).__name__}: {exc}"
                    if attempt < max_attempts and backoff_seconds:
                        time.sleep(backoff_seconds * 2 ** (attempt - 1))
            return "", error

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                found = list(pool.map(one, pdf["text"].tolist()))
                yield pd.DataFrame({"key": pdf["key"], "raw_output": [x for x, _ in found], "error": pd.Series([e for _, e in found], dtype=object)})

    return lambda docs: docs.select("key", "text").mapInPandas(run, "key string, raw_output string, error string")


LEDGER = "key string, raw_output string, error string, wave int"


def resumable_extract(requests: DataFrame, text_col: str, ledger: str, engine: Callable[[DataFrame], DataFrame], waves: int = 16,
                      only: int | None = None) -> DataFrame:
    """``requests`` with ``raw_output`` and ``error`` from an engine that is asked once per distinct document.

    Documents are asked in ``waves`` (by a hash of their key); a wave's answers are written to the folder ``ledger`` and
    committed as a whole. A run that is started again reads what is there and asks only for the rest, so a lost run costs the
    wave it was in. Requests of one text share its answer, whichever came first. ``only`` stops after so many waves: requests of
    later ones have a null output. Null texts are not asked and have a null output.
    """
    spark = requests.sparkSession
    named = requests.withColumn("_k", document_key(F.col(text_col)))
    distinct = named.where("_k IS NOT NULL").groupBy(F.col("_k").alias("key")).agg(F.first(text_col).alias("text"))
    wave = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(waves)).cast("int")
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def finished(number: int) -> bool:
        return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/wave={number}/_SUCCESS"))

    for number in [n for n in range(waves) if not finished(n)][:only]:
        # answers of an earlier ledger with other waves, or of texts asked before, are not asked again
        asked = distinct.where(wave == number).join(read_ledger(spark, ledger, waves).select("key"), "key", "left_anti")
        engine(asked).select("key", "raw_output", "error").write.mode("overwrite").parquet(f"{ledger}/wave={number}")
    answers = read_ledger(spark, ledger, waves).select(F.col("key").alias("_key"), "raw_output", "error")
    return named.join(answers, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def read_ledger(spark: SparkSession, ledger: str, waves: int) -> DataFrame:
    """Answers of the committed waves."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(ledger).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [n for n in range(waves) if fs.exists(jvm.Path(f"{ledger}/wave={n}/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema("key string, raw_output string, error string").parquet(*[f"{ledger}/wave={n}" for n in done])


def table_engine(responses: DataFrame, fallback: str = FALLBACK) -> Callable[[DataFrame], DataFrame]:
    """An engine for ``resumable_extract`` that answers from a table of canned responses (text, response)."""
    return lambda docs: lookup_engine(docs, responses, fallback=fallback).select("key", F.col("payload").alias("raw_output"), F.lit(None).cast("string").alias("error"))


def token_estimate(text: Column) -> Column:
    """max(1, len // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def chunk_text(df: DataFrame, text_col: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Fixed-size character chunks with their sequence number (``seq``,
    ``chunk``); empty text yields no chunks."""
    n = F.ceil(F.length(text_col) / size).cast("int")
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1),
                                       lambda i: F.substring(F.col(text_col), i * size + 1, size))) \
        .otherwise(F.array().cast("array<string>"))
    return df.select("*", F.posexplode(chunks).alias("seq", "chunk"))


def reassemble(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Concatenate chunks in ``seq`` order per message (``text``, ``n_chunks``)."""
    g = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("c"))
    return g.select(*keys, F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("text"),
                    F.size("c").alias("n_chunks"))


def cumulative_to_delta(steps: DataFrame, keys: list[str], step_col: str = "step",
                        text_col: str = "cumulative") -> DataFrame:
    """Cumulative text per step -> only the newly generated text; steps that
    did not grow emit nothing.

    Cumulative texts grow with the square of a text, and shrink so well in a shuffle that partitions sized by it are
    far larger in memory; so the steps are measured first and dealt by key to tasks of about TASK_BYTES.
    """
    size = steps.agg(F.sum(F.octet_length(text_col) + ROW_BYTES)).first()[0] or 0
    parts = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    steps = steps.repartition(parts, *keys)
    w = Window.partitionBy(*keys).orderBy(step_col).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.max(F.length(text_col)).over(w), F.lit(0))
    out = steps.withColumn("_prev", prev)
    return (out.filter(F.length(text_col) > F.col("_prev"))
            .select(*keys, step_col, F.expr(f"substring({text_col}, _prev + 1)").alias("delta")))


def request_marks(events: DataFrame, keys: list[str], ts: str = "ts", order_tiebreak: str = "event_id",
                  tokens: Column | None = None) -> DataFrame:
    """Per request: started (first mark), first_token (second mark),
    finished (last mark) and completion_tokens (mark count).

    The second mark comes from ``row_number() <= 2`` per request, which Spark
    turns into a map-side group limit, so a request with a huge share of the
    rows still ships two rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(ts, order_tiebreak)
    second = (events.select(*keys, ts, order_tiebreak).withColumn("_rn", F.row_number().over(w))
              .filter("_rn <= 2").filter("_rn = 2").select(*keys, F.col(ts).alias("first_token")))
    agg = events.groupBy(*keys).agg(
        F.min(ts).alias("started"), F.max(ts).alias("finished"),
        F.count(F.lit(1)).alias("completion_tokens"),
        (tokens if tokens is not None else F.lit(0)).alias("prompt_tokens"))
    return agg.join(second, keys, "left")


def _ms(a: Column, b: Column) -> Column:
    """Milliseconds between two timestamps, rounded half-up to 2 decimals in
    integer microseconds (exact, whatever the engine's float rounding)."""
    return F.floor((F.unix_micros(a) - F.unix_micros(b) + 5) / 10) / 100.0


def request_metrics(marks: DataFrame, now: Column | None = None) -> DataFrame:
    """ttft_ms, total_ms (a missing finish counts up to ``now``), token
    counts and tokens per second of decode time (0 when unknown), 2 decimals."""
    finished = F.col("finished") if now is None else F.coalesce(F.col("finished"), now)
    decode_s = (F.unix_micros("finished") - F.unix_micros("first_token")) / 1e6
    tps = F.when(F.col("first_token").isNotNull() & F.col("finished").isNotNull() & (decode_s > 0),
                 F.col("completion_tokens") / decode_s).otherwise(F.lit(0.0))
    return marks.select(
        "*", _ms(F.col("first_token"), F.col("started")).alias("ttft_ms"),
        _ms(finished, F.col("started")).alias("total_ms"),
        F.round(tps, 2).alias("tokens_per_second"))
