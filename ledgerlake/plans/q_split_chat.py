"""Queries for splitting and chat-set construction (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import chat as CH
from ledgerlake.operators import split as SP
from ledgerlake.operators.invoice import as_invoice, build_completion
from ledgerlake.plans import sql_corpus as SC
from ledgerlake.plans.derived import gold_invoices
from ledgerlake.plans.q_corpus import records
from ledgerlake.plans.registry import register
from ledgerlake.plans.sql_invoice import COMPLETION, GOLD_CTE, lit
from ledgerlake.sources.io import roundtrip_json, roundtrip_parquet
from ledgerlake.sources.tables import table

SEED = 0
FRACTIONS = (0.85, 0.10, 0.05)
REFERENCE_SIZES = (8500, 1000, 500)


def _sizes(n):
    return tuple(int(n * f) for f in FRACTIONS)


def _split_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    return SP.seeded_split(docs, "doc_id", *_sizes(n), seed=SEED, n_records=n)


SPLIT_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM documents),
sz AS (SELECT CAST(floor(n * {FRACTIONS[0]}) AS BIGINT) AS tr, CAST(floor(n * {FRACTIONS[1]}) AS BIGINT) AS va,
              CAST(floor(n * {FRACTIONS[2]}) AS BIGINT) AS te FROM n),
r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank
      FROM documents),
splits AS (
  SELECT doc_id, CASE WHEN rank < tr THEN 'train' WHEN rank < tr + va THEN 'val' ELSE 'test' END AS split,
         CAST(rank AS BIGINT) AS rank
  FROM r, sz WHERE rank < tr + va + te)"""


@register("seeded_split", SPLIT_SQL + "\nSELECT doc_id, split, rank FROM splits")
def q_seeded_split(spark, sf_dir):
    return _split_docs(spark, sf_dir).select("doc_id", "split", "rank")


@register("split_size_guard", f"""
SELECT CAST(count(*) AS BIGINT) AS n_records, CAST({sum(REFERENCE_SIZES)} AS BIGINT) AS requested,
       CAST(greatest({sum(REFERENCE_SIZES)} - count(*), 0) AS BIGINT) AS shortfall FROM documents""")
def q_split_size_guard(spark, sf_dir):
    return SP.size_report(table(spark, sf_dir, "documents"), *REFERENCE_SIZES)


@register("split_disjoint_check", SPLIT_SQL + """
SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids,
       CAST(0 AS BIGINT) + (SELECT count(*) FROM (SELECT doc_id FROM splits GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS n_in_several,
       CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS n_val,
       CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test
FROM splits""")
def q_split_disjoint_check(spark, sf_dir):
    return SP.disjoint_report(_split_docs(spark, sf_dir), "doc_id")


@register("split_sink", SPLIT_SQL + """
SELECT split, doc_id, text, lang, source FROM splits JOIN documents USING (doc_id)""")
def q_split_sink(spark, sf_dir):
    """Whole records, one folder per split, read back."""
    splits = _split_docs(spark, sf_dir).select("doc_id", "split")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    back = roundtrip_json(docs.join(splits, "doc_id"), "splits", partition_by=["split"])
    return back.select("split", "doc_id", "text", "lang", "source")


def _msg_sql(schema: bool) -> str:
    head, tail = (CH.WITH_SCHEMA.replace("{schema}", CH.SCHEMA_TEXT) if schema else CH.WITHOUT_SCHEMA).split("{document}")
    return f"""
SELECT doc_id, CAST(0 AS INT) AS pos, 'system' AS role, {lit(CH.SYSTEM)} AS content FROM documents
UNION ALL
SELECT doc_id, CAST(1 AS INT), 'user', {lit(head)} || text || {lit(tail)} FROM documents"""


def _messages(spark, sf_dir, schema):
    docs = table(spark, sf_dir, "documents")
    m = docs.select("doc_id", F.posexplode(CH.build_messages(F.col("text"), schema)).alias("pos", "m"))
    return m.select("doc_id", "pos", "m.role", "m.content")


@register("build_messages", _msg_sql(False))
def q_build_messages(spark, sf_dir):
    return _messages(spark, sf_dir, False)


@register("build_messages_schema", _msg_sql(True))
def q_build_messages_schema(spark, sf_dir):
    return _messages(spark, sf_dir, True)


@register("build_completion", "WITH " + GOLD_CTE.strip() + f"\nSELECT id, {COMPLETION} AS completion FROM gold")
def q_build_completion(spark, sf_dir):
    g = as_invoice(gold_invoices(spark, sf_dir), ["id"])
    return g.select("id", build_completion(F.col("invoice")).alias("completion"))


_USER_HEAD, _USER_TAIL = CH.WITHOUT_SCHEMA.split("{document}")
RECORDS_SQL = SC.WITH_RENDER.rstrip() + f""",
recs AS (SELECT printf('inv-%06d', id) AS id, text, {SC.GEN_COMPLETION} AS target FROM rendered),
conv AS (
  SELECT id, CAST(0 AS INT) AS pos, 'system' AS role, {lit(CH.SYSTEM)} AS content FROM recs
  UNION ALL SELECT id, 1, 'user', {lit(_USER_HEAD)} || text || {lit(_USER_TAIL)} FROM recs
  UNION ALL SELECT id, 2, 'assistant', target FROM recs),
fmt AS (
  SELECT id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
         || content || '<|eot_id|>', '' ORDER BY pos) AS formatted
  FROM conv GROUP BY id)
"""


@register("to_conversation", RECORDS_SQL + "SELECT id, pos, role, content FROM conv")
def q_to_conversation(spark, sf_dir):
    r = records(spark, sf_dir)
    m = r.select("id", F.posexplode_outer(CH.to_conversation(F.col("text"), F.col("invoice"))).alias("pos", "m"))
    return m.select("id", "pos", "m.role", "m.content")


@register("format_records", RECORDS_SQL + "SELECT id, formatted AS text FROM fmt")
def q_format_records(spark, sf_dir):
    return CH.format_records(records(spark, sf_dir), CH.LLAMA3).select("id", F.col("formatted").alias("text"))


_M = CH.RESPONSE_MARKER


@register("completion_span", RECORDS_SQL + f"""
SELECT id, CAST(instr(formatted, {lit(_M)}) AS INT) AS marker_pos,
       substr(formatted, instr(formatted, {lit(_M)}) + {len(_M)}) AS completion,
       round((instr(formatted, {lit(_M)}) + {len(_M)} - 1) / length(formatted), 6) AS unscored_share
FROM fmt""")
def q_completion_span(spark, sf_dir):
    f = CH.format_records(records(spark, sf_dir), CH.LLAMA3)
    return f.select("id", *CH.completion_span(F.col("formatted")))


@register("training_text_dataset", RECORDS_SQL + "SELECT formatted AS text FROM fmt")
def q_training_text_dataset(spark, sf_dir):
    f = CH.format_records(records(spark, sf_dir), CH.LLAMA3).select(F.col("formatted").alias("text"))
    return roundtrip_parquet(f, "train_text")
