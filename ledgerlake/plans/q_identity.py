"""Queries for text normalization, keys, fingerprints and dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.operators.identity import exact_dedup
from ledgerlake.plans.registry import register
from ledgerlake.sources.tables import table

# Oracle-side spellings of the same scalars.
SQL_NORM = "replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
SQL_TOKENS = (
    "list_sort(list_filter(list_transform(regexp_extract_all({c}, '\\d[\\d,]*(?:\\.\\d+)?'), "
    "lambda t: regexp_replace(CAST(TRY_CAST(CAST(TRY_CAST(replace(t, ',', '') AS DOUBLE) AS VARCHAR) AS DECIMAL(38,4)) AS VARCHAR), "
    "'\\.?0*$', '')), lambda x: x IS NOT NULL))"
)
SQL_FP = "substr(sha256(array_to_string(" + SQL_TOKENS + ", '|')), 1, 32)"


def sql_norm(c: str) -> str:
    return SQL_NORM.format(c=c)


def sql_tokens(c: str) -> str:
    return SQL_TOKENS.format(c=c)


def sql_fp(c: str) -> str:
    return SQL_FP.format(c=c)


@register("text_normalize", f"SELECT doc_id, {sql_norm('text')} AS norm_text FROM documents")
def q_text_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalize_text("text").alias("norm_text"))


@register("exact_key", f"SELECT doc_id, sha256({sql_norm('text')}) AS exact_key FROM documents")
def q_exact_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.exact_key("text").alias("exact_key"))


@register("numeric_tokens", f"""
SELECT doc_id, array_to_string(tok, '|') AS tokens, CAST(len(tok) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {sql_tokens('text')} AS tok FROM documents)""")
def q_numeric_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tok = T.numeric_tokens("text")
    return (docs.select("doc_id", tok.alias("tok"))
            .select("doc_id", F.array_join("tok", "|").alias("tokens"),
                    F.size("tok").cast("bigint").alias("n_tokens")))


@register("numeric_fingerprint", f"SELECT doc_id, {sql_fp('text')} AS fingerprint FROM documents")
def q_numeric_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.numeric_fingerprint("text").alias("fingerprint"))


@register("exact_dedup", f"""
SELECT sha256({sql_norm('text')}) AS exact_key, min(doc_id) AS rep_doc_id, count(*) AS n_docs
FROM documents GROUP BY 1""")
def q_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
