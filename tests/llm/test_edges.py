"""Every operator and pipeline stage on tables with extra columns named like internals, nulls, repeats, long texts, none."""

import ast
import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import ann_blocks, bpe, chat, drift_clusters, html_text, line_dedup, minhash, mixing, pii, range_join, repair, topk, toxicity
from tests.conftest import SF001

LONG = ("a quite ordinary sentence that somebody once wrote down, and again. " * 6000) + "\n" + "x" * 200_000
TEXTS = [(1, "The first text, by hand.\nSome line that is long enough to be counted as one.", "en", "web", 5), (2, None, None, None, None), (3, "", "en", "web", 0),
         (None, "no id here", "de", "web", 3), (1, "The first text, by hand.\nSome line that is long enough to be counted as one.", "en", "web", 5), (5, LONG, "en", "books", 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def names_in(module):
    """Every string in a module that could name a column, besides the operator's own columns."""
    with open(module.__file__) as f:
        found = {n.value for n in ast.walk(ast.parse(f.read())) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    return sorted({x for x in found if x.isidentifier() and len(x) < 20})


def clashing(df, module, keep):
    low = {c.lower() for c in df.columns} | {k.lower() for k in keep}
    extra = {}
    for n in names_in(module) + ["__in0", "__text", "__drop", "__doc", "__id", "__map", "__key", "__place", "__copy"]:
        if n.lower() not in low and n.lower() not in {e.lower() for e in extra}:
            extra[n] = F.lit(f"v-{n}")
    return df.select("*", *[v.alias(k) for k, v in extra.items()]), extra


@pytest.mark.parametrize("module, call, made", [
    (line_dedup, lambda d: line_dedup.dedup_lines(d), {"n_lines", "n_dropped"}),
    (pii, lambda d: pii.pseudonymise(d, "k"), {"n_entities"}),
    (mixing, lambda d: mixing.mix(d), {"n_words", "weight", "n_copies"}),
    (mixing, lambda d: mixing.repeated(mixing.mix(d)), {"n_words", "weight", "n_copies"}),
    (toxicity, lambda d: toxicity.score(d, toxicity.fit_model(d, d.selectExpr("doc_id", "1 as toxic").limit(0))), {"held_out", "score", "predicted"}),
    (bpe, lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), {"n_tokens", "ids_sha256", "decoded_sha256", "ids"}),
])
def test_columns_pass_through_whatever_their_names(spark, module, call, made):
    docs = spark.createDataFrame(TEXTS, DOCS)
    frame, extra = clashing(docs, module, made)
    out = call(frame)
    rows = out.collect()
    assert set(extra) <= set(out.columns) and all(r[n] == f"v-{n}" for r in rows for n in extra)
    assert len(rows) == len(TEXTS) or made == {"n_words", "weight", "n_copies"}
    assert call(frame.limit(0)).count() == 0


@pytest.mark.parametrize("module, call", [
    (minhash, lambda d: minhash.near_duplicates(d)),
    (html_text, lambda d: html_text.extract_pages(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u")))),
    (chat, lambda d: chat.format_chats(d.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"}))),
    (repair, lambda d: repair.repair(d.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"}))),
    (repair, lambda d: repair.repaired_texts(d.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"}))),
])
def test_odd_texts_and_extra_columns(spark, module, call):
    docs = spark.createDataFrame(TEXTS, DOCS)
    frame, _ = clashing(docs, module, {"page_id", "html", "url", "conv_id", "turn", "role", "n_chars"})
    assert call(frame).collect()
    assert call(frame.limit(0)).count() == 0


@pytest.mark.parametrize("module, call", [
    (ann_blocks, lambda d: ann_blocks.nearest(d, F.col("vec_id") % 20 == 0)), (topk, lambda d: topk.top_k(d, F.col("vec_id") % 50 == 0)),
    (drift_clusters, lambda d: drift_clusters.cluster(d, dim=2)), (range_join, lambda d: range_join.near_vectors(d))])
def test_odd_vectors_and_extra_columns(spark, module, call):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (20, [1.0, 2.5], 1), (50, None, 1), (3, [0.0, 0.0], None), (None, [1.0, 1.0], 2), (4, [], 1), (5, [1.0], 1), (6, [float("nan"), 1.0], 1)]
    frame, _ = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), module, {"vec_id", "embedding", "label"})
    assert call(frame).collect()
    assert call(frame.limit(0)).count() == 0


def test_stages_on_odd_rows_and_no_rows(spark):
    docs = spark.createDataFrame(TEXTS, DOCS).withColumns({c: F.lit(1) for c in ("score", "keeper", "t1", "end", "node")})
    columns = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name != "bpe":
            assert out.columns == columns
        if name != "mixing":
            assert {None, 2, 3} <= set(ids) and ids.count(5) == 1
        assert stage(spark, docs.limit(0), SF001).count() == 0
