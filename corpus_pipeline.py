"""Training-corpus pipeline over ``documents``: toxicity, line dedup, near dedup, source mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame that is written and
read again before the next one. All but the last return the columns of ``documents``; ``n_chars`` is kept equal to
the code points of the text. A row without doc_id passes the filters that need one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, line_dedup, minhash, mixing, toxicity
from ledgerlake.llm.common import read, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stages read whole texts through a learnt score, random draws and a tokenizer's merges: no SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    model = toxicity.fit_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat across documents."""
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    groups = minhash.near_duplicates(docs, width=5, percent=80, bands=32)
    gone, _ = write_table(groups.where("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources draw them."""
    return mixing.repeated(mixing.mix(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the decoded bytes."""
    coded = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = write_table(docs, f"stage-{name}")
    return docs
