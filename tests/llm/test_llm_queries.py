import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlake.llm import queries
from tests.conftest import SF001

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_every_operator_is_registered():
    assert [f"op{n}_" in {k.split("_")[0] + "_" for k in entry.queries()} for n in range(1, 14)] == [True] * 13
    assert "pipeline" in entry.queries() and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    frame = queries.QUERIES[name](spark, SF001)
    assert sorted(names) == sorted(frame.columns)

    def norm(rows, cols):
        at = [cols.index(c) for c in sorted(cols)]
        return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)

    assert norm([tuple(r) for r in frame.collect()], frame.columns) == norm(cur.fetchall(), names)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF001).cache()
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("toxic = 1").collect()}
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert gone and len(gone & toxic) / len(gone) > 0.3 and len(gone) < 0.2 * rows
        if name in ("line_dedup", "bpe"):
            assert docs.count() == before.count()
        if name == "near_dedup":
            assert 0 < docs.count() <= before.count() and docs.select("doc_id").distinct().count() == docs.count()
    assert docs.where("n_tokens is null").count() == 0


def test_modules_do_not_hide_import_errors():
    top = os.path.dirname(corpus_pipeline.__file__)
    for folder in (top, os.path.join(top, "ledgerlake", "llm")):
        for f in os.listdir(folder):
            if f.endswith(".py") and f != "__spark_entry__.py":
                with open(os.path.join(folder, f)) as h:
                    assert "except ImportError" not in h.read()
