"""Targets are shipped once for all runs, entries as texts; what is written leaves no shuffle files."""

import json
import os

from pyspark.sql import functions as F

from ledgerlake.operators import evaluate as E
from ledgerlake.operators.invoice import INVOICE
from ledgerlake.session import shuffles_dropped

GOLD = {"vendor": "Quay \x01\x02 Works", "invoice_number": "Q/1", "invoice_date": "2024-02-29", "line_items": [{"description": "Rope", "quantity": 2.0, "unit_price": 3.5, "amount": 7.0}],
        "subtotal": 7.0, "tax": 1.0, "total": 8.0, "currency": "EUR"}


def _scored(spark, rows, ids, tags):
    preds = spark.createDataFrame(rows, "tag string, id long, prediction string")
    gold = spark.read.schema(f"id long, invoice {INVOICE.simpleString()}").json(spark.sparkContext.parallelize([json.dumps({"id": i, "invoice": GOLD}) for i in ids]))
    return E.score_records(preds, gold, tags)


def test_runs_share_the_targets_and_every_row_is_scored_once(spark):
    whole, other = json.dumps(GOLD), json.dumps({**GOLD, "vendor": "Quay \x01 Works"})
    rows = [("a", 1, whole), ("a", 1, other), ("b", 2, other), ("c", 1, whole), (None, 1, whole), ("a", None, whole), ("b", 9, "none")]
    scored = _scored(spark, rows, [1, 1, 2, None], ["a", "b"])
    got = sorted(((r["tag"], r["id"], r["tp"], r["fp"], r["fn"], r["exact"]) for r in scored.collect()), key=str)
    missed = (0, 0, 11, False)
    assert got == sorted([("a", 1, 11, 0, 0, True), ("a", 1, 11, 0, 0, True), ("a", 1, 10, 1, 1, False), ("a", 1, 10, 1, 1, False), ("b", 2, 10, 1, 1, False), ("a", 2, *missed), ("b", 1, *missed), ("b", 1, *missed),
                          ("a", None, *missed), ("b", None, *missed), ("a", None, 0, 11, 0, False), ("c", 1, 0, 11, 0, False), (None, 1, 0, 11, 0, False), ("b", 9, 0, 0, 0, False)], key=str)
    scored.collect()
    told = scored._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in told


def test_entries_survive_the_way_as_one_text(spark):
    entries = [["a=s:x", "b=s:\x01", "c=s:\x02\x03", "d=\x02"], ["a=s:", "b=n:1.00"]]
    df = spark.createDataFrame([(e,) for e in entries], "e array<string>")
    back = [r[0] for r in df.select(E._unshipped(E._shipped(F.col("e")))).collect()]
    assert [len(x) for x in back] == [4, 2] and back[1] == entries[1] and len(set(back[0])) == 4


def test_answers_are_parsed_once_when_flattened(spark):
    from ledgerlake.plans import q_evaluate as Q
    plan = Q.q_flatten_record(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 3  # the answer, and twice what is read if it is odd


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import time
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    status = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "kept"))
    held = status.shuffleStatuses().size()
    with shuffles_dropped(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "dropped"))
    for _ in range(50):
        if status.shuffleStatuses().size() <= held:
            break
        time.sleep(0.1)
    assert status.shuffleStatuses().size() <= held and spark.conf.get(name, None) == before and os.path.isdir(tmp_path / "dropped")


def test_numbers_and_paths_are_read_as_before(spark):
    items = [{"amount": i} for i in range(E.WRITTEN_PATHS + 2)]
    texts = ['{"total":1e400,"tax":-1e400,"subtotal":1e3,"vendor":123456789012345678901234567890123456789012,"currency":-0.0,"invoice_number":9007199254740993,"invoice_date":0.12499999999999999999999}',
             '{"total":true,"tax":null,"subtotal":{"a":[1.50]},"vendor":["x"],"currency":"\\u20ac 1.50"}', json.dumps({"line_items": items})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, prediction string")
    got = [r["e"] for r in E.validate_predictions(df).select("id", E.flatten_extracted().alias("e")).orderBy("id").collect()]
    assert got[0] == ["vendor=n:1.2345678901234568E41", "invoice_number=n:9007199254740992.00", "invoice_date=n:0.13", "subtotal=n:1000.00", "tax=n:-inf", "total=n:inf", "currency=n:0.00"]
    assert got[1] == ['vendor=s:["x"]', 'subtotal=s:{"a":[1.5]}', "total=b:true", "currency=n:1.50"]
    assert got[2] == [f"line_items[{i}].amount=n:{i}.00" for i in range(len(items))]
