import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import extract as X
from ledgerlake.operators import reuse as R
from ledgerlake.operators.runs import alignment_report, compare_runs
from ledgerlake.operators.validate import assert_no_invalid, request_defaults


def test_lookup_engine_canned_or_fallback(spark):
    reqs = spark.createDataFrame([(1, "doc"), (2, "never seen")], "id long, text string")
    resp = spark.createDataFrame([("doc", json.dumps({"total": 1.0}, separators=(",", ":")))],
                                 "text string, response string")
    out = {r["id"]: r["payload"] for r in X.lookup_engine(reqs, resp).collect()}
    assert json.loads(out[1]) == {"total": 1.0}
    fallback = json.loads(out[2])
    assert fallback["vendor"] == "Mock Vendor Inc." and fallback["line_items"] == []


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abc",), ("a" * 40,)], "t string")
    assert [r[0] for r in df.select(X.token_estimate(F.col("t"))).collect()] == [1, 1, 10]


def test_request_defaults_and_empty_text(spark):
    df = spark.createDataFrame([(1, "x"), (2, "")], "id long, text string")
    rows = request_defaults(df).collect()
    assert [(r["id"], r["schema_name"], r["stream"], r["use_cache"]) for r in rows] == [(1, "invoice", False, True)]


def test_assert_no_invalid_raises(spark):
    bad = spark.createDataFrame([(3, 1)], "n_records long, n_invalid long")
    with pytest.raises(Exception):
        assert_no_invalid(bad).collect()
    good = spark.createDataFrame([(3, 0)], "n_records long, n_invalid long")
    assert assert_no_invalid(good).first()["n_invalid"] == 0


def test_alignment_report_counts_unmatched(spark):
    preds = spark.createDataFrame([("base", 1, "x"), ("base", 2, "y"), ("base", 9, "z")],
                                  "tag string, id long, prediction string")
    gold = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    r = alignment_report(preds, gold, ["base"]).first()
    assert (r["n_predictions"], r["n_gold"], r["n_unmatched"]) == (3, 3, 2)


def test_compare_runs_delta(spark):
    rows = [("baseline", 0.5, 0.4, 0.6, 0.1, 0.2, 0.3), ("tuned", 0.9, 0.8, 0.95, 0.7, 0.9, 0.05)]
    rep = spark.createDataFrame(rows, "tag string, field_f1 double, field_precision double, field_recall double, "
                                      "exact_match_rate double, schema_validity_rate double, "
                                      "invalid_json_syntax_rate double")
    out = {r["metric"]: r for r in compare_runs(rep).collect()}
    assert len(out) == 6 and out["field_f1"]["delta"] == 0.4
    assert out["invalid_json_syntax_rate"]["delta"] == -0.25


def test_live_entries_ttl_from_write(spark):
    t0 = dt.datetime(2024, 1, 2)
    writes = spark.createDataFrame([("a", t0 - dt.timedelta(seconds=30)), ("a", t0 - dt.timedelta(hours=30)),
                                    ("b", t0 - dt.timedelta(seconds=61))], "key string, ts timestamp")
    live = {r["key"] for r in R.live_entries(writes, "key", "ts", F.lit(t0), 60).collect()}
    assert live == {"a"}
    forever = {r["key"] for r in R.live_entries(writes, "key", "ts", F.lit(t0), None).collect()}
    assert forever == {"a", "b"}
