import json

import pytest

from ledgerlake.operators.evaluate import extract_record, score_records, score_report, validate_predictions
from ledgerlake.operators.invoice import INVOICE
from ledgerlake.operators.runs import alignment_report, require_aligned, run_report

BOARD = {"description": "Oak board", "quantity": 9.0, "unit_price": 8.25, "amount": 74.25}
LATH = {"description": "Lath", "quantity": 14.0, "unit_price": 2.0, "amount": 28.0}
# 7 scalar fields and 2 items of 4 fields: 15 entries
GOLD = {"vendor": "Harbour Timber", "invoice_number": "HT/5512", "invoice_date": "2023-09-02", "line_items": [BOARD, LATH],
        "subtotal": 102.25, "tax": 16.0, "total": 118.25, "currency": "NOK"}


def changed(**fields):
    return json.dumps({**GOLD, **fields})


def without(field):
    return json.dumps({k: v for k, v in GOLD.items() if k != field})


def targets(spark, n):
    return spark.read.schema(f"id long, invoice {INVOICE.simpleString()}").json(
        spark.sparkContext.parallelize([json.dumps({"id": i, "invoice": GOLD}) for i in range(n)]))


def answers(spark, rows):
    return spark.createDataFrame(rows, "tag string, id long, prediction string")


def flags(spark, *raws):
    checked = validate_predictions(answers(spark, [("t", i, r) for i, r in enumerate(raws)]))
    return [(r["parsed_ok"], r["schema_valid"]) for r in checked.orderBy("id").collect()]


def confusion(spark, raw):
    r = score_records(answers(spark, [("t", 0, raw)]), targets(spark, 1), ["t"]).first()
    return r["tp"], r["fp"], r["fn"], r["exact"]


@pytest.mark.parametrize("raw, want", [
    (json.dumps(GOLD), (True, True)),
    ("```json\n" + json.dumps(GOLD, indent=1) + "\n```", (True, True)),
    ("Sure! " + json.dumps(GOLD) + " Anything else?", (True, True)),
    (without("currency"), (True, True)), (changed(currency=None), (True, False)), (changed(currency="KRONER"), (True, False)),
    (changed(total="plenty"), (True, False)), (changed(total="118.25"), (True, True)), (changed(tax=-1), (True, False)),
    (changed(line_items=[{**BOARD, "quantity": 0}]), (True, False)), (changed(line_items="none"), (True, False)),
    (changed(invoice_date="2 Sept"), (True, False)), (without("vendor"), (True, False)),
    ("There is nothing to extract.", (False, False)), ("[4, 5]", (False, False)), ("", (False, False)),
    (json.dumps(GOLD)[:-20], (False, False)),
])
def test_parse_and_validate(spark, raw, want):
    assert flags(spark, raw) == [want]


def test_confusion_by_hand(spark):
    assert confusion(spark, json.dumps(GOLD)) == (15, 0, 0, True)
    assert confusion(spark, changed(vendor="Quay Timber", total=5)) == (13, 2, 2, False)
    assert confusion(spark, changed(line_items=[BOARD])) == (11, 0, 4, False)
    assert confusion(spark, changed(line_items=[BOARD, LATH, LATH])) == (15, 4, 0, False)
    assert confusion(spark, changed(total="NOK 118.250", vendor=" harbour  TIMBER")) [0] >= 14
    assert confusion(spark, "no idea") == (0, 0, 15, False)


def test_repeated_keys_and_non_numbers(spark):
    twice = json.dumps(GOLD)[:-1] + ', "total": 5}'
    back = '{"total": 5, ' + json.dumps(GOLD)[1:]
    nan = json.dumps({**GOLD, "tax": float("nan")})
    assert "NaN" in nan and flags(spark, twice, back, nan) == [(True, True), (True, True), (True, False)]
    assert confusion(spark, twice) == (14, 1, 1, False)
    assert confusion(spark, back) == (15, 0, 0, True)
    assert confusion(spark, nan) == (14, 1, 1, False)


def test_unmatched_rows_count(spark):
    rows = [("a", 0, json.dumps(GOLD)), ("a", 1, json.dumps(GOLD)), ("a", 77, json.dumps(GOLD)), ("b", 0, json.dumps(GOLD))]
    preds, gold = answers(spark, rows), targets(spark, 3)
    r = {x["tag"]: x for x in score_report(score_records(preds, gold, ["a", "b"])).collect()}
    assert (r["a"]["n"], r["a"]["json_parse_rate"], r["a"]["exact_match_rate"]) == (4, 0.75, 0.5)
    assert (r["a"]["field_precision"], r["a"]["field_recall"]) == (0.6667, 0.6667)
    assert (r["b"]["n"], r["b"]["field_precision"], r["b"]["field_recall"]) == (3, 1.0, 0.3333)
    report = alignment_report(preds, gold, ["a", "b"])
    assert {x["tag"]: x["n_unmatched"] for x in report.collect()} == {"a": 2, "b": 2}
    with pytest.raises(ValueError, match="a: 2, b: 2"):
        require_aligned(report)
    require_aligned(alignment_report(preds.where("tag = 'a' and id < 2"), gold.where("id < 2"), ["a"]))


def test_reports_of_runs_are_kept(spark, tmp_path):
    from ledgerlake.sources.io import write_jsonl
    runs = spark.createDataFrame([("a", "m1", True)], "tag string, model string, include_schema boolean")
    for tag in ("a", "b"):
        scored = score_report(score_records(answers(spark, [(tag, 0, json.dumps(GOLD))]), targets(spark, 1), [tag]))
        write_jsonl(run_report(scored, runs), str(tmp_path / "reports"), ["tag"])
    back = {r["tag"]: r for r in spark.read.json(str(tmp_path / "reports")).collect()}
    assert set(back) == {"a", "b"} and back["a"]["model"] == "m1" and back["b"]["model"] is None


def test_value_types_are_told_without_printing(spark):
    df = spark.sql("""SELECT parse_json('{"vendor": "1", "total": 12.50, "tax": true, "subtotal": null, "currency": {"a": 1}, "invoice_date": 20240117, "line_items": [{"quantity": 1e3}, 5]}') AS record""")
    out = extract_record(df)
    assert out._jdf.queryExecution().analyzed().toString().count("to_json(") <= 11  # one a field
    r = out.first()
    assert [(r[f"f_{f}"]["t"], r[f"f_{f}"]["s"], r[f"f_{f}"]["d"]) for f in ("vendor", "total", "tax", "subtotal", "currency", "invoice_date", "invoice_number")] == [
        ("STRING", "1", None), ("NUMBER", None, 12.5), ("BOOLEAN", None, 1.0), ("VOID", None, None), ("OBJECT", None, None), ("NUMBER", None, 20240117.0), (None, None, None)]
    assert r["f_currency"]["j"] == '{"a":1}' and r["f_tax"]["j"] == "true"
    assert [(i["idx"], i["quantity"]["d"], i["amount"]["t"]) for i in r["items"]] == [(0, 1000.0, None), (1, None, None)]


def test_entries_meet_once_and_types_are_compared_plainly(spark):
    scored = score_records(answers(spark, [("t", 0, json.dumps(GOLD))]), targets(spark, 1), ["t"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1
    assert " IN (" not in plan  # lists of types, searched for every value
    assert [r["tp"] for r in scored.collect()] == [15]


def test_invoices_of_stored_runs_are_assembled_once(spark, monkeypatch, tmp_path):
    from ledgerlake.plans import q_evaluate as Q

    asked, made_from, (gold_of, answers_of) = [], [], (Q.gold_invoices, Q.predictions)
    monkeypatch.setattr(Q, "_STORED", {})
    monkeypatch.setattr(Q, "gold_invoices", lambda *a: asked.append(a) or gold_of(*a))
    monkeypatch.setattr(Q, "predictions", lambda gold: made_from.extend(gold.inputFiles()) or answers_of(gold))
    sf = "/root/testdata/sf0.001"
    preds, gold = Q.stored_runs(spark, sf)
    assert len(asked) == 1 and made_from and not any("lineitem" in f for f in made_from)
    want = answers_of(gold_of(spark, sf))
    assert preds.count() == want.count() == 2 * gold.count() and not preds.exceptAll(want).count()
