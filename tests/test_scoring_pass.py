"""Records are read once, plain texts are quoted without a writer."""

from pyspark.sql import functions as F

from ledgerlake.functions.jsontext import json_quote
from ledgerlake.operators import evaluate


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_record_is_read_once_in_brackets(spark):
    half = '{"vendor":"\\ud800"}'
    rows = ['{"vendor":"v"}', '{"vendor":"v"} and more', '{"vendor":"v"},{"vendor":"w"}', '{"total":NaN}', '{"vendor":"v","vendor":"w"}', "{", "{}", half, None, "no", '{"line_items":[1,{"amount":2}]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, prediction string")
    got = {r.id: (r.parsed_ok, r.j) for r in evaluate.parse_predictions(df).select("id", "parsed_ok", F.to_json("record").alias("j")).collect()}
    assert [got[i][0] for i in range(11)] == [True, False, False, True, True, False, True, got[7][0], False, False, True]
    assert got[0][1] == '{"vendor":"v"}' and got[4][1] == '{"vendor":"w"}' and got[3][1] == '{"total":"NaN"}' and got[6][1] == "{}" and got[1][1] is None
    assert _plan(evaluate.parse_predictions(df)).count("_whole") > 0


def test_quotes_are_written_as_before(spark):
    texts = ["", "plain [x] ~", 'a"b', "a\\b", "é", "a\nb", "\x7f", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    want = [r[0] for r in df.select(F.expr("substring(to_json(array(t)), 2, length(to_json(array(t))) - 2)")).collect()]
    assert [r[0] for r in df.select(json_quote("t")).collect()] == want
