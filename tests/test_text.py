import hashlib
import re

from pyspark.sql import functions as F

from ledgerlake.functions import text as T


def one(spark, col, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(col(F.col("t"))).collect()]


def digest(joined):
    return hashlib.sha256(joined.encode()).hexdigest()[:32]


def test_case_and_white_space_do_not_matter(spark):
    forms = ["Crate 7,\tDOCK four", "  crate\u00a07,\n dock  FOUR ", "CRATE 7, DOCK\x1cFOUR"]
    assert one(spark, T.normalize_text, *forms) == ["crate 7, dock four"] * 3
    assert len(set(one(spark, T.exact_key, *forms))) == 1
    assert one(spark, T.normalize_text, "Maß", "", " ") == ["mass", "", ""]


def test_other_content_gives_another_key(spark):
    keys = one(spark, T.exact_key, "crate 7", "crate 8", "crates 7", "crate7")
    assert len(set(keys)) == 4 and keys[0] == hashlib.sha256(b"crate 7").hexdigest()


def test_number_tokens_by_hand(spark):
    got = one(spark, T.numeric_tokens, "3 boxes at 2,050.750 = 6,152.25", "0012 and 4.00005 and .5", "none", "9 9 10")
    assert got == [["2050.75", "3", "6152.25"], ["12", "4.0001", "5"], [], ["10", "9", "9"]]


def test_fingerprint_sees_numbers_only(spark):
    got = one(spark, T.numeric_fingerprint, "dock 4, crate 31.50", "CRATE 31.5\n(dock 4)", "dock 4, crate 31.6", "no digits")
    assert got == [digest("31.5|4"), digest("31.5|4"), digest("31.6|4"), digest("")]


def test_every_code_point_folds_as_the_language_folds_it(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).casefold() != chr(c) or chr(c).lower() != chr(c))]
    text = " ".join(f"x{ch}y" for ch in chars)
    assert one(spark, T.casefold, text) == [text.casefold()]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    assert [(r.t, r.f) for r in df.select("t", T.casefold(F.col("t")).alias("f")).collect() if r.f != r.t.casefold()] == []


def test_folding_in_context(spark):
    words = ["ΟΔΥΣΣΕΥΣ", "ὈΔΥΣΣΕΎΣ.", "Straße STRASSE ẞ", "ﬁne ﬄuent", "İstanbul", "ſmall", "Ꭰꭰ", "ŉ", "plain", "", "日本"]
    assert one(spark, T.casefold, *words) == [w.casefold() for w in words] and one(spark, T.casefold, None) == [None]


def test_values_are_worked_out_once_inside_lambdas(spark):
    """Scoring tags run in lambdas, where no common expression is shared: every repeated part is repeated work."""
    from ledgerlake.functions.jsontext import json_quote
    from ledgerlake.functions.values import string_tag
    from ledgerlake.operators.evaluate import _entry

    df = spark.createDataFrame([("x",)], "x string")
    plan = df.select(_entry(F.lit("p"), string_tag("x")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 6 and plan.count("RLIKE") <= 7
    assert df.select(json_quote("x"))._jdf.queryExecution().analyzed().toString().count("to_json(") <= 2  # with its name


def test_tags_and_quotes_keep_their_results(spark):
    from ledgerlake.functions.jsontext import json_quote, strip_edges
    from ledgerlake.functions.money import plain_number
    from ledgerlake.functions.text import WHITESPACE_CHARS, WHITESPACE_CLASS
    from ledgerlake.functions.values import number_tag, string_tag

    texts = {"$1,240.50": "n:1240.50", ",$5": "n:5.00", "CA$ 7": "n:7.00", "$CA$8": "n:8.00", "C,A$9": "n:9.00", "€£3": "n:3.00", "$x, Y": "s:$x, y",
             " Acme,  Co": "s:acme, co", "NaN": "x:nan", "-inf": "n:-inf", "": "s:", "1_0": "n:10.00", "1e30": "n:" + "1" + "0" * 30 + ".00", "A$5": "s:a$5", "$": "s:$"}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "x string")
    assert {r[0]: r[1] for r in df.select("x", string_tag("x")).collect()} == {**texts, None: None}
    assert df.select(json_quote("x").alias("q")).where("q = 'null'").count() == 1
    space = [chr(c) for c in range(0x3001) if re.fullmatch(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WHITESPACE_CLASS), chr(c))]
    assert sorted(WHITESPACE_CHARS) == space
    edges = [(w + "a" + w + "b" + w, "a" + w + "b") for w in space] + [("".join(space), "")]
    got = spark.createDataFrame(edges, "x string, want string").select(strip_edges("x").alias("x"), "want")
    assert got.where("x <> want").count() == 0
    cents = spark.sql("SELECT explode(array(0.00, 0.10, -0.10, 100.00, 3.09, 10.50, NULL)) AS c")
    assert [r[0] for r in cents.select(plain_number("c")).collect()] == ["0.0", "0.1", "-0.1", "100.0", "3.09", "10.5", None]
    numbers = spark.createDataFrame([(1.005,), (1e40,), (float("inf"),), (None,)], "d double")
    assert [r[0] for r in numbers.select(number_tag("d")).collect()] == ["n:1.01", "n:1.0E40", "n:inf", None]
