import re

from pyspark.sql import functions as F

from ledgerlake.llm import pii

TEXTS = {
    1: "Mail Bob.Smith@mail.example.com or BOB.SMITH@MAIL.EXAMPLE.COM, call +1 (187) 555-8851 or +1 187 555 8851.",
    2: 'token = "b99e99e99fd999c9cf9999b99d9a9999b999d9ce" card 4111111111111111 and 4111 1111 1111 1111, ip 64.147.79.24',
    3: "Mr. John Smith and MR JOHN SMITH met Frau Müller; г-н Иванов wrote to bob.smith@mail.example.com, ssn 123-45-6789",
    4: "Clean text 3.14, 2024-01-02, version 1.2.3 and 12345; Über alles.",
    5: "", 6: None, 7: "+1 (187) 555-8851" * 1 + " x" * 60_000,
}


def run(spark, rows, key="k"):
    docs = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, surface string")
    return [(r.doc_id, r.text, r.n_entities) for r in pii.pseudonymise(docs, key).collect()]


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_formats_and_coreference(spark):
    out = {d: t for d, t, _ in run(spark, TEXTS.items())}
    mails = re.findall(r"\S+@[\w.]+\w", out[1] + " " + out[3])
    assert len({m.lower() for m in mails}) == 1 and mails[1] == mails[0].upper() and mails[0] not in TEXTS[1] and mails[0].endswith(".com")
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}", out[1])
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "555-8851" not in out[1] + out[7]
    assert re.sub(r"\D", "", out[7].split(" x")[0]) == re.sub(r"\D", "", phones[0])
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", out[2])
    assert len(cards) == 2 and len({c.replace(" ", "") for c in cards}) == 1 and luhn_ok(cards[0]) and cards[0] != "4111111111111111"
    assert re.search(r'token = "[0-9a-f]{40}"', out[2]) and "b99e99" not in out[2]
    assert all(0 < int(x) < 256 for x in re.search(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+)", out[2]).groups())
    title, first, last = re.match(r"(Mr\.) (\w+) (\w+) and", out[3]).groups()
    assert f"MR {first} {last}".upper() in out[3] and first.lower() in pii.FIRST["latin"]["m"] and "John" not in out[3]
    assert re.search(r"г-н [А-Я][а-я]+", out[3]) and "Иванов" not in out[3] and "Müller" not in out[3]
    assert out[4] == TEXTS[4] and out[5] == "" and out[6] is None


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "a 10.0.0.1 b"), (1, "a 10.0.0.1 b"), (1, "c 10.0.0.2"), (None, "a 10.0.0.1 b"), (None, None)]
    out = run(spark, rows)
    assert sorted(n for _, _, n in out) == [0, 1, 1, 1, 1]
    assert len({t for _, t, _ in out if t and t.startswith("a")}) == 1
    assert run(spark, []) == []
    assert run(spark, rows, "other") != out


def test_surrogates_stay_distinct(spark):
    # 3,000 single-word names cannot all differ in their first round
    entities = spark.range(3000).select(F.lit("name").alias("kind"), F.concat(F.lit("mr "), F.conv(F.col("id").cast("string"), 10, 36)).alias("value"))
    ssns = spark.range(500).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 9, "0").alias("value"))
    every = entities.unionByName(ssns)
    got = pii.assign(every, "k").collect()
    assert len(got) == 3500 and len({(r.kind, r.surrogate) for r in got}) == 3500
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.value) for r in got}
