import json

from pyspark.sql import functions as F

from ledgerlake.operators import corpus as C
from ledgerlake.operators.invoice import arithmetic_problems, as_invoice, invoice_problems


def ids(spark, n, parts=None):
    df = spark.range(n).withColumnRenamed("id", "id")
    return df.repartition(parts) if parts else df


def test_generated_invoices_are_consistent_and_valid(spark):
    inv = as_invoice(C.generate_invoices(ids(spark, 200), "id", seed=7), ["id"])
    bad = inv.filter(F.size(F.concat(invoice_problems(F.col("invoice")), arithmetic_problems(F.col("invoice")))) > 0)
    assert bad.count() == 0
    sizes = [r[0] for r in inv.select(F.size("invoice.line_items")).collect()]
    assert min(sizes) >= 1 and max(sizes) <= 6


def test_generation_is_reproducible_and_partition_independent(spark):
    a = C.generate_invoices(ids(spark, 50), "id", seed=3)
    b = C.generate_invoices(ids(spark, 50, 5), "id", seed=3)
    c = C.generate_invoices(ids(spark, 50), "id", seed=4)
    key = ["id", "vendor", "invoice_number", "total"]
    assert sorted(a.select(*key).collect()) == sorted(b.select(*key).collect())
    assert sorted(a.select(*key).collect()) != sorted(c.select(*key).collect())


def test_every_style_prints_the_sum(spark):
    r = C.render_mixed(C.generate_invoices(ids(spark, 50), "id", seed=0), seed=0)
    for row in r.select("total", "text", "style").collect():
        assert f"{float(row['total']):,.2f}" in row["text"]
    assert {row["style"] for row in r.select("style").collect()} <= set(C.STYLES)


def test_noise_spares_words_with_digits(spark):
    line = "Oslo boats, invoice B0S-118 to pay: 90,518.05 kroner"
    df = spark.createDataFrame([(1, line)], "id long, t string")
    for rate in (1.0, 0.5, 0.0):
        noisy = df.select(C.ocr_noise(F.col("t"), 1, F.col("id"), rate)).first()[0]
        assert "90,518.05" in noisy and len(noisy.split()) == len(line.split())
        assert (noisy == line) == (rate == 0.0) or rate == 0.5


def test_render_prompt_payload_is_json(spark):
    inv = as_invoice(C.generate_invoices(ids(spark, 5), "id", seed=1), ["id"])
    for row in inv.select(C.render_prompt(F.col("invoice"), F.lit("terse receipt")).alias("p")).collect():
        payload = json.loads(row["p"].split("Invoice data:\n", 1)[1])
        assert list(payload) == ["vendor", "invoice_number", "invoice_date", "line_items", "subtotal", "tax",
                                 "total", "currency"]
