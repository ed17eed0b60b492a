"""Queries for corpus generation and rendering.

Invoices are generated one per order key (the ``orders`` table is the id
source, so the work grows with the data), seed 7.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.money import amount_format, money
from ledgerlake.operators import corpus as C
from ledgerlake.operators.invoice import as_invoice, build_completion
from ledgerlake.plans import sql_corpus as S
from ledgerlake.plans.derived import gold_invoices
from ledgerlake.plans.registry import register
from ledgerlake.plans.sql_invoice import GOLD_CTE
from ledgerlake.sources.tables import table

SEED = S.SEED
NOISE = 0.05


def generated(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return C.generate_invoices(ids, "id", SEED)


def rendered(spark, sf_dir, noise: float = 0.0):
    return C.render_mixed(generated(spark, sf_dir), SEED, noise)


@register("invoice_generate", S.WITH_GEN + """
SELECT id, vendor, invoice_number, strftime(invoice_date, '%Y-%m-%d') AS invoice_date,
       CAST(len(line_items) AS INT) AS n_items, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax,
       CAST(total AS DOUBLE) AS total, currency FROM gen""")
def q_invoice_generate(spark, sf_dir):
    g = generated(spark, sf_dir)
    return g.select("id", "vendor", "invoice_number", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"),
                    F.size("line_items").alias("n_items"), F.col("subtotal").cast("double").alias("subtotal"),
                    F.col("tax").cast("double").alias("tax"), F.col("total").cast("double").alias("total"), "currency")


@register("line_item_sample", S.WITH_GEN + """
SELECT id, CAST(pos - 1 AS INT) AS pos, description, CAST(quantity AS DOUBLE) AS quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST({amount} AS DOUBLE) AS amount FROM gen_lines""".replace(
    "{amount}", "round(CAST(quantity * unit_price AS DECIMAL(38,9)), 2)"))
def q_line_item_sample(spark, sf_dir):
    g = generated(spark, sf_dir)
    # Outer form: a plain posexplode lets the optimizer infer a size() filter
    # that would generate every invoice twice. Invoices always have items.
    e = g.select("id", F.posexplode_outer("line_items").alias("pos", "x")).filter(F.col("x").isNotNull())
    return e.select("id", "pos", "x.description", *[F.col(f"x.{c}").cast("double").alias(c)
                                                    for c in ("quantity", "unit_price", "amount")])


@register("money_round", """
SELECT l_orderkey, l_linenumber,
       CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,9)), 2) AS DOUBLE) AS net_price
FROM lineitem""")
def q_money_round(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("net_price"))


@register("invoice_totals", "WITH " + GOLD_CTE.strip() + """
SELECT id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax, CAST(total AS DOUBLE) AS total FROM gold""")
def q_invoice_totals(spark, sf_dir):
    g = gold_invoices(spark, sf_dir)
    return g.select("id", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")])


@register("invoice_assemble", "WITH " + GOLD_CTE.strip() + """
SELECT id, vendor, invoice_number, strftime(invoice_date, '%Y-%m-%d') AS invoice_date,
       CAST(len(line_items) AS INT) AS n_items, currency FROM gold""")
def q_invoice_assemble(spark, sf_dir):
    g = gold_invoices(spark, sf_dir)
    return g.select("id", "vendor", "invoice_number", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"),
                    F.size("line_items").alias("n_items"), "currency")


@register("amount_format", "WITH " + GOLD_CTE.strip() + f"""
SELECT id, {S.fmt('total')} AS total_text, {S.fmt('subtotal')} AS subtotal_text FROM gold""")
def q_amount_format(spark, sf_dir):
    g = gold_invoices(spark, sf_dir)
    return g.select("id", amount_format("total", F.col("currency")).alias("total_text"),
                    amount_format("subtotal", F.col("currency")).alias("subtotal_text"))


@register("date_variants", f"""
SELECT o_orderkey, {S.date_variant('o_orderdate', S.hexd('o_orderkey', "'render'", 0))} AS date_text FROM orders""")
def q_date_variants(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.date_variant(F.to_date("o_orderdate"),
                                                 C.hex_draw(C.draw_hex(SEED, F.col("o_orderkey"), "render"), 0)).alias("date_text"))


def _style_query(style):
    fn = {"table": S.render_table, "email": S.render_email, "receipt": S.render_receipt, "prose": S.render_prose}[style]

    def q(spark, sf_dir):
        g = generated(spark, sf_dir)
        dt = C.date_variant(F.col("invoice_date"), C.hex_draw(C.draw_hex(SEED, F.col("id"), "render"), 0))
        return g.select("id", C.RENDERERS[style](dt).alias("text"))
    register(f"render_{style}", S.WITH_GEN + f"SELECT id, {fn(S.DT)} AS text FROM gen")(q)


for _style in C.STYLES:
    _style_query(_style)


@register("render_mixed", S.WITH_RENDER + "SELECT id, style, text FROM rendered")
def q_render_mixed(spark, sf_dir):
    return rendered(spark, sf_dir).select("id", "style", "text")


@register("ocr_noise", S.WITH_RENDER + f"SELECT id, {S.ocr('text', NOISE)} AS text FROM rendered")
def q_ocr_noise(spark, sf_dir):
    return rendered(spark, sf_dir, NOISE).select("id", "text")


@register("record_build", S.WITH_RENDER + f"""
SELECT printf('inv-%06d', id) AS id, text, {S.GEN_COMPLETION} AS target, 'template' AS style FROM rendered""")
def q_record_build(spark, sf_dir):
    return records(spark, sf_dir).select("id", "text", "target", "style")


def records(spark, sf_dir):
    """Dataset records: id ``inv-%06d``, rendered text, target JSON, style,
    plus the invoice struct for downstream chat formatting."""
    r = rendered(spark, sf_dir)
    inv = as_invoice(r, ["id", "text"])
    return inv.select(F.format_string("inv-%06d", "id").alias("id"), F.col("id").alias("index"), "text",
                      build_completion(F.col("invoice")).alias("target"), F.lit("template").alias("style"),
                      "invoice")


def prompts(spark, sf_dir):
    g = generated(spark, sf_dir)
    inv = as_invoice(g, ["id"])
    style = C.pick(C.LLM_STYLES, C.hex_draw(C.draw_hex(SEED, F.col("id"), "render"), 2))
    return inv.select("id", style.alias("style"), C.render_prompt(F.col("invoice"), style).alias("prompt"))


@register("render_prompt", S.WITH_GEN + f"SELECT id, {S.render_prompt_sql()} AS prompt FROM gen")
def q_render_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).select("id", "prompt")


DROP_EVERY = 7


def _stub_renderer_factory():
    """Deterministic stand-in for a hosted model: rewrites the prompt's
    invoice block as plain lines; answers empty for every 7th invoice (those
    records are dropped) and fails transiently on every 5th call."""
    state = {"calls": 0}

    def render(prompt: str) -> str:
        import re
        state["calls"] += 1
        if state["calls"] % 5 == 0:
            raise ConnectionError("transient")
        payload = prompt.split("Invoice data:\n", 1)[1]
        number = re.search(r'"invoice_number": "[A-Z]+-\d+-(\d+)"', payload)
        if number and int(number.group(1)) % DROP_EVERY == 0:
            return ""
        return "\n".join(line.strip() for line in payload.splitlines() if ":" in line)
    return render


def model_rendered(spark, sf_dir):
    """Records rendered by the stub model: failures dropped, sorted by id."""
    out = C.model_render(prompts(spark, sf_dir), _stub_renderer_factory)
    return out.filter(F.col("rendered").isNotNull())


@register("llm_render")
def q_llm_render(spark, sf_dir):
    out = model_rendered(spark, sf_dir)
    return out.select(F.format_string("inv-%06d", "id").alias("id"), F.col("rendered").alias("text"),
                      "style").orderBy("id")


@register("dropped_count", S.WITH_GEN + f"""
SELECT CAST(count(*) AS BIGINT) AS requested,
       CAST(count(*) FILTER (WHERE seq % {DROP_EVERY} <> 0) AS BIGINT) AS written,
       CAST(count(*) FILTER (WHERE seq % {DROP_EVERY} = 0) AS BIGINT) AS dropped
FROM (SELECT id, CAST(split_part(invoice_number, '-', 3) AS INT) AS seq FROM gen)""")
def q_dropped_count(spark, sf_dir):
    requested = generated(spark, sf_dir).select("id")
    written = model_rendered(spark, sf_dir).select("id", F.lit(1).alias("w"))
    counts = requested.join(written, "id", "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count("w").alias("written"))
    return counts.select("requested", "written", (F.col("requested") - F.col("written")).alias("dropped"))
