"""Synthetic invoice corpus: generation, rendering to text, OCR noise.

Random draws are a hash of (seed, id, slot), so every value is a pure
function of its row: stable under repartitioning, recomputation after an
executor loss, and reproducible in SQL. Generation and rendering are one
narrow projection over the id table -- no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.money import MONEY, amount_format, money
from ledgerlake.operators.invoice import CURRENCIES, TAX_RATES

# Vendor names, products with price ranges, number prefixes.
VENDOR_STEMS = ["Acme", "Northwind", "Contoso", "Fabrikam", "Globex", "Initech", "Umbra", "Cascade",
                "Ironwood", "Blue Harbor", "Sterling", "Meridian", "Pinnacle", "Redwood", "Copperline",
                "Vantage", "Halcyon", "Brightpath", "Kestrel"]
VENDOR_SUFFIXES = ["Supply Co.", "Industries", "Logistics LLC", "Partners", "Group", "Manufacturing",
                   "Systems Inc.", "Trading Co.", "Holdings", "& Sons"]
PRODUCTS = [("Widget A", 8.0, 45.0), ("Widget B", 10.0, 60.0), ("Steel Bracket", 3.5, 22.0),
            ("Hex Bolt (100pk)", 12.0, 30.0), ("Copper Tubing 3m", 25.0, 90.0),
            ("Industrial Adhesive", 15.0, 55.0), ("Safety Goggles", 9.0, 28.0),
            ("Nitrile Gloves (box)", 14.0, 40.0), ("Cable Harness", 30.0, 120.0),
            ("Pressure Valve", 55.0, 210.0), ("Bearing Assembly", 40.0, 175.0),
            ("Consulting Hours", 85.0, 250.0), ("Freight Surcharge", 20.0, 95.0),
            ("Packaging Materials", 6.0, 35.0), ("Calibration Service", 120.0, 400.0)]
NUMBER_PREFIXES = ["INV", "INV", "IN", "BILL", "SI"]
FIRST_DAY = "2023-01-01"
DAY_SPAN = 1096
MAX_ITEMS = 6
MAX_QTY = 40
MAX_SEQ = 99999
# Date layouts of the renderers (Spark datetime patterns).
DATE_PATTERNS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd MMMM yyyy", "MMMM d, yyyy", "dd-MMM-yyyy"]
STYLES = ["table", "email", "receipt", "prose"]
# OCR confusions that can fire (tokens holding a digit are skipped).
OCR_FROM, OCR_TO = "SO", "50"


def draw(seed, id_col: Column, slot) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(seed:id:slot)."""
    return hex_draw(draw_hex(seed, id_col, slot), 0)


def draw_hex(seed, id_col: Column, group) -> Column:
    """md5(seed:id:group): 128 bits, i.e. four independent 32-bit draws."""
    key = F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"),
                      group if isinstance(group, Column) else F.lit(str(group)))
    return F.md5(key)


def hex_draw(hexed: Column, j: int) -> Column:
    """Draw number ``j`` (0-3) of an md5 hex string, as uniform [0, 1)."""
    return F.conv(F.substring(hexed, 8 * j + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def pick(values: list, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


# Draw layout: group "head" -> stem, suffix, date, prefix; group "more" ->
# number, item count, tax rate, currency; groups "rank:0".."rank:3" -> one
# draw per product (product k uses group k // 4, draw k % 4); group
# "item:<k>" -> quantity, unit price; group "render" -> date layout, style,
# model-render style.
RANK_GROUPS = 4


def generate_invoices(ids: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """One arithmetically consistent invoice per input id.

    1-6 distinct products (sampled without replacement by sorting per-product
    draws), quantity 1-40, unit price uniform in the product's range, cents
    rounding; subtotal, tax at one of ten rates, total. Each md5 is computed
    once per row and yields four draws.
    """
    i = F.col(id_col)
    hashed = ids.select(i.alias("id"), draw_hex(seed, i, "head").alias("h_head"),
                        draw_hex(seed, i, "more").alias("h_more"),
                        *[draw_hex(seed, i, f"rank:{g}").alias(f"h_rank{g}") for g in range(RANK_GROUPS)])
    ranked = F.array_sort(F.array(*[
        F.struct(hex_draw(F.col(f"h_rank{k // 4}"), k % 4).alias("r"),
                 F.struct(F.lit(k).alias("k"), F.lit(n).alias("description"),
                          F.lit(lo).alias("low"), F.lit(hi).alias("high")).alias("p"))
        for k, (n, lo, hi) in enumerate(PRODUCTS)]))
    n_items = (F.floor(hex_draw(F.col("h_more"), 1) * MAX_ITEMS) + 1).cast("int")
    idc = F.col("id")

    def with_hash(x):
        return F.struct(x["p"].alias("p"),
                        draw_hex(seed, idc, F.concat(F.lit("item:"), x["p"]["k"].cast("string"))).alias("h"))

    def item(x):
        p = x["p"]
        qty = (F.floor(hex_draw(x["h"], 0) * MAX_QTY) + 1).cast(MONEY)
        price = money(p["low"] + (p["high"] - p["low"]) * hex_draw(x["h"], 1))
        return F.struct(p["description"].alias("description"), qty.alias("quantity"),
                        price.alias("unit_price"), money(qty * price).alias("amount"))

    head, more = F.col("h_head"), F.col("h_more")
    issued = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.floor(hex_draw(head, 2) * DAY_SPAN).cast("int"))
    out = hashed.select(
        "id",
        F.concat(pick(VENDOR_STEMS, hex_draw(head, 0)), F.lit(" "),
                 pick(VENDOR_SUFFIXES, hex_draw(head, 1))).alias("vendor"),
        issued.alias("invoice_date"),
        pick(NUMBER_PREFIXES, hex_draw(head, 3)).alias("prefix"),
        (F.floor(hex_draw(more, 0) * MAX_SEQ) + 1).cast("int").alias("seq"),
        F.transform(F.transform(F.slice(ranked, 1, n_items), with_hash), item).alias("line_items"),
        pick([str(r) for r in TAX_RATES], hex_draw(more, 2)).cast("decimal(6,4)").alias("rate"),
        pick(CURRENCIES, hex_draw(more, 3)).alias("currency"))
    out = out.withColumn("invoice_number", F.format_string("%s-%d-%05d", "prefix", F.year("invoice_date"), "seq"))
    out = out.withColumn("subtotal", money(F.aggregate(
        "line_items", F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + x["amount"]).cast("decimal(28,2)"))))
    out = out.withColumn("tax", money(F.col("subtotal") * F.col("rate")))
    out = out.withColumn("total", money(F.col("subtotal") + F.col("tax")))
    return out.select("id", "vendor", "invoice_number", "invoice_date", "line_items",
                      "subtotal", "tax", "total", "currency")


def date_variant(date: Column, u: Column) -> Column:
    """One of five date layouts chosen by ``u``."""
    k = F.floor(u * len(DATE_PATTERNS)).cast("int")
    out = F.lit(None).cast("string")
    for n, pat in enumerate(DATE_PATTERNS):
        out = F.when(k == n, F.date_format(date, pat)).otherwise(out)
    return out


def _fmt(amount, currency="currency") -> Column:
    return amount_format(amount, F.col(currency) if isinstance(currency, str) else currency)


def _qty(x: Column) -> Column:
    return x.cast("int").cast("string")


# Renderer layouts (column headers, rules, labels, sentences).
TABLE_HEADER = "DESCRIPTION                QTY    UNIT PRICE      AMOUNT"
TABLE_RULE = "-" * 58


def render_table(date_text: Column) -> Column:
    items = F.transform("line_items", lambda x: F.format_string(
        "%-26s%5s%14s%14s", x["description"], _qty(x["quantity"]),
        _fmt(x["unit_price"]), _fmt(x["amount"])))
    head = F.array(F.col("vendor"), F.concat(F.lit("INVOICE "), F.col("invoice_number")),
                   F.concat(F.lit("Date: "), date_text), F.lit(""), F.lit(TABLE_HEADER), F.lit(TABLE_RULE))
    tail = F.array(F.lit(TABLE_RULE),
                   F.format_string("%45s%13s", F.lit("Subtotal"), _fmt("subtotal")),
                   F.format_string("%45s%13s", F.lit("Tax"), _fmt("tax")),
                   F.format_string("%45s%13s", F.lit("TOTAL DUE"), _fmt("total")),
                   F.lit(""), F.concat(F.lit("All amounts in "), F.col("currency"), F.lit(".")))
    return F.array_join(F.concat(head, items, tail), "\n")


def render_email(date_text: Column) -> Column:
    items = F.array_join(F.transform("line_items", lambda x: F.concat(
        _qty(x["quantity"]), F.lit("x "), x["description"], F.lit(" at "), _fmt(x["unit_price"]),
        F.lit(" ("), _fmt(x["amount"]), F.lit(")"))), "; ")
    return F.concat(
        F.lit("Subject: Invoice "), F.col("invoice_number"), F.lit(" from "), F.col("vendor"),
        F.lit("\n\nHi there,\n\nPlease find our invoice dated "), date_text,
        F.lit(" attached. We billed the following: "), items,
        F.lit(".\n\nThat comes to "), _fmt("subtotal"), F.lit(" before tax, with "), _fmt("tax"),
        F.lit(" tax applied, for a total of "), _fmt("total"), F.lit(" "), F.col("currency"),
        F.lit(" due on receipt.\n\nThanks,\nAccounts Receivable\n"), F.col("vendor"))


def render_receipt(date_text: Column) -> Column:
    items = F.flatten(F.transform("line_items", lambda x: F.array(
        x["description"], F.concat(F.lit("  "), _qty(x["quantity"]), F.lit(" @ "), _fmt(x["unit_price"]),
                                   F.lit(" = "), _fmt(x["amount"])))))
    head = F.array(F.concat(F.lit("*** "), F.upper("vendor"), F.lit(" ***")),
                   F.concat(F.lit("Ref "), F.col("invoice_number"), F.lit("  "), date_text), F.lit(""))
    tail = F.array(F.lit(""), F.concat(F.lit("SUB "), _fmt("subtotal")), F.concat(F.lit("TAX "), _fmt("tax")),
                   F.concat(F.lit("TOT "), _fmt("total"), F.lit(" ("), F.col("currency"), F.lit(")")),
                   F.lit("THANK YOU FOR YOUR BUSINESS"))
    return F.array_join(F.concat(head, items, tail), "\n")


def render_prose(date_text: Column) -> Column:
    items = F.array_join(F.transform("line_items", lambda x: F.concat(
        x["description"], F.lit(" (qty "), _qty(x["quantity"]), F.lit(", "), _fmt(x["amount"]), F.lit(")"))), ", ")
    return F.concat(
        F.lit("Record of charges from "), F.col("vendor"), F.lit(", reference "), F.col("invoice_number"),
        F.lit(", issued "), date_text, F.lit(". The order covered "), items,
        F.lit(". Net of tax the balance was "), _fmt("subtotal"), F.lit("; tax added "), _fmt("tax"),
        F.lit(", bringing the amount payable to "), _fmt("total"), F.lit(" in "), F.col("currency"), F.lit("."))


RENDERERS = {"table": render_table, "email": render_email, "receipt": render_receipt, "prose": render_prose}


def ocr_noise(text: Column, seed, id_col: Column, rate: float) -> Column:
    """Per-character confusions at ``rate`` on space-separated tokens that
    hold no digit (only S and O can then change). Rate 1.0 is a plain
    translate of every digit-free token."""
    tokens = F.split(text, " ", -1)

    def token(tok, ti):
        if rate >= 1.0:
            changed = F.translate(tok, OCR_FROM, OCR_TO)
        else:
            changed = F.array_join(F.transform(F.split(tok, "", -1), lambda c, ci: F.when(
                c.isin(*OCR_FROM) & (
                    draw(seed, id_col, F.concat(F.lit("ocr:"), ti.cast("string"), F.lit(":"), ci.cast("string")))
                    < F.lit(rate)), F.translate(c, OCR_FROM, OCR_TO)).otherwise(c)), "")
        return F.when(tok.rlike("[0-9]"), tok).otherwise(changed)

    return F.array_join(F.transform(tokens, token), " ")


def render_mixed(invoices: DataFrame, seed: int = 0, noise: float = 0.0) -> DataFrame:
    """Each invoice in one style picked by a draw; optional OCR noise.

    Adds ``style`` and ``text``.
    """
    i = F.col("id")
    h = invoices.withColumn("_h_render", draw_hex(seed, i, "render"))
    date_text = date_variant(F.col("invoice_date"), hex_draw(F.col("_h_render"), 0))
    u_style = hex_draw(F.col("_h_render"), 1)
    k = F.floor(u_style * len(STYLES)).cast("int")
    text = F.lit(None).cast("string")
    for n, name in enumerate(STYLES):
        text = F.when(k == n, RENDERERS[name](date_text)).otherwise(text)
    out = h.withColumn("style", pick(STYLES, u_style)).withColumn("text", text).drop("_h_render")
    if noise:
        out = out.withColumn("text", ocr_noise(F.col("text"), seed, i, noise))
    return out


# The rewrite prompt and the five target styles.
RENDER_PROMPT = (
    "You are producing training data for a document-extraction model.\n\n"
    "Rewrite the invoice below as a realistic {style}. Vary the wording, ordering and "
    "layout naturally — real documents are messy.\n\n"
    "Hard requirements:\n"
    "- Every value below must appear in your output, exactly once, unaltered.\n"
    "- Do not invent, drop, round or recompute any figure.\n"
    "- Output only the document text. No preamble, no commentary, no code fences.\n\n"
    "Invoice data:\n{payload}")
LLM_STYLES = ["scanned invoice with a plain-text line-item table",
              "email from accounts receivable to a customer",
              "terse point-of-sale receipt printout",
              "paragraph of prose summarizing the charges in a records system",
              "fax cover sheet followed by billing details"]
MAX_RENDER_ATTEMPTS = 4


def indented_json(inv: Column) -> Column:
    """Invoice struct as two-space indented JSON in declaration order."""
    from ledgerlake.functions.jsontext import json_quote
    from ledgerlake.functions.money import plain_number

    def item(x):
        return F.concat(
            F.lit('    {\n      "description": '), json_quote(x["description"]),
            F.lit(',\n      "quantity": '), plain_number(x["quantity"]),
            F.lit(',\n      "unit_price": '), plain_number(x["unit_price"]),
            F.lit(',\n      "amount": '), plain_number(x["amount"]), F.lit("\n    }"))

    items = inv["line_items"]
    items_text = F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n"), F.array_join(F.transform(items, item), ",\n"), F.lit("\n  ]")))
    return F.concat(
        F.lit('{\n  "vendor": '), json_quote(inv["vendor"]),
        F.lit(',\n  "invoice_number": '), json_quote(inv["invoice_number"]),
        F.lit(',\n  "invoice_date": '), json_quote(F.date_format(inv["invoice_date"], "yyyy-MM-dd")),
        F.lit(',\n  "line_items": '), items_text,
        F.lit(',\n  "subtotal": '), plain_number(inv["subtotal"]),
        F.lit(',\n  "tax": '), plain_number(inv["tax"]),
        F.lit(',\n  "total": '), plain_number(inv["total"]),
        F.lit(',\n  "currency": '), json_quote(inv["currency"]), F.lit("\n}"))


def render_prompt(invoice: Column, style: Column) -> Column:
    head, rest = RENDER_PROMPT.split("{style}")
    mid, tail = rest.split("{payload}")
    return F.concat(F.lit(head), style, F.lit(mid), indented_json(invoice), F.lit(tail))


def model_render(prompts: DataFrame, render_factory, prompt_col: str = "prompt",
                 max_attempts: int = MAX_RENDER_ATTEMPTS, backoff_seconds: float = 0.0) -> DataFrame:
    """Model-rendered text per prompt through a user-supplied renderer.

    ``render_factory()`` runs once per task and returns ``prompt -> text``.
    Up to ``max_attempts`` tries with exponential backoff; an empty answer or
    a final failure drops the record (``rendered`` is NULL and ``error`` set),
    so callers filter and sort by id afterwards.
    """
    import time as _time
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType(prompts.schema.fields + [T.StructField("rendered", T.StringType()),
                                                   T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = render_factory()
        for pdf in batches:
            texts, errors = [], []
            for prompt in pdf[prompt_col].tolist():
                text, err = None, None
                for attempt in range(max_attempts):
                    try:
                        text = (render(prompt) or "").strip() or None
                        err = None if text else "empty"
                        if text:
                            break
                    except Exception as exc:  # noqa: BLE001 - renderer failures are data
                        err = f"{type(exc).__name__}: {exc}"
                    if attempt + 1 < max_attempts and backoff_seconds:
                        _time.sleep(backoff_seconds * 2 ** attempt)
                texts.append(text)
                errors.append(err)
            yield pdf.assign(rendered=texts, error=errors)

    return prompts.mapInPandas(run, schema)
