"""Derived inputs: pure functions of the supplied tables (FIXTURES.md 3).

Gold invoices come from the star schema; predictions are deterministic
variations of each gold completion, so Spark and the SQL oracle build them
alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.jsontext import json_quote
from ledgerlake.functions.money import MONEY, money, plain_number
from ledgerlake.operators.invoice import CURRENCIES, TAX_RATES, completion_text, item_json
from ledgerlake.sources.tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

# Fixed texts used to vary predictions.
FENCE_OPEN = "```json\n"
FENCE_CLOSE = "\n```"
PROSE_BEFORE = "Here is the extracted invoice:\n"
PROSE_AFTER = "\nLet me know if anything else is needed."
TRAILING = "\nHope this helps!"
NO_JSON = "I could not find an invoice in this document."


def gold_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order: columns ``id`` plus the invoice fields.

    Plan: lineitem join part (AQE turns it into a broadcast only when the
    part side is measured small), one aggregate by order key that builds the
    item list and the exact decimal subtotal, then orders left-join items and
    customer. Orders without lines get an empty item list.
    """
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = lineitem.join(part, lineitem.l_partkey == part.p_partkey, "left")
    unit_price = money(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))
    qty = F.col("l_quantity").cast(MONEY)
    lines = lines.select(
        "l_orderkey",
        F.struct(*[F.col(c) for c in LINE_ORDER],
                 F.struct(F.col("p_name").alias("description"), qty.alias("quantity"),
                          unit_price.alias("unit_price"),
                          money(qty * unit_price).alias("amount")).alias("item")).alias("line"))
    per_order = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("line")).alias("lines"),
        F.sum(F.col("line.item.amount")).alias("amount_sum"))
    per_order = per_order.select(
        "l_orderkey", F.transform("lines", lambda x: x["item"]).alias("line_items"), "amount_sum")

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rates = F.array(*[F.lit(r).cast("decimal(6,4)") for r in TAX_RATES])
    currencies = F.array(*[F.lit(c) for c in CURRENCIES])
    j = (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
         .join(customer, orders.o_custkey == customer.c_custkey, "left"))
    key = F.col("o_orderkey")
    subtotal = money(F.coalesce(F.col("amount_sum"), F.lit(0)))
    out = j.select(
        key.alias("id"),
        F.col("c_name").alias("vendor"),
        F.format_string("INV-%d-%06d", F.year("o_orderdate"), key).alias("invoice_number"),
        F.to_date("o_orderdate").alias("invoice_date"),
        F.coalesce(F.col("line_items"), F.array().cast("array<struct<description:string,"
                   "quantity:decimal(18,2),unit_price:decimal(18,2),amount:decimal(18,2)>>"))
        .alias("line_items"),
        subtotal.alias("subtotal"),
        F.element_at(rates, F.pmod(key, F.lit(10)).cast("int") + 1).alias("rate"),
        F.element_at(currencies, F.pmod(key, F.lit(11)).cast("int") + 1).alias("currency"),
    )
    out = out.withColumn("tax", money(F.col("subtotal") * F.col("rate")))
    out = out.withColumn("total", money(F.col("subtotal") + F.col("tax")))
    return out.select("id", "vendor", "invoice_number", "invoice_date", "line_items",
                      "subtotal", "tax", "total", "currency")


def _dollar_text(c):
    return F.concat(F.lit('"$'), F.format_number(c.cast(MONEY), 2), F.lit('"'))


def predictions(gold: DataFrame) -> DataFrame:
    """Two runs of raw model output per gold invoice: ``baseline`` varies every
    record by id mod 10; ``tuned`` varies only where id mod 20 < 10."""
    gold = gold.withColumn("items", F.transform("line_items", item_json))
    items, n = F.col("items"), F.size("line_items")
    num = {m: plain_number(F.col(m)) for m in ("subtotal", "tax", "total")}

    def comp(items_json=items, total=num["total"], money_text=None):
        if money_text:
            return completion_text("vendor", "invoice_number", "invoice_date", items_json,
                                   money_text("subtotal"), money_text("tax"), money_text("total"),
                                   "currency")
        return completion_text("vendor", "invoice_number", "invoice_date", items_json,
                               num["subtotal"], num["tax"], total, "currency")

    gold = gold.withColumn("plain", comp())
    c = F.col("plain")
    dropped = comp(items_json=F.filter(items, lambda x, i: i < n - 1))
    duplicated = comp(items_json=F.concat(items, F.slice(items, 1, 1)))
    wrong_total = comp(total=plain_number(F.col("total") + F.lit(1)))
    text_items = F.transform("line_items", lambda it: F.concat(
        F.lit('{"description":'), json_quote(it["description"]),
        F.lit(',"quantity":'), plain_number(it["quantity"]),
        F.lit(',"unit_price":'), _dollar_text(it["unit_price"]),
        F.lit(',"amount":'), _dollar_text(it["amount"]), F.lit("}")))
    as_text = comp(items_json=text_items, money_text=lambda m: _dollar_text(F.col(m)))
    k = F.pmod(F.col("id"), F.lit(10))
    varied = (F.when(k == 0, c)
              .when(k == 1, F.concat(F.lit(FENCE_OPEN), c, F.lit(FENCE_CLOSE)))
              .when(k == 2, F.concat(F.lit(PROSE_BEFORE), c, F.lit(PROSE_AFTER)))
              .when(k == 3, F.concat(c, F.lit(TRAILING)))
              .when(k == 4, F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int")))
              .when(k == 5, wrong_total)
              .when(k == 6, dropped)
              .when(k == 7, duplicated)
              .when(k == 8, as_text)
              .otherwise(F.lit(NO_JSON)))
    gold = gold.withColumn("varied", varied)
    tuned = F.when(F.pmod(F.col("id"), F.lit(20)) < 10, F.col("varied")).otherwise(c)
    runs = F.array(F.struct(F.lit("baseline").alias("tag"), F.col("varied").alias("prediction")),
                   F.struct(F.lit("tuned").alias("tag"), tuned.alias("prediction")))
    return gold.select("id", F.explode(runs).alias("r")).select("r.tag", "id", "r.prediction")
