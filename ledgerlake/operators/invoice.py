"""The invoice data model: schema, validation rules and completion text.

One declared schema is the single source of truth (field order included);
everything else is a projection over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.jsontext import json_quote
from ledgerlake.functions.money import MONEY, plain_number

LINE_ITEM = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.DecimalType(18, 2)),
    T.StructField("unit_price", T.DecimalType(18, 2)),
    T.StructField("amount", T.DecimalType(18, 2)),
])

INVOICE = T.StructType([
    T.StructField("vendor", T.StringType()),
    T.StructField("invoice_number", T.StringType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("line_items", T.ArrayType(LINE_ITEM)),
    T.StructField("subtotal", T.DecimalType(18, 2)),
    T.StructField("tax", T.DecimalType(18, 2)),
    T.StructField("total", T.DecimalType(18, 2)),
    T.StructField("currency", T.StringType()),
])

SCALAR_FIELDS = ["vendor", "invoice_number", "invoice_date", "subtotal", "tax", "total", "currency"]
ITEM_FIELDS = ["description", "quantity", "unit_price", "amount"]
MONEY_FIELDS = ["subtotal", "tax", "total"]

# Tax rates and currency weights of the generator.
TAX_RATES = [0.0, 0.045, 0.0625, 0.07, 0.0825, 0.0875, 0.095, 0.13, 0.19, 0.20]
CURRENCIES = ["USD", "USD", "USD", "USD", "USD", "USD", "USD", "USD", "EUR", "GBP", "CAD"]
DEFAULT_CURRENCY = "USD"


def item_json(item: Column) -> Column:
    """One line item as compact JSON in declaration order."""
    return F.concat(
        F.lit('{"description":'), json_quote(item["description"]),
        F.lit(',"quantity":'), plain_number(item["quantity"]),
        F.lit(',"unit_price":'), plain_number(item["unit_price"]),
        F.lit(',"amount":'), plain_number(item["amount"]),
        F.lit("}"))


def completion_text(vendor, number, date, items_json, subtotal, tax, total, currency) -> Column:
    """Assemble compact invoice JSON from already-printed parts.

    ``items_json`` is an array of item JSON strings; money arguments are the
    printed numbers (or quoted strings) to splice in.
    """
    return F.concat(
        F.lit('{"vendor":'), json_quote(vendor),
        F.lit(',"invoice_number":'), json_quote(number),
        F.lit(',"invoice_date":'), json_quote(F.date_format(date, "yyyy-MM-dd")),
        F.lit(',"line_items":['), F.array_join(items_json, ","),
        F.lit('],"subtotal":'), subtotal,
        F.lit(',"tax":'), tax,
        F.lit(',"total":'), total,
        F.lit(',"currency":'), json_quote(currency),
        F.lit("}"))


def build_completion(inv: Column) -> Column:
    """Invoice struct -> the exact assistant answer: compact JSON, fields in
    declaration order, numbers printed like Python floats."""
    return completion_text(
        inv["vendor"], inv["invoice_number"], inv["invoice_date"],
        F.transform(inv["line_items"], item_json),
        plain_number(inv["subtotal"]), plain_number(inv["tax"]), plain_number(inv["total"]),
        inv["currency"])


def line_item_problems(item: Column) -> Column:
    """Failed rules of one line item struct (empty array when valid)."""
    return F.array_compact(F.array(
        F.when(item["description"].isNull(), F.lit("description_missing")),
        F.when(item["quantity"].isNull() | ~(item["quantity"] > 0), F.lit("quantity_not_positive")),
        F.when(item["unit_price"].isNull() | ~(item["unit_price"] >= 0), F.lit("unit_price_negative")),
        F.when(item["amount"].isNull() | ~(item["amount"] >= 0), F.lit("amount_negative")),
    ))


def line_item_valid(item: Column) -> Column:
    return F.size(line_item_problems(item)) == 0


def invoice_problems(inv: Column) -> Column:
    """Failed rules of a typed invoice struct (empty array when valid)."""
    items = inv["line_items"]
    rules = [
        F.when(inv["vendor"].isNull(), F.lit("vendor")),
        F.when(inv["invoice_number"].isNull(), F.lit("invoice_number")),
        F.when(inv["invoice_date"].isNull(), F.lit("invoice_date")),
        F.when(items.isNull() | ~F.forall(items, line_item_valid), F.lit("line_items")),
    ]
    rules += [F.when(inv[m].isNull() | ~(inv[m] >= 0), F.lit(m)) for m in MONEY_FIELDS]
    rules.append(F.when(inv["currency"].isNull() | (F.length(inv["currency"]) != 3), F.lit("currency")))
    return F.array_compact(F.array(*rules))


def arithmetic_problems(inv: Column, tolerance: float = 0.01) -> Column:
    """amount = qty x price per item, subtotal = sum of amounts,
    total = subtotal + tax, each within ``tolerance``."""
    items = inv["line_items"]
    tol = F.lit(tolerance).cast("decimal(18,4)")
    amount_sum = F.aggregate(items, F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + x["amount"]).cast("decimal(28,2)"))
    return F.array_compact(F.array(
        F.when(~F.forall(items, lambda x: F.abs(x["amount"] - x["quantity"] * x["unit_price"]) <= tol),
               F.lit("amount")),
        F.when(F.abs(inv["subtotal"] - amount_sum) > tol, F.lit("subtotal")),
        F.when(F.abs(inv["total"] - (inv["subtotal"] + inv["tax"])) > tol, F.lit("total")),
    ))


def as_invoice(df: DataFrame, prefix_cols: list[str]) -> DataFrame:
    """Pack flat invoice columns into one ``invoice`` struct column."""
    return df.select(*prefix_cols, F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INVOICE.fields])
                     .alias("invoice"))
