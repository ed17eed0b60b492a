"""Chat-set construction: messages, completions, templated training text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.invoice import INVOICE, build_completion

# The prompt contract shared by training, evaluation, serving.
SYSTEM = ("You extract structured invoice data from unstructured documents. "
          "You reply with a single JSON object and nothing else.")
WITH_SCHEMA = ("Extract the invoice below into JSON matching this schema:\n\n{schema}\n\n"
               "Return only the JSON object. No explanation, no code fences.\n\nDocument:\n{document}")
WITHOUT_SCHEMA = "Extract the invoice below into JSON.\n\nDocument:\n{document}"
# Marks where the assistant turn begins (Llama-3 style header).
RESPONSE_MARKER = "<|start_header_id|>assistant<|end_header_id|>"


class ChatTemplate:
    """Chat template as parameters: an opening, then per message ``head``,
    role, ``role_end``, content and ``message_end``, then a closing."""

    def __init__(self, head: str, role_end: str, message_end: str, opening: str = "", closing: str = ""):
        self.head, self.role_end, self.message_end = head, role_end, message_end
        self.opening, self.closing = opening, closing

    def render(self, messages: Column) -> Column:
        parts = F.transform(messages, lambda m: F.concat(
            F.lit(self.head), m["role"], F.lit(self.role_end), m["content"], F.lit(self.message_end)))
        return F.concat(F.lit(self.opening), F.array_join(parts, ""), F.lit(self.closing))


# The Llama 3 chat format.
LLAMA3 = ChatTemplate("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", opening="<|begin_of_text|>")

_TITLES = {"vendor": "Vendor", "invoice_number": "Invoice Number", "invoice_date": "Invoice Date",
           "line_items": "Line Items", "subtotal": "Subtotal", "tax": "Tax", "total": "Total",
           "currency": "Currency", "description": "Description", "quantity": "Quantity",
           "unit_price": "Unit Price", "amount": "Amount"}


def schema_dict() -> dict:
    """JSON Schema of the invoice model, built from the declared StructType
    plus its constraints, in declaration order."""
    def prop(name, dtype, extra=None):
        out = dict(extra or {})
        out["title"] = _TITLES[name]
        out["type"] = dtype
        return dict(sorted(out.items()))

    item = {"properties": {
        "description": prop("description", "string"),
        "quantity": prop("quantity", "number", {"exclusiveMinimum": 0}),
        "unit_price": prop("unit_price", "number", {"minimum": 0}),
        "amount": prop("amount", "number", {"minimum": 0})},
        "required": ["description", "quantity", "unit_price", "amount"], "title": "LineItem", "type": "object"}
    props = {}
    for f in INVOICE.fields:
        if f.name == "line_items":
            props[f.name] = {"items": {"$ref": "#/$defs/LineItem"}, "title": "Line Items", "type": "array"}
        elif f.name == "invoice_date":
            props[f.name] = prop(f.name, "string", {"format": "date"})
        elif f.name in ("subtotal", "tax", "total"):
            props[f.name] = prop(f.name, "number", {"minimum": 0})
        elif f.name == "currency":
            props[f.name] = prop(f.name, "string", {"default": "USD", "maxLength": 3, "minLength": 3})
        else:
            props[f.name] = prop(f.name, "string")
    required = [f.name for f in INVOICE.fields if f.name != "currency"]
    return {"$defs": {"LineItem": item}, "properties": props, "required": required,
            "title": "Invoice", "type": "object"}


SCHEMA_TEXT = json.dumps(schema_dict(), indent=2)


def user_content(document: Column, include_schema: bool = False) -> Column:
    if include_schema:
        head, tail = WITH_SCHEMA.split("{document}")
        head = head.replace("{schema}", SCHEMA_TEXT)
    else:
        head, tail = WITHOUT_SCHEMA.split("{document}")
    return F.concat(F.lit(head), document, F.lit(tail))


def build_messages(document: Column, include_schema: bool = False) -> Column:
    """System + user message around the document: ARRAY<STRUCT<role, content>>."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")),
                   F.struct(F.lit("user").alias("role"), user_content(document, include_schema).alias("content")))


def to_conversation(document: Column, invoice: Column, include_schema: bool = False) -> Column:
    """Messages plus the gold assistant turn."""
    return F.concat(build_messages(document, include_schema), F.array(
        F.struct(F.lit("assistant").alias("role"), build_completion(invoice).alias("content"))))


def format_records(records: DataFrame, template: ChatTemplate, include_schema: bool = False) -> DataFrame:
    """Records (``text`` + ``invoice``) -> one templated training string each.
    A pure projection: three messages per record, no grouping."""
    return records.withColumn("formatted", template.render(
        to_conversation(F.col("text"), F.col("invoice"), include_schema)))


def completion_span(formatted: Column, marker: str = RESPONSE_MARKER) -> list[Column]:
    """Where the scored part begins: 1-based offset of the marker (0 when
    absent), the completion after it, and the unscored share of the text."""
    pos = F.instr(formatted, marker)
    start = F.when(pos > 0, pos + len(marker))
    return [pos.alias("marker_pos"),
            F.when(pos > 0, F.expr(f"substr(formatted, instr(formatted, '{marker}') + {len(marker)})"))
            .alias("completion"),
            F.round(F.when(pos > 0, (start - 1) / F.length(formatted)).otherwise(F.lit(1.0)), 6)
            .alias("unscored_share")]
