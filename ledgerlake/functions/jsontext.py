"""JSON text helpers: string quoting, fence stripping, object salvage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import WHITESPACE_CLASS as _W
from ledgerlake.functions.text import WHITESPACE_CHARS, once

# Texts that stand in JSON as they are.
PLAIN = r'^[ !#-\[\]-~]*\z'
FENCES = rf"^```(?:json)?{_W}*|{_W}*```$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_quote(c) -> Column:
    """A string value as a JSON string literal (``null`` for NULL). Only what needs escapes goes through the writer."""
    text = _col(c)
    written = once(F.to_json(F.array(text)), lambda wrapped: F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))
    return F.when(text.rlike(PLAIN), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(written)


def strip_edges(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE_CHARS))


def strip_fences(c) -> Column:
    """Trimmed text; when it opens with three backticks, drop the opening
    fence (optionally tagged json) and the closing fence."""
    text = strip_edges(c)
    return F.when(text.startswith("```"), F.regexp_replace(text, FENCES, "")).otherwise(text)


def salvage_object(c) -> Column:
    """Text starting with '{' is kept whole; otherwise cut from the first '{'
    to the last '}'. NULL when there is no such span."""
    text = _col(c)
    start = F.instr(text, "{")
    last = F.instr(F.reverse(text), "}")
    end = F.when(last > 0, F.length(text) - last + 1).otherwise(F.lit(0))
    cut = F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.when(text.startswith("{"), text).otherwise(cut)
