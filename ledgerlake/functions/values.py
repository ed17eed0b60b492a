"""Field-value normalization for scoring, as a type-tagged string.

A flattened record holds values of three kinds (number, text, bool); one
string column holds the union as ``n:<cents>``, ``s:<folded text>`` or
``b:true|false`` so that ``1.0`` never equals ``"true"``. NaN becomes ``x:nan``
(never equal to any gold value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import WHITESPACE_CLASS, casefold, collapse_whitespace, once

_W = WHITESPACE_CLASS
# Python float() syntax for finite numbers (underscores between digits allowed).
PY_FLOAT = (rf"^{_W}*[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
            rf"(?:[eE][+-]?[0-9](?:_?[0-9])*)?{_W}*$")
PY_INF = rf"(?i)^{_W}*[+-]?(?:inf|infinity){_W}*$"
PY_NAN = rf"(?i)^{_W}*[+-]?nan{_W}*$"
# Texts that lose a currency mark (commas are dropped before).
MARKED = r"^,*(?:[$€£]|C,*A,*\$)"
# Texts of plain characters that start like no number and no mark: words, dates.
WORD = r"^(?=[!-~][ -~]*\z)(?:[ABD-HJ-MO-Za-hj-mo-z]|C[^A,]|[iI](?:[^nN,]|[nN][^fF,])|[nN][^aA,]|[0-9]+-)"
# Below this a number has 14 digits to the cent: a double tells them exactly.
SHORT = 1e12
NUMERIC_TYPE = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_float(c) -> Column:
    """Python ``float(text)`` as a DOUBLE, NULL where Python would raise."""
    s = _col(c)
    finite = F.regexp_replace(collapse_whitespace(s), "_", "").try_cast("double")
    sign = F.when(collapse_whitespace(s).startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (F.when(s.rlike(PY_FLOAT), finite)
            .when(s.rlike(PY_INF), sign * F.lit(float("inf")))
            .when(s.rlike(PY_NAN), F.lit(float("nan"))))


def number_tag(d) -> Column:
    def tag(d: Column) -> Column:
        cents = F.round(d, 2)
        return (F.when(d.between(-SHORT, SHORT), F.concat(F.lit("n:"), d.cast("decimal(18,2)").cast("string")))
                .when(d.isNull(), F.lit(None).cast("string"))
                .when(F.isnan(d), F.lit("x:nan"))
                .when(d == float("inf"), F.lit("n:inf"))
                .when(d == float("-inf"), F.lit("n:-inf"))
                .otherwise(F.concat(F.lit("n:"), F.coalesce(
                    cents.try_cast("decimal(38,2)").cast("string"), cents.cast("string")))))

    return once(_col(d).cast("double"), tag)


def decimal_tag(c) -> Column:
    """Tag of an exact cents value held as DECIMAL (no float round trip)."""
    return F.when(_col(c).isNotNull(), F.concat(F.lit("n:"), _col(c).cast("decimal(38,2)").cast("string")))


def string_tag(c) -> Column:
    """Normalize a text value: collapse spaces; without commas and leading
    currency marks (and a CA$ prefix) it may read as a number, else folded
    text (commas kept)."""
    def tag(text: Column) -> Column:
        plain = F.replace(text, F.lit(","), F.lit(""))
        stripped = F.when(text.rlike(MARKED), F.regexp_replace(F.regexp_replace(plain, r"^[$€£]+", ""), r"^CA\$", "")).otherwise(plain)
        number = once(stripped, lambda s: number_tag(py_float(s)))
        return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(
            F.coalesce(number, F.concat(F.lit("s:"), casefold(text))))

    s = _col(c)
    word = s.rlike(WORD) & ~s.contains("  ")  # nothing to collapse, and lower case is all of its folding
    return F.coalesce(F.when(word, F.concat(F.lit("s:"), F.lower(F.trim(s)))), once(collapse_whitespace(s), tag))
