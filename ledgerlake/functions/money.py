"""Money and number formatting scalars.

Money is computed in DECIMAL so sums and products are exact and rounding is
HALF_UP on the decimal value; the edge exposes DOUBLE or text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Currency symbols used when printing amounts (fixed values).
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "CAD": "CA$"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Round to cents, ties up (the reference adds 1e-9 before rounding to get
    the same effect on binary floats)."""
    return F.round(_col(c).cast("decimal(38,9)"), 2).cast(MONEY)


def plain_number(c) -> Column:
    """Print a cents value like a Python float: 37.5, 100.0, 3.09."""
    text = _col(c).cast(MONEY).cast("string")
    return F.when(text.endswith("0"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def currency_symbol(currency) -> Column:
    cur = _col(currency)
    expr = F.lit("")
    for code, sym in SYMBOLS.items():
        expr = F.when(cur == code, F.lit(sym)).otherwise(expr)
    return expr


def amount_format(amount, currency) -> Column:
    """Symbol (or nothing) + thousands separators + two decimals."""
    return F.concat(currency_symbol(currency), F.format_number(_col(amount).cast(MONEY), 2))
