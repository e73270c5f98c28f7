"""Display formats as column expressions (finishing step on small report frames).

All number formatting goes through ``format_number`` (Java ``DecimalFormat``,
half-even on the binary value, as Python's ``format`` does); ``printf`` is
half-up and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display strings of the report frames.
DASH = "—"
CURRENCY_PREFIX = "R$ "
CURRENCY_SUFFIX = " R$"
MONTH_LABEL_PATTERN = "MMM/yy"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_label(d: Column | str) -> Column:
    """``Jan/26`` style label (English month abbreviation, 2-digit year)."""
    return F.date_format(_col(d), MONTH_LABEL_PATTERN)


def grouped(v: Column | str, decimals: int) -> Column:
    """``1,234,567.89`` — comma thousands, point decimals."""
    return F.format_number(_col(v).cast("double"), decimals)


def brl(v: Column | str, decimals: int = 2) -> Column:
    """``1.234.567,89`` — point thousands, comma decimals (swap of ``grouped``)."""
    return F.translate(grouped(v, decimals), ",.", ".,")


def dotted_int(v: Column | str) -> Column:
    """Integer with point thousands: ``12.345``."""
    return F.translate(F.format_number(_col(v).cast("long"), 0), ",", ".")


def signed(v: Column | str, decimals: int, suffix: str = "") -> Column:
    """``+1,234.56`` / ``-7`` — explicit sign, comma thousands; NULL in, NULL out.

    The plus goes on exactly when the formatted number has no minus, as in
    Python's ``+`` format flag (so ``-0.0`` and ``-0.001`` give ``-0.00``).
    """
    text = grouped(v, decimals)
    sign = F.when(text.startswith("-"), F.lit("")).otherwise(F.lit("+"))
    return F.concat(sign, text, F.lit(suffix))


def plain_amount(v: Column | str) -> Column:
    """``R$ 1234.56``: two decimals, no grouping; NULL in, NULL out."""
    return F.concat(F.lit("R$ "), F.call_function("format_number", _col(v).cast("double"), F.lit("0.00")))


def percent_1(v: Column | str) -> Column:
    """``12.3%`` (one decimal, no grouping); NULL in, NULL out."""
    return F.concat(F.call_function("format_number", _col(v).cast("double"), F.lit("0.0")), F.lit("%"))


def truthy_or_dash(v: Column | str, text: Column) -> Column:
    """``text`` when ``v`` is non-NULL and non-zero, else a dash."""
    v = _col(v)
    return F.when(v.isNotNull() & (v != 0), text).otherwise(F.lit(DASH))
