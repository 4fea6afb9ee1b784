"""Text formats of the dashboard as Column expressions.

Rounding is decided once: numbers are taken as exact decimals and rounded half
away from zero (the reference rounds binary doubles half-to-even, which depends
on float representation; exact decimals make Spark and any SQL engine agree).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dec(x) -> Column:
    return _c(x).cast("decimal(38,6)")


def grouped_integer(x, sep: str = ",") -> Column:
    """Integer part with thousands groups (``1,234,567``)."""
    out = F.format_number(_c(x).cast("bigint"), 0)
    return out if sep == "," else F.translate(out, ",", sep)


# C9
def compact_number(x) -> Column:
    """1.2M / 3.4K / 567; NULL -> '0'."""
    v = _dec(x)
    millions = F.concat(F.round(v / F.lit(1000000), 1).cast("decimal(38,1)").cast("string"), F.lit("M"))
    thousands = F.concat(F.round(v / F.lit(1000), 1).cast("decimal(38,1)").cast("string"), F.lit("K"))
    units = F.format_number(F.round(v, 0).cast("bigint"), 0)
    return (
        F.when(v.isNull(), F.lit("0"))
        .when(v >= 1000000, millions)
        .when(v >= 1000, thousands)
        .otherwise(units)
    )


# C10
def dotted_thousands(x, positive_only: bool = False) -> Column:
    """Integer part (truncated) with '.' as group mark; NULL -> '0', or '-' when not > 0 with
    ``positive_only``."""
    c = _c(x)
    text = grouped_integer(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), ".")
    if positive_only:
        return F.when(c.isNotNull() & (c > 0), text).otherwise(F.lit("-"))
    return F.when(c.isNull(), F.lit("0")).otherwise(text)


# C11
def percent_text(x) -> Column:
    """Ratio as a percentage with two decimals (``12.34%``); NULL -> '0.00%'."""
    v = _c(x).cast("decimal(38,10)")
    return F.when(v.isNull(), F.lit("0.00%")).otherwise(
        F.concat(F.round(v * 100, 2).cast("decimal(38,2)").cast("string"), F.lit("%"))
    )


def minutes_text(x) -> Column:
    """Minutes with one decimal and a unit (``3.4 min``); NULL -> '0.0 min'."""
    v = F.coalesce(_c(x), F.lit(0)).cast("decimal(38,6)")
    return F.concat(F.round(v, 1).cast("decimal(38,1)").cast("string"), F.lit(" min"))


# C14
def date_label(d) -> Column:
    return F.date_format(_c(d), "dd/MM/yyyy")
