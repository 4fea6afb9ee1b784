"""Reusable Column expressions (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.params import Settings


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """Neither NULL nor the empty string: how the reference spells "missing"."""
    c = col(c)
    return c.isNotNull() & (c != "")


def ratio(num, den) -> Column:
    """SAFE_DIVIDE: NULL when the divisor is 0 or NULL, a double otherwise."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def round_ratio(num, den, digits: int = 2) -> Column:
    """ROUND(num / den, digits) decided exactly on integers: half away from zero.

    ``num`` and ``den`` are non-negative integer sums, so the rounding is done on
    the true ratio, not on a binary double; NULL when ``den`` is 0 or NULL.
    """
    scale = 10 ** digits
    n, d = col(num).cast("bigint"), col(den).cast("bigint")
    q = F.call_function("div", n * (2 * scale) + d, d * 2)
    return F.when(d != 0, q.cast("double") / F.lit(float(scale)))


def is_agency(email, settings: Settings) -> Column:
    return F.lower(col(email)) == F.lit(settings.agency_editor.lower())


def display_name(email, name, settings: Settings, agency_label: bool = True) -> Column:
    """Agency label for the agency account, else the author name, else the email."""
    base = F.coalesce(col(name), col(email))
    if not agency_label:
        return base
    return F.when(is_agency(email, settings), F.lit(settings.agency_label)).otherwise(base)


def _contains(c: Column, pattern: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).contains(pattern.lower())


def tool_label(source, settings: Settings) -> Column:
    """Pass-through tool label: tool 2, tool 1, else the raw source or '-'."""
    s = col(source)
    return (
        F.when(_contains(s, settings.tool2_pattern), F.lit(settings.tool2_label))
        .when(_contains(s, settings.tool1_pattern), F.lit(settings.tool1_label))
        .otherwise(F.coalesce(s, F.lit(settings.missing_text)))
    )


def tool_class(email, source, settings: Settings) -> Column:
    """Closed tool class: agency, tool 2, tool 1, other."""
    s = col(source)
    return (
        F.when(is_agency(email, settings), F.lit(settings.agency_class))
        .when(_contains(s, settings.tool2_pattern), F.lit(settings.tool2_label))
        .when(_contains(s, settings.tool1_pattern), F.lit(settings.tool1_label))
        .otherwise(F.lit(settings.other_class))
    )


def authors_side(tables, settings: Settings, country: str | None = None) -> DataFrame:
    """Author lookup keyed by ``lower(email)``; filtered to one country when asked.

    No hint: Spark broadcasts it by its bytes, known from its files or measured by AQE, and shuffles
    both sides beyond the threshold. Building a plan starts no job.
    """
    a = tables.authors.select(
        F.lower(F.col("email")).alias("_author_key"),
        F.col("complete_name").alias("author_name"),
        F.col("country").alias("author_country"),
    )
    if country is not None:
        a = a.filter(F.upper(F.col("author_country")) == F.upper(F.lit(country)))
    return a


def join_authors(df: DataFrame, email_col: str, tables, settings: Settings, country: str | None = None,
                 always: bool = True) -> DataFrame:
    """``LEFT JOIN authors ON LOWER(email) = LOWER(a.email)`` plus the optional country test.

    With a country the WHERE on the right side makes it an inner join to the
    authors of that country (fan-out of duplicate emails kept). Without one the
    join is a left join, or skipped entirely when ``always`` is False.
    Adds ``author_name`` and ``author_country``.
    """
    if country is None and not always:
        return df
    a = authors_side(tables, settings, country)
    how = "inner" if country is not None else "left"
    return df.join(a, F.lower(F.col(email_col)) == F.col("_author_key"), how).drop("_author_key")


def scalar(df: DataFrame, column: str) -> Column:
    """The single value of a one-row frame as a scalar subquery (Spark merges subqueries
    over the same frame into one)."""
    return df.select(column).scalar()


def one_row(spark, columns: dict) -> DataFrame:
    """A one-row frame of named Column values, typically scalar subqueries: no join needed."""
    return spark.range(1).select([c.alias(name) for name, c in columns.items()])
