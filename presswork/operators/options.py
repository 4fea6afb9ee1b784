"""Data date, default period and filter choices.

Scale: distinct editors, sections and countries of the period, each one grouping;
the lookup join sees one row per editor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import display_name, join_authors, present
from presswork.params import CREATE, FIRST_PUBLISH, Period, Settings

DEFAULT = Settings()


# B30
def last_data_date(tables) -> DataFrame:
    return tables.traffic_daily.agg(F.max("date").alias("last_date"))


# B31
def default_period(tables, days: int = 7) -> DataFrame:
    """The ``days`` days ending at the last data date (today when there is no data)."""
    end = F.coalesce(F.col("last_date"), F.current_date())
    return last_data_date(tables).select(F.date_sub(end, days - 1).alias("start_date"), end.alias("end_date"))


def _active_editors(tables, period: Period) -> DataFrame:
    return tables.editorial.filter(
        F.col("action_type").isin(CREATE, FIRST_PUBLISH) & period.covers("event_timestamp") & present("email_editor")
    )


# B32
def filter_authors(tables, period: Period, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct (email, display name, country) of creators and publishers of the period."""
    e = _active_editors(tables, period).select("email_editor").distinct()
    j = join_authors(e, "email_editor", tables, settings)
    return j.select(
        "email_editor", display_name("email_editor", "author_name", settings, agency_label=False).alias("display_name"),
        F.col("author_country").alias("country"),
    ).distinct().orderBy("display_name", "email_editor", F.col("country").asc_nulls_first())


# B33
def filter_sections(tables, period: Period) -> DataFrame:
    e = tables.editorial.filter(
        (F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp") & present("segment")
        & F.col("segment").rlike(r"\S")
    )
    return e.select(F.col("segment").alias("section")).distinct().orderBy("section")


# B34
def filter_countries(tables, period: Period) -> DataFrame:
    """Distinct non-blank countries of authors active in the period."""
    editors = _active_editors(tables, period).select(F.lower(F.col("email_editor")).alias("k")).distinct()
    a = tables.authors.filter(present("country") & F.col("country").rlike(r"\S"))
    a = a.join(editors, F.lower(a.email) == editors.k, "left_semi")
    return a.select("country").distinct().orderBy("country")


# B35
def author_lookup(tables, period: Period, settings: Settings = DEFAULT, choices: DataFrame | None = None) -> DataFrame:
    """One email per display name (the dropdown's name -> email map); the largest email wins,
    rows without a name or an email are left out. ``choices`` is B32's frame where it is at hand."""
    return (
        (filter_authors(tables, period, settings) if choices is None else choices).filter(present("display_name") & present("email_editor"))
        .groupBy("display_name").agg(F.max("email_editor").alias("email"))
        .orderBy("display_name")
    )
