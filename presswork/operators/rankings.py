"""Top publishers and creators.

The event log is aggregated per editor before the author lookup is joined, so
the join sees one row per editor (a hot agency account collapses map-side) and
the lookup fan-out of duplicate emails is kept by summing the per-editor counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import display_name, join_authors, present
from presswork.operators import ownership as own
from presswork.params import CREATE, FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()


def _rank(df: DataFrame, label: str, measure: str, limit: int) -> DataFrame:
    """Top ``limit`` by measure; ties broken by label then country (NULL first)."""
    return df.orderBy(F.col(measure).desc(), F.col(label).asc_nulls_first(), F.col("country").asc_nulls_first()).limit(limit)


def _top_rows(tables, period, filters, settings, action, label, measure, limit) -> DataFrame:
    e = tables.editorial.filter(
        (F.col("action_type") == action) & period.covers("event_timestamp") & present("email_editor")
    )
    if filters.section is not None:
        e = e.filter(F.col("segment") == F.lit(filters.section))
    per_editor = e.groupBy("email_editor").agg(F.count(F.lit(1)).alias("n"))
    j = join_authors(per_editor, "email_editor", tables, settings, filters.country)
    out = j.groupBy(
        display_name("email_editor", "author_name", settings).alias(label), F.col("author_country").alias("country")
    ).agg(F.sum("n").alias(measure))
    return _rank(out, label, measure, limit)


# B13
def top_publishers(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT,
                   limit: int | None = None) -> DataFrame:
    """FIRST_PUBLISH rows per (display name, country), top k."""
    return _top_rows(tables, period, filters, settings, FIRST_PUBLISH, "publisher", "published_notes",
                     limit or settings.top_k)


# B15
def top_creators(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT,
                 limit: int | None = None) -> DataFrame:
    """CREATE rows per (display name, country), top k."""
    return _top_rows(tables, period, filters, settings, CREATE, "creator", "created_notes", limit or settings.top_k)


def _distinct_notes_by(pairs: DataFrame, email: str, tables, settings, label, measure, limit) -> DataFrame:
    j = join_authors(pairs, email, tables, settings)
    out = j.groupBy(
        display_name(email, "author_name", settings).alias(label), F.col("author_country").alias("country")
    ).agg(F.count_distinct("note_id").alias(measure))
    return _rank(out, label, measure, limit)


# B14
def author_top_publishers(tables, period: Period, filters: Filters, settings: Settings = DEFAULT,
                          limit: int | None = None) -> DataFrame:
    """Who FIRST_PUBLISHed the author's notes in the period, by distinct notes."""
    ed = tables.editorial
    notes = own.scope_for(ed, period, filters.author).notes
    pairs = (
        ed.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp") & present("email_editor"))
        .select("email_editor", "note_id")
        .join(notes, "note_id", "left_semi")
        .distinct()
    )
    return _distinct_notes_by(pairs, "email_editor", tables, settings, "publisher", "published_notes",
                              limit or settings.top_k)


# B16
def author_top_creators(tables, period: Period, filters: Filters, settings: Settings = DEFAULT,
                        limit: int | None = None) -> DataFrame:
    """Who really created (CREATE, else first SAVE ever) the author's notes, by distinct notes."""
    ed = tables.editorial
    pairs = own.scope_for(ed, period, filters.author).real_creators().filter(present("creator_email")).distinct()
    return _distinct_notes_by(pairs, "creator_email", tables, settings, "creator", "created_notes",
                              limit or settings.top_k)
