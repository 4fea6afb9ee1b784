"""Per-section production and traffic.

Scale: the editorial side groups by (section, note) first and then by section, so
the tool counts need no COUNT(DISTINCT) expansion; traffic is aggregated per
section before the two small results are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import join_authors, present, ratio
from presswork.operators import ownership as own
from presswork.params import FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()


def _editorial_stats(e: DataFrame, settings: Settings) -> DataFrame:
    """Distinct notes per section and, of them, those with tool 1 / tool 2 rows.

    Pre-distinct on (section, note) replaces three COUNT(DISTINCT ...) (an Expand
    that triples the rows) by one grouping and plain sums.
    """
    src = F.lower(F.col("source"))
    per_note = e.groupBy(F.col("segment").alias("section"), "note_id").agg(
        F.bool_or(F.coalesce(src.contains(settings.tool1_pattern), F.lit(False))).alias("t1"),
        F.bool_or(F.coalesce(src.contains(settings.tool2_pattern), F.lit(False))).alias("t2"),
    )
    return per_note.groupBy("section").agg(
        F.count(F.lit(1)).alias("notes"),
        F.count_if("t1").alias("tool1_notes"),
        F.count_if("t2").alias("tool2_notes"),
    )


def _finish(ed_stats: DataFrame, traffic: DataFrame) -> DataFrame:
    j = ed_stats.join(traffic, "section", "left")
    sessions = F.coalesce(F.col("sessions"), F.lit(0).cast("bigint"))
    return j.select(
        "section", "notes", "tool1_notes", "tool2_notes",
        sessions.alias("sessions"),
        F.coalesce(F.col("pageviews"), F.lit(0).cast("bigint")).alias("pageviews"),
        F.coalesce(F.col("scroll_rate"), F.lit(0.0)).alias("scroll_rate"),
        ratio(sessions, F.col("notes")).alias("sessions_per_note"),
    ).orderBy(F.col("notes").desc(), F.col("section").asc())


def _published_rows(tables, period, section) -> DataFrame:
    e = tables.editorial.filter(
        (F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp") & present("segment")
    )
    if section is not None:
        e = e.filter(F.col("segment") == F.lit(section))
    return e


# B23
def section_stats(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """Editorial side by published-note section, traffic side by Gold section; both filtered."""
    e = join_authors(_published_rows(tables, period, filters.section), "email_editor", tables, settings,
                     filters.country, always=False)
    g = tables.traffic_daily.filter(period.covers_date("date") & period.covers("publish_date") & present("section"))
    if filters.section is not None:
        g = g.filter(F.col("section") == F.lit(filters.section))
    g = join_authors(g, "creator_email", tables, settings, filters.country, always=False)
    traffic = g.groupBy("section").agg(
        F.sum("visits").alias("sessions"),
        F.sum("pageviews").alias("pageviews"),
        ratio(F.sum("scrolls"), F.sum("visits")).alias("scroll_rate"),
    )
    return _finish(_editorial_stats(e, settings), traffic)


# B24
def author_section_stats(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """Author's published notes per section; traffic is clean traffic of the section's distinct urls."""
    notes = own.scope_for(tables.editorial, period, filters.author).published_notes
    e = _published_rows(tables, period, filters.section).join(notes, "note_id", "left_semi")
    urls = e.filter(F.col("story_url").isNotNull()).select(F.col("segment").alias("section"), "story_url").distinct()
    # clean traffic of these urls alone, summed per url first: the join meets one row per url, not one per day
    s = tables.traffic_clean.filter(period.covers_date("event_date"))
    per_url = s.join(urls.select("story_url"), s.article_url == urls.story_url, "left_semi").groupBy("article_url").agg(
        F.sum("daily_sessions").alias("s_sessions"), F.sum("daily_pageviews").alias("s_pageviews"),
        F.sum("sessions_with_scroll").alias("s_scroll"))
    j = urls.join(per_url, urls.story_url == per_url.article_url)
    traffic = j.groupBy("section").agg(
        F.sum("s_sessions").alias("sessions"),
        F.sum("s_pageviews").alias("pageviews"),
        ratio(F.sum("s_scroll"), F.sum("s_sessions")).alias("scroll_rate"),
    )
    return _finish(_editorial_stats(e, settings), traffic)
