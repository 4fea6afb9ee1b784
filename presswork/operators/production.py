"""Efficiency by production source.

Scale: traffic is summed per url before it meets the published notes, so the join
sees one row per url; the class grouping is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import join_authors, ratio, tool_class
from presswork.operators import ownership as own
from presswork.params import FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()
def _zero():
    return F.lit(0).cast("bigint")


def _classified(tables, period, section, settings) -> DataFrame:
    e = tables.editorial.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp"))
    if section is not None:
        e = e.filter(F.col("segment") == F.lit(section))
    return e


def _metrics(notes: DataFrame, per_url: DataFrame, settings: Settings) -> DataFrame:
    """Notes LEFT JOIN per-url traffic sums; a note published twice counts its traffic twice.

    A note without url meets no traffic. Its key is dealt out by the note and marked as no url, so that
    such notes, however many, don't land in one task."""
    keyed = notes.select("*", F.coalesce(F.col("story_url"), F.col("note_id").cast("string")).alias("join_url"),
                         F.col("story_url").isNotNull().alias("has_url"))
    sums = per_url.withColumn("is_url", F.lit(True))
    j = keyed.join(sums, (keyed.join_url == sums.article_url) & (keyed.has_url == sums.is_url), "left")
    m = j.groupBy("source_class").agg(
        F.count_distinct("note_id").alias("notes"),
        F.sum("s_sessions").alias("sessions"),
        F.sum("s_pageviews").alias("pageviews"),
        ratio(F.sum("s_scroll"), F.sum("s_sessions")).alias("scroll_rate"),
        (ratio(F.sum("s_time"), F.sum("s_sessions")) / F.lit(60.0)).alias("avg_time_minutes"),
    )
    sessions = F.coalesce("sessions", _zero())
    return m.filter(F.col("source_class") != F.lit(settings.other_class)).select(
        "source_class", "notes", sessions.alias("sessions"),
        F.coalesce("pageviews", _zero()).alias("pageviews"),
        ratio(sessions, F.col("notes")).alias("sessions_per_note"),
        F.coalesce("scroll_rate", F.lit(0.0)).alias("scroll_rate"),
        F.coalesce("avg_time_minutes", F.lit(0.0)).alias("avg_time_minutes"),
    ).orderBy(F.col("sessions").desc(), F.col("source_class").asc())


def _of_urls(traffic: DataFrame, notes: DataFrame) -> DataFrame:
    """The traffic rows of the notes' urls alone, cut down before they are summed."""
    urls = notes.filter(F.col("story_url").isNotNull()).select("story_url").distinct()
    return traffic.join(urls, traffic.article_url == urls.story_url, "left_semi")


# B36
def source_efficiency(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """Class of each FIRST_PUBLISH row of the period with the Gold traffic of its url in the period.

    Traffic is summed per url before the join (aggregate-before-join): the join then
    meets one row per url, and the per-note fan-out of the reference is unchanged.
    """
    e = join_authors(_classified(tables, period, filters.section, settings), "email_editor", tables, settings,
                     filters.country, always=False)
    notes = e.select("note_id", "story_url", tool_class("email_editor", "source", settings).alias("source_class"))
    g = tables.traffic_daily.filter(period.covers_date("date"))
    if filters.section is not None or filters.country is not None:
        g = _of_urls(g, notes)
    per_url = g.groupBy("article_url").agg(
        F.sum("visits").alias("s_sessions"), F.sum("pageviews").alias("s_pageviews"),
        F.sum("scrolls").alias("s_scroll"), F.sum("total_time_seconds").alias("s_time"),
    )
    return _metrics(notes, per_url, settings)


# B37
def author_source_efficiency(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """As B36 over the author's published notes, with clean traffic (section filter only)."""
    owned = own.scope_for(tables.editorial, period, filters.author).published_notes
    e = _classified(tables, period, filters.section, settings).join(owned, "note_id", "left_semi")
    notes = e.select("note_id", "story_url", tool_class("email_editor", "source", settings).alias("source_class"))
    s = _of_urls(tables.traffic_clean.filter(period.covers_date("event_date")), notes)
    per_url = s.groupBy("article_url").agg(
        F.sum("daily_sessions").alias("s_sessions"), F.sum("daily_pageviews").alias("s_pageviews"),
        F.sum("sessions_with_scroll").alias("s_scroll"), F.sum("total_engagement_seconds").alias("s_time"),
    )
    return _metrics(notes, per_url, settings)


# C8
def rank_sources(efficiency: DataFrame) -> DataFrame:
    """Sources by sessions per note, ascending."""
    return efficiency.orderBy(F.col("sessions_per_note").asc_nulls_first(), F.col("source_class").asc())
