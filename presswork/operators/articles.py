"""Article tables.

Scale: traffic and publisher metadata are aggregated per url, and per-note
metadata and creators per note, before any join; the top-k keeps k rows per task
and merges those in one task (TakeOrderedAndProject), never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import join_authors, present, round_ratio, tool_label
from presswork.operators import ownership as own
from presswork.params import FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()


def _zero():
    return F.lit(0).cast("bigint")


def _select_article(df: DataFrame, settings: Settings, traffic_nullable: bool, *more) -> DataFrame:
    visits = F.coalesce("visits", _zero()) if traffic_nullable else F.col("visits")
    pageviews = F.coalesce("pageviews", _zero()) if traffic_nullable else F.col("pageviews")
    return df.select(
        "url", "title", "section",
        F.coalesce("creator", F.lit(settings.missing_text)).alias("creator"),
        F.coalesce("publisher", F.lit(settings.missing_text)).alias("publisher"),
        tool_label("production_source", settings).alias("source"),
        visits.alias("visits"),
        pageviews.alias("pageviews"),
        F.coalesce(round_ratio("scrolls_sum", "visits_sum", 2), F.lit(0.0)).alias("scroll_rate"),
        F.coalesce("title_words", _zero()).alias("title_words"),
        F.coalesce("body_words", _zero()).alias("body_words"),
        *more,
    )


def _by_visits():
    return F.col("visits").desc(), F.col("url").asc_nulls_first()


# B28
def top_articles(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT,
                 limit: int | None = None) -> DataFrame:
    """Per url: metadata (MAX), traffic sums and scroll rate, the publisher and word counts of the
    period's FIRST_PUBLISH rows; boilerplate titles, home pages and rows without section dropped."""
    g = tables.traffic_daily.filter(period.covers_date("date") & period.covers("publish_date"))
    if filters.section is not None:
        g = g.filter(F.col("section") == F.lit(filters.section))
    g = join_authors(g, "creator_email", tables, settings, filters.country, always=False)
    traffic = g.groupBy(F.col("article_url").alias("url")).agg(
        F.max("article_title").alias("title"),
        F.max("section").alias("section"),
        F.max("creator_email").alias("creator"),
        F.max("production_source").alias("production_source"),
        F.sum("visits").alias("visits"),
        F.sum("pageviews").alias("pageviews"),
        F.sum("scrolls").alias("scrolls_sum"),
        F.sum("visits").alias("visits_sum"),
    )
    lower_title = F.lower(F.col("title"))
    keep = present("title") & F.col("section").isNotNull()
    for pattern in settings.exclude_title_patterns:
        keep = keep & ~lower_title.contains(pattern.lower())
    for pattern in settings.exclude_url_patterns:
        keep = keep & ~F.lower(F.col("url")).contains(pattern.lower())
    traffic = traffic.filter(keep)
    publishers = (
        tables.editorial.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp"))
        .groupBy(F.col("story_url").alias("url"))
        .agg(F.max("email_editor").alias("publisher"), F.max("title_word_count").alias("title_words"),
             F.max("body_word_count").alias("body_words"))
    )
    j = traffic.join(publishers, "url", "left")
    return _select_article(j, settings, traffic_nullable=False).orderBy(*_by_visits()).limit(
        settings.article_limit if limit is None else limit)


# B29
def author_top_articles(tables, period: Period, filters: Filters, settings: Settings = DEFAULT,
                        limit: int | None = None) -> DataFrame:
    """Every (note, url) of the author's published notes with metadata, real creator, publisher and
    traffic of the period; notes without traffic are kept with zeros.

    Per-note metadata and creators are aggregated before they meet the url pairs,
    so a note with many events or creators never multiplies rows in a join.
    """
    ed = tables.editorial
    scope = own.scope_for(ed, period, filters.author)
    notes = scope.published_notes
    pairs = scope.note_urls_any()
    note_rows = ed.join(notes, "note_id", "left_semi")
    meta = note_rows.groupBy("note_id").agg(
        F.max("title").alias("title"),
        F.max("segment").alias("section"),
        F.max(F.when(F.col("action_type") == FIRST_PUBLISH, F.col("email_editor"))).alias("publisher"),
        F.max("source").alias("production_source"),
        F.max("title_word_count").alias("title_words"),
        F.max("body_word_count").alias("body_words"),
    )
    creators = scope.real_creators().groupBy("note_id").agg(F.max("creator_email").alias("creator"))
    m = pairs.join(meta, "note_id", "left").join(creators, "note_id", "left").withColumnRenamed("story_url", "url")
    g = tables.traffic_daily.filter(period.covers_date("date"))
    urls = pairs.select(F.col("story_url").alias("url")).distinct()
    traffic = (
        g.join(urls, g.article_url == urls.url, "left_semi")
        .groupBy(F.col("article_url").alias("url"))
        .agg(F.sum("visits").alias("visits"), F.sum("pageviews").alias("pageviews"),
             F.sum("scrolls").alias("scrolls_sum"), F.sum("visits").alias("visits_sum"))
    )
    j = m.join(traffic, "url", "left").filter(present("title"))
    # rows are (note, url) pairs: the note decides between pairs of one url
    ranked = _select_article(j, settings, True, F.col("note_id")).orderBy(*_by_visits(), "note_id")
    return ranked.limit(settings.article_limit if limit is None else limit).drop("note_id")
