"""Author productivity (B38-B42) and the insights drawn from it.

Scale: notes are counted on distinct (editor, note) pairs after the size-checked
author lookup; traffic is summed per url, joined to distinct (editor, url) pairs and
summed per editor (a hot editor is combined map-side). The insights are one
aggregate over the bounded top-100 table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import is_agency, join_authors, one_row, present, ratio, scalar
from presswork.operators import ownership as own
from presswork.params import CREATE, FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()
def _zero():
    return F.lit(0).cast("bigint")

ACTIONS_BY_METRIC = {
    "created": (CREATE,),
    "published": (FIRST_PUBLISH,),
    "participated": (CREATE, FIRST_PUBLISH),
}


def _order(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(
        F.col("sessions").desc(), F.col("author").asc_nulls_first(), F.col("country").asc_nulls_first(),
        F.col("notes").desc(),
    ).limit(limit)


def _finish(authors_df: DataFrame, traffic: DataFrame, require_sessions: bool, limit: int) -> DataFrame:
    j = authors_df.join(traffic, "email_editor", "left")
    sessions = F.coalesce("sessions_total", _zero())
    out = j.select(
        "author", "country", "notes", sessions.alias("sessions"),
        F.coalesce("scroll", F.lit(0.0)).alias("scroll_rate"),
        ratio(sessions, F.col("notes")).alias("efficiency"),
    )
    if require_sessions:
        out = out.filter(F.col("sessions") > 0)
    return _order(out, limit)


def _per_author(e: DataFrame, tables, settings, country) -> DataFrame:
    """Distinct notes per (editor, name, country), counted after the author lookup."""
    pairs = e.select("email_editor", "note_id").distinct()
    j = join_authors(pairs, "email_editor", tables, settings, country)
    return j.groupBy(
        "email_editor",
        F.coalesce("author_name", "email_editor").alias("author"),
        F.coalesce("author_country", F.lit(settings.unknown_country)).alias("country"),
    ).agg(F.count_distinct("note_id").alias("notes"))


def _traffic_by_editor(pairs: DataFrame, per_url: DataFrame) -> DataFrame:
    """(editor, url) pairs joined to traffic already summed per url, then summed per editor."""
    j = pairs.join(per_url, pairs.story_url == per_url.article_url)
    return j.groupBy("email_editor").agg(
        F.sum("s_sessions").alias("sessions_total"), ratio(F.sum("s_scroll"), F.sum("s_sessions")).alias("scroll"),
    )


# B38-B40
def author_productivity(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT,
                        metric_type: str = "created") -> DataFrame:
    """Authors with at least ``min_notes`` distinct notes of the chosen actions in the period,
    with Gold traffic of all their urls in the period; sessions > 0; top 100."""
    actions = ACTIONS_BY_METRIC[metric_type]
    base = tables.editorial.filter(F.col("action_type").isin(*actions) & period.covers("event_timestamp"))
    e = base.filter(present("email_editor") & ~is_agency("email_editor", settings))
    if filters.section is not None:
        e = e.filter(F.col("segment") == F.lit(filters.section))
    authors_df = _per_author(e, tables, settings, filters.country).filter(F.col("notes") >= settings.min_notes)
    pairs = base.filter(F.col("story_url").isNotNull()).select("email_editor", "story_url").distinct()
    g = tables.traffic_daily.filter(period.covers_date("date"))
    per_url = g.groupBy("article_url").agg(F.sum("visits").alias("s_sessions"), F.sum("scrolls").alias("s_scroll"))
    return _finish(authors_df, _traffic_by_editor(pairs, per_url), True, settings.productivity_limit)


# B41
def author_own_productivity(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """One row for the author: name and country (defaults when unknown), published-note count
    and the clean traffic of every url those notes ever had."""
    author = filters.author
    ed = tables.editorial
    notes = own.scope_for(ed, period, author).published_notes
    info = (
        tables.authors.filter(F.lower(F.col("email")) == F.lower(F.lit(author)))
        .agg(F.min(F.struct(
            F.coalesce(F.col("complete_name"), F.lit(author)).alias("author"),
            F.coalesce(F.col("country"), F.lit(settings.unknown_country)).alias("country"),
        )).alias("info"))
    )
    count = notes.agg(F.count(F.lit(1)).alias("notes"))
    urls = ed.filter(F.col("story_url").isNotNull()).join(notes, "note_id", "left_semi").select("story_url").distinct()
    s = tables.traffic_clean.filter(period.covers_date("event_date"))
    traffic = s.join(urls, s.article_url == urls.story_url, "left_semi").agg(
        F.sum("daily_sessions").alias("sessions_total"),
        ratio(F.sum("sessions_with_scroll"), F.sum("daily_sessions")).alias("scroll"),
    )
    row = one_row(ed.sparkSession, {
        "info": scalar(info, "info"), "notes": scalar(count, "notes"),
        "sessions_total": scalar(traffic, "sessions_total"), "scroll": scalar(traffic, "scroll"),
    })
    sessions = F.coalesce("sessions_total", _zero())
    return row.select(
        F.coalesce(F.col("info.author"), F.lit(author)).alias("author"),
        F.coalesce(F.col("info.country"), F.lit(settings.unknown_country)).alias("country"),
        "notes", sessions.alias("sessions"),
        F.coalesce("scroll", F.lit(0.0)).alias("scroll_rate"),
        ratio(sessions, F.col("notes")).alias("efficiency"),
    )


# B42
def author_publishers_productivity(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """Each publisher of the author's notes (agency left out): notes, clean sessions, scroll, efficiency."""
    ed = tables.editorial
    notes = own.scope_for(ed, period, filters.author).notes
    fp = ed.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp")).join(notes, "note_id", "left_semi")
    e = fp.filter(present("email_editor") & ~is_agency("email_editor", settings))
    authors_df = _per_author(e, tables, settings, None)
    pairs = fp.filter(F.col("story_url").isNotNull()).select("email_editor", "story_url").distinct()
    s = tables.traffic_clean.filter(period.covers_date("event_date"))
    s = s.join(pairs.select("story_url"), s.article_url == pairs.story_url, "left_semi")
    per_url = s.groupBy("article_url").agg(
        F.sum("daily_sessions").alias("s_sessions"), F.sum("sessions_with_scroll").alias("s_scroll")
    )
    return _finish(authors_df, _traffic_by_editor(pairs, per_url), False, settings.productivity_limit)


def productivity_for(tables, period, filters, settings=DEFAULT, metric_type="created") -> DataFrame:
    """The dashboard's choice: B38-B40 without author; B42 (published) or B41 with one."""
    if filters.author is None:
        return author_productivity(tables, period, filters, settings, metric_type)
    if metric_type == "published":
        return author_publishers_productivity(tables, period, filters, settings)
    return author_own_productivity(tables, period, filters, settings)


INSIGHTS = (("most_efficient", "efficiency"), ("most_productive", "notes"), ("widest_reach", "sessions"))


# C7
def author_insights(productivity: DataFrame, min_rows: int = 3) -> DataFrame:
    """Author with the highest efficiency, notes and sessions (ties: more sessions, then name);
    empty unless the table has at least ``min_rows`` rows. One aggregate, one row per insight."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, col in INSIGHTS:
        key = F.struct((-F.col(col).cast("double")).alias("k"), (-F.col("sessions")).alias("s"), F.col("author").alias("a"))
        aggs.append(F.min(F.struct(key.alias("key"), F.col("author").alias("author"),
                                   F.col(col).cast("double").alias("value"))).alias(name))
    one = productivity.agg(*aggs).filter(F.col("n") >= min_rows)
    rows = ", ".join(f"'{name}', {name}.author, {name}.value" for name, _ in INSIGHTS)
    return one.select(F.expr(f"stack({len(INSIGHTS)}, {rows}) AS (insight, author, value)"))
