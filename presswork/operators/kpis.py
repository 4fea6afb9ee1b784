"""Production and traffic KPIs.

Scale: every KPI is a global aggregate with partial aggregation per task; the
period reaches the scans (timestamp range on the event log, date folders on the
traffic tables). A KPI row for one period, or two for a comparison, come from one pass
over each table: the event log gives one grouping of tagged distinct keys, both traffic
tables one grouping by (url, day), and each row counts for the period it falls in. The rows meet
in a grouping by period, never in a join. Author KPIs read the shared ``AuthorScope``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.columns import join_authors, one_row, ratio, scalar
from presswork.operators import ownership as own
from presswork.params import CREATE, FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()


def _editorial_scope(tables, period: Period, filters: Filters, settings: Settings, actions) -> DataFrame:
    """Editorial rows of the given actions in the period, with the section and country filters."""
    e = tables.editorial.filter(F.col("action_type").isin(*actions) & period.covers("event_timestamp"))
    if filters.section is not None:
        e = e.filter(F.col("segment") == F.lit(filters.section))
    return join_authors(e, "email_editor", tables, settings, filters.country, always=False)


# B1
def active_creators(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    e = _editorial_scope(tables, period, filters, settings, [CREATE])
    return e.agg(F.count_distinct("email_editor").alias("active_creators"))


# B2
def active_publishers(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    e = _editorial_scope(tables, period, filters, settings, [FIRST_PUBLISH])
    return e.agg(F.count_distinct("email_editor").alias("active_publishers"))


# B3
def published_notes(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    e = _editorial_scope(tables, period, filters, settings, [FIRST_PUBLISH])
    return e.agg(F.count_distinct("note_id").alias("published_notes"))


def _which(day, periods: dict[str, Period]) -> Column:
    """The name of the period that a day falls in, NULL outside all of them."""
    day = F.col(day) if isinstance(day, str) else day
    return F.coalesce(*[F.when(day.between(F.lit(p.start), F.lit(p.end)), F.lit(name)) for name, p in periods.items()])


def _hull(periods: dict[str, Period]) -> Period:
    return Period(min(p.start for p in periods.values()), max(p.end for p in periods.values()))


def _production_keys(tables, periods: dict[str, Period], filters: Filters, settings: Settings) -> DataFrame:
    """Distinct (which, kind, key) rows: what B1-B3 count, in one grouping.

    A CREATE row names a creator; a FIRST_PUBLISH row a publisher and a note."""
    e = _editorial_scope(tables, _hull(periods), filters, settings, [CREATE, FIRST_PUBLISH])

    def key(kind: str, editor=None, note=None) -> Column:
        return F.struct(F.lit(kind).alias("kind"),
                        (F.col(editor) if editor else F.lit(None).cast("string")).alias("editor"),
                        (F.col(note) if note else F.lit(None).cast("bigint")).alias("note"))

    keys = F.when(F.col("action_type") == CREATE, F.array(key("creator", "email_editor"))).otherwise(
        F.array(key("publisher", "email_editor"), key("note", None, "note_id")))
    found = e.select(_which(F.to_date("event_timestamp"), periods).alias("which"), F.explode(keys).alias("k")).select("which", "k.*")
    return found.filter(F.col("which").isNotNull() & (F.col("editor").isNotNull() | F.col("note").isNotNull())).distinct()


_KINDS = {"creator": "active_creators", "publisher": "active_publishers", "note": "published_notes"}


def _production(tables, periods: dict[str, Period], filters: Filters, settings: Settings) -> DataFrame:
    """B1-B3 of each period (``which``)."""
    return _production_keys(tables, periods, filters, settings).groupBy("which").agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in _KINDS.items()])


def _production_all(tables, period, filters, settings) -> DataFrame:
    """B1-B3 of one period from one scan of the event log, one row."""
    return _production_keys(tables, {"current": period}, filters, settings).agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in _KINDS.items()])


def _author_counts(tables, period: Period, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """One-row aggregates: distinct real creators (undated) and distinct period publishers
    of the author's notes. A NULL editor in either distinct list counts as one row."""
    ed = tables.editorial
    scope = own.scope_for(ed, period, filters.author)
    creators = scope.real_creators().select("creator_email").distinct().agg(
        F.count(F.lit(1)).alias("total_creators"))
    publishers = (
        ed.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp"))
        .select("note_id", "email_editor")
        .join(scope.notes, "note_id", "left_semi")
        .select("email_editor")
        .distinct()
        .agg(F.count(F.lit(1)).alias("total_publishers"))
    )
    return creators, publishers


# B4
def author_creator_publisher_counts(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct real creators (undated) and distinct period publishers of the author's notes, one row."""
    creators, publishers = _author_counts(tables, period, filters)
    return one_row(tables.spark, {"total_creators": scalar(creators, "total_creators"),
                                  "total_publishers": scalar(publishers, "total_publishers")})


# B5
def author_published_note_count(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct author notes published in the period; the FIRST_PUBLISH row tested by the
    section and country filters is not limited to the period."""
    ed = tables.editorial
    notes = own.scope_for(ed, period, filters.author).published_notes
    fp = ed.filter(F.col("action_type") == FIRST_PUBLISH)
    if filters.section is not None:
        fp = fp.filter(F.col("segment") == F.lit(filters.section))
    fp = join_authors(fp, "email_editor", tables, settings, filters.country, always=False)
    return fp.select("note_id").join(notes, "note_id", "left_semi").agg(F.count_distinct("note_id").alias("published_notes"))


def _traffic_columns() -> list[Column]:
    return [
        F.sum("visits").alias("total_visits"),
        F.sum("pageviews").alias("total_pageviews"),
        ratio(F.sum("total_time_seconds"), F.sum("visits")).alias("avg_time_seconds"),
        ratio(F.sum("scrolls"), F.sum("visits")).alias("scroll_rate"),
        F.sum("scrolls").alias("total_scrolls"),
    ]


def _traffic_sums(g: DataFrame) -> DataFrame:
    return g.agg(*_traffic_columns())


def _gold_scope(tables, period: Period, filters: Filters, settings: Settings, publish_in_period: bool) -> DataFrame:
    g = tables.traffic_daily.filter(period.covers_date("date"))
    if publish_in_period:
        g = g.filter(period.covers("publish_date"))
    if filters.section is not None:
        g = g.filter(F.col("section") == F.lit(filters.section))
    return join_authors(g, "creator_email", tables, settings, filters.country, always=False)


# B6
def traffic_totals(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """Traffic sums where both the traffic date and the publish date fall in the period."""
    return _traffic_sums(_gold_scope(tables, period, filters, settings, publish_in_period=True))


# B7
def author_traffic_totals(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    urls = own.scope_for(tables.editorial, period, filters.author).published_urls
    g = _gold_scope(tables, period, filters, settings, publish_in_period=False)
    return _traffic_sums(g.join(urls, g.article_url == urls.story_url, "left_semi"))


TRAFFIC_SUMS = ("visits", "pageviews", "scrolls", "total_time_seconds")


def clean_gold_days(tables, periods: dict[str, Period], filters: Filters, settings: Settings, sums=()) -> DataFrame:
    """Clean traffic INNER JOIN Gold on (url, date), as one aggregation instead of a join.

    Both fact tables are tagged and grouped by (url, day): the sum of daily users on
    the clean side and the number of (filtered) Gold rows per pair. A pair present on
    both sides contributes ``users * gold_rows`` (``joined_users``), exactly the join's fan-out;
    ``sums`` are Gold's own sums. One shuffle with map-side combine and no sort, so a hot (url, day)
    never lands whole in one task. Gold rows count where both dates fall in the same period.

    With a section, clean traffic is first cut down to the (url, day) keys of the section's Gold rows: a
    semi-join that Spark broadcasts, or prunes at the scan by a bloom filter of these urls, so that
    the traffic of other sections is not shuffled.
    """
    hull = _hull(periods)
    g = tables.traffic_daily.filter(hull.covers_date("date") & hull.covers("publish_date"))
    if len(periods) > 1:
        g = g.filter(_which("date", periods) == _which(F.to_date("publish_date"), periods))
    if filters.section is not None:
        g = g.filter(F.col("section") == F.lit(filters.section))
    keys = g.filter(F.col("article_url").isNotNull()).select(F.col("article_url").alias("url"), F.col("date").alias("day"))
    g = join_authors(g, "creator_email", tables, settings, filters.country, always=False).withColumnsRenamed(
        {"article_url": "url", "date": "day"})
    s = tables.traffic_clean.filter(hull.covers_date("event_date") & F.col("article_url").isNotNull()).select(
        F.col("article_url").alias("url"), F.col("event_date").alias("day"), F.col("daily_users").alias("users"))
    if filters.section is not None:
        s = s.join(keys, ["url", "day"], "left_semi")
    zero, one, none = (F.lit(x).cast("bigint") for x in (0, 1, None))
    tagged = s.select("url", "day", "users", one.alias("clean_rows"), zero.alias("gold_rows"), *[none.alias(c) for c in sums]).unionByName(
        g.select("url", "day", none.alias("users"), zero.alias("clean_rows"), one.alias("gold_rows"), *sums))
    days = tagged.groupBy("url", "day").agg(*[F.sum(c).alias(c) for c in ("users", "clean_rows", "gold_rows", *sums)])
    # a NULL url meets nothing
    met = F.col("url").isNotNull() & (F.col("clean_rows") > 0) & (F.col("gold_rows") > 0)
    return days.select("day", met.alias("met"), F.when(met, F.col("users") * F.col("gold_rows")).alias("joined_users"), *sums)


def clean_gold_pairs(tables, period: Period, filters: Filters, settings: Settings) -> DataFrame:
    """(day, joined_users) of the (url, day) pairs present on both sides."""
    return clean_gold_days(tables, {"current": period}, filters, settings).filter("met").select("day", "joined_users")


def _traffic(tables, periods: dict[str, Period], filters: Filters, settings: Settings) -> DataFrame:
    """B6 and B8 of each period (``which``) from one pass over both traffic tables."""
    days = clean_gold_days(tables, periods, filters, settings, TRAFFIC_SUMS)
    return days.groupBy(_which("day", periods).alias("which")).agg(
        *_traffic_columns(), F.sum("joined_users").alias("daily_user_sum"))


# B8
def daily_user_sum(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """SUM of daily users (not a distinct count) of clean traffic joined to Gold on (url, date)."""
    return clean_gold_pairs(tables, period, filters, settings).agg(F.sum("joined_users").alias("daily_user_sum"))


# B9
def author_daily_user_sum(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    urls = own.scope_for(tables.editorial, period, filters.author).published_urls
    s = tables.traffic_clean.filter(period.covers_date("event_date"))
    return s.join(urls, s.article_url == urls.story_url, "left_semi").agg(F.sum("daily_users").alias("daily_user_sum"))


KPI_COLUMNS = (
    "active_creators", "active_publishers", "published_notes", "total_visits", "daily_user_sum",
    "total_pageviews", "avg_time_minutes", "scroll_rate", "total_scrolls", "visits_per_note",
)


_PARTS = (("active_creators", "active_publishers", "published_notes"),
          ("total_visits", "total_pageviews", "avg_time_seconds", "scroll_rate", "total_scrolls", "daily_user_sum"))
_DOUBLES = ("avg_time_seconds", "scroll_rate")


def _finish(rows: DataFrame) -> DataFrame:
    """KPI rows from the parts: NULL becomes 0, minutes = seconds / 60, visits per note = visits / max(notes, 1)."""
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "which",
        F.coalesce("active_creators", zero).alias("active_creators"),
        F.coalesce("active_publishers", zero).alias("active_publishers"),
        F.coalesce("published_notes", zero).alias("published_notes"),
        F.coalesce("total_visits", zero).alias("total_visits"),
        F.coalesce("daily_user_sum", zero).alias("daily_user_sum"),
        F.coalesce("total_pageviews", zero).alias("total_pageviews"),
        (F.coalesce("avg_time_seconds", F.lit(0.0)) / F.lit(60.0)).alias("avg_time_minutes"),
        F.coalesce("scroll_rate", F.lit(0.0)).alias("scroll_rate"),
        F.coalesce("total_scrolls", zero).alias("total_scrolls"),
        (F.coalesce("total_visits", zero).cast("double")
         / F.greatest(F.coalesce("published_notes", zero), F.lit(1).cast("bigint")).cast("double")).alias("visits_per_note"),
    )


def _author_row(tables, which: str, period: Period, filters: Filters, settings: Settings) -> DataFrame:
    """An author's KPI row: ownership belongs to the period, so each period has a scope of its own.
    One row of scalar subqueries: no join between the one-row aggregates."""
    creators, publishers = _author_counts(tables, period, filters)
    notes = author_published_note_count(tables, period, filters, settings)
    traffic = author_traffic_totals(tables, period, filters, settings)
    users = author_daily_user_sum(tables, period, filters, settings)
    cols = {"which": F.lit(which), "active_creators": scalar(creators, "total_creators"),
            "active_publishers": scalar(publishers, "total_publishers"), "published_notes": scalar(notes, "published_notes"),
            "daily_user_sum": scalar(users, "daily_user_sum")}
    cols |= {k: scalar(traffic, k) for k in _PARTS[1] if k != "daily_user_sum"}
    return _finish(one_row(tables.spark, cols))


def kpi_rows(tables, periods: dict[str, Period], filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """One row of KPIs for each named period (``which``), each table read once for all of them.

    Periods must not overlap."""
    if filters.author is not None:
        return reduce(DataFrame.unionByName, [_author_row(tables, n, p, filters, settings) for n, p in periods.items()])

    def padded(part: DataFrame, have) -> DataFrame:
        return part.select("which", *[F.col(c) if c in have else F.lit(None).cast("double" if c in _DOUBLES else "bigint").alias(c)
                                      for c in _PARTS[0] + _PARTS[1]])

    # every period has a row, whatever the tables hold of it
    names = tables.spark.range(1).select(F.explode(F.array(*map(F.lit, periods))).alias("which"))
    parts = (padded(names, ()), padded(_production(tables, periods, filters, settings), _PARTS[0]),
             padded(_traffic(tables, periods, filters, settings), _PARTS[1]))
    rows = reduce(DataFrame.unionByName, parts).groupBy("which").agg(*[F.max(c).alias(c) for c in _PARTS[0] + _PARTS[1]])
    return _finish(rows)


# B10
def kpis(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """One row of KPIs; NULL becomes 0, minutes = seconds / 60, visits per note = visits / max(notes, 1)."""
    return kpi_rows(tables, {"current": period}, filters, settings).drop("which")


# B11
def kpis_previous_period(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    return kpis(tables, period.previous(), filters, settings)


# B12
def kpi_change(rows: DataFrame) -> DataFrame:
    """Long form of the rows ``current`` and ``previous`` of ``kpi_rows``: one row per KPI with both
    values, percent change and direction.

    0 and 'neutral' when the previous value is 0 or NULL; a change >= 0 is positive.
    """
    def value(which: str, k: str) -> Column:
        return F.max(F.when(F.col("which") == which, F.col(k).cast("double"))).alias(f"{which}_{k}")

    one = rows.agg(*[value(w, k) for k in KPI_COLUMNS for w in ("current", "previous")])
    triples = ", ".join(f"'{k}', current_{k}, previous_{k}" for k in KPI_COLUMNS)
    long = one.select(F.expr(f"stack({len(KPI_COLUMNS)}, {triples}) AS (kpi, current_value, previous_value)"))
    prev = F.col("previous_value")
    no_base = prev.isNull() | (prev == 0)
    change = (F.col("current_value") - prev) / prev * F.lit(100.0)
    return long.select(
        "kpi", "current_value", "previous_value",
        F.when(no_base, F.lit(0.0)).otherwise(change).alias("change_pct"),
        F.when(no_base, F.lit("neutral")).when(change >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
    )


def kpi_comparison(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """The KPI rows of a period (``current``) and of the one before it (``previous``)."""
    return kpi_rows(tables, {"current": period, "previous": period.previous()}, filters, settings)


def kpi_change_for(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    return kpi_change(kpi_comparison(tables, period, filters, settings))
