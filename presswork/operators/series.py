"""Daily series (B17-B22) and their least-squares trend.

Scale: a series is one grouping by day (at most one row per day of the period).
The trend is fitted from five exact integer sums over those few rows, carried beside each of them,
so that neither the series nor its source is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions.columns import join_authors
from presswork.operators.kpis import clean_gold_pairs
from presswork.operators import ownership as own
from presswork.params import DAILY_MEASURES, FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()
SERIES_METRICS = ("notes", "users") + DAILY_MEASURES


def _ordered(df: DataFrame) -> DataFrame:
    """By day in one partition: a row per day of the period needs no range exchange (nor the sampling for it)."""
    return df.repartition(1).sortWithinPartitions("day")


# B17
def daily_published(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """FIRST_PUBLISH rows per day (rows, not distinct notes)."""
    e = tables.editorial.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp"))
    if filters.section is not None:
        e = e.filter(F.col("segment") == F.lit(filters.section))
    e = join_authors(e, "email_editor", tables, settings, filters.country, always=False)
    return _ordered(e.groupBy(F.to_date("event_timestamp").alias("day")).agg(F.count(F.lit(1)).alias("value")))


# B18
def author_daily_published(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct author notes FIRST_PUBLISHed per day; the section filter applies, the country filter not."""
    ed = tables.editorial
    notes = own.scope_for(ed, period, filters.author).notes
    e = ed.filter((F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp"))
    if filters.section is not None:
        e = e.filter(F.col("segment") == F.lit(filters.section))
    e = e.select("note_id", F.to_date("event_timestamp").alias("day")).join(notes, "note_id", "left_semi")
    return _ordered(e.groupBy("day").agg(F.count_distinct("note_id").alias("value")))


def _gold(tables, period, filters, settings, publish_in_period=True, country=True) -> DataFrame:
    g = tables.traffic_daily.filter(period.covers_date("date"))
    if publish_in_period:
        g = g.filter(period.covers("publish_date"))
    if filters.section is not None:
        g = g.filter(F.col("section") == F.lit(filters.section))
    return join_authors(g, "creator_email", tables, settings, filters.country if country else None, always=False)


# B19
def daily_users(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT) -> DataFrame:
    """B8 per day: clean traffic joined to Gold on (url, date), done as one aggregation."""
    pairs = clean_gold_pairs(tables, period, filters, settings)
    return _ordered(pairs.groupBy("day").agg(F.sum("joined_users").alias("value")))


# B20
def author_daily_users(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    urls = own.scope_for(tables.editorial, period, filters.author).published_urls
    s = tables.traffic_clean.filter(period.covers_date("event_date"))
    s = s.join(urls, s.article_url == urls.story_url, "left_semi")
    return _ordered(s.groupBy(F.col("event_date").alias("day")).agg(F.sum("daily_users").alias("value")))


def _check_measure(metric: str) -> str:
    if metric not in DAILY_MEASURES:
        raise ValueError(f"unknown traffic measure {metric!r}; allowed: {DAILY_MEASURES}")
    return metric


# B21
def daily_traffic(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT,
                  metric: str = "visits") -> DataFrame:
    g = _gold(tables, period, filters, settings)
    return _ordered(g.groupBy(F.col("date").alias("day")).agg(F.sum(_check_measure(metric)).alias("value")))


# B22
def author_daily_traffic(tables, period: Period, filters: Filters, settings: Settings = DEFAULT,
                         metric: str = "visits") -> DataFrame:
    urls = own.scope_for(tables.editorial, period, filters.author).published_urls
    g = _gold(tables, period, filters, settings, publish_in_period=False, country=False)
    g = g.join(urls, g.article_url == urls.story_url, "left_semi")
    return _ordered(g.groupBy(F.col("date").alias("day")).agg(F.sum(_check_measure(metric)).alias("value")))


def daily_series(tables, period: Period, filters: Filters = Filters(), settings: Settings = DEFAULT,
                 metric: str = "visits") -> DataFrame:
    """The series the dashboard's metric choice selects (notes, users or a traffic measure)."""
    author = filters.author is not None
    if metric == "notes":
        return (author_daily_published if author else daily_published)(tables, period, filters, settings)
    if metric == "users":
        return (author_daily_users if author else daily_users)(tables, period, filters, settings)
    return (author_daily_traffic if author else daily_traffic)(tables, period, filters, settings, metric)


def with_fit(series: DataFrame, origin) -> DataFrame:
    """A (day, value) series with its least-squares fit beside every row: ``points``, ``slope`` and
    ``intercept`` on exact integers over the days with a value; x = days since ``origin``, y = value.

    The sums are taken over the whole series in the pass that puts it in order, so the series is
    computed once. It has one row per day of the period, in one task, and stays in that order.
    """
    x = F.datediff(F.col("day"), F.lit(origin)).cast("decimal(38,0)")
    y = F.col("value").cast("decimal(38,0)")
    given = F.col("value").isNotNull()
    whole = Window.partitionBy()

    def total(c):
        return F.sum(F.when(given, c)).over(whole)

    s = series.repartition(1).select("day", "value", F.count("value").over(whole).cast("decimal(38,0)").alias("n"),
                      total(x).alias("sx"), total(y).alias("sy"), total(x * x).alias("sxx"), total(x * y).alias("sxy"))
    den = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    slope = F.try_divide((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double"), den)
    intercept = F.try_divide((F.col("sy") * F.col("sxx") - F.col("sx") * F.col("sxy")).cast("double"), den)
    return s.select("day", "value", F.col("n").cast("bigint").alias("points"), F.round(slope, 6).alias("slope"),
                    F.round(intercept, 6).alias("intercept"))


# C1
def trend_line(series: DataFrame, origin, fitted: DataFrame | None = None) -> DataFrame:
    """Adds the OLS fitted value ``trend`` to a (day, value) series; NULL with fewer than 2 days.

    ``fitted`` is the series' ``with_fit`` frame where it is at hand."""
    x = F.datediff(F.col("day"), F.lit(origin)).cast("double")
    rows = with_fit(series, origin) if fitted is None else fitted
    return rows.select("day", "value", F.round(F.col("intercept") + F.col("slope") * x, 3).alias("trend")).sortWithinPartitions("day")


# C2
def trend_direction(series: DataFrame, origin, fitted: DataFrame | None = None) -> DataFrame:
    """One row: slope per day, intercept and 'up' when the slope is > 0, else 'down' (NULL without a fit)."""
    rows = with_fit(series, origin) if fitted is None else fitted
    # the fit is the same on every row; a series without rows has 0 points and no fit
    fit = rows.agg(F.coalesce(F.max("points"), F.lit(0).cast("bigint")).alias("points"), F.max("slope").alias("slope"),
                   F.max("intercept").alias("intercept"))
    return fit.select(
        "points", "slope", "intercept",
        F.when(F.col("slope").isNull(), F.lit(None).cast("string"))
        .when(F.col("slope") > 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
    )
