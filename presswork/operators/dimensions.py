"""Traffic by dimension (B25-B27) and the client-side steps on it.

Scale: traffic is summed per (url, type, value) before the url filter joins it
(the days collapse), a hot dimension value is combined map-side, and the per-type
top values (the only window) run over the bounded top-100 list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.columns import join_authors, present
from presswork.functions.lookups import country_code, translate_country
from presswork.operators import ownership as own
from presswork.params import FIRST_PUBLISH, Filters, Period, Settings

DEFAULT = Settings()


def _per_article(d: DataFrame) -> DataFrame:
    """Visits per (url, type, value): collapses the days before any join, and turns the
    later COUNT(DISTINCT url) into a plain count (NULL urls are not counted)."""
    return d.groupBy("article_url", "dimension_type", "dimension_value").agg(F.sum("visits").alias("visits"))


def _breakdown(per_article: DataFrame, limit: int) -> DataFrame:
    out = per_article.groupBy("dimension_type", "dimension_value").agg(
        F.sum("visits").alias("total_visits"),
        F.count("article_url").alias("article_count"),
    ).filter(F.col("total_visits") > 0)
    return out.orderBy(
        F.col("total_visits").desc(), F.col("dimension_type").asc_nulls_first(), F.col("dimension_value").asc_nulls_first()
    ).limit(limit)


# B25
def traffic_by_dimension(tables, period: Period, settings: Settings = DEFAULT) -> DataFrame:
    """Visits and distinct articles per (type, value), raw scan of the period, top 100."""
    d = _per_article(tables.traffic_dimensions.filter(period.covers_date("event_date")))
    return _breakdown(d, settings.dimension_limit)


def _published_urls(tables, period, section) -> DataFrame:
    e = tables.editorial.filter(
        (F.col("action_type") == FIRST_PUBLISH) & period.covers("event_timestamp") & present("story_url")
    )
    if section is not None:
        e = e.filter(F.col("segment") == F.lit(section))
    return e


# B26
def traffic_by_dimension_filtered(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """As B25 over the urls FIRST_PUBLISHed in the period that pass the section and country filters."""
    e = join_authors(_published_urls(tables, period, filters.section), "email_editor", tables, settings,
                     filters.country, always=False)
    urls = e.select("story_url").distinct()
    d = _per_article(tables.traffic_dimensions.filter(period.covers_date("event_date")))
    return _breakdown(d.join(urls, d.article_url == urls.story_url, "left_semi"), settings.dimension_limit)


# B27
def author_traffic_by_dimension(tables, period: Period, filters: Filters, settings: Settings = DEFAULT) -> DataFrame:
    """As B26 over the author's published urls (the country filter does not apply)."""
    author_urls = own.scope_for(tables.editorial, period, filters.author).published_urls
    e = _published_urls(tables, period, filters.section)
    urls = e.join(author_urls, "story_url", "left_semi").select("story_url").distinct()
    d = _per_article(tables.traffic_dimensions.filter(period.covers_date("event_date")))
    return _breakdown(d.join(urls, d.article_url == urls.story_url, "left_semi"), settings.dimension_limit)


# C3
def top_values_per_dimension(breakdown: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Top values of every dimension type of a (bounded, top-100) breakdown, in one pass."""
    w = Window.partitionBy("dimension_type").orderBy(F.col("total_visits").desc(), F.col("dimension_value").asc_nulls_first())
    return breakdown.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= settings.per_dimension_top)


# C4
def dimension_types(breakdown: DataFrame) -> DataFrame:
    return breakdown.filter(F.col("dimension_type").isNotNull()).select("dimension_type").distinct().orderBy("dimension_type")


# C5
def translate_values(breakdown: DataFrame) -> DataFrame:
    """Country names of the ``geo`` type in the display language; other types unchanged."""
    v = F.col("dimension_value")
    return breakdown.withColumn(
        "dimension_value", F.when(F.col("dimension_type") == "geo", translate_country(v)).otherwise(v)
    )


# C6
def with_country_code(df: DataFrame, country_col: str = "country") -> DataFrame:
    return df.withColumn("country_code", country_code(country_col))
