"""The dashboard page as one set of lazy DataFrames (the reference's page load).

``dashboard_page`` returns every result the page shows for a period and filters,
the choices of its filters and the data date first; ``write_page`` writes them (parquet, plus CSV for
the article export). With an author filter the author operators share one
persisted ownership scope.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.formatting import date_label
from presswork.operators import articles as A
from presswork.operators import dimensions as D
from presswork.operators import kpis as K
from presswork.operators import options as OPT
from presswork.operators import production as PR
from presswork.operators import productivity as PV
from presswork.operators import rankings as R
from presswork.operators import reports as REP
from presswork.operators import sections as SEC
from presswork.operators import series as S
from presswork.params import Filters, Period, Settings
from presswork.sources.sinks import write_csv


def resolve_period(tables, start=None, end=None, days: int = 7) -> Period:
    """The given period, or the ``days`` days ending at the last data date (one small aggregate)."""
    if start and end:
        return Period(start, end)
    row = OPT.default_period(tables, days).collect()[0]
    return Period(row.start_date, row.end_date)


class Page(dict):
    """The page's results by name, and the small frames that several of them read.

    These are computed once, kept (memory, spilling to disk; rebuilt from lineage if an executor is lost)
    and given back by ``release``, or at the end of a ``with`` block."""

    def __init__(self):
        super().__init__()
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.kept[-1]

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def __enter__(self) -> "Page":
        return self

    def __exit__(self, *error) -> None:
        self.release()


def dashboard_page(tables, period: Period, filters: Filters = Filters(), settings: Settings = Settings(),
                   series_metric: str = "visits", productivity_metric: str = "created") -> Page:
    """Every result of the page. What two results share (both periods' KPI rows, the fitted series,
    the article and productivity tables, the choices of authors) is computed once."""
    author = filters.author is not None
    page = Page()
    geo = (D.author_traffic_by_dimension(tables, period, filters, settings) if author
           else D.traffic_by_dimension_filtered(tables, period, filters, settings)
           if (filters.section or filters.country) else D.traffic_by_dimension(tables, period, settings))
    series = page.keep(S.with_fit(S.daily_series(tables, period, filters, settings, series_metric), period.start))
    articles = page.keep((A.author_top_articles if author else A.top_articles)(tables, period, filters, settings))
    productivity = page.keep(PV.productivity_for(tables, period, filters, settings, productivity_metric))
    kpi_rows = page.keep(K.kpi_comparison(tables, period, filters, settings))
    kpis = kpi_rows.filter(F.col("which") == "current").drop("which")
    choices = page.keep(OPT.filter_authors(tables, period, settings))
    last = OPT.last_data_date(tables)
    page |= {
        # what the filters offer
        "filter_authors": choices,
        "filter_sections": OPT.filter_sections(tables, period),
        "filter_countries": OPT.filter_countries(tables, period),
        "author_lookup": OPT.author_lookup(tables, period, settings, choices),
        "last_data_date": last.select("last_date", date_label("last_date").alias("last_date_label")),
        # results
        "kpis": kpis,
        "kpi_cards": REP.kpi_cards(kpis),
        "kpi_change": K.kpi_change(kpi_rows),
        "top_publishers": D.with_country_code(
            (R.author_top_publishers if author else R.top_publishers)(tables, period, filters, settings)),
        "top_creators": D.with_country_code(
            (R.author_top_creators if author else R.top_creators)(tables, period, filters, settings)),
        "dimensions": D.translate_values(D.top_values_per_dimension(geo, settings)),
        "daily_series": S.trend_line(series, period.start, fitted=series),
        "trend": S.trend_direction(series, period.start, fitted=series),
        "sections": REP.section_report(
            (SEC.author_section_stats if author else SEC.section_stats)(tables, period, filters, settings)),
        "source_efficiency": PR.rank_sources(
            (PR.author_source_efficiency if author else PR.source_efficiency)(tables, period, filters, settings)),
        "productivity": productivity,
        "insights": PV.author_insights(productivity),
        "articles": articles,
        "article_export": REP.article_export(articles),
    }
    return page


def write_page(page: Page, folder: str, parallelism: int = 4) -> None:
    """Write every result and release what the page kept; the writes are independent Spark jobs submitted
    from a few threads so that their small stages overlap on the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    def write(item):
        name, df = item
        if name == "article_export":
            write_csv(df, os.path.join(folder, name))
        else:
            df.write.mode("overwrite").parquet(os.path.join(folder, name))

    with page, ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(write, page.items()))


def refresh() -> None:
    """Drop cached tables and author scopes, as the dashboard's refresh button clears its cache."""
    from presswork.operators.ownership import clear_scopes
    from presswork.sources.tables import clear_cache

    clear_scopes()
    clear_cache()
