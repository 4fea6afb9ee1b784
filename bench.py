"""Benchmark: the dashboard's queries (all-newsroom page and one-author page).

Reads the driver tables of $BENCH_SF_DIR (default /root/testdata/sf0.1), derives the
five input tables and writes them once to the shared checkpoint folder (timed as
``prepare_tables``), then runs every headline query to completion through the
``noop`` sink on local[$BENCH_CPUS], each the median of ``REPEATS`` runs that share nothing, and
both whole pages once. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from presswork.operators.ownership import clear_scopes  # noqa: E402
from presswork.params import Filters  # noqa: E402
from presswork.plans.catalog import QueryParams, all_entries  # noqa: E402
from presswork.plans.page import dashboard_page  # noqa: E402
from presswork.session import build_session  # noqa: E402
from presswork.sources.fixtures import derive_tables  # noqa: E402

REPEATS = 5
HEADLINE = (
    # all-newsroom page
    "kpis", "kpis_previous_period", "kpi_change", "top_publishers", "top_creators", "traffic_by_dimension", "section_stats",
    "top_articles", "source_efficiency", "daily_traffic", "trend_line", "author_productivity_created",
    "filter_authors", "last_data_date",
    # same page with section + country filters
    "kpis_filtered", "traffic_by_dimension_filtered", "section_stats_filtered", "top_articles_filtered",
    # one-author page
    "author_kpis", "author_kpi_change", "author_top_publishers", "author_top_creators", "author_traffic_by_dimension",
    "author_section_stats", "author_top_articles", "author_source_efficiency", "author_daily_published",
    "author_publishers_productivity", "author_own_productivity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or list(HEADLINE)
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="presswork-bench", driver_memory="8g")

    t0 = time.perf_counter()
    tables = derive_tables(spark, sf_dir).materialize()
    prepare = time.perf_counter() - t0

    entries = all_entries()
    params = QueryParams()
    # untimed warm-up of the JVM code paths (an aggregate and a broadcast join); neither
    # query is a headline query and nothing they compute is kept
    for key in ("published_notes", "active_creators_country"):
        entries[key].build(tables, params).write.format("noop").mode("overwrite").save()

    times = {}
    for key in keys:
        runs = []
        for _ in range(REPEATS):
            clear_scopes()  # no run reads what the one before it kept
            df = entries[key].build(tables, params)
            t = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[key] = round(statistics.median(runs), 3)

    def whole_page(filters: Filters) -> float:
        clear_scopes()
        t = time.perf_counter()
        with dashboard_page(tables, params.period, filters, params.settings) as page:
            for df in page.values():
                df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    pages = {"page_sec": whole_page(params.filters()), "author_page_sec": whole_page(params.filters(author=True))}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "dashboard_queries_total", "value": total, "unit": "sec", "queries": times,
        "repeats": REPEATS, **pages, "prepare_tables_sec": round(prepare, 3), "sf": sf, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
