"""Compute the dashboard page and write it: ``python -m presswork --data DIR --out DIR [options]``."""

from __future__ import annotations

import argparse

from presswork.params import Filters
from presswork.plans.page import dashboard_page, resolve_period, write_page
from presswork.session import build_session, size_for_input
from presswork.sources.tables import load_tables


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="presswork", description=__doc__)
    ap.add_argument("--data", required=True, help="folder with the five tables, or with the driver tables")
    ap.add_argument("--out", required=True, help="output folder (parquet per result, CSV article export)")
    ap.add_argument("--start"), ap.add_argument("--end")
    ap.add_argument("--author"), ap.add_argument("--section"), ap.add_argument("--country")
    ap.add_argument("--series", default="visits", choices=["visits", "users", "notes", "pageviews", "scrolls"])
    ap.add_argument("--productivity", default="created", choices=["created", "published", "participated"])
    ap.add_argument("--master", default=None)
    ap.add_argument("--input-bytes", type=int, default=None, help="size shuffles for an input of this many bytes")
    a = ap.parse_args(argv)
    if bool(a.start) != bool(a.end):
        ap.error("give both --start and --end, or neither (the default is the last 7 days of data)")
    spark = build_session(a.master)
    if a.input_bytes:
        size_for_input(spark, a.input_bytes)
    tables = load_tables(spark, a.data)
    period = resolve_period(tables, a.start, a.end)
    page = dashboard_page(tables, period, Filters(a.author, a.section, a.country),
                          series_metric=a.series, productivity_metric=a.productivity)
    write_page(page, a.out)
    print(f"period {period.start}..{period.end}: wrote {len(page)} results to {a.out}")


if __name__ == "__main__":
    main()
