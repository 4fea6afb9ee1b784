"""The whole page computes in both modes; the CLI writes every result."""

import os
import tempfile

from presswork.__main__ import main
from presswork.params import Filters
from presswork.plans.catalog import QueryParams
from presswork.plans.page import dashboard_page, resolve_period
from tests.conftest import SMALL_SF


def test_page_all_and_author(spark, sf_tables):
    qp = QueryParams()
    for f in (Filters(), Filters(section=qp.section, country=qp.country), Filters(author=qp.author)):
        page = dashboard_page(sf_tables, qp.period, f)
        counts = {k: df.count() for k, df in page.items()}
        assert counts["kpis"] == 1 and counts["kpi_change"] == 10


def test_default_period_is_last_seven_days(sf_tables):
    p = resolve_period(sf_tables)
    assert p.days == 7


def test_cli_writes_the_page(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="presswork-page-"), "page")
    main(["--data", SMALL_SF, "--out", out, "--author", QueryParams().author])
    assert {"kpis", "article_export", "daily_series", "insights"} <= set(os.listdir(out))


def test_refresh_drops_scopes_and_tables(spark, sf_tables):
    from presswork.operators import ownership as own
    from presswork.plans.page import refresh
    from presswork.sources import tables as T

    qp = QueryParams()
    scope = own.scope_for(sf_tables.editorial, qp.period, qp.author)
    refresh()
    assert not own._SCOPES and not T._CACHE and scope.roles.is_cached is False


def test_cli_needs_both_dates():
    import pytest

    with pytest.raises(SystemExit):
        main(["--data", SMALL_SF, "--out", "/nonexistent", "--start", "2024-01-08"])


def test_page_computes_shared_results_once_and_releases_them(spark, sf_tables):
    from tests.test_plans import plan_lines

    qp = QueryParams()
    for f in (Filters(), Filters(author=qp.author)):
        with dashboard_page(sf_tables, qp.period, f) as page:
            kept = list(page.kept)
            for group in (("kpis", "kpi_cards", "kpi_change"), ("daily_series", "trend"), ("articles", "article_export"),
                          ("productivity", "insights"), ("filter_authors", "author_lookup")):
                for name in group:
                    lines = plan_lines(page[name])
                    assert any("InMemoryTableScan" in x for x in lines), name
                    page[name].collect()
            assert all(df.is_cached for df in kept) and len(kept) == 5
        assert not page.kept and not any(df.is_cached for df in kept)


def test_page_equals_its_operators(spark, sf_tables):
    """What the page shares is what each operator gives alone."""
    from presswork.operators import kpis as K
    from presswork.operators import options as OPT
    from presswork.operators import reports as REP
    from presswork.operators import series as S

    qp = QueryParams()
    for f in (Filters(section=qp.section), Filters(author=qp.author)):
        with dashboard_page(sf_tables, qp.period, f) as page:
            series = S.daily_series(sf_tables, qp.period, f)
            alone = {"kpis": K.kpis(sf_tables, qp.period, f), "kpi_change": K.kpi_change_for(sf_tables, qp.period, f),
                     "kpi_cards": REP.kpi_cards(K.kpis(sf_tables, qp.period, f)),
                     "daily_series": S.trend_line(series, qp.period.start), "trend": S.trend_direction(series, qp.period.start),
                     "author_lookup": OPT.author_lookup(sf_tables, qp.period)}
            for name, df in alone.items():
                assert sorted(map(tuple, page[name].collect())) == sorted(map(tuple, df.collect())), name
            assert page["last_data_date"].columns == ["last_date", "last_date_label"]
