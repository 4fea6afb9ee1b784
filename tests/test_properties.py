"""Properties that hold between operators and the filter matrix (SURVEY 2.8)."""

import datetime as dt

import pytest

from presswork.operators import dimensions as D
from presswork.operators import kpis as K
from presswork.operators import ownership as O
from presswork.operators import productivity as PV
from presswork.operators import rankings as R
from presswork.operators import sections as SEC
from presswork.operators import series as S
from presswork.operators import options as OPT
from presswork.operators import production as PR
from presswork.plans.catalog import QueryParams
from presswork.params import Filters, Period

QP = QueryParams()
P, AUTHOR = QP.period, QP.author


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_author_notes_is_union_of_parts(sf_tables):
    e = sf_tables.editorial
    union = (O.notes_created_by(e, P, AUTHOR).union(O.notes_published_by(e, P, AUTHOR))
             .union(O.notes_first_saved_by(e, P, AUTHOR)).distinct())
    assert rows(O.author_notes(e, P, AUTHOR)) == rows(union)
    assert rows(O.author_notes(e, P, AUTHOR))


def test_published_author_notes_are_author_notes(sf_tables):
    e = sf_tables.editorial
    assert O.author_published_notes(e, P, AUTHOR).subtract(O.author_notes(e, P, AUTHOR)).count() == 0


def test_daily_published_adds_up_to_publish_rows(sf_tables):
    total = sum(r.value for r in S.daily_published(sf_tables, P).collect())
    fp = sf_tables.editorial.filter("action_type = 'FIRST_PUBLISH'").filter(P.covers("event_timestamp")).count()
    assert total == fp


def test_daily_traffic_adds_up_to_traffic_total(sf_tables):
    total = sum(r.value for r in S.daily_traffic(sf_tables, P).collect())
    assert total == K.traffic_totals(sf_tables, P).collect()[0].total_visits


def test_section_notes_equal_filtered_published_notes(sf_tables):
    for r in SEC.section_stats(sf_tables, P).collect():
        n = K.published_notes(sf_tables, P, Filters(section=r.section)).collect()[0][0]
        assert n == r.notes


@pytest.mark.parametrize("f", [Filters(section=QP.section), Filters(country=QP.country),
                               Filters(section=QP.section, country=QP.country)])
def test_filters_never_raise_production_counts(sf_tables, f):
    base = K._production_all(sf_tables, P, Filters(), QP.settings).collect()[0]
    filt = K._production_all(sf_tables, P, f, QP.settings).collect()[0]
    assert all(b >= a for a, b in zip(filt, base))


def test_previous_period():
    prev = P.previous()
    assert prev.days == P.days and prev.end == P.start - dt.timedelta(days=1)
    with pytest.raises(ValueError):
        Period(dt.date(2024, 1, 2), dt.date(2024, 1, 1))
    assert Period.last_days(dt.date(2024, 1, 21)).start == dt.date(2024, 1, 15)


# Filter matrix: cells where the reference ignores a filter; setting it must change nothing.
IGNORED = [
    ("B9 section+country", lambda t, f: K.author_daily_user_sum(t, P, f)),
    ("B14 section+country", lambda t, f: R.author_top_publishers(t, P, f)),
    ("B16 section+country", lambda t, f: R.author_top_creators(t, P, f)),
    ("B18 country", lambda t, f: S.author_daily_published(t, P, Filters(f.author, None, f.country))),
    ("B20 section+country", lambda t, f: S.author_daily_users(t, P, f)),
    ("B22 country", lambda t, f: S.author_daily_traffic(t, P, Filters(f.author, None, f.country))),
    ("B24 country", lambda t, f: SEC.author_section_stats(t, P, Filters(f.author, None, f.country))),
    ("B27 country", lambda t, f: D.author_traffic_by_dimension(t, P, Filters(f.author, None, f.country))),
    ("B37 country", lambda t, f: PR.author_source_efficiency(t, P, Filters(f.author, None, f.country))),
    ("B41 section+country", lambda t, f: PV.author_own_productivity(t, P, f)),
    ("B42 section+country", lambda t, f: PV.author_publishers_productivity(t, P, f)),
]


@pytest.mark.parametrize("name,op", IGNORED, ids=[n for n, _ in IGNORED])
def test_ignored_filter_changes_nothing(sf_tables, name, op):
    plain = Filters(author=AUTHOR)
    loaded = Filters(author=AUTHOR, section=QP.section, country=QP.country)
    assert rows(op(sf_tables, plain)) == rows(op(sf_tables, loaded))


def test_option_lists_ignore_filters_and_are_sorted(sf_tables):
    secs = [r.section for r in OPT.filter_sections(sf_tables, P).collect()]
    assert secs == sorted(secs) and "" not in secs
