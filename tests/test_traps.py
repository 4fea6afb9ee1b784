"""One hand-made table per semantic trap of the reference."""

import os
import tempfile

import pytest

from presswork.operators import dimensions as D
from presswork.operators import kpis as K
from presswork.operators import ownership as O
from presswork.operators import production as PR
from presswork.operators import rankings as R
from presswork.operators import series as S
from presswork.params import Filters, Period, Settings
from presswork.sources.tables import read_tables
from tests.fixtures import clean, d, ed, gold, make_tables, ts

P = Period(d(8), d(21))
A = "a@x"


def ids(df, col="note_id"):
    return sorted(r[col] for r in df.collect())


def test_null_note_id_in_create_does_not_empty_first_saved(spark):
    """NOT IN over a set holding NULL returns nothing; NULL note ids are dropped on load."""
    t = make_tables(spark, editorial=[
        ed(None, None, "z@x", "CREATE", ts(9)),
        ed(1, "/n/1", A, "SAVE", ts(10)),
    ])
    with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR", "/tmp")) as tmp:
        for name, frame in t.as_dict().items():
            frame.write.parquet(os.path.join(tmp, name))
        loaded = read_tables(spark, tmp)
        assert loaded.editorial.filter("note_id IS NULL").count() == 0
        assert ids(O.notes_first_saved_by(loaded.editorial, P, A)) == [1]


def test_first_save_in_period_differs_from_all_time(spark):
    """Ownership ranks SAVEs inside the period, the real creator over all time."""
    t = make_tables(spark, editorial=[
        ed(1, "/n/1", "x@x", "SAVE", ts(5)),
        ed(1, "/n/1", A, "SAVE", ts(10)),
    ])
    assert ids(O.notes_first_saved_by(t.editorial, P, A)) == [1]
    creators = {(r.note_id, r.creator_email) for r in O.real_creators(t.editorial).collect()}
    assert creators == {(1, "x@x")}


def test_url_form_drops_null_url_saves_before_ranking(spark):
    """With urls required another editor may become first."""
    t = make_tables(spark, editorial=[
        ed(2, None, "y@x", "SAVE", ts(9)),
        ed(2, "/n/2", A, "SAVE", ts(10)),
    ])
    assert ids(O.notes_first_saved_by(t.editorial, P, A)) == []
    pairs = {(r.note_id, r.story_url) for r in O.author_note_urls(t.editorial, P, A).collect()}
    assert pairs == {(2, "/n/2")}
    # the section form ranks all SAVEs: the first one (NULL url) is not the author's
    assert O.author_note_urls(t.editorial, P, A, require_url=False).count() == 0


def test_equal_timestamps_break_ties_by_editor_null_last(spark):
    """T4: ties on the timestamp go to the smaller editor; a NULL editor comes last."""
    t = make_tables(spark, editorial=[
        ed(3, "/n/3", "b@x", "SAVE", ts(10)),
        ed(3, "/n/3", None, "SAVE", ts(10)),
        ed(3, "/n/3", "a@x", "SAVE", ts(10)),
    ])
    first = O.first_saves_in_period(t.editorial, P).collect()
    assert [(r.note_id, r.email_editor) for r in first] == [(3, "a@x")]


def test_double_publish_fans_out_traffic_in_source_efficiency(spark):
    """A note published twice counts once as a note and twice in traffic."""
    t = make_tables(
        spark,
        editorial=[ed(4, "/n/4", "p@x", "FIRST_PUBLISH", ts(9)), ed(4, "/n/4", "p@x", "FIRST_PUBLISH", ts(11))],
        daily=[gold(10, "/n/4", 100)],
    )
    row = PR.source_efficiency(t, P).collect()
    assert [(r.source_class, r.notes, r.sessions) for r in row] == [("Tool 1", 1, 200)]
    days = {(r.day, r.value) for r in S.daily_published(t, P).collect()}
    assert days == {(d(9), 1), (d(11), 1)}


def test_editor_without_author_row_and_blank_editors(spark):
    t = make_tables(
        spark,
        editorial=[
            ed(5, "/n/5", "ghost@x", "FIRST_PUBLISH", ts(9)),
            ed(6, "/n/6", "", "FIRST_PUBLISH", ts(9)),
            ed(7, "/n/7", None, "FIRST_PUBLISH", ts(9)),
            ed(8, "/n/8", "agency", "FIRST_PUBLISH", ts(9)),
            ed(9, "/n/9", "Known@X", "FIRST_PUBLISH", ts(9)),
        ],
        authors=[("known@x", "Known Person", "Peru")],
    )
    rows = {(r.publisher, r.country, r.published_notes) for r in R.top_publishers(t, P).collect()}
    assert rows == {("ghost@x", None, 1), (Settings().agency_label, None, 1), ("Known Person", "Peru", 1)}
    # COUNT(DISTINCT) ignores NULL but counts ''
    assert K.active_publishers(t, P).collect()[0][0] == 4
    # country filter matches case-insensitively and drops editors without an author row
    only = R.top_publishers(t, P, Filters(country="peru")).collect()
    assert [(r.publisher, r.published_notes) for r in only] == [("Known Person", 1)]


def test_zero_visit_dimension_values_are_dropped(spark):
    t = make_tables(spark, dims=[
        (d(9), "/n/1", "geo", "ARGENTINA", 0),
        (d(9), "/n/1", "geo", "PERU", 3),
        (d(9), "/n/2", "geo", "PERU", 2),
    ])
    rows = [(r.dimension_value, r.total_visits, r.article_count) for r in D.traffic_by_dimension(t, P).collect()]
    assert rows == [("PERU", 5, 2)]


def test_empty_period_gives_a_row_of_zeros(spark):
    t = make_tables(spark, editorial=[ed(1, "/n/1", A, "CREATE", ts(1))], daily=[gold(2, "/n/1", 5)])
    row = K.kpis(t, Period(d(20), d(21))).collect()[0].asDict()
    assert row["published_notes"] == 0 and row["total_visits"] == 0 and row["visits_per_note"] == 0.0
    assert row["avg_time_minutes"] == 0.0


def test_one_day_series_has_no_trend(spark):
    t = make_tables(spark, daily=[gold(9, "/n/1", 5, publish=d(9))])
    series = S.daily_traffic(t, P)
    assert [r.trend for r in S.trend_line(series, P.start).collect()] == [None]
    assert S.trend_direction(series, P.start).collect()[0].direction is None


def test_trend_on_a_straight_line(spark):
    t = make_tables(spark, daily=[gold(day, f"/n/{day}", 10 * day, publish=d(8)) for day in range(8, 12)])
    fit = S.trend_direction(S.daily_traffic(t, P), P.start).collect()[0]
    assert fit.slope == pytest.approx(10.0) and fit.intercept == pytest.approx(80.0) and fit.direction == "up"


def test_daily_users_is_a_sum_not_a_distinct_count(spark):
    """The 'unique users' KPI adds daily users up."""
    t = make_tables(
        spark,
        daily=[gold(9, "/n/1", 5, publish=d(9)), gold(10, "/n/1", 5, publish=d(9))],
        clean_rows=[clean(9, "/n/1", 5, users=4), clean(10, "/n/1", 5, users=4)],
    )
    assert K.daily_user_sum(t, P).collect()[0][0] == 8


def test_default_period_without_data_ends_today(spark):
    import datetime as dt

    from presswork.operators import options as OPT

    t = make_tables(spark)
    row = OPT.default_period(t).collect()[0]
    assert row.end_date == dt.date.today() or (dt.date.today() - row.end_date).days <= 1
    assert (row.end_date - row.start_date).days == 6


def test_duplicate_author_emails_are_reported_and_fan_out(spark):
    from presswork.sources.quality import author_email_duplicates

    t = make_tables(
        spark,
        editorial=[ed(1, "/n/1", "dup@x", "FIRST_PUBLISH", ts(9))],
        authors=[("dup@x", "Dup One", "Peru"), ("DUP@x", "Dup Two", "Peru")],
    )
    dups = author_email_duplicates(t).collect()
    assert [(r.email_key, r.rows, r.spellings) for r in dups] == [("dup@x", 2, 2)]
    # The lookup fan-out is kept, one row per matching author
    rows = {(r.publisher, r.published_notes) for r in R.top_publishers(t, P).collect()}
    assert rows == {("Dup One", 1), ("Dup Two", 1)}


def test_dispatchers_follow_the_dashboard_choice(spark, sf_tables):
    from presswork.operators import productivity as PV
    from presswork.plans.catalog import QueryParams

    qp = QueryParams()
    a = Filters(author=qp.author)
    assert sorted(map(tuple, S.daily_series(sf_tables, qp.period, a, metric="notes").collect())) == \
        sorted(map(tuple, S.author_daily_published(sf_tables, qp.period, a).collect()))
    assert sorted(map(tuple, S.daily_series(sf_tables, qp.period, Filters(), metric="users").collect())) == \
        sorted(map(tuple, S.daily_users(sf_tables, qp.period).collect()))
    assert PV.productivity_for(sf_tables, qp.period, a, metric_type="published").columns == \
        ["author", "country", "notes", "sessions", "scroll_rate", "efficiency"]
    with pytest.raises(ValueError):
        S.daily_traffic(sf_tables, qp.period, metric="users; DROP TABLE x")


def test_clean_gold_join_as_aggregation_keeps_join_semantics(spark):
    """A duplicated Gold row doubles the users (join fan-out); pairs present on one side
    only contribute nothing and produce no day."""
    t = make_tables(
        spark,
        daily=[gold(9, "/n/1", 5, publish=d(9)), gold(9, "/n/1", 6, publish=d(9)),   # duplicated (url, day)
               gold(10, "/n/2", 5, publish=d(9))],                                    # no clean row
        clean_rows=[clean(9, "/n/1", 5, users=4), clean(11, "/n/3", 5, users=7)],     # /n/3 has no Gold row
    )
    assert K.daily_user_sum(t, P).collect()[0][0] == 8
    assert [(r.day, r.value) for r in S.daily_users(t, P).collect()] == [(d(9), 8)]


def test_trend_skips_days_without_value(spark):
    import datetime as dt

    from presswork.operators.series import trend_direction

    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(i), v) for i, v in enumerate((10, 20, None, 40))]
    fit = trend_direction(spark.createDataFrame(rows, "day date, value long"), day).first()
    assert (fit.points, fit.slope, fit.intercept, fit.direction) == (3, 10.0, 10.0, "up")
