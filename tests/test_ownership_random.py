"""Random small event logs: the aggregate-form ownership equals a brute force of the
reference's window / NOT IN semantics (ties on time, NULL and empty editors, NULL urls)."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from presswork.operators import ownership as O
from presswork.params import Period
from presswork.sources.tables import SCHEMAS
from tests.test_skew import brute_author_notes

P = Period(dt.date(2024, 1, 8), dt.date(2024, 1, 21))
A = "a@x"
TIMES = [dt.datetime(2024, 1, d, 12) for d in (5, 8, 10, 21, 22)]

row = st.tuples(
    st.integers(0, 4),
    st.sampled_from([None, "/n/1", "/n/2"]),
    st.sampled_from([None, "", A, "b@x", "agency"]),
    st.sampled_from(["CREATE", "SAVE", "FIRST_PUBLISH", "UPDATE"]),
    st.sampled_from(TIMES),
)


def key(t, e, u):
    return (t, e is None, e or "", u is None, u or "")


def first_rows(df):
    df = df.copy()
    df["k"] = [key(t, e, u) for t, e, u in zip(df.event_timestamp, df.email_editor, df.story_url)]
    return df.sort_values("k").groupby("note_id").head(1)


def brute(pdf):
    day = pdf.event_timestamp.dt.date
    inp = (day >= P.start) & (day <= P.end)
    notes = brute_author_notes(pdf, P.start, P.end, A)
    published = set(pdf[(pdf.action_type == "FIRST_PUBLISH") & inp].note_id)
    with_create = set(pdf[pdf.action_type == "CREATE"].note_id)
    by = (pdf.email_editor == A) & pdf.story_url.notna() & inp
    direct = pdf[by & pdf.action_type.isin(["CREATE", "FIRST_PUBLISH"])]
    saves = first_rows(pdf[(pdf.action_type == "SAVE") & inp & pdf.story_url.notna()])
    saved = saves[(saves.email_editor == A) & ~saves.note_id.isin(with_create)]
    pairs = {(n, u) for n, u in zip(direct.note_id, direct.story_url)} | {(n, u) for n, u in zip(saved.note_id, saved.story_url)}
    urls = {u for n, u in pairs if n in published}
    creators = [(n, e) for n, e in zip(pdf[pdf.action_type == "CREATE"].note_id, pdf[pdf.action_type == "CREATE"].email_editor)]
    first_all = first_rows(pdf[pdf.action_type == "SAVE"])
    creators += [(n, e) for n, e in zip(first_all.note_id, first_all.email_editor) if n not in with_create]
    return notes, notes & published, urls, sorted(creators, key=repr)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=14))
def test_ownership_matches_brute_force(spark, rows):
    full = [(n, u, e, a, t, "s", None, "T", 1, 1) for n, u, e, a, t in rows]
    df = spark.createDataFrame(full, SCHEMAS["editorial_activity"])
    pdf = pd.DataFrame(rows, columns=["note_id", "story_url", "email_editor", "action_type", "event_timestamp"])
    pdf = pdf.astype(object).where(pdf.notna(), None)
    pdf["event_timestamp"] = pd.to_datetime(pdf.event_timestamp)
    notes, published, urls, creators = brute(pdf)
    assert {r.note_id for r in O.author_notes(df, P, A).collect()} == notes
    assert {r.note_id for r in O.author_published_notes(df, P, A).collect()} == published
    assert {r.story_url for r in O.author_published_urls(df, P, A).collect()} == urls
    got = sorted(((r.note_id, r.creator_email) for r in O.real_creators(df).collect()), key=repr)
    assert got == creators
