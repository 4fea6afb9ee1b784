"""Random inputs for the rewrites that differ most from the reference SQL: section tool counts
(pre-distinct instead of COUNT(DISTINCT CASE ...)) and the dimension breakdown (pre-aggregated
per url before the url join), each against a pandas brute force."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from presswork.operators import dimensions as D
from presswork.operators import sections as SEC
from presswork.params import Filters, Period, Settings
from tests.fixtures import make_tables

P = Period(dt.date(2024, 1, 8), dt.date(2024, 1, 21))
S = Settings()
DAYS = [dt.datetime(2024, 1, d, 9) for d in (7, 8, 15, 21, 22)]

fp_row = st.tuples(st.integers(0, 5), st.sampled_from([None, "", "s1", "s2"]),
                   st.sampled_from([None, "Editor-one v2", "EDITOR-TWO-bot", "wire", "editor-one+editor-two"]),
                   st.sampled_from(DAYS))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(fp_row, min_size=1, max_size=15))
def test_section_tool_counts(spark, rows):
    ed = [(n, f"/n/{n}", "e@x", "FIRST_PUBLISH", t, seg, src, "T", 1, 1) for n, seg, src, t in rows]
    t = make_tables(spark, editorial=ed)
    got = {(r.section, r.notes, r.tool1_notes, r.tool2_notes) for r in SEC.section_stats(t, P).collect()}
    df = pd.DataFrame(rows, columns=["note", "seg", "src", "ts"])
    df = df[(df.ts.dt.date >= P.start) & (df.ts.dt.date <= P.end) & df.seg.notna() & (df.seg != "")]
    want = set()
    for seg, g in df.groupby("seg"):
        low = g.src.fillna("").str.lower()
        want.add((seg, g.note.nunique(), g[low.str.contains("editor-one")].note.nunique(),
                  g[low.str.contains("editor-two")].note.nunique()))
    assert got == want


dim_row = st.tuples(st.sampled_from([dt.date(2024, 1, d) for d in (7, 9, 10, 21, 22)]),
                    st.sampled_from([None, "/n/1", "/n/2", "/n/3"]), st.sampled_from(["geo", "device"]),
                    st.sampled_from(["A", "B", None]), st.integers(0, 4))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(dim_row, min_size=1, max_size=15), st.sets(st.sampled_from(["/n/1", "/n/2", "/n/3"])))
def test_dimension_breakdown(spark, rows, published):
    ed = [(int(u[-1]), u, "e@x", "FIRST_PUBLISH", dt.datetime(2024, 1, 9), "s1", None, "T", 1, 1) for u in published]
    t = make_tables(spark, editorial=ed, dims=rows)
    df = pd.DataFrame(rows, columns=["d", "url", "type", "value", "visits"]).astype(object)
    df = df[(df.d >= P.start) & (df.d <= P.end)]

    def brute(frame):
        out = set()
        for (ty, va), g in frame.groupby(["type", "value"], dropna=False):
            va = None if pd.isna(va) else va
            total = int(g.visits.sum())
            if total > 0:
                out.add((ty, va, total, int(g.url.dropna().nunique())))
        return out

    plain = {tuple(r) for r in D.traffic_by_dimension(t, P).collect()}
    assert plain == brute(df)
    filtered = {tuple(r) for r in D.traffic_by_dimension_filtered(t, P, Filters(section="s1")).collect()}
    assert filtered == brute(df[df.url.isin(published)])


from presswork.operators import production as PR  # noqa: E402
from presswork.operators import rankings as R  # noqa: E402
from tests.fixtures import gold  # noqa: E402

pub_row = st.tuples(st.integers(0, 4), st.sampled_from([None, "", "a@x", "B@x", "agency", "c@x"]),
                    st.sampled_from(DAYS), st.sampled_from([None, "Editor-one v2", "editor-two", "wire"]))
author_row = st.tuples(st.sampled_from(["a@x", "A@X", "b@x"]), st.sampled_from(["Ann", "Bob", None]),
                       st.sampled_from(["Peru", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(pub_row, min_size=1, max_size=12), st.lists(author_row, max_size=4))
def test_top_publishers_keeps_lookup_fan_out(spark, rows, authors):
    ed = [(n, f"/n/{n}", e, "FIRST_PUBLISH", t, "s1", src, "T", 1, 1) for n, e, t, src in rows]
    t = make_tables(spark, editorial=ed, authors=authors)
    got = sorted((tuple(r) for r in R.top_publishers(t, P, limit=1000).collect()), key=repr)
    ev = pd.DataFrame(rows, columns=["note", "email", "ts", "src"])
    ev = ev[(ev.ts.dt.date >= P.start) & (ev.ts.dt.date <= P.end) & ev.email.notna() & (ev.email != "")]
    au = pd.DataFrame(authors, columns=["email", "name", "country"]).astype(object)
    counts = {}
    for email in ev.email:
        matches = [(nm, c) for em, nm, c in au.itertuples(index=False) if em.lower() == email.lower()] or [(None, None)]
        for name, country in matches:
            label = S.agency_label if email.lower() == "agency" else (name if name is not None else email)
            counts[(label, country)] = counts.get((label, country), 0) + 1
    assert got == sorted(((k[0], k[1], v) for k, v in counts.items()), key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(pub_row, min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 4), st.integers(7, 22),
                                                                      st.integers(0, 9)), max_size=10))
def test_source_efficiency_keeps_publish_fan_out(spark, rows, traffic):
    ed = [(n, f"/n/{n}", e, "FIRST_PUBLISH", t, "s1", src, "T", 1, 1) for n, e, t, src in rows]
    g = [gold(day, f"/n/{n}", v) for n, day, v in traffic]
    t = make_tables(spark, editorial=ed, daily=g)
    got = {(r.source_class, r.notes, r.sessions, r.pageviews) for r in PR.source_efficiency(t, P).collect()}
    ev = pd.DataFrame(rows, columns=["note", "email", "ts", "src"])
    ev = ev[(ev.ts.dt.date >= P.start) & (ev.ts.dt.date <= P.end)]
    tr = pd.DataFrame([(f"/n/{n}", day, v) for n, day, v in traffic], columns=["url", "day", "v"])
    tr = tr[(tr.day >= 8) & (tr.day <= 21)]

    def cls(email, src):
        s = (src or "").lower()
        if email is not None and email.lower() == "agency":
            return S.agency_class
        return S.tool2_label if "editor-two" in s else S.tool1_label if "editor-one" in s else S.other_class

    want = {}
    for note, email, _, src in ev.itertuples(index=False):
        c = cls(email, src)
        hits = tr[tr.url == f"/n/{note}"]
        entry = want.setdefault(c, [set(), 0, 0])
        entry[0].add(note)
        entry[1] += int(hits.v.sum())
        entry[2] += int((hits.v + 1).sum())
    assert got == {(c, len(n), s, pv) for c, (n, s, pv) in want.items() if c != S.other_class}


from presswork.operators import productivity as PV  # noqa: E402

prod_row = st.tuples(st.integers(0, 5), st.sampled_from([None, "/n/1", "/n/2", "/n/3"]),
                     st.sampled_from([None, "", "a@x", "B@x", "agency"]), st.sampled_from(["CREATE", "FIRST_PUBLISH"]),
                     st.sampled_from(DAYS))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(prod_row, min_size=3, max_size=16), st.lists(author_row, max_size=3),
       st.lists(st.tuples(st.integers(1, 3), st.integers(7, 22), st.integers(0, 9)), max_size=8))
def test_author_productivity(spark, rows, authors, traffic):
    ed = [(n, u, e, a, t, "s1", None, "T", 1, 1) for n, u, e, a, t in rows]
    g = [gold(day, f"/n/{n}", v) for n, day, v in traffic]
    t = make_tables(spark, editorial=ed, daily=g, authors=authors)
    got = sorted((tuple(r) for r in PV.author_productivity(t, P, metric_type="participated").collect()), key=repr)

    ev = pd.DataFrame(rows, columns=["note", "url", "email", "action", "ts"]).astype(object)
    ev = ev[[P.start <= x.date() <= P.end for x in ev.ts]]
    au = pd.DataFrame(authors, columns=["email", "name", "country"]).astype(object)
    tr = pd.DataFrame([(f"/n/{n}", d_, v, v // 2) for n, d_, v in traffic], columns=["url", "day", "v", "s"])
    tr = tr[(tr.day >= 8) & (tr.day <= 21)]
    groups = {}
    for note, _, email, _, _ in ev.itertuples(index=False):
        if email is None or email == "" or email.lower() == "agency":
            continue
        matches = [(nm, c) for em, nm, c in au.itertuples(index=False) if em.lower() == email.lower()] or [(None, None)]
        for name, country in matches:
            key = (email, name if name is not None else email, country if country is not None else S.unknown_country)
            groups.setdefault(key, set()).add(note)
    want = []
    for (email, name, country), notes in groups.items():
        if len(notes) < S.min_notes:
            continue
        urls = {u for u, e in zip(ev.url, ev.email) if e == email and u is not None}
        hits = tr[tr.url.isin(urls)]
        sessions, scrolls = int(hits.v.sum()), int(hits.s.sum())
        if sessions > 0:
            want.append((name, country, len(notes), sessions, scrolls / sessions, sessions / len(notes)))
    assert got == sorted(want, key=repr)
