"""Hot keys: one note holds a third of all events and one editor a third of all actions.

Results are checked against a brute-force pandas version of the reference's
window / NOT IN semantics on the same (small) data.
"""


import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswork.operators import ownership as O
from presswork.operators import rankings as R
from presswork.plans.catalog import QueryParams
from presswork.sources.tables import Tables

QP = QueryParams()
HOT_NOTE = -1


@pytest.fixture(scope="module")
def skewed(sf_tables):
    e = sf_tables.editorial
    h = F.abs(F.xxhash64("note_id", "event_timestamp")) % 3
    e = e.withColumn("note_id", F.when(h == 0, F.lit(HOT_NOTE).cast("bigint")).otherwise(F.col("note_id")))
    e = e.withColumn("email_editor", F.when(h == 1, F.lit(QP.author)).otherwise(F.col("email_editor")))
    return Tables(e, sf_tables.traffic_daily, sf_tables.traffic_clean, sf_tables.traffic_dimensions, sf_tables.authors)


def brute_author_notes(pdf: pd.DataFrame, start, end, author):
    day = pdf.event_timestamp.dt.date
    inp = (day >= start) & (day <= end)
    by = pdf.email_editor == author
    created = set(pdf[by & (pdf.action_type == "CREATE") & inp].note_id)
    published = set(pdf[by & (pdf.action_type == "FIRST_PUBLISH") & inp].note_id)
    saves = pdf[(pdf.action_type == "SAVE") & inp].copy()
    saves["k"] = [(t, e is None, e or "", u is None, u or "") for t, e, u in
                  zip(saves.event_timestamp, saves.email_editor, saves.story_url)]
    first = saves.sort_values("k").groupby("note_id").head(1)
    with_create = set(pdf[pdf.action_type == "CREATE"].note_id)
    first_saved = set(first[(first.email_editor == author) & ~first.note_id.isin(with_create)].note_id)
    return created | published | first_saved


def test_hot_note_and_editor_ownership(skewed):
    pdf = skewed.editorial.toPandas()
    assert (pdf.note_id == HOT_NOTE).mean() > 0.25 and (pdf.email_editor == QP.author).mean() > 0.25
    got = {r.note_id for r in O.author_notes(skewed.editorial, QP.period, QP.author).collect()}
    assert got == brute_author_notes(pdf, QP.period.start, QP.period.end, QP.author)


def test_hot_note_real_creators(skewed):
    pdf = skewed.editorial.toPandas()
    creates = pdf[pdf.action_type == "CREATE"][["note_id", "email_editor"]]
    saves = pdf[pdf.action_type == "SAVE"].copy()
    saves["k"] = [(t, e is None, e or "", u is None, u or "") for t, e, u in
                  zip(saves.event_timestamp, saves.email_editor, saves.story_url)]
    first = saves.sort_values("k").groupby("note_id").head(1)
    first = first[~first.note_id.isin(set(creates.note_id))][["note_id", "email_editor"]]
    want = sorted(map(tuple, pd.concat([creates, first]).astype(object).where(lambda x: x.notna(), None).values.tolist()),
                  key=repr)
    got = sorted(((r.note_id, r.creator_email) for r in O.real_creators(skewed.editorial).collect()), key=repr)
    assert got == want


def test_hot_editor_top_publishers(skewed):
    pdf = skewed.editorial.toPandas()
    day = pdf.event_timestamp.dt.date
    fp = pdf[(pdf.action_type == "FIRST_PUBLISH") & (day >= QP.period.start) & (day <= QP.period.end)
             & pdf.email_editor.notna() & (pdf.email_editor != "")]
    top = R.top_publishers(skewed, QP.period, limit=1).collect()[0]
    assert top.publisher.lower().startswith("author") or top.publisher == QP.author
    assert top.published_notes == int((fp.email_editor == QP.author).sum())


@pytest.mark.parametrize("hot", ["null_urls", "one_url"])
def test_hot_urls_of_source_efficiency(spark, sf_tables, hot):
    """A third of the published notes without url, or with one url: the same figures as brute force, and the
    rows without url are dealt out over the join's tasks."""
    from presswork.operators import production as P

    e = sf_tables.editorial
    h = F.pmod(F.xxhash64("note_id", "event_timestamp"), F.lit(3)) == 0
    url = F.lit(None).cast("string") if hot == "null_urls" else F.lit("/n/1")
    t = Tables(e.withColumn("story_url", F.when(h, url).otherwise(F.col("story_url"))), sf_tables.traffic_daily,
               sf_tables.traffic_clean, sf_tables.traffic_dimensions, sf_tables.authors)
    got = {r.source_class: (r.notes, r.sessions) for r in P.source_efficiency(t, QP.period).collect()}
    pdf, g = t.editorial.toPandas(), t.traffic_daily.toPandas()
    day = pdf.event_timestamp.dt.date
    pub = pdf[(pdf.action_type == "FIRST_PUBLISH") & (day >= QP.period.start) & (day <= QP.period.end)].copy()
    assert (pub.story_url.isna() if hot == "null_urls" else pub.story_url == "/n/1").mean() > 0.25
    visits = g[(g.date >= QP.period.start) & (g.date <= QP.period.end)].groupby("article_url").visits.sum()
    source = pub.source.fillna("").str.lower()
    pub["cls"] = ["Agencies" if (x or "").lower() == "agency" else "Tool 2" if "editor-two" in s else "Tool 1" if "editor-one" in s else "Other"
                  for x, s in zip(pub.email_editor, source)]
    pub["visits"] = [int(visits.get(u, 0)) if u is not None else 0 for u in pub.story_url]
    want = {c: (x.note_id.nunique(), int(x.visits.sum())) for c, x in pub.groupby("cls") if c != "Other"}
    assert got == want


def test_rows_without_url_are_dealt_out(spark, sf_tables):
    from presswork.operators.production import _metrics
    from tests.test_plans import plan_text

    notes = sf_tables.editorial.selectExpr("note_id", "if(note_id % 3 = 0, story_url, null) as story_url", "'Tool 1' as source_class")
    per_url = sf_tables.traffic_daily.groupBy("article_url").agg(
        *[F.sum("visits").alias(c) for c in ("s_sessions", "s_pageviews", "s_scroll", "s_time")])
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        text = plan_text(_metrics(notes, per_url, QP.settings))
        assert "hashpartitioning(join_url" in text
        keyed = notes.selectExpr("coalesce(story_url, cast(note_id as string)) as join_url", "story_url is not null as has_url")
        rows = notes.count()
        sizes = [r["count"] for r in keyed.repartition(8, "join_url", "has_url").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) < 2 * rows / 8
