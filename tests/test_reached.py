"""Effects that the checked data reach seldom or never: every label, exclusions, duplicates, rounding ties."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from presswork.functions.columns import round_ratio
from presswork.functions.lookups import COUNTRY_CODES, COUNTRY_TRANSLATIONS
from presswork.operators import articles as A
from presswork.operators import dimensions as D
from presswork.params import Period, Settings
from presswork.plans.catalog import QueryParams, all_entries
from presswork.sources.quality import author_email_duplicates
from tests.fixtures import d, ed, gold, make_tables, ts

P = Period("2024-01-08", "2024-01-21")


def test_every_country_name_and_code(spark):
    rows = [("geo", k, 1, 1) for k in (*COUNTRY_TRANSLATIONS, "Atlantis", None, "")] + [("source", "Spain", 1, 1), (None, "Spain", 1, 1)]
    b = spark.createDataFrame(rows, "dimension_type string, dimension_value string, total_visits long, article_count long")
    got = [(r.dimension_type, r.dimension_value) for r in D.translate_values(b).collect()]
    want = [("geo", v) for v in (*COUNTRY_TRANSLATIONS.values(), "Atlantis", None, "")] + [("source", "Spain"), (None, "Spain")]
    assert got == want
    names = [n for k in COUNTRY_CODES for n in (k, k.lower(), k.capitalize())]
    c = spark.createDataFrame([(n,) for n in (*names, "nowhere", None, "")], "country string")
    assert [r.country_code for r in D.with_country_code(c).collect()] == [COUNTRY_CODES[n.upper()] for n in names] + ["", "", ""]


def test_boilerplate_titles_and_urls_are_dropped(spark):
    t = make_tables(spark, daily=[
        gold(9, "/n/1", 10), gold(9, "/n/2", 9, title="Daily HOROSCOPE"), gold(9, "/Homepage/x", 8), gold(9, "/n/3", 7, title="horoscope?"),
        gold(9, "/n/4", 6, section=None), gold(9, "/n/5", 5, title="")])
    names = lambda s: [r.url for r in A.top_articles(t, P, settings=s).collect()]
    assert names(Settings()) == ["/n/1", "/n/2", "/n/3"]
    assert names(Settings(exclude_title_patterns=("horoscope",))) == ["/n/1"]
    assert names(Settings(exclude_url_patterns=("/N/1", "/n/3"))) == ["/n/2", "/Homepage/x"]


def test_excluding_query_drops_rows(sf_tables):
    qp = QueryParams()
    kept = {r.url for r in all_entries()["top_articles_excluded"].build(sf_tables, qp).collect()}
    assert kept and not any("/n/2" in u for u in kept)
    assert {r.url for r in all_entries()["top_articles"].build(sf_tables, qp).collect()} - kept


def test_email_duplicates(spark):
    t = make_tables(spark, authors=[("A@x", "Ann", None), ("a@X", "Ann", "AMERICA"), ("b@x", "Ben", None), ("b@x", "Ben", None), ("c@x", "C", None),
                                    (None, "N", None), (None, "N", None)])
    assert sorted(map(tuple, author_email_duplicates(t).collect())) == [("a@x", 2, 2), ("b@x", 2, 1)]


def test_rounding_is_half_up_on_the_true_ratio(spark):
    rnd = random.Random(3)
    rows = [(n, k) for n, k in ((1, 8), (3, 8), (5, 1000), (15, 1000), (1, 3), (2, 3), (0, 5), (7, 0), (10 ** 12 + 5, 10 ** 3))]
    rows += [(rnd.randint(0, 10 ** 9), rnd.randint(1, 10 ** rnd.randint(1, 6))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "n long, d long")
    for digits in (0, 2, 3):
        got = [r.v for r in df.select(round_ratio("n", "d", digits).alias("v")).collect()]
        for (n, k), v in zip(rows, got, strict=True):
            want = None if k == 0 else float(int(Fraction(n, k) * 10 ** digits + Fraction(1, 2))) / 10 ** digits
            assert v == want


@pytest.mark.parametrize("key", ["author_source_efficiency_own_section", "translate_country_names"])
def test_queries_reach_their_effect(spark, key):
    """At the scale that the results are compared at."""
    from presswork.sources.tables import load_tables

    qp = QueryParams()
    got = all_entries()[key].build(load_tables(spark, "/root/testdata/sf0.01"), qp)
    if key == "translate_country_names":
        assert len({"México", "España", "Perú", "Brasil", "Alemania", "Francia"} & {r.dimension_value for r in got.collect()}) == 6
    else:
        assert got.count() > 0


def test_kpi_periods_do_not_mix(spark):
    """A row counts for the period it falls in; Gold rows published in the other period for none; the
    rows of an empty period are zeros."""
    from presswork.operators import kpis as K
    from tests.fixtures import clean

    t = make_tables(
        spark,
        editorial=[ed(1, "/n/1", "a@x", "CREATE", ts(9)), ed(1, "/n/1", "a@x", "CREATE", ts(2)), ed(2, None, None, "FIRST_PUBLISH", ts(3)),
                   ed(1, "/n/1", "b@x", "FIRST_PUBLISH", ts(10)), ed(1, "/n/1", "b@x", "FIRST_PUBLISH", ts(11)),
                   ed(3, "/n/3", "b@x", "FIRST_PUBLISH", ts(25))],
        daily=[gold(9, "/n/1", 100), gold(9, "/n/1", 50), gold(9, "/n/2", 7, publish=d(2)), gold(2, None, 5), gold(3, "/n/9", 3, publish=d(9))],
        clean_rows=[clean(9, "/n/1", 11), clean(9, "/n/2", 4), clean(2, None, 9), clean(9, None, 2)])
    now, before = Period("2024-01-08", "2024-01-14"), Period("2024-01-01", "2024-01-07")
    rows = {r.which: r.asDict() for r in K.kpi_rows(t, {"current": now, "previous": before}).collect()}
    assert [rows["current"][k] for k in ("active_creators", "active_publishers", "published_notes", "total_visits", "daily_user_sum")] == [1, 1, 1, 150, 20]
    assert [rows["previous"][k] for k in ("active_creators", "active_publishers", "published_notes", "total_visits", "daily_user_sum")] == [1, 0, 1, 5, 0]
    for which, p in (("current", now), ("previous", before)):
        assert K.kpis(t, p).first().asDict() == {k: v for k, v in rows[which].items() if k != "which"}
    empty = K.kpis(make_tables(spark), now).first()
    assert set(empty) == {0} and len(empty) == 10
    change = {r.kpi: (r.change_pct, r.direction) for r in K.kpi_change_for(t, now).collect()}
    assert change["total_visits"] == (2900.0, "positive") and change["active_publishers"] == (0.0, "neutral")
