"""The article export reaches CSV with a header and the formatted columns."""

import csv
import glob
import os
import tempfile

from presswork.operators import articles as A
from presswork.operators import reports as REP
from presswork.plans.catalog import QueryParams


def test_article_export_csv(spark, sf_tables):
    qp = QueryParams()
    out = os.path.join(tempfile.mkdtemp(prefix="presswork-csv-"), "articles")
    articles = A.top_articles(sf_tables, qp.period, qp.filters(), qp.settings)
    REP.export_articles_csv(articles, out)
    rows = []
    for part in sorted(glob.glob(os.path.join(out, "part-*.csv"))):
        with open(part, newline="", encoding="utf-8") as fh:
            rows += list(csv.DictReader(fh))
    assert len(rows) == articles.count() > 0
    assert list(rows[0]) == [label for _, label in REP.ARTICLE_COLUMNS]
    assert all(r["Scroll"].endswith("%") for r in rows)


def test_stored_tables_read_back_through_load_tables(spark, sf_tables):
    from presswork.operators import kpis as K
    from presswork.sources.tables import load_tables

    root = os.path.join(tempfile.mkdtemp(prefix="presswork-stored-"), "tables")
    stored = sf_tables.materialize(root)
    again = load_tables(spark, root)
    assert sorted(os.listdir(root)) == sorted(stored.as_dict())
    qp = QueryParams()
    a = K.kpis(sf_tables, qp.period).collect()
    b = K.kpis(again, qp.period).collect()
    assert a == b
