"""Counts FIXTURES.md states for the suggested author at sf0.01 (checked there in two engines)."""

import os

import pytest

from presswork.operators import ownership as O
from presswork.plans.catalog import QueryParams
from presswork.sources.tables import load_tables

SF001 = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF001), reason="sf0.01 driver tables not present")
def test_suggested_author_counts(spark):
    qp = QueryParams()
    e = load_tables(spark, SF001).editorial
    assert O.notes_created_by(e, qp.period, qp.author).count() == 9
    assert O.notes_published_by(e, qp.period, qp.author).count() == 7
    assert O.notes_first_saved_by(e, qp.period, qp.author).count() == 2
    assert O.author_notes(e, qp.period, qp.author).count() == 18


@pytest.mark.skipif(not os.path.exists(SF001), reason="sf0.01 driver tables not present")
def test_derived_tables_match_the_fixture_statement(spark):
    from pyspark.sql import functions as F

    t = load_tables(spark, SF001)
    assert [t.row_count(n) for n in ("editorial_activity", "traffic_daily", "traffic_clean",
                                     "traffic_dimensions", "authors")] == [10000, 41591, 41591, 60000, 1350]
    act = F.col("action_type")
    per = t.editorial.groupBy("note_id").agg(
        F.count_if(act == "SAVE").alias("saves"), F.count_if(act == "CREATE").alias("creates"),
        F.count_if(act == "FIRST_PUBLISH").alias("pubs"),
        F.count_distinct(F.when(act == "CREATE", F.col("email_editor"))).alias("creators"))
    row = per.agg(F.count_if((F.col("saves") > 0) & (F.col("creates") == 0)).alias("a"),
                  F.count_if(F.col("pubs") > 1).alias("b"), F.count_if(F.col("creators") > 1).alias("c")).collect()[0]
    assert (row.a, row.b, row.c) == (714, 435, 476)
