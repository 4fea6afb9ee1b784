"""Stored tables: each written when a query asks for it, the same rows as the derived ones."""

import pytest

from presswork.plans.catalog import QueryParams, all_entries
from presswork.sources.fixtures import derive_tables

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key,reads", [
    ("author_published_note_count", {"editorial_activity"}),
    ("author_lookup", {"editorial_activity", "authors"}),
    ("top_publishers_filtered", {"editorial_activity", "authors"}),
    ("daily_users_country", {"traffic_daily", "traffic_clean", "authors"})])
def test_a_query_stores_the_tables_it_reads(spark, key, reads):
    from presswork.operators.ownership import clear_scopes
    from presswork.sources.tables import SCHEMAS, StoredTables

    derived = derive_tables(spark, SF001)
    tables = StoredTables(derived)
    got = all_entries()[key].build(tables, QueryParams()).collect()
    assert {name for name in SCHEMAS if tables.held(name) is not None} == reads
    assert got == all_entries()[key].build(derived, QueryParams()).collect()
    clear_scopes()


def test_stored_rows_are_the_derived_rows_and_events_are_dealt_without_texts(spark):
    derived = derive_tables(spark, SF001)
    stored = derived.materialize()
    for name, df in derived.as_dict().items():
        assert sorted(map(str, stored.table(name).collect())) == sorted(map(str, df.collect())), name
    plan = derived._dealt["editorial_activity"]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Title ") < plan.find("Sort") < plan.find("Repartition")  # from the top: texts, sort, deal
