"""Every registered query against its DuckDB oracle text on the driver tables (small scale)."""

import pytest

from presswork.plans.catalog import all_entries
from tests.conftest import SMALL_SF
from tools.check_oracle import compare

import __spark_entry__ as se

KEYS = sorted(all_entries())


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(se.oracle_sql()) and set(se.oracle_sql()) <= set(se.queries())


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SMALL_SF, KEYS, verbose=False)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(results, key):
    status = results[key]
    assert status[0] == "ok", status


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert set(df.columns) >= {"active_creators", "published_notes", "total_visits", "visits_per_note"}


def test_entry_schema_is_stable(spark):
    assert se.entry(spark).schema == se.entry(spark).schema
