"""Plan checks: pushdown, broadcast of the author lookup, no Python in any plan."""

import contextlib
import io

import pytest

from presswork.plans.catalog import QueryParams, all_entries
from presswork.sources.fixtures import derive_tables

import __spark_entry__ as se

QP = QueryParams()


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
        df.explain("extended")
    return buf.getvalue()


@pytest.fixture(scope="module")
def materialized(spark):
    from tests.conftest import SMALL_SF

    return derive_tables(spark, SMALL_SF).materialize()


@pytest.mark.parametrize("key", sorted(all_entries()))
def test_no_python_in_plans(materialized, key):
    text = plan_text(all_entries()[key].build(materialized, QP))
    for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in text


@pytest.mark.parametrize("key", sorted(all_entries()))
def test_no_cross_or_nested_loop_joins(materialized, key):
    """One-row results are combined as scalar subqueries, never joined."""
    text = plan_text(all_entries()[key].build(materialized, QP))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Join Cross" not in text


def test_author_lookup_is_broadcast(materialized):
    text = plan_text(all_entries()["top_publishers"].build(materialized, QP))
    assert "BroadcastHashJoin" in text and "BroadcastExchange" in text


def test_period_reaches_the_scan(materialized):
    text = plan_text(all_entries()["published_notes"].build(materialized, QP))
    assert "GreaterThanOrEqual(event_timestamp,2024-01-08T00:00)" in text
    assert "LessThan(event_timestamp,2024-01-22T00:00)" in text


def test_traffic_period_prunes_date_partitions(materialized):
    text = plan_text(all_entries()["traffic_totals"].build(materialized, QP))
    parts = [line for line in text.splitlines() if line.startswith("PartitionFilters")]
    assert parts and any("2024-01-08" in line and "2024-01-21" in line for line in parts)


def test_scan_reads_only_used_columns(materialized):
    df = all_entries()["active_creators"].build(materialized, QP)
    read = [line for line in plan_text(df).splitlines() if line.startswith("ReadSchema")]
    assert read and all("title" not in line and "body_word_count" not in line for line in read)


def test_ownership_is_one_aggregate_not_a_window(materialized):
    text = plan_text(all_entries()["author_notes"].build(materialized, QP))
    assert "Window" not in text


def test_note_aggregate_combines_map_side(materialized):
    """A hot note never reaches one task whole: the per-note aggregate is partial before the shuffle."""
    text = plan_text(all_entries()["real_creators"].build(materialized, QP))
    assert "partial_max((action_type" in text and "partial_min(CASE WHEN" in text


def test_author_scope_is_shared_and_evicted(spark, materialized):
    from presswork.operators import ownership as own

    own._SCOPES.clear()
    a = own.scope_for(materialized.editorial, QP.period, QP.author)
    assert own.scope_for(materialized.editorial, QP.period, QP.author) is a
    assert a.roles.is_cached
    for i in range(own._SCOPE_LIMIT):
        own.scope_for(materialized.editorial, QP.period, f"other{i}@x")
    assert a.roles.is_cached is False and len(own._SCOPES) == own._SCOPE_LIMIT


def test_lookup_above_the_bound_is_shuffled_not_broadcast(spark, materialized):
    """The author lookup carries no hint. With Spark's size-based broadcast off (as for a lookup of
    many GB), the join is a shuffle (sort-merge) join and the results do not change."""
    from presswork.operators import rankings as R
    from presswork.params import Filters

    f = Filters(country=QP.country)
    hinted = sorted(map(tuple, R.top_publishers(materialized, QP.period, f, QP.settings).collect()))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        shuffled = R.top_publishers(materialized, QP.period, f, QP.settings)
        assert "SortMergeJoin" in plan_text(shuffled)
        assert sorted(map(tuple, shuffled.collect())) == hinted
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextlib.contextmanager
def settings(spark, **values):
    """Spark settings by their last name for a while."""
    keys = {k: next(n for n in SETTINGS if n.endswith("." + k)) for k in values}
    old = {n: spark.conf.get(n, None) for n in keys.values()}
    try:
        for k, n in keys.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


SETTINGS = ("spark.sql.maxMetadataStringLength", "spark.sql.autoBroadcastJoinThreshold",
           "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")


def plan_lines(df):
    """The physical plan line by line, subqueries included, with whole paths."""
    with settings(df.sparkSession, maxMetadataStringLength="4000"):
        return df._jdf.queryExecution().executedPlan().toString().splitlines()


def scans(df, table):
    return sum(line.count("FileScan") for line in plan_lines(df) if f"/{table}]" in line)


@pytest.mark.parametrize("key", ["kpis", "kpis_filtered", "kpi_change", "kpi_change_filtered"])
def test_kpis_have_no_expand(materialized, key):
    df = all_entries()[key].build(materialized, QP)
    assert "Expand" not in plan_text(df)


@pytest.mark.parametrize("key", ["kpis", "kpi_change"])
def test_kpis_read_each_table_once(materialized, key):
    """Also for two periods at once."""
    df = all_entries()[key].build(materialized, QP)
    assert [scans(df, t) for t in ("editorial_activity", "traffic_daily", "traffic_clean")] == [1, 1, 1]


@pytest.mark.parametrize("key", ["kpis_filtered", "daily_user_sum_filtered", "daily_users_filtered"])
def test_traffic_of_other_sections_is_not_shuffled(spark, materialized, key):
    """Clean traffic meets the filtered urls before its exchange: in a broadcast semi-join, and
    beyond a broadcast in a bloom filter right over the scan."""
    def before_exchange(df):
        """What stands between the scan of the clean traffic and the first exchange over it."""
        lines = plan_lines(df)
        at = next(i for i, x in enumerate(lines) if "FileScan" in x and "/traffic_clean]" in x)
        over, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-*|"))
        for x in reversed(lines[:at]):
            own = len(x) - len(x.lstrip(" :+-*|"))
            if own < depth:
                over, depth = [*over, x.strip(" :+-*")], own
        return "\n".join(over).split("Exchange")[0]

    assert "LeftSemi" in before_exchange(all_entries()[key].build(materialized, QP))
    with settings(spark, autoBroadcastJoinThreshold="-1", applicationSideScanSizeThreshold="0"):
        df = all_entries()[key].build(materialized, QP)
        assert "might_contain" in before_exchange(df)
        got = df.collect()
    assert got == all_entries()[key].build(materialized, QP).collect()


@pytest.mark.parametrize("key", ["trend_line", "author_trend_line", "trend_direction"])
def test_trend_computes_its_series_once(materialized, key):
    text = "\n".join(plan_lines(all_entries()[key].build(materialized, QP)))
    assert "Subquery" not in text.replace("SubqueryAdaptiveBroadcast", "") and "rangepartitioning" not in text


@pytest.mark.parametrize("key", ["author_section_stats", "author_source_efficiency", "author_publishers_productivity", "source_efficiency_filtered"])
def test_traffic_is_cut_to_the_urls_before_it_is_summed(materialized, key):
    """The semi-join stands below the partial sums."""
    lines = plan_lines(all_entries()[key].build(materialized, QP))
    table = "/traffic_daily]" if key.startswith("source") else "/traffic_clean]"
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and table in x)
    semi = max(i for i, x in enumerate(lines[:at]) if "LeftSemi" in x)
    partial = max(i for i, x in enumerate(lines[:at]) if "partial_sum" in x)
    assert partial < semi


def test_plans_start_no_job(spark, materialized):
    """Building and explaining a plan runs nothing; sizes are Spark's to know or to measure."""
    from presswork.operators.ownership import clear_scopes

    clear_scopes()
    sc = spark.sparkContext
    sc.setJobGroup("presswork-plans", "plans only")
    try:
        for key in sorted(all_entries()):
            all_entries()[key].build(materialized, QP)
        assert list(sc.statusTracker().getJobIdsForGroup("presswork-plans")) == []
    finally:
        sc._jsc.clearJobGroup()
