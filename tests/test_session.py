"""Session sizing and the shared checkpoint folder."""

import inspect

from presswork.session import build_session, checkpoint_dir, configure, size_for_input
from presswork.sources.tables import SCHEMAS, read_tables, stored


def test_size_for_input(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                            "spark.sql.files.maxPartitionBytes")}
    try:
        assert size_for_input(spark, 10 * 1024 ** 2) == 200
        assert size_for_input(spark, 100 * 1024 ** 4) == 409_600
        assert size_for_input(spark, 1024 ** 4) == 4096
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4096"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_configure_and_checkpoint_dir(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert checkpoint_dir(spark)


def test_build_session_leaves_submit_settings_alone(spark):
    before = {k: spark.conf.get(k) for k in ("spark.master", "spark.sql.shuffle.partitions")}
    build_session()
    assert {k: spark.conf.get(k) for k in before} == before
    assert all(inspect.signature(build_session).parameters[k].default is None for k in ("master", "shuffle_partitions"))


def test_stored_tables_open_by_uri(spark, sf_tables, tmp_path):
    for name, df in sf_tables.as_dict().items():
        df.limit(5).write.parquet(str(tmp_path / name))
    for root in (f"file://{tmp_path}", str(tmp_path)):
        assert all(stored(spark, root, name) for name in SCHEMAS)
        assert read_tables(spark, root).authors.count() == 5
    assert stored(spark, f"file://{tmp_path}/nothing", "authors") is None


def test_loaded_tables_follow_their_files(spark, sf_tables, tmp_path):
    """A table that is written anew, appended to or replaced is seen by the same session, without refresh();
    what was kept of the old version is released."""
    from presswork.operators import ownership as own
    from presswork.operators.options import last_data_date
    from presswork.plans.catalog import QueryParams
    from presswork.sources.tables import load_tables

    qp, root = QueryParams(), f"file://{tmp_path}"
    for name, df in sf_tables.as_dict().items():
        df.write.parquet(f"{root}/{name}")
    first = load_tables(spark, root)
    rows = first.authors.count()
    scope = own.scope_for(first.editorial, qp.period, qp.author)
    assert load_tables(spark, root) is first and scope.roles.is_cached
    sf_tables.authors.limit(2).write.mode("append").parquet(f"{root}/authors")
    second = load_tables(spark, root)
    assert second is not first and second.authors.count() == rows + 2 and not scope.roles.is_cached
    late = sf_tables.traffic_daily.selectExpr("date_add(date, 400) as date", *[c for c in sf_tables.traffic_daily.columns if c != "date"])
    late.write.mode("overwrite").parquet(f"{root}/traffic_daily")
    assert last_data_date(load_tables(spark, root)).first().last_date.year == 2025
    assert load_tables(spark, root) is load_tables(spark, root)
