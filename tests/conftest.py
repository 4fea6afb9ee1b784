import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL_SF = os.environ.get("PRESSWORK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from presswork.session import checkpoint_dir, configure

    s = (
        SparkSession.builder.master("local[*]")
        .appName("presswork-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf_tables(spark):
    from presswork.sources.tables import load_tables

    return load_tables(spark, SMALL_SF)
