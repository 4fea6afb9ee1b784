"""Text formats (C9-C11, C14) with the rounding decided once: exact decimals, half away from zero."""

import datetime as dt


from presswork.functions import formatting as FMT
from presswork.functions.columns import round_ratio
from presswork.functions.lookups import country_code, translate_country


def one(spark, col, value, schema):
    return spark.createDataFrame([(value,)], f"x {schema}").select(col.alias("y")).collect()[0].y


def test_compact_number(spark):
    cases = [(None, "0"), (0, "0"), (999, "999"), (1000, "1.0K"), (1250, "1.3K"), (1249, "1.2K"),
             (999949, "999.9K"), (1000000, "1.0M"), (1250000, "1.3M"), (123456789, "123.5M")]
    for value, text in cases:
        assert one(spark, FMT.compact_number("x"), value, "bigint") == text, value
    assert one(spark, FMT.compact_number("x"), 999.5, "double") == "1,000"


def test_dotted_thousands(spark):
    assert one(spark, FMT.dotted_thousands("x"), 1234567, "bigint") == "1.234.567"
    assert one(spark, FMT.dotted_thousands("x"), None, "bigint") == "0"
    assert one(spark, FMT.dotted_thousands("x"), 1999.9, "double") == "1.999"
    assert one(spark, FMT.dotted_thousands("x", positive_only=True), 0, "bigint") == "-"


def test_percent_text(spark):
    assert one(spark, FMT.percent_text("x"), 0.123456, "double") == "12.35%"
    assert one(spark, FMT.percent_text("x"), None, "double") == "0.00%"
    assert one(spark, FMT.percent_text("x"), 1.0, "double") == "100.00%"


def test_date_label(spark):
    assert one(spark, FMT.date_label("x"), dt.date(2024, 1, 21), "date") == "21/01/2024"


def test_round_ratio_is_exact(spark):
    df = spark.createDataFrame([(1005, 1000), (2675, 1000), (1, 8), (5, 0)], "n bigint, d bigint")
    got = [r.r for r in df.select(round_ratio("n", "d", 2).alias("r")).collect()]
    assert got == [1.01, 2.68, 0.13, None]


def test_lookups(spark):
    df = spark.createDataFrame([("Mexico",), ("Atlantis",), (None,)], "c string")
    assert [r.t for r in df.select(translate_country("c").alias("t")).collect()] == ["México", "Atlantis", None]
    df = spark.createDataFrame([("america",), ("Peru",), (None,)], "c string")
    assert [r.t for r in df.select(country_code("c").alias("t")).collect()] == ["AM", "🇵🇪", ""]


def test_minutes_and_grouped_counts(spark):
    assert one(spark, FMT.minutes_text("x"), 3.25, "double") == "3.3 min"
    assert one(spark, FMT.minutes_text("x"), None, "double") == "0.0 min"
    assert one(spark, FMT.grouped_integer("x"), 1234567, "bigint") == "1,234,567"
