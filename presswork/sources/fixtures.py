"""Derive the five input tables from the driver's TPC-H-like tables.

The recipes are the ones in FIXTURES.md; every column here is computed by Spark
from ``events``, ``lineitem``, ``supplier``, ``customer``, ``nation`` and
``region``, so the work grows with those tables. The modulo rules of the recipe
(NULL urls, blank sections, the agency and blank editors, customers without an
author row) shape the edge cases of the data; no rule drops rows to make a query
cheaper, and every query reads all rows of the derived tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.joins import fixed_broadcast
from presswork.params import Settings
from presswork.sources.tables import SCHEMAS, Tables, conform

#: The driver tables that the recipes read.
SOURCES = ("events", "lineitem", "supplier", "customer", "nation", "region")

# Fixed values of the fixture recipe.
AGENCY_USER_MOD = 7      # user_id % 50 == 7 is the agency account
EMPTY_USER_MOD = 9       # user_id % 50 == 9 has an empty editor
EVENT_ACTIONS = {"signup": "CREATE", "click": "SAVE", "purchase": "FIRST_PUBLISH"}
OTHER_ACTION = "UPDATE"
SOURCES_BY_MOD4 = {0: "Editor-one v2", 1: "editor-two-bot", 2: "wire"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _url(note_id: Column) -> Column:
    return F.concat(F.lit("/n/"), note_id.cast("string"))


def _section(note_id: Column) -> Column:
    return (
        F.when(note_id % 17 == 0, F.lit(None).cast("string"))
        .when(note_id % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("section_"), (note_id % 7).cast("string")))
    )


def _source(note_id: Column) -> Column:
    m = note_id % 4
    out = F.lit(None).cast("string")
    for k in sorted(SOURCES_BY_MOD4, reverse=True):
        out = F.when(m == k, F.lit(SOURCES_BY_MOD4[k])).otherwise(out)
    return out


def _customer_email(n: Column) -> Column:
    return F.concat(F.lit("customer#"), F.lpad(n.cast("string"), 9, "0"))


def _jan_2024(day: Column) -> Column:
    return F.make_date(F.lit(2024), F.lit(1), day.cast("int"))


def editorial_activity(spark: SparkSession, sf_dir: str, settings: Settings = Settings(), by_time: bool = False) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).cast("bigint").alias("note_id"), "user_id", "event_type", "ts"
    )
    if by_time:  # as it is written: dealt and sorted before the texts are made, so that neither carries them
        e = e.repartitionByRange("ts").sortWithinPartitions("ts")
    n = F.col("note_id")
    u = F.col("user_id") % 50
    action = F.lit(OTHER_ACTION)
    for event_type, action_name in reversed(list(EVENT_ACTIONS.items())):
        action = F.when(F.col("event_type") == event_type, F.lit(action_name)).otherwise(action)
    df = e.select(
        n.alias("note_id"),
        F.when(n % 11 == 0, F.lit(None).cast("string")).otherwise(_url(n)).alias("story_url"),
        F.when(u == AGENCY_USER_MOD, F.lit(settings.agency_editor))
        .when(u == EMPTY_USER_MOD, F.lit(""))
        .otherwise(_customer_email(F.col("user_id")))
        .alias("email_editor"),
        action.alias("action_type"),
        F.col("ts").alias("event_timestamp"),
        _section(n).alias("segment"),
        _source(n).alias("source"),
        F.concat(F.lit("Title "), n.cast("string")).alias("title"),
        (F.lit(3) + n % 12).alias("title_word_count"),
        (F.lit(100) + n % 900).alias("body_word_count"),
    )
    return conform(df, SCHEMAS["editorial_activity"]).filter(F.col("note_id").isNotNull())


def _lineitem_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 6).cast("bigint").alias("note_id"),
        _jan_2024(F.dayofmonth("l_shipdate")).alias("date"),
        "l_linenumber",
        F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.floor(F.col("l_extendedprice") / 10).cast("bigint").alias("t"),
    )


def _lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate feeding both traffic tables, so a plan using both reuses its exchange."""
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    return _lineitem_base(spark, sf_dir).groupBy("date", "note_id").agg(
        F.sum(q).alias("s_q"),
        F.sum(q + F.col("l_linenumber")).alias("s_qline"),
        F.sum(F.least(q, d)).alias("s_scroll"),
        F.sum(t).alias("s_t"),
        F.sum(F.when(q > 1, q - 1).otherwise(q)).alias("s_users"),
    )


def traffic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("note_id")
    df = _lineitem_daily(spark, sf_dir).select(
        "date",
        _url(n).alias("article_url"),
        _jan_2024(F.lit(1) + n % 28).alias("publish_date"),
        F.concat(F.lit("Title "), n.cast("string")).alias("article_title"),
        _section(n).alias("section"),
        _customer_email(n % 15).alias("creator_email"),
        _source(n).alias("production_source"),
        F.col("s_q").alias("visits"),
        F.col("s_qline").alias("pageviews"),
        F.col("s_scroll").alias("scrolls"),
        F.col("s_t").alias("total_time_seconds"),
    )
    return conform(df, SCHEMAS["traffic_daily"])


def traffic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("note_id")
    df = _lineitem_daily(spark, sf_dir).select(
        F.col("date").alias("event_date"),
        _url(n).alias("article_url"),
        F.col("s_q").alias("daily_sessions"),
        F.col("s_qline").alias("daily_pageviews"),
        F.col("s_users").alias("daily_users"),
        F.col("s_scroll").alias("sessions_with_scroll"),
        F.col("s_t").alias("total_engagement_seconds"),
    )
    return conform(df, SCHEMAS["traffic_clean"])


def traffic_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = fixed_broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supplier_nation = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "n_name")
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    j = li.join(supplier_nation, li.l_suppkey == supplier_nation.s_suppkey)
    flag = F.col("l_returnflag")
    df = j.select(
        _jan_2024(F.dayofmonth("l_shipdate")).alias("event_date"),
        _url(F.floor(F.col("l_orderkey") / 6).cast("bigint")).alias("article_url"),
        F.when(flag == "A", "geo").when(flag == "N", "source").otherwise("device").alias("dimension_type"),
        F.when(flag == "A", F.col("n_name"))
        .when(flag == "N", F.concat(F.lit("src_"), (F.col("l_partkey") % 20).cast("string")))
        .otherwise(F.concat(F.lit("dev_"), (F.col("l_linenumber") % 3).cast("string")))
        .alias("dimension_value"),
        (F.col("l_quantity").cast("bigint") - 1).alias("visits"),
    )
    return conform(df, SCHEMAS["traffic_dimensions"])


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = fixed_broadcast(_read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    nation = fixed_broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    # recipe: one customer in ten has no author row (editors absent from the lookup)
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").filter(F.col("c_custkey") % 10 != 3)
    j = c.join(fixed_broadcast(geo), c.c_nationkey == geo.n_nationkey)
    df = j.select(
        F.col("c_name").alias("email"),
        F.concat(F.lit("Author "), F.col("c_custkey").cast("string")).alias("complete_name"),
        F.when(F.col("c_custkey") % 10 == 5, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("country"),
    )
    return conform(df, SCHEMAS["authors"])


def derive_tables(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> Tables:
    return Tables(
        editorial=editorial_activity(spark, sf_dir, settings),
        traffic_daily=traffic_daily(spark, sf_dir),
        traffic_clean=traffic_clean(spark, sf_dir),
        traffic_dimensions=traffic_dimensions(spark, sf_dir),
        authors=authors(spark, sf_dir),
        _dealt={"editorial_activity": editorial_activity(spark, sf_dir, settings, by_time=True)},
    )
