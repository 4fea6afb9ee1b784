"""The five input tables, their schemas, loading and materialisation."""

from __future__ import annotations

import os
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import checkpoint_dir, configure

EDITORIAL_SCHEMA = T.StructType([
    T.StructField("note_id", T.LongType()),
    T.StructField("story_url", T.StringType()),
    T.StructField("email_editor", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("event_timestamp", T.TimestampNTZType()),
    T.StructField("segment", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("title_word_count", T.LongType()),
    T.StructField("body_word_count", T.LongType()),
])

TRAFFIC_DAILY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("publish_date", T.DateType()),
    T.StructField("article_title", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("creator_email", T.StringType()),
    T.StructField("production_source", T.StringType()),
    T.StructField("visits", T.LongType()),
    T.StructField("pageviews", T.LongType()),
    T.StructField("scrolls", T.LongType()),
    T.StructField("total_time_seconds", T.LongType()),
])

TRAFFIC_CLEAN_SCHEMA = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("daily_sessions", T.LongType()),
    T.StructField("daily_pageviews", T.LongType()),
    T.StructField("daily_users", T.LongType()),
    T.StructField("sessions_with_scroll", T.LongType()),
    T.StructField("total_engagement_seconds", T.LongType()),
])

TRAFFIC_DIMENSIONS_SCHEMA = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("dimension_type", T.StringType()),
    T.StructField("dimension_value", T.StringType()),
    T.StructField("visits", T.LongType()),
])

AUTHORS_SCHEMA = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("complete_name", T.StringType()),
    T.StructField("country", T.StringType()),
])

SCHEMAS = {
    "editorial_activity": EDITORIAL_SCHEMA,
    "traffic_daily": TRAFFIC_DAILY_SCHEMA,
    "traffic_clean": TRAFFIC_CLEAN_SCHEMA,
    "traffic_dimensions": TRAFFIC_DIMENSIONS_SCHEMA,
    "authors": AUTHORS_SCHEMA,
}

# Date column each traffic table is partitioned by when written out.
PARTITION_COLUMNS = {
    "traffic_daily": "date",
    "traffic_clean": "event_date",
    "traffic_dimensions": "event_date",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns in order with the declared types; fail on a missing one."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass
class Tables:
    """The five inputs as DataFrames."""

    editorial: DataFrame
    traffic_daily: DataFrame
    traffic_clean: DataFrame
    traffic_dimensions: DataFrame
    authors: DataFrame
    _rows: dict = field(default_factory=dict, repr=False)
    _dealt: dict = field(default_factory=dict, repr=False)  # the same rows, dealt and sorted as they are written

    @property
    def spark(self) -> SparkSession:
        return self.editorial.sparkSession

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "editorial_activity": self.editorial,
            "traffic_daily": self.traffic_daily,
            "traffic_clean": self.traffic_clean,
            "traffic_dimensions": self.traffic_dimensions,
            "authors": self.authors,
        }

    def table(self, name: str) -> DataFrame:
        return self.as_dict()[name]

    def row_count(self, name: str) -> int:
        if name not in self._rows:
            self._rows[name] = self.table(name).count()
        return self._rows[name]

    def register_views(self, prefix: str = "") -> None:
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)

    def materialize(self, path: str | None = None) -> "Tables":
        """Write the five tables as parquet to the shared checkpoint folder and read them back.

        Traffic tables are partitioned by their date so that a period filter
        prunes whole folders (the write is rebalanced by AQE so file sizes stay
        even when one day is hot); the event log is range-partitioned and sorted by
        time so that file footers and row-group statistics skip data outside the period.
        """
        root = path or _new_root(self.spark)
        out = {name: self.store(name, root) for name in SCHEMAS}
        return Tables(
            editorial=out["editorial_activity"],
            traffic_daily=out["traffic_daily"],
            traffic_clean=out["traffic_clean"],
            traffic_dimensions=out["traffic_dimensions"],
            authors=out["authors"],
        )

    def store(self, name: str, root: str) -> DataFrame:
        """One table written as ``materialize`` writes it, and read back."""
        df, target = self.table(name), os.path.join(root, name)
        if name in self._dealt:
            df = self._dealt[name]
        elif name == "editorial_activity":
            # time ranges per file (file-level skipping), time order inside (row groups)
            df = df.repartitionByRange("event_timestamp").sortWithinPartitions("event_timestamp")
        elif name in PARTITION_COLUMNS:
            # AQE rebalances the write: a hot day is split, small days are merged
            df = df.hint("rebalance", PARTITION_COLUMNS[name])
        writer = df.write.mode("overwrite")
        if name in PARTITION_COLUMNS:
            writer = writer.partitionBy(PARTITION_COLUMNS[name])
        writer.parquet(target)
        return conform(self.spark.read.parquet(target), SCHEMAS[name])


def _new_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "presswork-tables", uuid.uuid4().hex)


class StoredTables(Tables):
    """Tables of which each is written whole, once, when it is first asked for: a query derives
    and stores the tables it reads, not those of other queries."""

    def __init__(self, derived: Tables):
        self._derived, self._root = derived, _new_root(derived.spark)
        self._stored: dict[str, DataFrame] = {}
        self._rows, self._dealt = {}, {}
        self._lock = threading.RLock()

    def table(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._stored:
                self._stored[name] = self._derived.store(name, self._root)
            return self._stored[name]

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in SCHEMAS}

    def held(self, name: str) -> DataFrame | None:
        """The table if it was asked for."""
        return self._stored.get(name)

    spark = property(lambda self: self._derived.spark)
    editorial = property(lambda self: self.table("editorial_activity"))
    traffic_daily = property(lambda self: self.table("traffic_daily"))
    traffic_clean = property(lambda self: self.table("traffic_clean"))
    traffic_dimensions = property(lambda self: self.table("traffic_dimensions"))
    authors = property(lambda self: self.table("authors"))


def _files(spark: SparkSession, targets: list[str]) -> DataFrame:
    """The files below the targets, without their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(targets)
    return found.select("path", "length", "modificationTime")


def stored(spark: SparkSession, path: str, name: str) -> str | None:
    """Where the table is stored below ``path`` (a folder or a file), on any file system Spark reads."""
    for target in (f"{path.rstrip('/')}/{name}", f"{path.rstrip('/')}/{name}.parquet"):
        try:
            _files(spark, [target])
            return target
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def table_version(spark: SparkSession, targets: list[str]) -> tuple:
    """Number, bytes, last change and a digest of all files of the tables: a table that is written anew,
    appended to or loses a file has another version. One job over the listing, no data is read."""
    return tuple(_files(spark, targets).agg(
        F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def read_tables(spark: SparkSession, path: str) -> Tables:
    """Read the five tables written as ``{path}/{name}`` (parquet file or folder)."""
    dfs = {}
    for name, schema in SCHEMAS.items():
        target = stored(spark, path, name)
        if target is None:
            raise FileNotFoundError(f"no table {name} in {path}")
        dfs[name] = conform(spark.read.parquet(target), schema)
    return Tables(
        editorial=dfs["editorial_activity"].filter(F.col("note_id").isNotNull()),
        traffic_daily=dfs["traffic_daily"],
        traffic_clean=dfs["traffic_clean"],
        traffic_dimensions=dfs["traffic_dimensions"],
        authors=dfs["authors"],
    )


@dataclass
class _Loaded:
    targets: list[str]
    version: tuple
    tables: Tables


_CACHE: dict[tuple, _Loaded] = {}
_LOCK = threading.Lock()


def load_tables(spark: SparkSession, path: str, materialize: bool = True) -> Tables:
    """Tables for a folder: the five tables if written there, else derived from the
    driver tables by :mod:`presswork.sources.fixtures` and, with ``materialize``, each written
    once, when a query first asks for it, to the shared checkpoint folder (traffic partitioned by date) so that every
    query reads stored tables. One object per session, folder and version of its
    files, so the derivation happens once; when the files change, the next call reads them anew
    and what was kept of the old version is released."""
    from presswork.operators.ownership import clear_scopes
    from presswork.sources.fixtures import SOURCES, derive_tables

    configure(spark)
    key = (id(getattr(spark, "_jsparkSession", spark)), path if "://" in path else os.path.abspath(path), materialize)
    with _LOCK:
        held = _CACHE.get(key)
        if held is not None and held.tables.spark is not spark:
            held = None  # a new session reusing an old session's id: derive again
        if held is not None and _version(spark, held.targets) == held.version:
            return held.tables
        if held is not None:
            editorial = held.tables.held("editorial_activity") if isinstance(held.tables, StoredTables) else held.tables.editorial
            if editorial is not None:
                clear_scopes(editorial)
        targets = [stored(spark, path, n) for n in SCHEMAS]
        if all(targets):
            version = table_version(spark, targets)  # before the read: a change in between shows next time
            tables = read_tables(spark, path)
        else:
            targets = [f"{path.rstrip('/')}/{n}.parquet" for n in SOURCES]
            version = table_version(spark, targets)
            derived = derive_tables(spark, path)
            tables = StoredTables(derived) if materialize else derived
        _CACHE[key] = _Loaded(targets, version, tables)
        return tables


def _version(spark: SparkSession, targets: list[str]) -> tuple | None:
    try:
        return table_version(spark, targets)
    except AnalysisException:  # a folder is gone: load_tables finds out what is there now
        return None


def clear_cache() -> None:
    """Forget the loaded tables (the next ``load_tables`` reads or derives them again)."""
    with _LOCK:
        _CACHE.clear()
