"""Helpers that several operators share: inputs, scratch tables, word arrays, components."""

from __future__ import annotations

import ctypes
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import checkpoint_dir

#: Bytes of text that a task turns into arrays at a time (a longer text is taken alone).
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name whatever other columns are called."""
    columns = df.columns
    at = [columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(columns))]).select(
        *[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "presswork-llm", f"{label}-{uuid.uuid4().hex}")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at the files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once an application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(SparkFiles.getRootDirectory()) / f"sources-{uuid.uuid4().hex}" / "presswork.zip"
    target.parent.mkdir()
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


#: Bytes of an Arrow batch, unless the session sets its own: a task holds one in the JVM and one in Python,
#: also where rows are wide (pairs of full sets, long texts).
BATCH_SETTING, BATCH_BYTES, SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package, in batches of bounded bytes."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return what a task has freed to the system: a worker that waits, or goes on with another stage, would
    hold on to the most that any task before it needed."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def string_arrays(column: pa.Array, kind: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of a string (or binary) column; null counts as empty."""
    column = column.cast(kind or pa.large_string()).fill_null("" if kind is None else b"")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each, at least one row."""
    offsets, _ = string_arrays(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of two rows or more in rows sorted by ``by``, one at a time."""
    pending: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*pending, pa.Table.from_batches([batch])])
        marks = [table.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        for start, end in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            if end - start > 1:
                yield table.slice(start, end - start)
        pending = [table.slice(cuts[-1] if len(cuts) else 0)]
    if pending and pending[0].num_rows > 1:
        yield pending[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_odd(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd multipliers, the same in every process."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(at + np.uint64(seed)) | np.uint64(1)


class Words:
    """Words of a run of texts as arrays.

    ``keep`` (256 booleans) tells which bytes belong to words; ``data`` holds the texts' bytes
    after the mapping ``lower``. ``start``/``end`` are byte positions, ``doc`` the text's index,
    ``first``/``count`` the range of each text's words.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, keep: np.ndarray, lower: np.ndarray | None = None):
        self.offsets, self.data = offsets, data if lower is None else lower[data]
        inside = keep[data]
        # a text's first byte starts a new word even where the text before ends in one
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = inside[heads]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[heads[heads > 0] - 1] = inside[heads[heads > 0] - 1]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit multilinear hash of each word's bytes and length."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.repeat(self.start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        place = at - np.repeat(self.start, length)
        terms = (self.data[at].astype(np.uint64) + np.uint64(1)) * random_odd(seed, int(length.max()))[place]
        sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(length)[:-1])))
        return mix64(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_set(member) -> np.ndarray:
    """The 256 booleans of a predicate on byte values."""
    return np.array([bool(member(i)) for i in range(256)])


#: A-Z to a-z, every other byte as it is.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node of an edge.

    Alternates two joins-and-minimum steps until every component is a star around its smallest
    node: every node hands its larger neighbours to its smallest one, then its smaller neighbours.
    Each step is written to the shared folder, so no lineage grows and nothing is gathered anywhere;
    rounds grow with the logarithm of the longest path. Minima over a node's neighbours are
    combined before the shuffle and written too, so that the way back is a join of two tables, in which Spark can split the
    partition of a node with very many neighbours.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select(
            "n", F.least("n", "m").alias("m")), label)
        large = saved(both.join(least, both.a == least.n).filter("b > a").select(F.col("m").alias("a"), "b")
                      .filter("a <> b"), label)
        # here a < b: hand every smaller neighbour of b to its smallest
        least = saved(large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m")), label)
        small = large.join(least, large.b == least.n).select(
            F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        now = saved(small.distinct(), label)
        ends = now.select(F.col("a").alias("n"), F.lit(0).alias("below")).union(now.select("b", F.lit(1)))
        unsettled = ends.groupBy("n").agg(F.sum("below").alias("above"), F.min("below").alias("least")).filter(
            "above > 1 or (above = 1 and least = 0)")
        if unsettled.agg(F.count("*")).first()[0] == 0:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``links`` (a, b) between components, or nodes that no
    label names yet, have joined them: only the links are walked again."""
    new = components(links).toDF("old", "new")
    moved = labels.join(new, labels.component == new.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    return moved.union(new).groupBy("node").agg(F.min("component").alias("component"))


def _odd_ids(rows: DataFrame, name: str) -> bool:
    """Whether an id is null or occurs more than once."""
    return not rows.groupBy(name).count().filter((F.col("count") > 1) | F.col(name).isNull()).isEmpty()


def by_row(rows: DataFrame, name: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``find(rows)``, whose result has the id ``name``, ``component_id`` (the smallest id of the row's group)
    and ``kept``, for ids of any kind, where ``find`` itself needs them unique and not null.

    Rows with null or repeated ids are numbered for it, so that each is a node of its own; then a group
    is named by the smallest id of its rows. A null id has a null component and is kept."""
    if not _odd_ids(rows, name):
        return find(rows)
    numbered, found = _by_number(rows, name, find)
    own = found.join(numbered.select("row", F.col(name).alias("own_id")), found[name] == F.col("row"))
    least = own.groupBy(F.col("component_id").alias("group")).agg(F.min("own_id").alias("least"))
    out = own.join(least, own.component_id == F.col("group"))
    component = F.when(F.col("own_id").isNotNull(), F.col("least"))
    changed = {name: F.col("own_id"), "component_id": component, "kept": F.coalesce(F.col("own_id") == component, F.lit(True))}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in found.columns])


def _by_number(rows: DataFrame, name: str, find: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows with a number each in ``row``, and what ``find`` says of them by these numbers."""
    numbered = saved(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return numbered, saved(find(numbered.drop(name).withColumnRenamed("row", name)), "by-number")


def one_of_each(table: DataFrame, name: str, payload: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``table``, with all its columns, without all but one row of each group that ``find`` names: the one of
    the smallest id stays, of equal ids the first; a null id comes last."""
    names = table.columns
    plain = rename_all(table)
    key, value = (plain.columns[names.index(n)] for n in (name, payload))
    if not _odd_ids(plain.select(key), key):
        gone = find(pick(table, name, payload)).filter("not kept").select(F.col(name).alias("gone"))
        return plain.join(gone, plain[key] == F.col("gone"), "left_anti").toDF(*names)
    numbered = saved(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = find(numbered.select(F.col("row").alias(name), F.col(value).alias(payload))).select(name, "component_id")
    own = found.join(numbered.select("row", F.col(key).alias("own_id")), found[name] == F.col("row"))
    # fixed-width minima: the smallest id, then the first of its rows
    least = own.groupBy("component_id").agg(F.min("own_id").alias("least"))
    first = (own.join(least, "component_id").filter(F.col("own_id").eqNullSafe(F.col("least")))
             .groupBy("component_id").agg(F.min("row").alias("stays")))
    return numbered.join(first, numbered.row == F.col("stays"), "left_semi").drop("row").toDF(*names)


def rename_all(df: DataFrame, prefix: str = "c") -> DataFrame:
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def chunks(items: Sequence, n: int) -> Iterator[Sequence]:
    for i in range(0, len(items), n):
        yield items[i:i + n]
