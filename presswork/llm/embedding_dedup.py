"""Embedding near-duplicates: Euclidean p-stable hashing proposes pairs, exact cosines decide.

Vectors of one direction and more copies are the usual case, so equal vectors collapse to a class
first. Each class's unit vector is hashed by ``tables`` hash functions of ``k`` quantised random
projections (floor((a.x + b) / WIDTH)); vectors that share a hash are compared exactly. ``k`` grows
with the logarithm of the number of classes, so that unrelated vectors seldom meet, and ``tables``
follows from ``MISS``: a pair at cosine exactly 0.95 shares no hash with at most that probability.

A bucket is cut into blocks of about ``BLOCK`` vectors and every two blocks meet in a group of their
own, so a bucket with a third of all vectors is spread over many tasks of bounded memory. A group
multiplies its two blocks and hands on link counts and, for components, each vector's smallest
linked vector after in-group joining: never the pairs. A pair that shares several hashes counts in
the first table only: vectors carry the keys of all tables, and two blocks whose vectors all share an
earlier key are not multiplied again.

Edge cases: null, empty or zero vectors and vectors with null or non-finite parts link with nothing;
vectors of different lengths are never compared; rows are vectors of their own, whether they repeat or
share their id with other vectors; a null vec_id keeps its links but has a null component and
kept true (to ``deduplicate`` it is a copy like any other, the last one); an empty table
gives an empty result; ``label`` and further columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import by_row, components, groups, map_batches, mix64, one_of_each, pick, saved

COSINE = 0.95
WIDTH = 2.0
MISS = 1e-4
BLOCK = 1024
SEED = 11


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two points at a distance."""
    c = width / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def parameters(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(k, tables) for ``n`` vectors: orthogonal vectors meet in a table with probability below 1 / (8 n)."""
    k = max(6, math.ceil(math.log(8 * max(2, n)) / -math.log(collision(math.sqrt(2)))))
    near = collision(math.sqrt(2 - 2 * cosine)) ** k
    return k, math.ceil(math.log(miss) / math.log1p(-near))


class Hashes:
    """The hash functions for vectors of one length."""

    def __init__(self, dim: int, k: int, tables: int):
        rng = np.random.default_rng([SEED, dim, k])
        self.k, self.tables, self.dim = k, tables, dim
        self.directions = rng.standard_normal((dim, tables * k))
        self.shifts = rng.uniform(0, WIDTH, tables * k)
        self.factors = (rng.integers(1, 1 << 62, k, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit key per vector and table (table and length included)."""
        cells = np.floor((unit @ self.directions + self.shifts) / WIDTH).astype(np.int64).astype(np.uint64)
        sums = (cells.reshape(len(unit), self.tables, self.k) * self.factors).sum(axis=2, dtype=np.uint64)
        salt = mix64(np.arange(self.tables, dtype=np.uint64) + np.uint64(self.dim * 1_000_003))
        return mix64(sums + salt[None, :]).view(np.int64)


def unit_vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column (all of one length, not zero) at length 1, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def _hash_classes(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for batch in batches:
            for dim, at in _by_length(batch.column("embedding")):
                hashes = known.setdefault(dim, Hashes(dim, k, tables))
                for part in np.array_split(at, -(-len(at) // 512)):
                    own = batch.take(pa.array(part))
                    keys = hashes.keys(unit_vectors(own.column("embedding")))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column("id"), own.column("embedding"), own.column("copies"), lists],
                                                     names=["id", "embedding", "copies", "keys"])
    return run


def _linked(a: np.ndarray, b: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks with the cosine; within one block each pair once."""
    i, j = np.nonzero(a @ b.T >= cosine)
    return (i[i < j], j[i < j]) if same else (i, j)


def _first_met(ka: np.ndarray, kb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share no key in the given tables. Most linked pairs share one of the first few and
    are not looked at again."""
    alone = np.arange(len(i))
    for table in range(ka.shape[1]):
        if not len(alone):
            break
        a, b = ka[:, table], kb[:, table]
        alone = alone[a[i[alone]] != b[j[alone]]]
    return alone


def _all_met(ka: np.ndarray, kb: np.ndarray) -> bool:
    """Whether all vectors of two blocks share a key in one of the given tables: every pair counted there."""
    first = (ka[:1] == kb[:1]).ravel()
    return bool(first.any() and ((ka[:, first] == ka[:1, first]).all(axis=0) & (kb[:, first] == kb[:1, first]).all(axis=0)).any())


def _labels(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``n`` vectors reaches over the links of its group."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def _meet(cosine: float):
    """Compares the two blocks of every (key, left, right) in rows sorted by these columns."""
    def group(rows: pa.Table) -> pa.RecordBatch | None:
        ids, sizes = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        block = rows.column("block").to_numpy()
        left, right, table = (rows.column(c)[0].as_py() for c in ("left", "right", "slot"))
        vectors = rows.column("embedding").combine_chunks()
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :table]
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        for _, at in _by_length(vectors):  # one length, but for colliding keys
            x, y = at[block[at] == left], at[block[at] == right]
            if not len(x) or not len(y) or _all_met(keys[x], keys[y]):
                continue
            a = unit_vectors(vectors.take(pa.array(x)))
            b = a if left == right else unit_vectors(vectors.take(pa.array(y)))
            i, j = _linked(a, b, left == right, cosine)
            counts = _first_met(keys[x], keys[y], i, j)
            i, j = x[i[counts]], y[j[counts]]
            if not len(i):
                continue
            links += np.bincount(i, sizes[j], len(ids)).astype(np.int64) + np.bincount(j, sizes[i], len(ids)).astype(np.int64)
            label = _labels(len(ids), i, j, label)
        use = np.flatnonzero((links > 0) | (label != ids))
        if not len(use):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use]), pa.array(label[use])],
                                          names=["id", "links", "reaches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["key", "left", "right"]):
            if (out := group(rows)) is not None:
                yield out

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    return by_row(pick(vectors, "vec_id", "embedding"), "vec_id", lambda rows: _near_duplicates(rows, cosine, miss, block))


def _near_duplicates(rows: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` of rows with unique ids."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable)
    # nodes are numbered by the smallest vec_id of their rows
    classes = saved(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    k, tables = parameters(classes.count(), cosine, miss)
    kind = classes.schema["embedding"].dataType.simpleString()
    hashed = saved(map_batches(classes.select("id", "embedding", "copies"), _hash_classes(k, tables),
                               f"id bigint, embedding {kind}, copies bigint, keys array<bigint>"), "hashed")
    keys = hashed.select("id", F.posexplode("keys").alias("slot", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    members = (keys.join(buckets, "key").withColumn("blocks", blocks)
               .withColumn("block", F.pmod(F.xxhash64("id", "slot"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("id", "key", "slot", "block", F.least("block", "other").alias("left"),
                       F.greatest("block", "other").alias("right")))
    held = members.join(hashed, "id")
    meeting = held.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    met = saved(map_batches(meeting, _meet(cosine), "id bigint, links bigint, reaches bigint"), "met")
    linked = components(met.filter("id <> reaches").select(F.col("id").alias("a"), F.col("reaches").alias("b")))
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = (classes.join(counts, "id", "left").join(linked, F.col("id") == F.col("node"), "left")
                .select(F.col("embedding").alias("vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "id").alias("component")))
    found = good.join(of_class, good.embedding == F.col("vector")).select("vec_id", "n_links", "component")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return found.unionAll(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"),
                                        (F.col("vec_id") == F.col("component")).alias("kept"))


def deduplicate(vectors: DataFrame) -> DataFrame:
    """``vectors``, with all their columns: one row of every group, that of the smallest vec_id (of equal ids the
    first, a null id last), and every row without links."""
    return one_of_each(vectors, "vec_id", "embedding", _near_duplicates)
