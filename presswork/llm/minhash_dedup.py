"""Near-duplicate documents: MinHash bands propose pairs, sequential Bayesian tests prune them,
full shingle sets confirm what is left.

1. Every text becomes the set of its distinct five-word shingles (A-Z lower-cased, words split at
   ASCII white space; a shorter text is one shingle). Texts with equal sets collapse to one class,
   so thousands of exact copies cost one row each and no pair.
2. Each class has ``BANDS`` x ``ROWS`` MinHash values. Classes that agree on a band share a bucket.
   A bucket never becomes all its pairs: every member is paired with two pivots of the bucket
   (chosen by a hash, so different bands take different pivots).
3. A pair's signatures are compared ``BATCH`` values at a time. With m matches of n, the posterior
   of the similarity under a uniform prior is Beta(m + 1, n - m + 1); the pair goes as soon as the
   posterior probability of ``THRESHOLD`` or more falls below ``MISS``.
4. Survivors are verified on the full sets in two waves: each document's most similar partner first;
   then, of the rest, only the pairs that still lie in different components.
5. What pivots did not decide is decided in the buckets that still hold several components: they
   are cut into blocks of bounded size, every two blocks meet in a group with their signatures and
   sets, and pairs of different components are tested and verified there (steps 3 and 4) as
   matrices; only links leave the group. So a pair that shares a band is either verified or already
   connected: no link that could join two components is lost, and no table holds all pairs.

A pair at similarity exactly 0.75 shares no band with probability (1 - 0.75^5)^40 = 2e-5, more
similar ones far less. All tables between steps are files in the shared checkpoint folder.

Edge cases: a text without words (null, empty, only white space) has an empty set, n_shingles 0 and
no links; equal rows and equal texts are linked; rows of one id are nodes of their own, whatever their
texts; a row with a null id gets n_shingles, a null component and kept true (nothing can name it),
but links others and is a copy like any other to ``deduplicate``; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import (LOWER, Words, by_row, byte_set, components, groups, map_batches, merged, mix64, one_of_each,
                                  pick, random_odd, saved, slices, string_arrays)

SHINGLE = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 40, 5
BATCH = 20
#: Bytes of text that are turned into word arrays at a time: these take some fifty times as much.
SLICE = 1 << 20
#: Largest posterior probability of a qualifying similarity at which a pair is given up.
MISS = 1e-6
#: Members of a bucket that meet in one group at most (twice), and shingles compared at a time.
BLOCK, COLUMNS = 512, 4096
#: Everything but space and the control characters 9 to 13.
WORD_BYTES = byte_set(lambda b: b != 32 and not 9 <= b <= 13)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = Words(*string_arrays(column), WORD_BYTES, LOWER)
    hashes = words.hashes(seed=3)
    factors = random_odd(SHINGLE, SHINGLE)
    n = max(0, len(hashes) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        runs += hashes[j:j + n] * factors[j]
    runs = mix64(runs)
    out = []
    for first, count in zip(words.first, words.count, strict=True):
        if count >= SHINGLE:
            out.append(np.unique(runs[first:first + count - SHINGLE + 1]))
        elif count:
            short = (hashes[first:first + count] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mix64(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    n = BANDS * ROWS
    return random_odd(101, n), mix64(np.arange(7, 7 + n, dtype=np.uint64))


def signature(hashes: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over a set, as 32-bit numbers."""
    factors, shifts = permutations
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(hashes, -(-len(hashes) // 512)):
        values = part[:, None] * factors[None, :]
        values += shifts
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature (band number included)."""
    bands = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = (bands * random_odd(55, ROWS)[None, None, :]).sum(axis=2, dtype=np.uint64)
    return mix64(keys + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]).view(np.int64)


def least_matches() -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): the posterior bound, one entry a batch.

    P(similarity >= t | m of n) is the chance of at most m successes in n + 1 draws of t."""
    t, out = THRESHOLD_PERCENT / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append((n, m))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    permutations = _permutations()
    factors = random_odd(9, 2)
    for batch in batches:
        for part in slices(batch, most=SLICE):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures = np.array([signature(sets[i], permutations) for i in full], np.uint32).reshape(-1, BANDS * ROWS)
            class_of, sig, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            all_keys = band_keys(signatures) if full else []
            for k, i in enumerate(full):
                both = [(mix64(sets[i] ^ f) * f).sum(dtype=np.uint64) for f in factors]
                class_of[i] = np.array([len(sets[i]), *both], np.uint64).tobytes()
                sig[i], keys[i] = signatures[k].tobytes(), all_keys[k]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(class_of, pa.binary()),
                 pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "class", "signature", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "set"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs whose posterior stays above the bound through all batches."""
    bound = least_matches()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, -1) for c in ("sa", "sb"))
        alive, matches = np.arange(n), np.zeros(n, np.int64)
        for upto, needed in bound:
            matches[alive] += (a[alive, upto - BATCH:upto] == b[alive, upto - BATCH:upto]).sum(axis=1)
            alive = alive[matches[alive] >= needed]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive)), pa.array(matches[alive])],
            names=["a", "b", "matches"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(la, lb) of the pairs whose full sets reach the similarity: 100 x intersection >= 75 x union."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= THRESHOLD_PERCENT * (len(x) + len(y) - common):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("la").take(at), batch.column("lb").take(at)], names=["a", "b"])


def _survivors(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the exact size bound and the Bayesian test, with their matches."""
    side = sketches.select("id", "n", "signature")
    left = pairs.join(side.toDF("a", "na", "sa"), "a")
    both = left.join(side.toDF("b", "nb", "sb"), "b").filter(
        100 * F.least("na", "nb") >= THRESHOLD_PERCENT * F.greatest("na", "nb"))
    return saved(map_batches(both.select("a", "b", "sa", "sb"), _prune, "a bigint, b bigint, matches bigint"),
                 "survivors")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components la and lb of confirmed pairs (a, b, la, lb)."""
    with_a = pairs.join(sets.toDF("a", "xa"), "a")
    return saved(map_batches(with_a.join(sets.toDF("b", "xb"), "b").select("la", "lb", "xa", "xb"), _confirm,
                             "a bigint, b bigint"), "links")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components la and lb so far (an unlabelled node is its own)."""
    out = pairs.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    return out.select("a", "b", F.coalesce("ca", "a").alias("la"), F.coalesce("cb", "b").alias("lb")).filter("la <> lb")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    return by_row(pick(docs, "doc_id", "text"), "doc_id", _near_duplicates)


def _near_duplicates(rows: DataFrame) -> DataFrame:
    """``near_duplicates`` of rows with unique ids."""
    sketched = saved(map_batches(rows, _sketch, "doc_id bigint, n_shingles bigint, class binary, "
                                                "signature binary, bands array<bigint>"), "sketches")
    named = sketched.filter("class is not null")
    # one representative a class: its smallest id
    classes = saved(named.groupBy("class").agg(F.min("doc_id").alias("id")), "classes")
    reps = (named.join(classes.withColumnRenamed("class", "c"), (F.col("class") == F.col("c"))
                       & (F.col("doc_id") == F.col("id"))).dropDuplicates(["id"])
            .select("id", F.col("n_shingles").alias("n"), "signature", "bands"))
    banded = reps.select("id", F.explode("bands").alias("key"))
    order = F.xxhash64("id", "key")
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min_by("id", order).alias("p"),
                                        F.max_by("id", order).alias("q")).filter("size > 1")
    members = saved(banded.join(buckets, "key"), "buckets")
    pairs = (members.select("id", F.explode(F.array("p", "q")).alias("pivot")).filter("id <> pivot")
             .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    survivors = _survivors(pairs, reps)

    touched = survivors.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(touched.hint("shuffle_hash"), rows.doc_id == touched.id, "left_semi").dropDuplicates(["doc_id"])
    sets = saved(map_batches(texts, _sets, "id bigint, set binary"), "sets")
    ends = survivors.select("a", "b", "matches", F.explode(F.array("a", "b")).alias("id"))
    best = ends.groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("matches", F.xxhash64("a", "b"))).alias("p"))
    first = best.select("p.a", "p.b").distinct()
    labels = saved(components(_links(first.withColumns({"la": F.col("a"), "lb": F.col("b")}), sets)), "labels")
    for links in (lambda: _links(_apart(survivors, labels), sets), lambda: _residue(members, labels, reps, rows)):
        if not (found := links()).isEmpty():
            labels = saved(merged(labels, found), "labels")

    of_class = classes.join(labels, classes.id == labels.node, "left").select(
        F.col("class").alias("c"), F.coalesce("component", "id").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "class").join(of_class, F.col("class") == F.col("c"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _residue(members: DataFrame, labels: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """Links among bucket members that no pivot has joined, for buckets with several components.

    Such a bucket is cut into blocks, and two blocks meet in a group that holds their signatures and
    full sets: pairs are tested and verified there as matrices and only links (a, b) between
    components leave it. Buckets of two or three are all pivots."""
    large = members.filter("size > 3").select("key", "id")
    labelled = saved(large.join(labels.toDF("id", "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")), "members")
    several = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max(
        "component").alias("most")).filter("least <> most").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    opened = saved(labelled.join(several, "key"), "open-members")
    need = opened.select("id").distinct()
    texts = rows.join(need.hint("shuffle_hash"), rows.doc_id == need.id, "left_semi").dropDuplicates(["doc_id"])
    held = (map_batches(texts, _sets, "id bigint, set binary").join(reps.select("id", "signature"), "id"))
    placed = (opened.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("id", "component", "key", "block", F.least("block", "other").alias("left"),
                      F.greatest("block", "other").alias("right")))
    meeting = (placed.join(saved(held, "open-sets"), "id").repartition("key", "left", "right")
               .sortWithinPartitions("key", "left", "right"))
    return saved(map_batches(meeting, _meet, "a bigint, b bigint"), "links")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the blocks of every (key, left, right) in rows sorted by these columns."""
    for rows in groups(batches, ["key", "left", "right"]):
        block = rows.column("block").to_numpy()
        left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
        x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
        component = rows.column("component").to_numpy()
        if len(x) and len(y):
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
            signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(block), -1)
            i, j = _candidates(signatures, component, rows.column("key")[0].as_py(), x, y, left == right)
            at = _verified(sets, i, j)
            if len(at):
                links = np.unique(np.sort(np.stack([component[i[at]], component[j[at]]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])


def _candidates(signatures: np.ndarray, component: np.ndarray, key: int, x: np.ndarray, y: np.ndarray, same: bool
                ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks in different components that pass the Bayesian test and meet here first."""
    i, j = (m.ravel() for m in np.meshgrid(x, y, indexing="ij"))
    use = component[i] != component[j]
    if same:
        use &= i < j
    i, j = i[use], j[use]
    matches = np.zeros(len(i), np.int64)
    for upto, needed in least_matches():
        part = signatures[:, upto - BATCH:upto]
        for c in range(BATCH):
            matches += part[i, c] == part[j, c]
        use = matches >= needed
        i, j, matches = i[use], j[use], matches[use]
    keys = band_keys(signatures)
    band = int(np.argmax(keys[x[0]] == key)) if len(x) else 0
    first = np.ones(len(i), bool)
    for b in range(band):
        first &= keys[i, b] != keys[j, b]
    return i[first], j[first]


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the similarity on the full sets. Shared shingles become columns of a 0/1
    matrix, whose products are the intersections, ``COLUMNS`` shingles at a time."""
    if not len(i):
        return np.zeros(0, np.int64)
    used, slot = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = slot[:len(i)], slot[len(i):]
    sizes = np.array([len(sets[u]) for u in used])
    owner = np.repeat(np.arange(len(used)), sizes)
    shingle, column, seen = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    number = np.cumsum(seen > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    common = np.zeros(len(i), np.int64)
    for start in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        use = (column >= start) & (column < start + COLUMNS)
        matrix = np.zeros((len(used), COLUMNS), np.float32)
        matrix[owner[use], column[use] - start] = 1
        common += (matrix @ matrix.T).astype(np.int64)[i, j]
    return np.flatnonzero(100 * common >= THRESHOLD_PERCENT * (sizes[i] + sizes[j] - common))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns: one row of every group of near copies, that of the smallest id (of
    equal ids the first, a null id last), and every row without links."""
    return one_of_each(docs, "doc_id", "text", _near_duplicates)
