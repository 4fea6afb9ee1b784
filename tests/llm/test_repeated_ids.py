"""Repeated and null ids: rows are nodes of their own in both near-duplicate operators."""

import numpy as np


def test_one_id_with_two_vectors(spark):
    from presswork.llm.embedding_dedup import deduplicate, near_duplicates

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (7, None), (7, None)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = near_duplicates(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 1, None, True), (None, 1, None, True),
        (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True)], key=key)
    left = deduplicate(frame)
    assert left.columns == frame.columns
    assert sorted(map(tuple, left.collect()), key=lambda r: (r[0] is None, str(r))) == sorted(
        [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (None, [-1.0, 0.0], 5), (None, None, 5), (7, None, 5), (7, None, 5)],
        key=lambda r: (r[0] is None, str(r)))


def test_a_third_of_the_vectors_in_one_cluster(spark):
    """Links and components against brute force; blocks are cut, and met pairs are skipped."""
    from presswork.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(5)
    n, dim = 3000, 48
    x = rng.standard_normal((n, dim))
    x[:n // 3] = rng.standard_normal(dim) + rng.standard_normal((n // 3, dim)) * rng.choice([0.05, 0.2, 0.3], (n // 3, 1))
    x[n // 3:n // 3 + 300] = np.repeat(x[-30:], 10, axis=0)
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        if (low == label).all():
            break
        label = low
    got = sorted(near_duplicates(frame, block=256).collect())
    found, want = np.array([r.n_links for r in got]), linked.sum(axis=1)
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert [r.component_id for r in got] == label.tolist()


def test_one_doc_id_with_two_texts(spark):
    from presswork.llm.minhash_dedup import deduplicate, near_duplicates

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a), (4, a + " x"), (None, b), (None, "c d"), (None, "c d"), (None, "c d"), (5, ""), (5, ""), (None, None)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (None, None, True), (None, None, True),
                          (None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (None, None, True)], key=str)
    left = deduplicate(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == [(1, a), (1, b), (5, ""), (5, "")]
    assert [(r.doc_id, r.text) for r in left.filter("doc_id is null").orderBy("text").collect()] == [(None, None), (None, "c d")]


def test_components_on_documents(spark):
    """Every n_shingles and component of the small table against brute force."""
    import re

    from presswork.llm.minhash_dedup import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[r.doc_id] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_vectors_of_the_small_table(spark):
    """The table as it is stored (single precision), with copies of some rows, against brute force."""
    from pyspark.sql import functions as F

    from presswork.llm.embedding_dedup import near_duplicates

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    copies = table.filter("vec_id % 7 = 0").select((F.col("vec_id") + 10 ** 6).alias("vec_id"), "embedding")
    rows = table.union(copies).collect()
    x = np.array([r.embedding for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in near_duplicates(table.union(copies)).collect()}
    assert [got[r.vec_id].n_links for r in rows] == linked.sum(axis=1).tolist()
    assert all(got[r.vec_id].component_id == r.vec_id - 10 ** 6 for r in rows if r.vec_id >= 10 ** 6)
