"""Run detection against a brute-force search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest


def brute_runs(words):
    """(start, length, period) of every maximal stretch that is long enough, by its smallest period."""
    smallest = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                smallest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_cover_reaches_every_difference():
    from presswork.llm.run_detect import COVER, RESIDUES

    assert {(a - b) % COVER for a in RESIDUES for b in RESIDUES} == set(range(COVER))


@pytest.mark.parametrize("seed", range(6))
def test_extensions_equal_word_by_word(seed):
    from presswork.llm.run_detect import Extensions

    rnd = random.Random(seed)
    words = [rnd.randrange(1 + seed % 3) for _ in range(400)]
    words[200:300] = words[50:150]
    words = np.array([*words, 99])
    held = Extensions(words)
    pairs = np.array([sorted(rnd.sample(range(401), 2)) for _ in range(800)])
    for (a, b), n in zip(pairs, held.common(pairs[:, 0], pairs[:, 1]), strict=True):
        k = 0
        while b + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert n == k


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_many_texts(seed):
    from presswork.llm.run_detect import find_runs

    rnd = random.Random(seed)
    texts = []
    for _ in range(10):
        n, k = rnd.choice((0, 1, 23, 24, 25, 60, 200)), rnd.choice((1, 2, 3, 40))
        w = [rnd.randrange(k) for _ in range(n)]
        if n and rnd.random() < 0.7:
            a, p, e = rnd.randrange(n), rnd.randint(1, 40), rnd.randint(0, n)
            w = [w[i] if i < a or i >= e else w[a + (i - a) % p] for i in range(n)]
        texts.append(w)
    found = find_runs(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts]))
    got = list(zip(*(x.tolist() for x in found), strict=True))
    assert got == [(i, *r) for i, w in enumerate(texts) for r in brute_runs(w)]


def test_report_on_odd_rows(spark):
    from presswork.llm.run_detect import detect, report

    rnd = random.Random(5)
    vocabulary = ["a", "b", "é", " ", "x" * 300, " y"]
    texts = [None, "", " \t\n", "one", "w " * 23, "w " * 24, "a\x0bb\x0cc\r" * 8, "a b c " * 8 + "d e " * 12 + "x", "z" * 5000,
             " ".join(rnd.choice(vocabulary) for _ in range(1500)), "q r " * 900, *[
                 " ".join(rnd.choice(vocabulary[:k]) for _ in range(rnd.randint(1, 300))) for k in (1, 2, 3, 6) for _ in range(20)]]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "w " * 30, 1, "r"), (7, texts[7], 1, "r"), (7, "w " * 40, 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, report(docs).collect()), key=key)
    assert got == sorted((brute_row(i, t) for i, t, *_ in rows), key=key)
    assert report(docs.limit(0)).count() == 0
    plain = {(r.doc_id, r.collapsed.decode()) for r in detect(docs).filter("doc_id is null or doc_id in (5, 7)").collect()}
    assert plain == {(None, "w"), (5, "w"), (7, "a b c d e x"), (7, "w")}


def test_report_on_documents(spark):
    from presswork.llm.run_detect import report

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(brute_row(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 1500)
    ids = {r[0] for r in want}
    assert sorted(tuple(r) for r in report(docs).collect() if r.doc_id in ids) == want


def test_long_texts_take_little_time():
    """One word, a Fibonacci word and random words, a quarter of a million each."""
    import time

    from presswork.llm.run_detect import find_runs

    a, b = [0], [0, 1]
    while len(b) < 250_000:
        a, b = b, b + a
    rnd = np.random.default_rng(1)
    began = time.process_time()
    for words in (np.zeros(250_000, np.int64), np.array(b[:250_000]), rnd.integers(0, 50_000, 250_000)):
        find_runs(words, np.array([len(words)]))
    assert time.process_time() - began < 30
