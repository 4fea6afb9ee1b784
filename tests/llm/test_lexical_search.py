"""Ranked lexical search against brute force, blocks of items and odd rows included."""

import math
import re
from collections import Counter

import duckdb
import pytest


def terms_of(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score); scores alone are fixed where doc_ids repeat."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(weight[t] * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return out


def by_rank(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, str(r[0]), r[1]))


DOCS = [(i, t) for i, t in enumerate([
    None, "", "... !!", "the cat sat", "The CAT sat on the mat", "cat cat cat cat", "concatenate", "dog", "le chat é É", "chat_cat-cat.cat",
    "日本 cat 日本語", "cat\x00sat", "a " * 3000 + "cat", "x" * 20_000])] + [(3, "the cat sat"), (4, "dog cat"), (None, "cat"), (None, "mat")] + [
    (100 + i, "same words in many copies") for i in range(40)]
ITEMS = [(1, "cat"), (2, "the cat, the mat"), (3, None), (4, ""), (5, "nowhere"), (6, "É é 日本"), (1, "dog"), (None, "sat"), (None, "mat"),
         (7, "copies " * 50), (8, "x" * 20_000), (9, "a")]


@pytest.mark.parametrize("block_chars", [2_000_000, 5_000])
def test_odd_rows(spark, block_chars):
    from presswork.llm.lexical_search import search

    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, score int")
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, rank string")
    got = search(docs.repartition(5), items, block_chars=block_chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_rank(got.collect()) == by_rank(brute(DOCS, ITEMS))


def test_empty_tables_and_string_items(spark):
    from presswork.llm.lexical_search import search

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([("k", "cat sat"), (None, "dog")], "item_id string, text string")
    assert by_rank(search(docs, items, top=3).collect()) == by_rank(brute(DOCS, [("k", "cat sat"), (None, "dog")], 3))
    assert search(docs.limit(0), items).isEmpty() and search(docs, items.limit(0)).isEmpty()


def test_scores_in_two_parts_are_the_same():
    import numpy as np

    from presswork.llm.lexical_search import _sums

    rnd = np.random.default_rng(0)
    cell, value = rnd.integers(0, 50, 10_000), rnd.integers(0, 1 << 35, 10_000)
    assert (_sums(cell, value, 50, True) == _sums(cell, value, 50, False)).all()


def test_sql_agrees_on_odd_rows(spark):
    """The registered SQL on the rows that differ by id only once."""
    from presswork.llm.lexical_search import SEARCH_SQL

    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", DOCS), ("benchmark", "item_id", ITEMS)):
        c.execute(f"create table {name} ({key} bigint, text varchar)")
        c.executemany(f"insert into {name} values (?, ?)", [[i, t and t.replace("\x00", "\x01")] for i, t in rows])
    assert by_rank(c.execute(SEARCH_SQL).fetchall()) == by_rank(brute(DOCS, ITEMS))
