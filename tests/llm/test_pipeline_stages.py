"""Every stage of the pipeline against a plain version of it, over rows with nulls and repeats."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def _lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    return {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    from presswork.llm.common import read_table, saved

    rows = read_table(spark, SF, "documents")
    first = rows.filter("text is not null").orderBy("doc_id").limit(3).collect()
    odd = [first[0], (first[1][0] + 10 ** 6, *first[1][1:]), (None, *first[2][1:]), (None, None, None, None, None), (10 ** 6, "", "en", None, 0),
           (10 ** 6 + 5, f'one two token = "{KEY}" three', "en", "s", None), (None, f"password={KEY}", None, None, 7)]
    return saved(rows.unionAll(spark.createDataFrame([tuple(r) for r in odd], rows.schema)), "pipeline-docs")


def _rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_quality(spark, docs):
    import corpus_pipeline
    from presswork.llm.quality import classify

    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    accepted = {r.doc_id: r.accepted for r in classify(docs).filter("doc_id is not null").collect()}
    got = _rows(kept)
    assert not got - _rows(docs)  # rows as they were
    assert {r[0] for r in got} - {None} == {i for i, ok in accepted.items() if ok}


def test_near_dedup(spark, docs):
    import corpus_pipeline

    rows = [tuple(r) for r in docs.collect()]
    sets = [_shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        before = list(group)
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    got = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = _rows(got)
    assert sum(kept.values()) == len(set(group)) and not kept - Counter(rows)
    for g in set(group):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None]
        if ids:
            assert any(r[0] == min(ids) for r in kept)


def test_decontaminate(spark, docs):
    import corpus_pipeline
    from presswork.llm.common import read_table

    items = [_windows(r.text) for r in read_table(spark, SF, "benchmark").select("text").collect()]
    windows = set().union(*items)
    by_length = {n: {w for w in windows if len(w) == n} for n in {len(w) for w in windows}}

    def clean(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
        return not any(tuple(w[k:k + n]) in of for n, of in by_length.items() for k in range(len(w) - n + 1))

    got = corpus_pipeline.decontaminate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert _rows(got) == Counter({r: n for r, n in _rows(docs).items() if clean(r[1])})


def test_secrets(spark, docs):
    import corpus_pipeline
    from presswork.llm import secret_scan

    model = secret_scan.fit(docs)

    def clean(text):
        for a, b, p in reversed(model.findings(text, 0.5)) if text else ():
            text = text[:a] + "[SECRET]" + text[b:] if p >= 0.5 else text
        return text

    want = Counter()
    for (i, text, lang, source, n), times in _rows(docs).items():
        new = clean(text)
        want[i, new, lang, source, n if new == text else len(new)] += times
    got = corpus_pipeline.secrets_stage(spark, docs, SF)
    assert got.columns == docs.columns and _rows(got) == want
    assert {r[1] for r in want if "[SECRET]" in (r[1] or "")} >= {'one two token = "[SECRET]" three', "password=[SECRET]"}


def test_tokens(spark, docs):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from presswork.llm.byte_bpe import RANKS

    with open(P.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (i, text, *_), times in _rows(docs).items():
        ids = enc.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += times
    got = corpus_pipeline.tokens_stage(spark, docs, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert _rows(got) == want


def test_empty_table(spark, docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
