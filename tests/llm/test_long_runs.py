"""Secrets inside runs of thousands of characters, and the dictionary at any size of the input."""

import random

import pytest

KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


@pytest.fixture(scope="module")
def model(spark):
    from presswork.llm.secret_scan import fit

    return fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), findings=1500)


def test_keys_in_long_runs(spark, model):
    from presswork.llm.secret_scan import find, redact

    rnd = random.Random(1)
    words = sorted(w for w in model.lexicon.words if w.isascii())

    def path(n):
        out = ""
        while len(out) < n:
            out += "/" + rnd.choice(words)
        return out

    keys = ["AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(20)]
    # where a key stands must not matter: those that the forest knows alone are found in runs too
    known = [k for k in keys if model.judge(f"the {k} of", [(4, 4 + len(k))])[0] >= 0.5]
    assert len(known) >= 18
    texts = [f"see {path(2500)}{'/.'[i % 2]}{k}{path(2500)} end" for i, k in enumerate(known)]
    texts.append(f"{path(3000)}/token={KEY}/{path(3000)}")
    known.append(KEY)
    plain = [path(5000), "a" * 5000, "-" * 5000, None, "", "_" * 300]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts + plain)] + [(None, texts[0], "kept")],
                                 "doc_id long, text string, start string")
    found = {}
    for r in find(rows, model).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.start + r.n_chars))
    for i, key in [*enumerate(known), (None, known[0])]:
        at = texts[i or 0].index(key)
        assert any(a <= at and at + len(key) <= b for a, b in found[i]), i
        assert sum(b - a for a, b in found[i]) < 600, i  # the run around it stays
    assert not set(found) - {None, *range(len(texts))}
    clean = {r.doc_id: r.text for r in redact(rows, model).collect()}
    assert all(k not in (clean[i] or "") for i, k in enumerate(known)) and known[0] not in clean[None]
    assert [clean[len(texts) + i] for i in range(len(plain))] == plain
    assert find(rows.limit(0), model).count() == 0


def test_a_packed_run_is_one_finding(model):
    import base64

    body = base64.b64encode(random.Random(2).randbytes(1200)).decode()
    text = f"private key = {body} end"
    assert [(text[a:b], p >= 0.5) for a, b, p in model.findings(text, 0.5)] == [(body, True)]
    # a run of a million characters takes time in proportion to its length
    assert model.findings("x" + "ab/" * 100_000, 0.5)


def test_parts_cover_the_run():
    from presswork.llm.secret_scan import LONG, WINDOW, candidates, parts

    rnd = random.Random(3)
    for _ in range(200):
        run = "".join(rnd.choice("abcXYZ019/._-=+") for _ in range(rnd.randint(LONG + 1, 2000)))
        for a, b in candidates(run):
            if b - a > LONG:
                cut = parts(run, a, b)
                assert all(a <= x < y <= b and y - x <= LONG for x, y in cut)
                for at in range(a, b - WINDOW // 2):  # whatever half a window long stands whole in a part
                    assert any(x <= at and at + WINDOW // 2 <= y for x, y in cut)


def test_dictionary_by_share(spark):
    from pyspark.sql import functions as F

    from presswork.llm import secret_scan

    rows = spark.createDataFrame([(i, "common words here " * 40 + f"rare{'abcdefghij'[i]}") for i in range(10)] + [(10, None), (11, "")],
                                 "doc_id long, text string")
    whole = secret_scan.build_lexicon(rows).words
    assert {"common", "words", "here", "rarea"} <= whole
    many = rows.unionAll(spark.range(3).select(F.lit(99).cast("long"), F.repeat(F.lit("common words here "), 400_000)))
    assert secret_scan.build_lexicon(many).words == {"common", "words", "here"}
    assert secret_scan.build_lexicon(rows.limit(0)).words == frozenset()
