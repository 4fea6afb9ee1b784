"""Language identification: held-out accuracy, spans of mixed texts, the path against brute force."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, corpus):
    from presswork.llm.language_id import predict

    got = predict(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == corpus.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    for lang in ("en", "de", "fr", "es"):
        held_out = [r.lang_pred == lang for r in got if r.held_out and r.lang == lang]
        assert len(held_out) > 20 and np.mean(held_out) > 0.97


def test_held_out_rows_teach_nothing(spark, corpus):
    """Other langs on the rows that are held out change no prediction."""
    from presswork.llm.language_id import is_held_out, predict

    twisted = corpus.withColumn("lang", F.when(is_held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, predict(twisted).collect())) == sorted(map(tuple, predict(corpus).collect()))


def test_path_against_every_path():
    from presswork.llm.language_id import viterbi

    rnd = np.random.default_rng(2)
    count = np.array([5, 0, 1, 7, 3])
    first = np.cumsum(count) - count
    scores = rnd.normal(0, 3, (count.sum(), 3))
    prior = np.log([0.5, 0.3, 0.2])
    got = viterbi(scores, first, count, prior, switch=2.0)
    for a, n in zip(first, count, strict=True):
        if n:
            def value(path, a=a):
                own = sum(scores[a + i, k] for i, k in enumerate(path))
                return own + prior[path[0]] - 2.0 * sum(x != y for x, y in itertools.pairwise(path))

            assert tuple(got[a:a + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)


def test_spans_scripts_and_odd_rows(spark, corpus):
    from presswork.llm.language_id import UNDETERMINED, fit, identify, predict

    greek = [(10 ** 6 + i, "καλημέρα κόσμε της νύχτας", "el") for i in range(30)]
    more = corpus.select("doc_id", "text", "lang").union(spark.createDataFrame(greek, "doc_id long, text string, lang string"))
    model = fit(more)
    assert model.languages == ["de", "el", "en", "es", "fr"]
    english = corpus.filter("lang = 'en' and length(text) > 800").orderBy("doc_id").first().text[:400].rsplit(" ", 1)[0]
    german = corpus.filter("lang = 'de' and length(text) > 800").orderBy("doc_id").first().text[:300].rsplit(" ", 1)[0]
    mixed = f"{english}\n{german}\nνύχτας κόσμε."
    rows = [(1, mixed, "en", 2), (2, None, "en", 2), (3, "", "en", 2), (4, "12 + 3 !!", "en", 2), (5, "ΚΌΣΜΕ", None, 2), (None, german, "en", 2),
            (1, mixed, "en", 2), (6, "漢字だけ", "en", 2), (7, "z" * 100_000, "en", 2), (8, "́̂", "en", 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [r.asDict() for r in identify(odd, model).collect()]
    of = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [r["lang_pred"] for r in got if r["doc_id"] == 1] == ["en", "en"]
    spans = [tuple(s) for s in of[1]["spans"]]
    assert [s[2] for s in spans] == ["en", "de", "el"]
    assert abs(spans[0][1] - len(english)) < 12 and mixed[spans[2][0]:spans[2][1]] == "νύχτας κόσμε"
    for i in (2, 3, 4, 8):
        assert (of[i]["lang_pred"], of[i]["score"], of[i]["spans"]) == (UNDETERMINED, 0.0, [])
    assert of[5]["lang_pred"] == "el" and of[5]["score"] > 0.99 and of[None]["lang_pred"] == "de"
    assert of[6]["lang_pred"] in model.languages and 0 <= of[7]["score"] <= 1
    assert predict(odd.limit(0)).count() == 0
    untaught = predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {(UNDETERMINED, 0.0)}


def test_counts_do_not_depend_on_the_split(spark, corpus):
    from presswork.llm import language_id
    from presswork.llm.language_id import fit

    one, many = fit(corpus.coalesce(1)), fit(corpus.repartition(7))
    assert (one.keys == many.keys).all() and np.allclose(one.scores, many.scores) and len(one.keys) > 1000
    assert language_id.LEAST_SHARE * len(one.keys) <= len(one.languages)
