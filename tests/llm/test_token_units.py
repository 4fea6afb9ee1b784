"""Units, memory and file order of the token store."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from presswork.llm.token_store import TOKENIZER

    tokenizer = Tokenizer.from_file(P.path(TOKENIZER))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_odd_texts_as_the_library_encodes_them(library):
    from presswork.llm.token_store import TOKENIZER, Encoder

    rnd = random.Random(4)
    signs = ["a", "B", "é", "É", "ß", "İ", "×", "日", "本", "😀", "́", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "\x02", "'", "-", ".", "<|", "|>",
             "endoftext", "9", "½", "ﬁ", "‍", "ab" * 200, "日" * 400]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + [None, "", "\n", "x" * 50_000]
    encoder = Encoder(P.path(TOKENIZER))
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode_batch(pa.array(texts))
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids + [2]


def test_memory_is_bounded_by_bytes(monkeypatch):
    from presswork.llm import token_store

    monkeypatch.setattr(token_store, "MEMO_BYTES", 1 << 20)
    encoder = token_store.Encoder(P.path(token_store.TOKENIZER))
    rnd = random.Random(1)
    for _ in range(6):
        words = [f"w{rnd.randint(0, 10 ** 9)}" for _ in range(3000)] + ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(5)]
        encoder.encode_batch(pa.array([" ".join(words)]))
        assert encoder.bytes <= 1 << 20 and max(map(len, encoder.memo), default=0) <= token_store.MEMO_UNIT
        assert encoder.bytes == sum(len(k) + len(v) + token_store.MEMO_OVERHEAD for k, v in encoder.memo.items())


def test_one_id_for_a_third_of_all_rows(spark, library):
    """Rows of one doc_id, of equal texts too, are dealt to several files, which still follow doc_id."""
    from presswork.llm.token_store import read_tokens, write_tokens

    rows = [(i, f"text number {i}") for i in range(400)] + [(77, "the same")] * 200 + [(None, f"no id {i % 7}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "n_tokens").selectExpr(
        "n_tokens as text", "'clash' as n_tokens", "doc_id", "1 as start")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = write_tokens(docs)
        got = sorted(read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert manifest.agg({"n_docs": "max"}).first()[0] < 150
    assert [r.doc_id for r in got] == [None] * 100 + sorted(i for i, _ in rows if i is not None)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    crc = lambda text: zlib.crc32(np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, crc(t)) for i, t in rows)


def test_units_as_a_plain_scan_cuts_them():
    """White space, and the border between ASCII punctuation and an ASCII letter, digit or Latin letter with a mark, cut."""
    from presswork.llm.common import string_arrays
    from presswork.llm.token_store import split_units

    letter = lambda c: c.isascii() and c.isalnum() or "\xc0" <= c <= "ɿ" and c not in "×÷İ"
    mark = lambda c: "!" <= c <= "~" and not c.isalnum() and c != "'"
    rnd = random.Random(6)
    signs = "aZ9éÿĀŉſİ×÷¿ßʀɏ日😀́ \t\n\x1f\x02\x85\xa0'-.(<"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12))) for _ in range(20_000)] + [None, "", ".", "É", "-É", "É-"]
    expected = []
    for text in texts:
        units, before = [], " "
        for c in text or "":
            if c not in " \t\n":
                if before in " \t\n" or mark(before) and letter(c) or letter(before) and mark(c):
                    units.append("")
                units[-1] += c
            before = c
        expected.append(units)
    offsets, data = string_arrays(pa.array(texts))
    start, counts = split_units(offsets, data)
    assert counts.tolist() == list(map(len, expected))
    ends, raw = [*start[1:].tolist(), len(data)], data.tobytes()
    assert [raw[a:b].rstrip().decode() for a, b in zip(start.tolist(), ends, strict=True)] == [u for units in expected for u in units]


def test_words_of_letters_are_given_to_the_library_with_a_blank_between(library):
    """One call for many words, with nothing to encode but the words: no joint to encode beside each."""
    from presswork.llm.token_store import TOKENIZER, Encoder

    rnd = random.Random(2)
    words = list(dict.fromkeys("".join(rnd.choice("abcdefghiéñüßñ日本ΣК") for _ in range(rnd.randint(1, 12))) for _ in range(5000)))
    encoder, given = Encoder(P.path(TOKENIZER)), []
    call = encoder._ids
    encoder._ids = lambda texts: given.extend(texts) or call(texts)
    got = encoder.encode([w.encode() for w in words])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(given) <= 5 and sum(map(len, given)) <= sum(map(len, words)) + len(words)


def test_letters_that_the_library_turns_into_more(library):
    """A dotted capital I and a composition exclusion end in marks, so their words are not told apart by blanks."""
    from presswork.llm.token_store import TOKENIZER, Encoder

    words = ["abc", "İstanbul", "xİ", "क़", "क़a", "zß", "ﬁn", "ŉa", "ǅ", "ªº", "ㅤ", "K", "한", "하", "𐐀x", "ⅷ"] * 2
    encoder = Encoder(P.path(TOKENIZER))
    got = encoder.encode([w.encode() for w in words])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert {"İstanbul".isalpha(), "क़".isalpha()} == {True}
