"""Language identification of mixed texts: script ranges, word scores and a Viterbi path over the words.

A word is a run of letters (and marks on them), lower-cased, at most ``PIECE`` characters of it at a time.

1. Scripts: a letter's script is the range of code points it lies in. Languages that were learned with
   a share of at least ``SCRIPT_SHARE`` of their letters in a word's script are its candidates; where
   there is none, all languages are.
2. Scores: a word's score in a language sums over its characters the log share of the trigram around
   each (a blank stands for the word's ends), mixed with the mean share over all languages; trigrams
   that no language has are worth the same everywhere.
3. Path: Viterbi over the words of a text, with ``SWITCH`` nats for every change of language, gives spans.
   The language whose spans hold most letters is the text's; ties go to the first by name.

Learning counts trigrams and letters by language over every training row: each task adds up its own,
Spark the tasks'. Shares, not counts, make the model, so it doesn't depend on the languages' sizes.
Trigrams below ``LEAST_SHARE`` of every language's are left out, at any size of the input; so each of
L languages brings 1 / LEAST_SHARE trigrams at most, and the model, a table of 4 bytes a trigram and
language that is collected once and broadcast, stays below 400 kB x L x L (4 languages: 6.4 MB). Training rows of
one language may be most of all rows: nothing is grouped but counts.

The score is the share of the text's letters in spans of the predicted language, times that language's
posterior given these spans' words.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and no spans; so is every text if
nothing was learned; a null lang teaches nothing; repeated rows count each; an empty table gives an
empty result; a text is never divided (a task needs about 150 bytes a character of the longest);
other columns are never read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import map_batches, pick, slices, string_arrays

UNDETERMINED = "und"
#: Cost of a change of language between two words, in nats.
SWITCH = 8.0
#: Weight of the mean share over all languages in a trigram's share.
MIXED = 0.05
#: Least share of a language's trigrams that a trigram of the model has in some language.
LEAST_SHARE = 1e-5
SCRIPT_SHARE = 0.01
PIECE = 32
READ_BYTES = 1 << 20
#: Distinct (language, trigram) counts that a training task holds before it hands them on.
HELD_COUNTS = 1 << 20

# Fixed values of the Unicode standard: first code points of the scripts' main blocks, each up to the next.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2E80, "Han"), (0x3040, "Hiragana"), (0x30A0, "Katakana"),
    (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x33480, "Other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_BLANK = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for a mark, else 0; and the lower case (itself where that is not one character)."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.int64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            kind[i] = 1
            if len(small := c.lower()) == 1:
                lower[i] = ord(small)
        elif i > 127 and unicodedata.category(c)[0] == "M":
            kind[i] = 2
    return kind, lower


class Letters:
    """The words of a run of texts: trigrams of their characters, and where they begin.

    ``gram``: a key a character of a word (three code points of 21 bits); ``word``: the words' first places
    in it; ``first``/``count``: each text's range of words; ``letters`` and ``script`` of each word;
    ``start``/``end``: its characters in the text."""

    def __init__(self, column: pa.Array):
        offsets, data = string_arrays(column)
        points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le", "replace"), "<u4")
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        bounds = heads[offsets]  # of the texts, in code points
        kind_of, lower_of = _tables()
        kind = kind_of[points]
        inside = np.flatnonzero(kind)
        lower = lower_of[points[inside]]
        gap = np.ones(len(inside) + 1, bool)
        gap[1:-1] = np.diff(inside) > 1
        gap[np.searchsorted(inside, bounds)] = True
        begins = np.flatnonzero(gap[:-1])
        # long runs in pieces
        sizes = np.diff(np.append(begins, len(inside)))
        if len(sizes) and sizes.max() > PIECE:
            pieces = -(-sizes // PIECE)
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begins = np.repeat(begins, pieces) + number * PIECE
        self.word = begins
        edge = np.zeros(len(inside) + 1, bool)
        edge[begins] = edge[-1] = True
        previous, following = np.full(len(inside), _BLANK), np.full(len(inside), _BLANK)
        previous[1:], following[:-1] = lower[:-1], lower[1:]
        previous[edge[:-1]], following[edge[1:]] = _BLANK, _BLANK
        self.gram = previous.astype(np.int64) << 42 | lower << 21 | following
        is_letter = (kind[inside] == 1).astype(np.int64)
        self.letters = np.add.reduceat(is_letter, begins) if len(begins) else np.zeros(0, np.int64)
        self.script = _SCRIPT[np.searchsorted(_STARTS, points[inside[begins]], "right") - 1]
        cuts = np.searchsorted(inside[begins], bounds)
        self.first, self.count = cuts[:-1], np.diff(cuts)
        self.text = np.repeat(np.arange(len(bounds) - 1), self.count)
        lasts = np.append(begins[1:], len(inside)) - 1
        self.start, self.end = (inside[x] - bounds[:-1][self.text] for x in (begins, lasts)) if len(begins) else (begins, begins)
        self.end = self.end + 1


@dataclass
class Model:
    """Languages by name; sorted trigram keys with a score a language; candidates by script; log share of the texts."""

    languages: list[str]
    keys: np.ndarray
    scores: np.ndarray
    candidates: np.ndarray
    prior: np.ndarray

    def words(self, held: Letters) -> np.ndarray:
        """The score of each word in each language; what is no candidate is out of reach."""
        if not len(held.word):
            return np.zeros((0, len(self.languages)))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, held.gram), len(self.keys) - 1)
            rows = np.where(self.keys[at] == held.gram, at, len(self.keys))  # the last row is of unknown trigrams
        else:
            rows = np.zeros(len(held.gram), np.int64)
        out = np.empty((len(held.word), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.scores[k][rows], held.word, dtype=np.float64)
        return np.where(self.candidates[held.script], out, -1e6)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word (``scores``: a row a word) along each text's path.

    All texts are walked side by side, the longest to the end; a change costs ``switch``."""
    best = np.zeros(len(scores), np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    alive = np.searchsorted(-count, -np.arange(1, count.max(initial=0) + 1), "right")
    value = np.tile(prior, (int(alive[0]) if len(alive) else 0, 1))
    stays = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.int64)
    for t, n in enumerate(alive.tolist()):
        at = first[:n] + t
        value = value[:n] if len(value) > n else value
        if t:
            top = value.argmax(axis=1)
            floor = value[np.arange(n), top] - switch
            keep = value >= floor[:, None]
            stays[at], came[at] = keep, top
            value = np.where(keep, value, floor[:, None])
        value = value + scores[at]
        ended = np.flatnonzero(count[:n] == t + 1)
        best[at[ended]] = value[ended].argmax(axis=1)
    for t in range(len(alive) - 1, 0, -1):
        at = first[:alive[t]] + t
        now = best[at]
        best[at - 1] = np.where(stays[at, now], now, came[at])
    return best


def fit(docs: DataFrame, switch: float = SWITCH) -> Model:
    """The model of the languages of ``docs`` (text, lang): every row with a lang teaches."""
    rows = pick(docs, "text", "lang").filter("lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = {}, {}
        for batch in batches:
            for part in slices(batch, most=READ_BYTES):
                langs = part.column("lang").dictionary_encode()
                held, code = Letters(part.column("text")), langs.indices.to_numpy()
                of_word = code[held.text]
                of_gram = np.repeat(of_word, np.diff(np.append(held.word, len(held.gram))))
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    found, n = np.unique(held.gram[of_gram == k], return_counts=True)
                    mine = of_word == k
                    by_script = np.bincount(held.script[mine], held.letters[mine], len(_NAMES)).astype(np.int64)
                    # scripts as keys -1, -2, ...; the number of texts as the key before them
                    extra = np.append(-1 - np.arange(len(_NAMES)), -1 - len(_NAMES))
                    keys.setdefault(lang, []).append(np.concatenate([found, extra]))
                    counts.setdefault(lang, []).append(np.concatenate([n, by_script, [int((code == k).sum())]]))
                if sum(len(x) for parts in keys.values() for x in parts) > HELD_COUNTS:
                    keys, counts = _summed(keys, counts)
                    if sum(len(parts[0]) for parts in keys.values()) > HELD_COUNTS // 2:
                        yield from _handed(keys, counts)
                        keys, counts = {}, {}
        yield from _handed(*_summed(keys, counts))

    counted = map_batches(rows, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.filter("n > 0").persist()
    try:
        totals = {r.lang: r.n for r in counted.filter("gram >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        rest = counted.filter("gram < 0").collect()
        least = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(LEAST_SHARE * n)) for lang, n in totals.items()],
                           F.lit(0.0))
        common = counted.filter("gram >= 0").filter(F.col("n") >= least).select("gram").distinct()
        table = counted.join(common, "gram").toPandas()
    finally:
        counted.unpersist()
    languages = sorted({r.lang for r in rest})
    number = {lang: k for k, lang in enumerate(languages)}
    keys = np.unique(table["gram"].to_numpy(np.int64))
    shares = np.zeros((len(languages), len(keys)))
    shares[table["lang"].map(number).to_numpy(np.int64), np.searchsorted(keys, table["gram"].to_numpy(np.int64))] = (
        table["n"].to_numpy(float) / table["lang"].map(totals).to_numpy(float))
    mean = shares.mean(axis=0) if languages else shares.sum(axis=0)
    # a last column for trigrams outside the model: the same in every language
    scores = np.log((1 - MIXED) * shares + MIXED * mean)
    scores = np.concatenate([scores, np.full((len(languages), 1), np.log(MIXED * LEAST_SHARE))], axis=1).astype(np.float32)
    letters, texts = np.zeros((len(_NAMES), len(languages))), np.zeros(len(languages))
    for r in rest:
        if r.gram == -1 - len(_NAMES):
            texts[number[r.lang]] = r.n
        else:
            letters[-1 - r.gram, number[r.lang]] = r.n
    known = letters > SCRIPT_SHARE * letters.sum(axis=0)
    known[~known.any(axis=1)] = True
    return Model(languages, keys, scores, known, np.log(texts / max(texts.sum(), 1)))


def _summed(keys: dict, counts: dict) -> tuple[dict, dict]:
    """The counts of each language with every key once."""
    out: tuple[dict, dict] = {}, {}
    for lang in keys:
        found, at = np.unique(np.concatenate(keys[lang]), return_inverse=True)
        out[0][lang], out[1][lang] = [found], [np.bincount(at, np.concatenate(counts[lang])).astype(np.int64)]
    return out


def _handed(keys: dict, counts: dict) -> Iterator[pa.RecordBatch]:
    for lang in keys:
        for found, n in zip(keys[lang], counts[lang], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found),
                                              pa.array(n)], names=["lang", "gram", "n"])


_SPANS = "array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every document; spans are (start, end, lang) in characters of
    the text, from the first to the last word of neighbours in one language."""
    rows = pick(docs, "doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=READ_BYTES):
                lang, score, spans = _labelled(held.value, Letters(part.column("text")), part.num_rows, switch)
                bounds, columns = spans
                arrays = [pa.array(c, t.type) for c, t in zip(columns, span, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(span)))],
                    names=["doc_id", "lang_pred", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, lang_pred string, score double, spans {_SPANS}")


def _labelled(model: Model, words: Letters, n: int, switch: float):
    """Language and score of each of ``n`` texts, and their spans (bounds by text; starts, ends, languages)."""
    if not len(words.word) or not model.languages:
        return [UNDETERMINED] * n, np.zeros(n), (np.zeros(n + 1, np.int64), ([], [], []))
    k = len(model.languages)
    scores = model.words(words)
    path = viterbi(scores, words.first, words.count, model.prior, switch)
    letters = np.bincount(words.text * k + path, words.letters, n * k).reshape(n, k)
    total = letters.sum(axis=1)
    top = letters.argmax(axis=1)
    own = path == top[words.text]
    sums = np.stack([np.bincount(words.text[own], scores[own, j], n) for j in range(k)], axis=1) + model.prior
    sums -= sums.max(axis=1, keepdims=True)
    posterior = np.exp(sums[np.arange(n), top]) / np.exp(sums).sum(axis=1)
    score = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1) * posterior, 0.0)
    lang = np.where(total > 0, np.array(model.languages, object)[top], UNDETERMINED)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (words.text[1:] != words.text[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(path)) - 1
    held = total[words.text[starts]] > 0
    starts, ends = starts[held], ends[held]
    bounds = np.searchsorted(words.text[starts], np.arange(n + 1))
    return lang.tolist(), score, (bounds, (words.start[starts], words.end[ends], [model.languages[j] for j in path[starts]]))


def is_held_out() -> Column:
    """Whether a row's doc_id (as text) is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans): learns from the rows that are not held out,
    predicts all. A null doc_id is not held out."""
    named = pick(docs, "doc_id", "text", "lang")
    found = identify(named, fit(named.filter(~is_held_out())))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
