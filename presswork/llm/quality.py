"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation
maximisation over the counts of vote patterns (a table of at most 3^labellers rows, counted over
all documents) estimates how often each labeller votes what on good documents and on each kind of
bad ones, and the kinds' shares; the kinds start from the labellers' families, since a document bad
in one way is no evidence about labellers of another. The posteriors of good of a bounded sample of documents (``SAMPLE`` rows, chosen by a
hash) train a linear scorer over hashed features of words; the scorer then judges every document.

Passes: votes over all documents (only patterns are shuffled), features of the sample, scores over
all documents. Nothing is joined, so a hot source or a very long document moves no data.

Edge cases: a null, empty or blank text has no evidence: it gets probability null and is rejected
(nothing in it to keep); one-word texts are judged as any other; repeated rows get equal scores; an
empty table gives an empty result; null ids are judged like others; further columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import (LOWER, Words, byte_set, map_batches, mix64, pick, rename_all, slices, string_arrays)

#: Documents whose posteriors train the scorer, and the number of hashed features.
SAMPLE, FEATURES = 6000, 4096
ROUNDS = 60
#: Bytes of text that are turned into word arrays at a time: these take some fifty times as much.
SLICE = 1 << 20
GOOD, BAD, ABSTAIN = 1, 0, 2

LABELLERS = ("symbols", "bars", "capitals", "exclaims", "plain_words", "doubled_bytes", "repeated_words",
             "distinct_words", "repeated_pairs", "word_length", "bare_symbols", "short_words")

#: Labellers that see the same kind of badness; EM starts each kind from its family.
FAMILIES = (("symbols", "plain_words", "doubled_bytes"), ("bars", "plain_words", "bare_symbols", "short_words"),
            ("capitals", "exclaims", "plain_words", "doubled_bytes"),
            ("repeated_words", "distinct_words", "repeated_pairs"))
#: Words of no evidence added to every text, so that a few odd words don't condemn a short one.
NEUTRAL_WORDS = 6

_WORD = byte_set(lambda b: b != 32 and not 9 <= b <= 13)
_LETTER = byte_set(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_UPPER = byte_set(lambda b: 65 <= b <= 90)
_LOWER_CASE = byte_set(lambda b: 97 <= b <= 122)
_SYMBOL = byte_set(lambda b: chr(b) in "#$%&*@^~<>{}[]")
#: What ordinary words, numbers, phone numbers and quotations consist of.
_ORDINARY = byte_set(lambda b: _LETTER[b] or chr(b) in "0123456789.+-()=\"':/")
_STOP = byte_set(lambda b: chr(b) in ".,;:?")
#: Classes of bytes in word shapes: symbols stand for themselves.
_SHAPE = np.array([ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0")
                   if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[edges[1:]] - sums[edges[:-1]]


def _vote(values: np.ndarray, bad_above: float, good_below: float) -> np.ndarray:
    return np.where(values > bad_above, BAD, np.where(values < good_below, GOOD, ABSTAIN))


def votes(words: Words) -> np.ndarray:
    """One row of votes per text; texts without words abstain throughout."""
    data, edges = words.data, words.offsets
    n = np.maximum(words.count, 1)
    ends = np.append(words.first, len(words.start))
    size = np.maximum(_per_text(_WORD[data], edges), 1)
    letters = np.maximum(_per_text(_UPPER[data] | _LOWER_CASE[data], edges), 1)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & ~_LETTER[data[1:]] & _WORD[data[1:]]
    odd = np.concatenate(([0], np.cumsum(~_ORDINARY[data])))
    tail = _STOP[data[words.end - 1]] if len(words.end) else np.zeros(0, bool)
    plain = odd[words.end] - odd[words.start] <= tail
    hashes = words.hashes()
    again, pair_again = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    pair_again[2:] = again[2:] & again[1:-1]
    keyed = hashes + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first_seen = np.unique(keyed, return_index=True)
    distinct = np.bincount(words.doc[first_seen], minlength=len(n)) if len(keyed) else np.zeros(len(n))
    rare = np.where(words.count >= 25, 1 - distinct / np.minimum(n, 60), 0.5)
    length = _per_text(words.end - words.start, ends) / n
    bare = (odd[words.end] - odd[words.start] == words.end - words.start) & (words.end - words.start < 3)
    short = np.where(words.count >= 25, 1 - _per_text(words.end - words.start <= 3, ends) / n, 0.88)
    out = np.stack([
        _vote(_per_text(_SYMBOL[data], edges) / size, 0.05, 0.01),
        _vote(_per_text(data == ord("|"), edges) / n, 0.25, 0.02),
        _vote(_per_text(_UPPER[data], edges) / letters, 0.4, 0.15),
        _vote(_per_text(data == ord("!"), edges) / n, 0.4, 0.05),
        _vote(1 - _per_text(plain, ends) / n, 0.35, 0.12),
        _vote(_per_text(same, edges) / size, 0.06, 0.015),
        _vote(_per_text(again, ends) / n, 0.25, 0.08),
        _vote(rare, 0.8, 0.5),
        _vote(_per_text(pair_again, ends) / n, 0.15, 0.03),
        _vote(np.abs(length - 6.0), 5.0, 2.5),
        _vote(_per_text(bare, ends) / n, 0.2, 0.02),
        _vote(short, 0.9, 0.85),
    ], axis=1)
    out[words.count == 0] = ABSTAIN
    return out.astype(np.int64)


def _patterns(found: np.ndarray) -> np.ndarray:
    return found @ (3 ** np.arange(found.shape[1], dtype=np.int64))


def features(words: Words) -> np.ndarray:
    """Two hashed features a word: its content, and its shape with whether it repeats the word before."""
    hashes = words.hashes(seed=5)
    shapes = _SHAPE[words.data]
    last = words.end - 1
    key = shapes[words.start].astype(np.uint64)
    for back in range(3):
        at = last - back
        key = key * np.uint64(257) + np.where(at >= words.start, shapes[np.maximum(at, 0)], 0).astype(np.uint64)
    again = np.zeros(len(hashes), np.uint64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = mix64(key * np.uint64(2) + again + np.uint64(1 << 40))
    both = np.stack([hashes % np.uint64(FEATURES // 2), np.uint64(FEATURES // 2) + shape % np.uint64(FEATURES // 2)])
    return both.astype(np.int64)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS
                             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares of good and of each bad kind, vote probabilities [kind, labeller, vote], posterior of
    good per pattern). One vote of each kind per class is added, so no probability becomes zero."""
    k = len(LABELLERS)
    given = (patterns[:, None] // 3 ** np.arange(k)) % 3
    one_hot = (given[:, :, None] == np.arange(3)).astype(float)
    table = np.empty((1 + len(FAMILIES), k, 3))
    table[:] = np.array([0.05, 0.80, 0.15])
    for i, family in enumerate(FAMILIES, 1):
        table[i, [LABELLERS.index(name) for name in family]] = np.array([0.70, 0.15, 0.15])
    shares = np.array([0.8, *[0.2 / len(FAMILIES)] * len(FAMILIES)])
    posterior = np.zeros((len(patterns), len(shares)))
    for _ in range(rounds):
        logs = np.log(shares) + np.tensordot(one_hot, np.log(table), axes=([1, 2], [1, 2]))
        posterior = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        weight = posterior * counts[:, None]
        seen = np.tensordot(weight, one_hot, axes=(0, 0)) + 1.0
        table = seen / seen.sum(axis=2, keepdims=True)
        shares = (weight.sum(axis=0) + 1) / (counts.sum() + len(shares))
    return shares, table, posterior[:, 0]


@dataclass
class QualityModel:
    shares: np.ndarray
    labellers: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, words: Words) -> np.ndarray:
        used = self.weights[features(words)].sum(axis=0) if len(words.start) else np.zeros(0)
        mean = _per_text(used, np.append(words.first, len(words.start))) / (words.count + NEUTRAL_WORDS)
        return np.where(words.count > 0, 1 / (1 + np.exp(-np.clip(mean + self.bias, -60, 60))), np.nan)


def _train(rows: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on word-feature shares: Adam on the whole sample, light L2."""
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, f in enumerate(rows):
        x[i] = np.bincount(f, minlength=FEATURES) / (len(f) // 2 + NEUTRAL_WORDS)
    weights, bias = np.zeros(FEATURES, np.float32), np.float32(0)
    m, v = np.zeros(FEATURES + 1, np.float32), np.zeros(FEATURES + 1, np.float32)
    y = target.astype(np.float32)
    for step in range(1, 301):
        miss = (1 / (1 + np.exp(-np.clip(x @ weights + bias, -60, 60))) - y) / max(1, len(y))
        grad = np.append(miss @ x + 1e-6 * weights, miss.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def _words(column: pa.Array) -> Words:
    return Words(*string_arrays(column), _WORD, LOWER)


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """The label model over all of ``docs`` and the scorer from a sample of about ``sample`` rows."""
    rows = pick(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                words = Words(*string_arrays(part.column("text")), _WORD)
                seen, n = np.unique(_patterns(votes(words)[words.count > 0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], names=["pattern", "n"])

    counted = (map_batches(rows.select("text"), count, "pattern bigint, n bigint").groupBy("pattern")
               .agg(F.sum("n").alias("n")).collect())
    if not counted:
        return QualityModel(np.ones(1), np.full((1, len(LABELLERS), 3), 1 / 3), np.zeros(FEATURES, np.float32), 0.0)
    patterns = np.array([r.pattern for r in counted])
    counts = np.array([r.n for r in counted], float)
    order = np.argsort(patterns)
    shares, table, posterior = expectation_maximisation(patterns[order], counts[order])
    of_pattern = dict(zip(patterns[order].tolist(), posterior.tolist(), strict=True))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                words = Words(*string_arrays(part.column("text")), _WORD)
                found = features(_words(part.column("text")))
                keep = np.flatnonzero(words.count)
                lists = []
                for i in keep:
                    own = np.sort(found[:, words.first[i]:words.first[i] + words.count[i]].ravel())
                    lists.append(own[:: max(1, len(own) // 20_000)])  # shares of at most 20,000 words
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_patterns(votes(words))[keep]), pa.array([x.astype(np.int16) for x in lists], pa.list_(pa.int16()))],
                    names=["pattern", "features"])

    part = min(1.0, sample / counts.sum())
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(np.ceil(part * 1_000_000)))
    got = map_batches(chosen, describe, "pattern bigint, features array<smallint>").limit(2 * sample).collect()
    target = np.array([of_pattern[r.pattern] for r in got])
    weights, bias = _train([np.array(r.features, np.int64) for r in got], target)
    return QualityModel(shares, table, weights, bias)


def score(docs: DataFrame, model: QualityModel, column: str = "probability") -> DataFrame:
    """``docs`` with all its columns and, last, the probability of good quality (null without words)."""
    names = docs.columns
    plain = rename_all(docs)
    at = names.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}", SLICE):
                p = held.value.probability(_words(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, from_pandas=True)],
                                                 names=[*part.schema.names, "p"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return map_batches(plain, run, f"{schema}, p double").toDF(*names, column)


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, probability, accepted) for every row."""
    rows = pick(docs, "doc_id", "text")
    return score(rows, fit(rows)).select("doc_id", "probability",
                                         F.coalesce(F.col("probability") >= threshold, F.lit(False)).alias("accepted"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the scorer accepts."""
    names = docs.columns
    scored = score(docs, fit(docs), "p")
    plain = rename_all(scored)
    return plain.filter(F.col(plain.columns[-1]) >= threshold).drop(plain.columns[-1]).toDF(*names)
