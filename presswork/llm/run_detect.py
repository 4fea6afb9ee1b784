"""Periodic runs of words: a difference-cover index answers longest-common-extension queries on a harmonic grid.

A run is a stretch of words that repeats with a smallest period q, at least ``max(24, 3 * q)`` words
long and not extensible. Such a stretch holds at least ``max(24 - q, 2 * q)`` consecutive words equal
to the word q further on, so of each period only every so many-th word is compared with its partner
(the harmonic grid: about n log n comparisons over all periods). Where the two agree, the extension
to the right, and to the left on the mirrored words, tells the stretch.

Extensions (``Extensions``): positions whose number modulo ``COVER`` lies in a difference cover are the
sample; for any two positions some offset below ``COVER`` brings both into it. Only the sampled
suffixes are sorted (by blocks of ``COVER`` words, then by doubling), with the common prefixes of
neighbours and a sparse table of their minima. A query compares words up to the offset and then
reads the rest from the table.

Texts of a batch are taken ``READ_BYTES`` at a time, as one row of word numbers with a mark of its own
between any two texts, so that nothing extends over a text's end. A text is never divided; a task
needs about 500 bytes a word of the longest text.

Edge cases: a null or empty text has no words and no runs; words are compared by all their bytes;
a null doc_id is never rewritten by ``with_planted_period``; repeated rows are rows of their own; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from presswork.llm.common import Words, byte_set, map_batches, pick, slices, string_arrays

#: A run's least length in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Modulus of the sample, and the residues: every number below ``COVER`` is a difference of two of them.
COVER, RESIDUES = 21, (0, 1, 4, 14, 16)
READ_BYTES = 1 << 20
#: Grid points in memory at a time.
POINTS = 1 << 20
WORD_BYTES = byte_set(lambda b: not (b == 32 or 9 <= b <= 13))

_SLOT = np.full(COVER, -1)
_SLOT[list(RESIDUES)] = np.arange(len(RESIDUES))
#: ``_OFFSET[a, b]``: the least offset that brings positions of residues a and b into the sample.
_OFFSET = np.array([[next(d for d in range(COVER) if _SLOT[(a + d) % COVER] >= 0 and _SLOT[(b + d) % COVER] >= 0)
                     for b in range(COVER)] for a in range(COVER)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of ``keys``, equal keys alike."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    steps = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = steps
    return ranks


class Extensions:
    """Longest common extensions to the right in ``words`` (word numbers; the last one, and one in each
    stretch that a query may run into, occurs nowhere else)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        # marks of their own behind the end, so that every block is whole
        self.words = np.concatenate([words, words.max(initial=0) + 1 + np.arange(2 * COVER)]).astype(np.int64)
        self.per_class = n // COVER + 1
        sample = (np.array(RESIDUES)[:, None] + COVER * np.arange(self.per_class)).ravel()
        sample = np.minimum(sample, n + COVER - 1)  # behind the end: never asked for
        self._sort(sample)

    def _sort(self, sample: np.ndarray) -> None:
        blocks = self._blocks(sample)
        levels = [blocks]
        last = (np.arange(len(sample)) // self.per_class + 1) * self.per_class - 1
        ranks, step = blocks, 1
        while len(ranks) > 1 and step < self.per_class and ranks.max() < len(ranks) - 1:
            after = ranks[np.minimum(np.arange(len(ranks)) + step, last)]
            ranks = _ranks(ranks * (len(ranks) + 1) + after)
            levels.append(ranks)
            step *= 2
        order = np.argsort(ranks, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        # common prefix of neighbours in this order: whole blocks by the levels, then words
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            size = 1 << level
            same = (levels[level][a] == levels[level][b]) & (a + size <= last[a]) & (b + size <= last[b])
            common[same] += size * COVER
            a[same] += size
            b[same] += size
        common += self._compare(sample[a], sample[b], np.full(len(a), COVER))
        self.table = [common.astype(np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half, least = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(least[:-half], least[half:]))

    def _blocks(self, sample: np.ndarray) -> np.ndarray:
        """The order of the sampled blocks of ``COVER`` words; blocks told apart early are not looked at again."""
        ranks = _ranks(self.words[sample])
        for t in range(1, COVER):
            open_ = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
            if not len(open_):
                break
            # ranks leave room between them for the open ones
            own = _ranks(ranks[open_] * (int(self.words[-1]) + 1) + self.words[sample[open_] + t])
            ranks = ranks * len(sample)
            first = np.full(len(own), len(own))
            np.minimum.at(first, _ranks(ranks[open_]), own)
            ranks[open_] += own - first[_ranks(ranks[open_])]
            ranks = _ranks(ranks)
        return ranks

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and ``b`` on, up to ``most`` (below or at ``COVER``)."""
        equal = np.zeros(len(a), np.int64)
        on = np.flatnonzero(most > 0)
        top = len(self.words) - 1
        while len(on):
            at = equal[on]
            on = on[self.words[np.minimum(a[on] + at, top)] == self.words[np.minimum(b[on] + at, top)]]
            equal[on] += 1
            on = on[equal[on] < most[on]]
        return equal

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from positions ``a`` and ``b`` (a < b) on."""
        offset = _OFFSET[a % COVER, b % COVER]
        equal = self._compare(a, b, offset)
        on = np.flatnonzero(equal == offset)
        p, q = a[on] + offset[on], b[on] + offset[on]
        p, q = (self.place[_SLOT[x % COVER] * self.per_class + x // COVER] for x in (p, q))
        low, high = np.minimum(p, q), np.maximum(p, q)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at, table = np.flatnonzero(level == k), self.table[k]
            equal[on[at]] += np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return equal


def find_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of texts that lie end to end (``counts`` words each): text, start, length and period, in that order."""
    firsts = np.cumsum(counts) - counts
    texts = np.flatnonzero(counts >= LEAST_WORDS)
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none, none
    sizes = counts[texts]
    # one mark of its own before and after each text
    base = np.cumsum(sizes + 1) - sizes
    row = int(words.max(initial=0)) + 1 + np.arange(sizes.sum() + len(texts) + 1)
    source = np.repeat(firsts[texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    place = np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    row[place] = words[source]
    points = list(_grid(row, base, sizes))
    at, period = (np.concatenate(x) for x in zip(*points, strict=True)) if points else (none, none)
    right = Extensions(row).common(at, at + period) if len(at) else none
    mirrored = len(row) - 1
    left = Extensions(row[::-1]).common(mirrored - (at + period - 1), mirrored - (at - 1)) if len(at) else none
    whole = np.flatnonzero(right + left + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
    start, length, period = at[whole] - left[whole], (left + right + period)[whole], period[whole]
    # a stretch found with multiples of its period counts with the smallest, several grid points find it
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    text = np.searchsorted(base, start, "right") - 1
    start = start - base[text]
    order = np.lexsort((period, start, text))
    return texts[text][order], start[order], length[order], period[order]


def _grid(row: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points (position, period) whose word is the word a period further on."""
    periods = sizes // LEAST_PERIODS
    ends = np.cumsum(periods)
    for low in range(0, int(ends[-1]), POINTS):
        pair = np.arange(low, min(low + POINTS, int(ends[-1])))
        text = np.searchsorted(ends, pair, "right")
        period = pair - (ends[text] - periods[text]) + 1
        step = np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
        number = -(-(sizes[text] - period) // step)
        upto = np.cumsum(number)
        a = 0
        while a < len(pair):
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + POINTS, "right")))
            n = number[a:b]
            q, skip = np.repeat(period[a:b], n), np.repeat(step[a:b], n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(base[text[a:b]], n) + k * skip
            hit = row[at] == row[at + q]
            yield at[hit], q[hit]
            a = b


def planted_period(doc_id: int, n: int) -> tuple[int, int] | None:
    """Where and with which period the contract rewrites the words of a document, if it does."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class Texts:
    """The words of a run of texts as numbers (equal words alike), and their spellings."""

    def __init__(self, column: pa.Array):
        offsets, data = string_arrays(column)
        words = Words(offsets, data, WORD_BYTES)
        self.counts, self.firsts = words.count, np.cumsum(words.count) - words.count
        bounds = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int64)
        inside = WORD_BYTES[data]
        self.spelled = pa.Array.from_buffers(pa.large_binary(), len(words.start), [
            None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
        self.numbers = self.spelled.dictionary_encode().indices.to_numpy().astype(np.int64)

    def joined(self, at: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of ``counts`` words each from the words numbered ``at``, joined by one space."""
        bounds = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64())
        lists = pa.LargeListArray.from_arrays(bounds, self.spelled.take(pa.array(at)))
        return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def _collapsed(texts: Texts, source: np.ndarray, text, start, length, period) -> pa.Array:
    """Every text without the words that a run holds after its first period."""
    drops = np.zeros(len(source) + 1, np.int64)
    np.add.at(drops, texts.firsts[text] + start + period, 1)
    np.add.at(drops, texts.firsts[text] + start + length, -1)
    kept = np.cumsum(drops[:-1]) == 0
    before = np.concatenate(([0], np.cumsum(kept)))
    return texts.joined(source[kept], before[texts.firsts + texts.counts] - before[texts.firsts])


_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) of every document: runs an array of (start, length, period) by start,
    then period; collapsed the text (binary) with each run reduced to its first period.

    ``plant`` first rewrites the words of about every tenth document (``planted_period``)."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, source, found in _found(batches, plant):
            text, start, length, period = found
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(text, np.arange(len(ids) + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([ids, runs, _collapsed(texts, source, *found).cast(pa.binary())],
                                              names=["doc_id", "runs", "collapsed"])

    return map_batches(_rows(docs), run, f"doc_id bigint, runs array<{_RUN}>, collapsed binary")


def _rows(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text")
    return rows.withColumn("doc_id", rows.doc_id.cast("bigint"))


def _found(batches: Iterator[pa.RecordBatch], plant: bool):
    """(doc_ids, texts, number of each word's spelling, runs) of about ``READ_BYTES`` of text at a time."""
    for batch in batches:
        for part in slices(batch, most=READ_BYTES):
            texts, ids = Texts(part.column("text")), part.column("doc_id")
            source = np.arange(len(texts.numbers))
            for i, doc_id in enumerate(ids.to_pylist()) if plant else ():
                n, first = int(texts.counts[i]), texts.firsts[i]
                if doc_id is not None and (planted := planted_period(doc_id, n)):
                    a, p = planted
                    source[first + a:first + n] = first + a + np.arange(n - a) % p
            yield ids, texts, source, find_runs(texts.numbers[source], texts.counts)


def report(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Per document: doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli;
    ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, source, found in _found(batches, plant):
            collapsed = _collapsed(texts, source, *found)
            bounds = np.searchsorted(found[0], np.arange(len(ids) + 1)).tolist()
            runs = list(zip(*(x.tolist() for x in found[1:]), strict=True))
            rows = []
            for i in range(len(ids)):
                own = runs[bounds[i]:bounds[i + 1]]
                best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else (None, None, None)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in own).encode()
                rows.append((len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(lines).hexdigest(),
                             hashlib.sha256(collapsed[i].as_buffer()).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'bigint'}" for n in names)
    return map_batches(_rows(docs), run, kinds)
