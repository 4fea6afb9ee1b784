"""Ranked lexical search: an automaton over the terms of all items reads every text, there is no index.

The distinct terms of the items are broadcast. Each task builds an Aho-Corasick automaton of them,
every term guarded by a boundary mark on either side, so that it matches whole terms alone; a text
is read with each byte between terms turned into that mark. Counting the automaton's outputs gives
a document's term frequencies directly from its text. Texts are read twice: once for the numbers of
documents that hold each term (added up in each task before the shuffle), once for the scores. A
term's output number leads to the items that hold it, so a document adds only to items that share a
term with it. A task keeps the best ``TOP`` documents of each item; the rest is a ranking of those.

Size: items are searched in blocks of about ``BLOCK_CHARS`` characters of distinct terms (one block
for any usual set); a block's terms, postings and weights are all that is broadcast or returned to
the driver. Each block reads the texts anew, so nothing whole grows with the items. One item's terms
are held together. In a task, a text with its automaton outputs and one ``CELLS`` table are in memory.

Edge cases: a null or empty text holds no term and is not counted; repeated documents are documents
of their own, with ranks of their own (equal doc_ids in any order); a null doc_id comes after all
others of its score; items of one item_id are one item, null included; a null or empty item and an
empty table give no rows; scores are whole numbers, exact at any number of terms; other columns are
never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from presswork.llm.common import LOWER, byte_set, map_batches, pick, slices, string_arrays

TOP = 10
#: Characters of distinct terms in a block of items.
BLOCK_CHARS = 2_000_000
#: Bytes of text, pairs of a term's occurrence and an item, and cells of a score table at a time.
READ_BYTES, PAIRS, CELLS = 1 << 20, 2 << 20, 4 << 20
#: Bytes of terms: letters, digits and everything outside ASCII.
TERM_BYTES = byte_set(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Every other byte is the boundary mark; A-Z are lower-cased.
_MARKED = np.where(TERM_BYTES, LOWER, 32).astype(np.uint8)
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = np.iinfo(np.int64).max


class TermSet:
    """A block's items and distinct terms: ``items[places[t]:places[t + 1]]`` hold term number t."""

    def __init__(self, ids: list, terms_of: list[list[str]]):
        self.ids = ids
        self.terms = sorted({t for terms in terms_of for t in terms})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = np.array([(number[t], i) for i, terms in enumerate(terms_of) for t in terms], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.items = pairs[:, 1].astype(np.int32)
        self.places = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))
        self.most = max(map(len, terms_of), default=0)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once a worker; each term stands between two boundary marks."""
        if self._automaton is None:
            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(self.terms):
                found.add_word(f" {term} ", i)
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a run of texts: number of terms of each, and (text, term, occurrences) of the items' terms."""
        offsets, data = string_arrays(column)
        marked, inside = _MARKED[data], TERM_BYTES[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = inside[heads]
        sizes = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
        text, term, tf = [], [], []
        raw = marked.tobytes()
        for i in np.flatnonzero(sizes) if self.terms else ():
            held = Counter(map(_output, self.automaton.iter(f" {raw[offsets[i]:offsets[i + 1]].decode(errors='replace')} ")))
            text.append(np.full(len(held), i))
            term.append(np.fromiter(held.keys(), np.int64, len(held)))
            tf.append(np.fromiter(held.values(), np.int64, len(held)))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return sizes, join(text), join(term), join(tf)


def _output(match: tuple[int, int]) -> int:
    return match[1]


class Best:
    """The best ``top`` (score, doc_id) of each item among those offered."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.held = np.zeros((3, 0), np.int64)  # item, score, doc_id
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def offer(self, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        """``scores``: a row a document, a column an item; only scores above 0 count."""
        row, item = np.nonzero(scores >= self.least)
        if len(row):
            self.new.append(np.stack([item, scores[row, item], doc_ids[row]]))
            self.waiting += len(row)
            if self.waiting > 2 * self.top * len(self.least) + 1000:
                self.settle()

    def settle(self) -> np.ndarray:
        every = np.concatenate([self.held, *self.new], axis=1)
        every = every[:, np.lexsort((every[2], -every[1], every[0]))]
        first = np.searchsorted(every[0], np.arange(len(self.least)))
        place = np.arange(every.shape[1]) - first[every[0]]
        last = place == self.top - 1
        self.least[every[0, last]] = every[1, last]
        self.held, self.new, self.waiting = every[:, place < self.top], [], 0
        return self.held


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[TermSet]:
    """The items in blocks; items of one id are one item, whose distinct terms stay together."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(_PATTERN), F.lit(0))
    terms = pick(benchmark, "item_id", "text").select("item_id", F.explode(words).alias("term")).distinct()
    chars = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    n = -(-int(chars) // block_chars)
    for i in range(n):
        own = terms if n == 1 else terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        rows = own.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        if rows:
            yield TermSet([r.item_id for r in rows], [r.terms for r in rows])


def _statistics(texts: DataFrame, held) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents with each of the items' terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, length = np.zeros(len(held.value.terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, most=READ_BYTES):
                sizes, _, term, _ = held.value.count(part.column("text"))
                df += np.bincount(term, minlength=len(df))
                documents, length = documents + int((sizes > 0).sum()), length + int(sizes.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], documents)),
            pa.array(np.append(np.zeros(len(seen), np.int64), length))], names=["term", "documents", "length"])

    sums = map_batches(texts.select("text"), run, "term bigint, documents bigint, length bigint").groupBy("term").agg(
        F.sum("documents").alias("documents"), F.sum("length").alias("length"))
    df, total, length = np.zeros(len(held.value.terms), np.int64), 0, 0
    for row in sums.collect():  # a row a term of the block, and one with the totals
        if row.term < 0:
            total, length = row.documents, row.length
        else:
            df[row.term] = row.documents
    return total, length, df


def weights(total: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _sums(cell: np.ndarray, value: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """Sums of whole numbers by cell; doubles hold them unless there are very many, then in two parts."""
    if exact:
        return np.bincount(cell, value, n).astype(np.int64)
    high, low = value >> 20, value & (1 << 20) - 1
    return (np.bincount(cell, high, n).astype(np.int64) << 20) + np.bincount(cell, low, n).astype(np.int64)


def _scores(block: TermSet, term_weights: np.ndarray, text: np.ndarray, term: np.ndarray, tf: np.ndarray,
            m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, scores of the texts from it on by item) for a run of texts with length factors ``m``."""
    value = term_weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
    n, fans = len(block.ids), np.diff(block.places)[term]
    exact = block.most * int(value.max(initial=0)) < 1 << 53
    bounds = np.searchsorted(text, np.arange(len(m) + 1))
    before = np.concatenate(([0], np.cumsum(fans)))
    start, rows = 0, max(1, CELLS // n)
    while start < len(m):
        fits = int(np.searchsorted(before[bounds], before[bounds[start]] + PAIRS, "right")) - 1
        end = min(max(start + 1, fits), start + rows, len(m))
        a, b = bounds[start], bounds[end]
        own = fans[a:b]
        ends = np.cumsum(own)
        at = np.repeat(block.places[term[a:b]] - (ends - own), own) + np.arange(ends[-1] if b > a else 0)
        cell = np.repeat((text[a:b] - start) * n, own) + block.items[at]
        yield start, _sums(cell, np.repeat(value[a:b], own), (end - start) * n, exact).reshape(-1, n)
        start = end


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, above 0 only.

    Items match documents by terms (letters, digits and characters outside ASCII, A-Z lower-cased);
    a term's weight falls with the documents that hold it, its share of a score rises with its
    occurrences and falls with the document's length.
    """
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = StructType().add(pick(benchmark, "item_id").schema[0]).add("doc_id", "long").add("score", "long")
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)
        total, length, df = _statistics(texts, held)
        found = found.unionAll(_best_of_tasks(texts, held, weights(total, df), total, length, top, schema))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # a row a task, item and rank: thinned in parts of an item first
    parts = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    thin = found.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top).drop("rank")
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _best_of_tasks(texts: DataFrame, held, term_weights: np.ndarray, total: int, length: int, top: int,
                   schema: StructType) -> DataFrame:
    """The best documents of each item in every task."""
    out_type = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best = Best(len(block.ids), top)
        for batch in batches:
            for part in slices(batch, most=READ_BYTES):
                sizes, text, term, tf = block.count(part.column("text"))
                if not len(text):
                    continue
                m = np.array([10 + 90 * n * total // length for n in sizes.tolist()], np.int64)
                doc_ids = part.column("doc_id").fill_null(_LAST).to_numpy()
                for start, scores in _scores(block, term_weights, text, term, tf, m):
                    best.offer(scores, doc_ids[start:start + len(scores)])
        item, score, doc_id = best.settle()
        if len(item):
            ids = [block.ids[i] for i in item.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, out_type), pa.array(doc_id, mask=doc_id == _LAST), pa.array(score)],
                names=["item_id", "doc_id", "score"])

    return map_batches(texts, run, schema)


#: The same ranking in DuckDB: terms as rows, joined.
SEARCH_SQL = r"""
with doc_terms as (
  select doc_id, row_number() over () as doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), totals as (
  select count(*) as n_docs, sum(len(terms))::bigint as n_terms from doc_terms where len(terms) > 0
), occurrences as (
  select doc, term, count(*) as tf from (select doc, unnest(terms) as term from doc_terms) group by doc, term
), item_terms as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weighted as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from occurrences, totals group by term, n_docs
), lengths as (
  select doc, doc_id, 10 + (90 * len(terms)::bigint * n_docs) // n_terms as m from doc_terms, totals where len(terms) > 0
), scores as (
  select i.item_id, l.doc_id, l.doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from item_terms i join occurrences o using (term) join weighted using (term) join lengths l using (doc)
  group by i.item_id, l.doc_id, l.doc
), ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id asc nulls last))::int as rank, doc_id, score
  from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
