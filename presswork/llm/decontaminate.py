"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. Every
``window`` consecutive words of a benchmark item form a window; an item of fewer words (but
not none) is one window of its own length. The windows' hashes are broadcast, each task
looks up the windows of its documents and confirms every hit word by word.

Size: the benchmark is broadcast in blocks of about ``block_chars`` characters of item text, whose windows
are arrays of about 45 bytes a word (one block for any usual benchmark; measured: 8 million characters take some
400 MB in the driver while they are built, 41 MB once sent). With more blocks, documents are scanned once a block and
the hits merged by row, so nothing that grows with the benchmark is ever held whole.

Edge cases: null or empty texts have no words and are clean; null or empty items give no
window; repeated items and repeated documents count as rows of their own (items with one id
are one item); a null ``item_id`` takes part in hits but not in ``items``; an empty benchmark
leaves all documents clean; other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import (LOWER, Words, byte_set, map_batches, mix64, pick, random_odd, rename_all, slices,
                                   string_arrays)

WINDOW = 10
#: Characters of benchmark text that one broadcast block may hold.
BLOCK_CHARS = 8_000_000
#: Bytes of words: letters, digits and everything outside ASCII.
WORD_BYTES = byte_set(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

_SCAN = "hits array<int>, n_words bigint, items array<string>"


class WindowSet:
    """Windows of the benchmark items as arrays: the items' words, end to end, and for each length the sorted
    hashes of the distinct windows, the first word of each and the items that hold it. About 45 bytes a
    word beside the text."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        names = sorted({str(i) for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(names)}
        self.names = names
        words = _words(pa.array([t for _, t in items], pa.string()))
        self.data, self.start, self.end = words.data, words.start.astype(np.int32), words.end.astype(np.int32)
        owner = np.array([-1 if i is None else number[str(i)] for i, _ in items], np.int64)
        sizes = np.minimum(words.count, window)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        hashes = words.hashes()
        for size in np.unique(sizes[sizes > 0]).tolist():
            first = np.flatnonzero(words.doc[:len(hashes) - size + 1] == words.doc[size - 1:])
            first = first[sizes[words.doc[first]] == size]
            one, two = (_window_hashes(hashes, size, seed)[first] for seed in (0, 1))
            order = np.lexsort((two, one))
            one, two, first = one[order], two[order], first[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            held = np.unique(np.stack([np.cumsum(new) - 1, owner[words.doc[first]]]), axis=1)
            held = held[:, held[1] >= 0]
            self.by_length[size] = (one[new], first[new].astype(np.int32),
                                    np.searchsorted(held[0], np.arange(int(new.sum()) + 1)), held[1].astype(np.int32))

    def _spelled(self, first: int, size: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[first:first + size], self.end[first:first + size], strict=True)]

    def scan(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Whether each word is hit, and the item ids that occur in each text."""
        hit = np.zeros(len(words.start), bool)
        found: list[set[int]] = [set() for _ in range(len(words.offsets) - 1)]
        hashes = words.hashes()
        for size, (known, first, places, owners) in self.by_length.items():
            if len(hashes) < size:
                continue
            own = _window_hashes(hashes, size)
            inside = words.doc[:len(own)] == words.doc[size - 1:]
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            for i in np.flatnonzero(inside & (known[place] == own)):
                spelled = [words.data[words.start[k]:words.end[k]].tobytes() for k in range(i, i + size)]
                j = place[i]
                while j < len(known) and known[j] == own[i]:
                    if self._spelled(first[j], size) == spelled:
                        hit[i:i + size] = True
                        found[words.doc[i]].update(owners[places[j]:places[j + 1]].tolist())
                    j += 1
        return hit, [{self.names[k] for k in own} for own in found]


def _words(column: pa.Array) -> Words:
    return Words(*string_arrays(column), WORD_BYTES, LOWER)


def _window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(random_odd(size + 1000 * seed, size)):
        total += hashes[j:j + n] * factor
    return mix64(total)


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[object, str]]]:
    """The benchmark's items in blocks of bounded size; only one block is held at a time by a task."""
    items = pick(benchmark, "item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(chars) // block_chars))
    for i in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r.item_id, r.text) for r in block.select("item_id", F.col("text")).collect()]


def _scan(docs: DataFrame, block: list[tuple[object, str]], window: int) -> DataFrame:
    """``docs`` (any columns, the text in ``text``) with the columns hits, n_words, items."""
    held = docs.sparkSession.sparkContext.broadcast(WindowSet(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = _words(part.column("text"))
                hit, items = held.value.scan(words)
                at = [np.flatnonzero(hit[a:a + n]).tolist() if hit[a:a + n].any() else []
                      for a, n in zip(words.first, words.count, strict=True)]
                columns = list(part.columns) + [
                    pa.array(at, pa.list_(pa.int32())), pa.array(words.count, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "hits", "n_words", "items"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{names}, {_SCAN}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, hits, n_words, items) for every document row: hits are the word numbers
    (from 0) inside any occurring window, items the ids of the items with such windows."""
    rows = pick(docs, "doc_id", "text")
    parts = [_scan(rows, block, window) for block in _blocks(benchmark, block_chars)]
    if len(parts) == 1:
        return parts[0]
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionAll(part)
    merged = all_parts.groupBy("doc_id", "text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / F.lit(len(parts))).cast("int").alias("copies"))
    return merged.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_contamination(docs, benchmark, window).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def _cut(text: str, hits: list[int]) -> str:
    """``text`` without the hit words and what stands between two of them; the rest joined by one space."""
    data = text.encode()
    words = _words(pa.array([text], pa.string()))
    keep, last = [], 0
    for run in np.split(np.asarray(hits), np.flatnonzero(np.diff(hits) > 1) + 1):
        keep.append(data[last:words.start[run[0]]])
        last = words.end[run[-1]]
    keep.append(data[last:])
    return " ".join(p for p in (k.decode().strip() for k in keep) if p)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, mode: str = "documents",
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with all its columns: without the contaminated documents (``mode="documents"``),
    or with the hit spans cut out of their texts (``mode="spans"``; a column ``n_chars`` follows)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    names = docs.columns
    plain = rename_all(docs)
    text = plain.columns[names.index("text")]
    renamed = plain.withColumnRenamed(text, "text")
    blocks = list(_blocks(benchmark, block_chars))
    # a block at a time over the same rows: what a block hits, the next need not see
    for i, block in enumerate(blocks):
        if mode == "documents":
            renamed = _scan(renamed, block, window).filter(F.size("hits") == 0).drop("hits", "n_words", "items")
        else:
            renamed = _scan(renamed, block, window).withColumnsRenamed({"hits": f"hits{i}"}).drop("n_words", "items")
    if mode == "documents":
        return renamed.toDF(*names)
    hits = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"hits{i}") for i in range(len(blocks))]))))
    marked = renamed.withColumn("hits", hits).drop(*[f"hits{i}" for i in range(len(blocks))])
    schema = marked.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [t if not h else _cut(t, h) for t, h in
                   zip(batch.column(at).to_pylist(), batch.column("hits").to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = map_batches(marked, cut, schema).drop("hits").toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


#: The report in DuckDB: windows as joined words, every position of every document against them.
REPORT_SQL = r"""
with doc_words as (
  select doc_id, row_number() over () as doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), items as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), starts as (
  select item, words, least(10, len(words)) as size, unnest(range(1, len(words) - least(10, len(words)) + 2)) as pos
  from items where len(words) > 0
), windows as (
  select distinct item, size, array_to_string(words[pos:pos + size - 1], ' ') as spelled from starts
), sizes as (select distinct size from windows
), places as (
  select doc, size, words, unnest(range(1, len(words) - size + 2)) as pos from doc_words, sizes where len(words) >= size
), hits as (
  select p.doc, p.pos, p.size, w.item
  from places p join windows w on w.size = p.size and w.spelled = array_to_string(p.words[p.pos:p.pos + p.size - 1], ' ')
), hit_words as (
  select doc, count(distinct word) as n_hit from (select doc, unnest(range(pos, pos + size)) as word from hits) group by doc
), hit_items as (
  select doc, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit_words using (doc) left join hit_items using (doc)
"""
