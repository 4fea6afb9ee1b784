"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Encoding: a text is cut into words (the matches of the public split pattern, found with array
operations on character classes). Distinct words become rows in DuckDB; a recursive query lays a
word out as token positions, joins neighbouring tokens with the merge table, and contracts the
leftmost pair of minimum rank of every word, until no word has a pair left. Words over ``LONG_WORD``
bytes are first cut where no token of the vocabulary occurs across, which leaves pieces of some bytes of
almost any text. What is still long, such as digits or one letter repeated, takes a query that contracts
all disjoint occurrences of the minimum pair at once where that is the same, and is cut again after
``ROUNDS`` rounds.

Decoding: the ids of a document are cut into runs, distinct runs become rows (run, position, id),
and an ordered aggregation over the join with the token table gives each run's bytes.

A worker remembers the words it has encoded and the runs it has decoded, about ``MEMO_WORDS`` each of up to
``LONG_WORD`` bytes or ids; the memory only saves work, results never depend on it. Each task holds about
``SLICE`` bytes of text as arrays.

Edge cases: a null or empty text has no ids and decodes to no bytes; a text without blanks is one word, encoded
whole by its pieces (1 MB: some seconds); ids and texts of equal rows
are equal; ids that are not in the vocabulary make decoding fail with their value; an empty table
gives an empty result; other columns are kept out of the way by position.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from presswork.llm.common import chunks, map_batches, pick, rename_all, slices, string_arrays

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a word from which on the query for long words is used.
LONG_WORD = 96
#: Rounds of contraction between two cuts of a long piece.
ROUNDS = 8
#: Words a worker remembers, and words given to one query.
MEMO_WORDS, QUERY_WORDS = 300_000, 30_000
#: Bytes of text that are split, encoded and decoded at a time.
SLICE = 1 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Contractions of the split pattern after the apostrophe.
_ENDINGS = [tuple(map(ord, e)) for e in ("s", "t", "re", "ve", "m", "ll", "d")]

_SHORT = """
with recursive state(round, word, toks) as (
  select 0, word, toks from words
  union all
  select round + 1, s.word,
         s.toks[:(best & 4294967295) - 1] || [(best >> 32)::int] || s.toks[(best & 4294967295) + 2:]
  from state s join (
    select word, min(merged << 32 | place) as best
    from (select word, unnest(toks[:-2]) as a, unnest(toks[2:]) as b, unnest(range(1, len(toks))) as place
          from state where len(toks) > 1) pairs
    join merges on pairs.a = merges.first and pairs.b = merges.second
    group by word) least using (word)
)
select word, arg_max(toks, round) as toks from state group by word
"""

# every pair of the minimum rank at once (of a chain of overlapping ones, a token repeated, the first, third,
# fifth ...) up to the first whose token makes a pair of lower rank with what stands or will stand beside it,
# which is what one contraction after the other from the left would do; ``ROUNDS`` times
_LONG = """
with recursive state(word, round, toks) using key (word) as (
  select word, 0, toks from words
  union
  (with pairs as (
    select word, place, merged, before, after, min(merged) over (partition by word) as least
    from (select word, unnest(toks[:-2]) as a, unnest(toks[2:]) as b, unnest([-1] || toks[:-3]) as before,
                 unnest(toks[3:] || [-1]) as after, unnest(range(1, len(toks))) as place
          from state where len(toks) > 1 and round < {rounds}) p
    join merges on p.a = merges.first and p.b = merges.second),
  hits as (
    select word, place, merged, before, after, place - row_number() over (partition by word order by place) as chain
    from pairs where merged = least),
  turns as (select *, row_number() over (partition by word, chain order by place) as nth,
                   row_number() over (partition by word order by place) as ordinal from hits),
  checked as (
    select t.word, t.place, t.merged, t.ordinal,
           sum((x.merged < t.merged or y.merged < t.merged or z.merged < t.merged)::int) over (partition by t.word order by t.place) as lower
    from turns t left join merges x on x.first = t.before and x.second = t.merged
    left join merges y on y.first = t.merged and y.second = t.after
    left join merges z on z.first = t.merged and z.second = t.merged
    where t.nth % 2 = 1),
  taken as (select word, place, merged from checked where ordinal = 1 or coalesce(lower, 0) = 0),
  tokens as (select word, round, unnest(toks) as tok, unnest(range(1, len(toks) + 1)) as place
             from state where word in (select word from taken)),
  kept as (select t.word, t.round, t.place, coalesce(h.merged, t.tok)::int as tok
           from tokens t left join taken h on h.word = t.word and h.place = t.place
           where not exists (select 1 from taken d where d.word = t.word and d.place + 1 = t.place))
  select word, max(round) + 1, list(tok order by place) from kept group by word)
)
select word, toks from state
"""

_DECODE = """
select run, list(bytes order by place) as parts from runs join tokens using (id) group by run order by run
"""


@cache
def _classes() -> np.ndarray:
    """The split pattern's class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 <= b:
                kinds[a:0xD800] = kinds[0xE000:b + 1] = kind
            else:
                kinds[a:b + 1] = kind
    return kinds


def split_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pattern's matches over all texts (they cover the texts without gaps), and
    the number of matches of each text."""
    text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width)))
    heads = np.searchsorted(at, offsets)  # texts' first characters
    n = len(points)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    kind = _classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[heads] = True
    first = begin[:n].copy()  # a text's first character
    begin[1:n] |= kind[1:] != kind[:-1]
    last = np.append(first[1:], True)  # a text's last character
    # a run of white space followed by something else gives its last character away: a blank to
    # what follows, any other as a match of its own
    gives = (kind == SPACE) & ~last
    gives[:-1] &= kind[1:] != SPACE
    give = np.flatnonzero(gives)
    begin[give] = True
    blank = give[points[give] == 32]
    begin[blank + 1] = False
    begin[heads] = True
    _contractions(points, kind, first, last, begin)
    starts = np.flatnonzero(begin[:n])
    counts = np.diff(np.searchsorted(starts, heads))
    return np.append(at[starts], at[n]), counts


def _contractions(points: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray) -> None:
    """An apostrophe that starts a match and stands before one of the endings is a match with it."""
    for i in np.flatnonzero(points == 39):
        if not first[i] and (kind[i - 1] == OTHER or points[i - 1] == 32):
            continue  # part of the match before
        for ending in _ENDINGS:
            j = i + 1 + len(ending)
            if j <= len(points) and not first[i + 1:j].any() and tuple(points[i + 1:j]) == ending:
                begin[i], begin[i + 1:j], begin[j] = True, False, True
                break


class Vocabulary:
    """Ranks, the merge table and a DuckDB connection of one worker."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
        self.ranks, self.memo, self.decoded = ranks, {}, {}
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.known[list(ranks.values())] = True
        self.after_blank = np.zeros(len(self.known), bool)  # tokens that start with a blank
        self.after_blank[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        firsts, seconds, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    firsts.append(a), seconds.append(b), merged.append(rank)
        merges = pa.table({"first": pa.array(firsts, pa.int32()), "second": pa.array(seconds, pa.int32()),
                           "merged": pa.array(merged, pa.int64())})
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        for name, table in (("merges", merges), ("tokens", tokens)):
            self.con.register("given", table)
            self.con.execute(f"create table {name} as select * from given")
            self.con.unregister("given")

    def _merge(self, words: list[bytes], query: str) -> list[bytes]:
        """The ids of words, given as bytes."""
        return self._contract(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], [len(w) for w in words], query)

    def _contract(self, ids: np.ndarray, sizes: list[int], query: str) -> list[bytes]:
        """What the query makes of words, given as ids end to end."""
        toks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
        self.con.register("words", pa.table({"word": pa.array(range(len(sizes)), pa.int32()), "toks": toks}))
        got = self.con.sql(query).to_arrow_table()
        self.con.unregister("words")
        toks = got.column("toks").combine_chunks()
        raw = toks.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = np.cumsum(toks.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        out: list = [b""] * len(sizes)
        for word, a, b in zip(got.column("word").to_pylist(), [0, *ends], ends):
            out[word] = raw[4 * a:4 * b]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        memo = self.memo
        new = {w for w in words if w not in memo}
        found, short, long = {}, [], []
        for w in new:
            if w in self.ranks:  # the whole word is a token
                found[w] = np.uint32(self.ranks[w]).tobytes()
            elif len(w) <= LONG_WORD:
                short.append(w)
            else:
                long.append(w)
        if long:
            found.update(zip(long, self._long(long), strict=True))
        for part in chunks(short, QUERY_WORDS):
            found.update(zip(part, self._merge(part, _SHORT), strict=True))
        out = [memo[w] if w in memo else found[w] for w in words]
        memo.update((w, ids) for w, ids in found.items() if len(w) <= LONG_WORD)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return out

    def _long(self, words: list[bytes]) -> list[bytes]:
        """The ids of long words, all of them together: cut into pieces, short ones contracted to the end, long
        ones for some rounds and cut again, since what has been contracted leaves fewer tokens that can
        still cross a place."""
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        n = int(bounds[-1])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        ends = np.arange(1, n + 1)  # of the tokens, in bytes
        occur = tuple(np.concatenate(x) for x in zip(*(
            (a + first, b + first) for (a, b), first in zip(map(self.occurrences, words), bounds[:-1], strict=True)), strict=True))
        done: dict[int, bytes] = {}  # by the first byte
        while len(ids):
            starts = ends - self.sizes[ids]
            short, long = {}, []
            for a, b in self._pieces(ids, ends, occur, n):
                if b - a == 1:
                    done[int(starts[a])] = ids[a:b].astype("<u4").tobytes()
                elif b - a <= LONG_WORD:
                    short.setdefault(ids[a:b].astype("<u4").tobytes(), []).append(int(starts[a]))
                else:
                    long.append((a, b))
            for part in chunks(list(short), QUERY_WORDS):
                flat = np.frombuffer(b"".join(part), "<u4")
                for piece, got in zip(part, self._contract(flat, [len(p) // 4 for p in part], _SHORT), strict=True):
                    done.update((first, got) for first in short[piece])
            left = []
            if long:
                flat = np.concatenate([ids[a:b] for a, b in long])
                for (a, b), got in zip(long, self._contract(flat, [b - a for a, b in long], _LONG.format(rounds=ROUNDS)), strict=True):
                    if len(got) == 4 * (b - a):
                        done[int(starts[a])] = got
                    else:
                        left.append((int(starts[a]), np.frombuffer(got, "<u4").astype(np.int64)))
            ids = np.concatenate([x for _, x in left]) if left else ids[:0]
            ends = np.concatenate([first + np.cumsum(self.sizes[x]) for first, x in left]) if left else ends[:0]
        order = np.array(sorted(done))
        parts = [done[first] for first in order.tolist()]
        cuts = np.searchsorted(order, bounds).tolist()
        return [b"".join(parts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _pieces(self, ids: np.ndarray, ends: np.ndarray, occur: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[int, int]]:
        """Ranges of tokens between places that no token of the vocabulary, from one token's begin to another's end, occurs across.

        Whatever contraction still makes is such a token, so nothing ever crosses these places."""
        begins = ends - self.sizes[ids]
        is_begin, is_end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        is_begin[begins], is_end[ends] = True, True
        start, end = (x[is_begin[occur[0]] & is_end[occur[1]]] for x in occur)
        crossed = np.cumsum(np.bincount(start + 1, minlength=n + 1) - np.bincount(end, minlength=n + 1))
        fixed = (crossed[ends[:-1]] == 0) | (begins[1:] != ends[:-1])
        places = [0, *(np.flatnonzero(fixed) + 1).tolist(), len(ids)]
        return list(zip(places[:-1], places[1:], strict=True))

    @cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each token."""
        sizes = np.zeros(len(self.known), np.int64)
        for token, rank in self.ranks.items():
            sizes[rank] = len(token)
        return sizes

    @cached_property
    def _finder(self) -> ahocorasick.Automaton:
        """Finds every token of two bytes or more; bytes are given as the characters of their numbers."""
        finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in self.ranks:
            if len(token) > 1:
                finder.add_word(token.decode("latin-1"), len(token))
        finder.make_automaton()
        return finder

    def occurrences(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every occurrence of a token of two bytes or more."""
        found = np.fromiter((end << 16 | size for end, size in self._finder.iter(word.decode("latin-1"))), np.int64)
        end = (found >> 16) + 1
        return end - (found & 0xFFFF), end

    def decode(self, runs: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids (given as 32-bit numbers)."""
        memo, found = self.decoded, {}
        for part in chunks([r for r in runs if r not in memo], QUERY_WORDS):
            found.update(zip(part, self._join(part), strict=True))
        out = [memo[r] if r in memo else found[r] for r in runs]
        memo.update((r, parts) for r, parts in found.items() if len(r) <= 4 * LONG_WORD)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return out

    def _join(self, runs: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(runs), "<u4")
        unknown = ids[(ids >= len(self.known)) | ~self.known[np.minimum(ids, len(self.known) - 1)]]
        if len(unknown):
            raise ValueError(f"not in the vocabulary: {unknown[0]}")
        run = np.repeat(np.arange(len(runs), dtype=np.int32), [len(r) // 4 for r in runs])
        self.con.register("runs", pa.table({"run": run, "place": np.arange(len(ids), dtype=np.int32),
                                            "id": ids.astype(np.int32)}))
        parts = self.con.sql(_DECODE).to_arrow_table().column("parts").combine_chunks()
        self.con.unregister("runs")
        offsets, data = string_arrays(parts.flatten(), pa.large_binary())
        edges = offsets[np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))))].tolist()
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _gather(codes: np.ndarray, parts: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """All parts in the order of ``codes`` end to end, and where each begins (in units)."""
    flat = np.frombuffer(b"".join(parts), np.uint32 if unit == 4 else np.uint8)
    sizes = np.array([len(p) // unit for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    ends = np.cumsum(own)
    if not len(codes) or not ends[-1]:
        return flat[:0], np.concatenate(([0], ends))
    at = np.repeat(starts[codes] - (ends - own), own) + np.arange(ends[-1])
    return flat[at], np.concatenate(([0], ends))


def _distinct(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes and distinct values of consecutive byte strings."""
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                  [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def encode_batch(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the range of each text's ids."""
    offsets, data = string_arrays(column)
    words, counts = split_words(offsets, data)
    codes, distinct = _distinct(words, data)
    ids, begins = _gather(codes, vocab.encode(distinct), 4)
    return ids, begins[np.concatenate(([0], np.cumsum(counts)))]


def decode_batch(ids: np.ndarray, ranges: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """The bytes of each range of ids. Runs begin at tokens that start with a blank and at texts."""
    if not len(ids):
        return [b""] * (len(ranges) - 1)
    begin = vocab.after_blank[np.minimum(ids, len(vocab.after_blank) - 1)]
    begin[ranges[:-1][np.diff(ranges) > 0]] = True
    cuts = np.append(np.flatnonzero(begin), len(ids))
    codes, distinct = _distinct(cuts * 4, ids.astype("<u4").view(np.uint8))
    data, begins = _gather(codes, vocab.decode(distinct), 1)
    edges = begins[np.searchsorted(cuts, ranges)]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``docs`` with all its columns and a last one, the ids of ``text`` as array<int>."""
    path, names = path or public_tokenizers.path(RANKS), docs.columns
    plain = rename_all(docs)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, f"c{at}", SLICE):
                ids, ranges = encode_batch(part.column(at), vocab)
                lists = pa.ListArray.from_arrays(pa.array(ranges, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return map_batches(plain, run, f"{schema}, ids array<int>").toDF(*names, column)


def decode(encoded: DataFrame, path: str | None = None, column: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the ids in ``column`` replaced by the decoded text in ``text`` (last).

    Bytes that are no UTF-8 (ids cut apart inside a character) become U+FFFD; null ids a null text."""
    path, names = path or public_tokenizers.path(RANKS), encoded.columns
    plain = rename_all(encoded)
    at = names.index(column)
    kept = [i for i in range(len(names)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = batch.column(at)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            sizes = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
            texts = decode_batch(flat, np.concatenate(([0], np.cumsum(sizes))), vocab)
            new = [None if null else t.decode(errors="replace")
                   for t, null in zip(texts, ids.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(new, pa.string())],
                                             names=[*(f"c{i}" for i in kept), "text"])

    fields = plain.schema.fields
    schema = ", ".join(f"{fields[i].name} {fields[i].dataType.simpleString()}" for i in kept)
    out = map_batches(plain, run, f"{schema}, text string" if kept else "text string")
    return out.toDF(*[names[i] for i in kept], text)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers) and
    decoded_sha256 (the bytes that the ids decode to). Encoding and decoding share a task, so neither
    the texts nor the ids are written or shuffled."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids, ranges = encode_batch(part.column("text"), vocab)
                texts = decode_batch(ids, ranges, vocab)
                raw = ids.astype("<u4").tobytes()
                sums = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ranges[:-1], ranges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ranges)), pa.array(sums),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(pick(docs, "doc_id", "text"), run,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
