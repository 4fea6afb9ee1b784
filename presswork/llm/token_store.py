"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

Documents are range-partitioned and sorted by doc_id; each task tokenises its part and writes one
file. A file is a run of frames of at most ``FRAME_IDS`` ids each (little-endian unsigned 32-bit
numbers), then frames with the documents' index (doc_id and number of ids, 64-bit numbers), then the
seek table of the public zstandard seekable format: a skippable frame that lists every frame's
compressed size, decompressed size and checksum (the low 32 bits of the XXH64 of its content).
A reader gets the table from the end of the file and decompresses only the frames it needs.

Files of lost or repeated task attempts are harmless: each attempt writes a name of its own, and the
manifest, written once, names the files that count. The manifest has one row a file.

Encoding: a text is cut into units at ASCII white space and between ASCII punctuation and letters
(the tokenizer never joins across these); each distinct unit is encoded once by the tokenizers
library, many in a call: units of letters with a blank between, told apart by the ids that end a word,
others with a control character between, whose id is known. A worker remembers units of up to
``MEMO_UNIT`` bytes, ``MEMO_BYTES`` in all; results do not depend on the memory. A unit is never divided: a text without blanks is one
unit, encoded whole.

Edge cases: a null or empty text is its end id alone; rows of equal doc_ids are ordered by their texts'
hashes and may lie in several files;
null doc_ids come first and are kept; control strings of the vocabulary are ordinary text; an empty
table gives an empty manifest and result; other columns are never read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.llm.common import chunks, map_batches, pick, saved, scratch_path, slices, string_arrays

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids in a frame, and documents in a frame of the index.
FRAME_IDS, FRAME_DOCS = 1 << 18, 1 << 16
#: Bytes of units and ids that a worker remembers, longest remembered unit, and what an entry takes beside its bytes.
MEMO_BYTES, MEMO_UNIT, MEMO_OVERHEAD = 200 << 20, 256, 200
#: Units in one call of the library.
JOINED = 2048
LEVEL = 3
# Fixed values of the public seekable format: skippable frame, footer, and "checksums follow".
SKIPPABLE, FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

#: Kinds of bytes: white space, punctuation, ASCII letters and digits, lead bytes of two-byte letters (Latin letters with
#: marks), other bytes of letters and signs beyond ASCII; 0: the apostrophe and control characters.
_SPACE, _MARK, _ALNUM, _LATIN, _BEYOND = range(1, 6)
_KINDS = bytes(_SPACE if b == 32 or 9 <= b <= 13 else _LATIN if 0xC3 <= b <= 0xC9 else _BEYOND if b > 127 else
               _ALNUM if chr(b).isalnum() else _MARK if 33 <= b <= 126 and b != 39 else 0 for b in range(256))
#: Not letters under these lead bytes: two signs, and the dotted capital I, whose lower case ends in a combining mark.
_NOT_LETTERS = (0xC397, 0xC3B7, 0xC4B0)
_NO, _YES, _IF_LETTER = range(3)


def _begins(before: int, here: int) -> int:
    """Whether a unit begins at a byte, by the kinds of the byte before and its own."""
    if here == _SPACE:
        return _NO
    if before == _SPACE or (before, here) in ((_MARK, _ALNUM), (_ALNUM, _MARK)):
        return _YES
    return _IF_LETTER if (before, here) in ((_MARK, _LATIN), (_LATIN, _MARK), (_BEYOND, _MARK)) else _NO


#: ``_begins`` by 8 times the kind before and the kind here.
_BEGINS = bytes(_begins(i >> 3, i & 7) for i in range(256))
#: Joins units in one call of the library; a unit that holds it is encoded alone.
_JOINT = b" \x02 "


def split_units(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of all texts begin, and the number of units of each text. A unit reaches to the
    next one or to white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    pairs = kind.copy()
    pairs[1:] |= kind[:-1] << 3
    begin = np.frombuffer(pairs.tobytes().translate(_BEGINS), np.uint8).copy()
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = kind[heads] != _SPACE
    start = np.flatnonzero(begin != _NO)
    sure = begin[start] == _YES
    unsure = start[~sure]
    # the two-byte letter, or sign, that begins here or ends before the punctuation here
    lead = np.maximum(np.where(kind[unsure] == _MARK, unsure - 2, unsure), 0)
    sign = data[lead].astype(np.uint16) << 8 | data.take(lead + 1, mode="clip")
    sure[~sure] = (kind[lead] == _LATIN) & ~np.isin(sign, _NOT_LETTERS)
    start = start[sure]
    return start, np.diff(np.searchsorted(start, offsets))


def _letters(unit: bytes) -> bool:
    """Whether a unit, in normal form and lower case as the library encodes it, is letters alone."""
    return unicodedata.normalize("NFC", unit.decode()).lower().isalpha()


class Encoder:
    """The tokenizer and the units that a worker has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[bytes, bytes] = {}
        self.bytes = 0
        self.joint = self._ids([_JOINT.decode()])[0]
        # ids that end a word; none where a word may end in a byte that has no such id
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix and all(c + suffix in vocab for c in ByteLevel.alphabet()):
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, part: list[bytes], words: bool) -> list[bytes] | None:
        """The ids of each unit from one call for all, or None if it does not tell them apart. A unit of letters alone
        is one word or more, so as many words as units are one each."""
        ids = np.array(self._ids([(b" " if words else _JOINT).join(part).decode()])[0], "<u4")
        if words:
            first = np.flatnonzero(self.ends[ids]) + 1
            first, end = np.append(0, first[:-1]), first
        else:
            end = np.flatnonzero(ids == self.joint[0])
            first, end = np.append(0, end + 1), np.append(end, len(ids))
        if len(end) != len(part):
            return None
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * end).tolist(), strict=True)]

    def encode(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit as little-endian unsigned 32-bit numbers."""
        memo = self.memo
        out = list(map(memo.get, units))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = dict.fromkeys(units[i] for i in missing)
        words, together, alone = [], [], []
        for unit in new:
            (alone if len(unit) > MEMO_UNIT or b"\x02" in unit else words if _letters(unit) else together).append(unit)
        for part in chunks(words, JOINED):
            if found := self._joined(part, True):
                new.update(zip(part, found, strict=True))
            else:  # not letters to the library
                together += part
        for part in chunks(together, JOINED):
            if found := self._joined(part, False):
                new.update(zip(part, found, strict=True))
            else:  # the joint's id stands for something else too
                alone += part
        for part in chunks(alone, JOINED):
            for unit, ids in zip(part, self._ids([u.decode() for u in part]), strict=True):
                new[unit] = np.array(ids, "<u4").tobytes()
        for i in missing:
            out[i] = new[units[i]]
        kept = {u: ids for u, ids in new.items() if len(u) <= MEMO_UNIT} if alone else new
        memo.update(kept)
        self.bytes += sum(map(len, kept)) + sum(map(len, kept.values())) + MEMO_OVERHEAD * len(kept)
        if self.bytes > MEMO_BYTES:
            memo.clear()
            self.bytes = 0
        return out

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's end id included, and the number of ids of each."""
        offsets, data = string_arrays(column)
        start, counts = split_units(offsets, data)
        # each unit with the white space up to the next one, which only the distinct ones lose
        array = pa.Array.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        units = list(map(bytes.rstrip, coded.dictionary.to_numpy(zero_copy_only=False)))
        parts = pa.array([np.uint32(END_ID).tobytes(), *self.encode(units)], pa.large_binary())
        # an end id (code 0) after the units of each text
        codes = np.insert(coded.indices.to_numpy() + 1, np.cumsum(counts), 0)
        bounds, raw = string_arrays(parts.take(pa.array(codes)), pa.large_binary())
        marks = bounds[np.concatenate(([0], np.cumsum(counts + 1)))] // 4
        return raw.view("<u4"), np.diff(marks)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes frames to a stream and the seek table at the end."""

    def __init__(self, stream):
        self.stream, self.entries = stream, []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def write(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.stream.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


def write_file(uri: str, batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Writes (doc_ids, ids, counts) runs to a file; returns the numbers of documents and ids.

    A null doc_id is given as the smallest 64-bit number."""
    fs, path = _open(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    docs, n_ids, rest = [], 0, np.zeros(0, "<u4")
    with fs.open_output_stream(path, compression=None) as stream:  # the frames are compressed here
        out = FrameWriter(stream)
        for doc_ids, ids, counts in batches:
            docs.append(np.stack([doc_ids, counts], axis=1).astype("<i8"))
            n_ids += len(ids)
            rest = np.concatenate([rest, ids])
            while len(rest) >= FRAME_IDS:
                out.write(rest[:FRAME_IDS].astype("<u4").tobytes())
                rest = rest[FRAME_IDS:]
        if len(rest):
            out.write(rest.astype("<u4").tobytes())
        index = np.concatenate(docs) if docs else np.zeros((0, 2), "<i8")
        id_frames = len(out.entries)
        for part in (index[i:i + FRAME_DOCS] for i in range(0, len(index), FRAME_DOCS)):
            out.write(part.tobytes())
        out.write(struct.pack("<QQ", id_frames, len(index)))
        out.close()
    return len(index), n_ids


class TokenFile:
    """Reads a file frame by frame; every frame is checked against its checksum."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.entries = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        self.places = np.concatenate(([0], np.cumsum([e[0] for e in self.entries]))).tolist()
        self.id_frames, self.n_docs = struct.unpack("<QQ", self.frame(n - 1))

    def frame(self, i: int) -> bytes:
        packed, size, check = self.entries[i]
        content = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.places[i]), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return content

    def index(self) -> np.ndarray:
        """(doc_id, number of ids) of every document in order."""
        parts = [np.frombuffer(self.frame(i), "<i8") for i in range(self.id_frames, len(self.entries) - 1)]
        return np.concatenate(parts).reshape(-1, 2) if parts else np.zeros((0, 2), "<i8")

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from number ``start`` on; only the frames that hold them are decompressed."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // FRAME_IDS, (start + count - 1) // FRAME_IDS
        held = np.frombuffer(b"".join(self.frame(i) for i in range(first, last + 1)), "<u4")
        return held[start - first * FRAME_IDS:start - first * FRAME_IDS + count]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id's number, ids) of every document, one frame in memory beside a document's own."""
        start, frame, held = 0, -1, np.zeros(0, "<u4")
        for doc_id, count in self.index().tolist():
            parts, at = [], start
            while at < start + count:
                if at // FRAME_IDS != frame:
                    frame = at // FRAME_IDS
                    held = np.frombuffer(self.frame(frame), "<u4")
                part = held[at - frame * FRAME_IDS:start + count - frame * FRAME_IDS]
                parts.append(part)
                at += len(part)
            yield doc_id, start, parts[0] if len(parts) == 1 else np.concatenate(parts or [held[:0]])
            start += count

    def close(self) -> None:
        self.file.close()


_NULL = np.iinfo(np.int64).min


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Tokenises ``docs`` (doc_id, text) into files below ``folder``; returns the manifest: part, uri,
    n_docs, n_tokens and first (ids in all files before)."""
    spark = docs.sparkSession
    folder, path = folder or scratch_path(spark, "token-files"), path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), encoder(path)

        def encoded(first: pa.RecordBatch):
            for batch in chain([first], batches):
                for piece in slices(batch):
                    ids, counts = held.encode_batch(piece.column("text"))
                    yield piece.column("doc_id").fill_null(_NULL).to_numpy(), ids, counts

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
        n_docs, n_tokens = write_file(uri, encoded(first))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([n_docs], pa.int64()),
                                          pa.array([n_tokens], pa.int64())], names=["part", "uri", "n_docs", "n_tokens"])

    # equal ids are dealt out by text, equal texts by row, so that none of them lands in one task
    keys = ("doc_id", "hash", "row")
    rows = pick(docs, "doc_id", "text").withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    manifest = saved(map_batches(ordered.select("doc_id", "text"), run, "part bigint, uri string, n_docs bigint, n_tokens bigint"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; with
    ``with_ids`` also the ids as array<bigint>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
                file, rows = TokenFile(uri), []
                for doc_id, start, ids in file.documents():
                    rows.append((None if doc_id == _NULL else doc_id, first + start, len(ids), zlib.crc32(ids.tobytes()),
                                 ids.tolist() if with_ids else None))
                    if len(rows) == 2000:
                        yield packed(rows)
                        rows = []
                file.close()
                if rows:
                    yield packed(rows)

    def packed(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = manifest.select("part", "uri", "first")
    n = max(1, files.count())
    out = map_batches(files.repartitionByRange(n, "part"), run,
                      "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>")
    return out if with_ids else out.drop("ids")
