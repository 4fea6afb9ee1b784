"""Secret scan: candidate strings, and a random forest that removes the false positives.

Candidates are long runs of token characters and values of assignments (``name = "value"``). The
forest judges each by its length, character classes, entropy, character transitions, coverage by
dictionary words, likeness to a path, and the words next to it. It is trained with Spark ML on
labelled findings: secrets of common formats and look-alikes (hashes of commits and files, ids,
paths, identifiers, numbers, place holders), made from a seed and set into ordinary words; the
number of findings (``FINDINGS``) bounds the training. The dictionary and the transition table come
from counts over all documents. The dictionary holds each word that makes at least one in ``RATE``
of all counted words, whatever their number, so there are at most ``RATE`` of them (of 14 letters at
most) and the model can be broadcast. Scanning is one pass without a shuffle.

A candidate of over ``LONG`` characters (a cookie, a path, a packed list) is judged in parts: its
pieces between separators and overlapping windows over the whole of it. Parts that are judged secret
and overlap or touch are one finding, a window's ends moved out to the piece they lie in (by a
window at most), its probability the highest of its parts.

Edge cases: null and empty texts have no candidates; a candidate is judged wherever it stands, also
in the last character of a very long text or in the middle of a very long run; equal rows give equal findings, once each; of
overlapping candidates the longer one counts, but a run is cut where a value begins in it, so that
``name=value`` is judged as name and value, and the value whole; an empty table trains on the findings alone and finds nothing;
a null id is kept as the finding's id; further columns are never read (``redact`` keeps them).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import map_batches, pick, rename_all, saved, slices

FINDINGS, SEED = 4000, 20
TREES, DEPTH = 30, 8
#: A word of the dictionary makes at least one in so many of all counted words.
RATE = 200_000
#: Characters of a candidate judged as a whole; of a longer one's windows, and from one window to the next.
LONG, WINDOW, STEP = 256, 64, 32
#: Parts judged at a time.
PARTS = 4096

_RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
_VALUE = re.compile(r"""[=:][ \t]{0,3}["']?([^\s"'<>|,;]{8,})""")
#: Where the next value of a query begins, in a value and in one that is an address.
_NEXT = re.compile(r"&(?:amp;)?[A-Za-z_][\w.\-]{0,40}=")
_NEXT_OF_ADDRESS = re.compile(r"(?:\?|&(?:amp;)?)[A-Za-z_][\w.\-]{0,40}=")
_WORD = re.compile(r"[^\W\d_]+")
#: The pieces of a long candidate, and what of one a window's end is moved over.
_PIECE = re.compile(r"[^/.=,:;&?\-]{16,}")
_BEFORE, _AFTER = re.compile(r"[A-Za-z0-9]*\Z"), re.compile(r"[A-Za-z0-9]*")
#: Words that name a secret, and words that name something that only looks like one.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "credential", "bearer", "private")
HARMLESS_NAMES = ("commit", "sha", "md5", "checksum", "hash", "digest", "uuid", "id", "version", "build", "file", "path",
                  "phone", "card", "example", "revision", "etag", "trace")

FEATURES = ("length", "digits", "lower", "upper", "symbols", "entropy", "transitions", "dictionary", "slashes", "dots",
            "path", "class_changes", "hexadecimal", "uuid", "repeats", "secret_word", "harmless_word", "assigned",
            "quoted", "placeholder")


@dataclass
class Lexicon:
    """What all documents say about words: frequent words, and how common each pair of letters is."""

    words: frozenset[str]
    transitions: np.ndarray  # 27 x 27 log-probabilities, index 0 for anything but a-z


def _letters(values: np.ndarray) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[97:123] = out[65:91] = np.arange(1, 27)
    return out[values]


def build_lexicon(docs: DataFrame) -> Lexicon:
    rows = pick(docs, "text").filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(27 * 27, np.int64), Counter()
        for batch in batches:
            for part in slices(batch):
                text = "\n".join(part.column("text").to_pylist())
                codes = _letters(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
                pairs += np.bincount(codes[:-1] * 27 + codes[1:], minlength=27 * 27)
                words.update(text.lower().split())
                if len(words) > 300_000:  # hand on what there is: sums are made after the shuffle
                    yield _counted(words)
                    words = Counter()
        yield _counted(words)
        yield pa.RecordBatch.from_arrays([pa.array([f"\t{i}" for i in range(27 * 27)]), pa.array(pairs)],
                                         names=["word", "n"])

    counts = saved(map_batches(rows, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pair = F.col("word").startswith("\t")
    total = counts.filter(~pair).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = counts.filter(pair | (F.col("n") * RATE >= total)).collect()  # at most 729 pairs and RATE words
    table = np.full(27 * 27, 0.5)
    for r in got:
        if r.word.startswith("\t"):
            table[int(r.word[1:])] += r.n
    table = table.reshape(27, 27)
    words = frozenset(r.word for r in got if not r.word.startswith("\t"))
    return Lexicon(words, np.log(table / table.sum(axis=1, keepdims=True)))


def _counted(words: Counter) -> pa.RecordBatch:
    kept = {w: n for w, n in words.items() if 3 <= len(w) <= 14 and w.isalpha()}
    return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())],
                                      names=["word", "n"])


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) of candidate strings, without overlaps, in order."""
    runs = [m.span() for m in _RUN.finditer(text)]
    values = [m.span(1) for m in _VALUE.finditer(text)] if "=" in text or ":" in text else []
    values = [part for a, b in values for part in _pairs(text, a, b)]
    spans, at = list(values), 0
    for a, b in runs:  # what of a run no value that begins in it takes
        while at < len(values) and values[at][0] < a:
            at += 1
        while at < len(values) and values[at][0] < b:
            end = values[at][0]
            while end > a and text[end - 1] == "=":
                end -= 1
            if end - a >= 16:
                spans.append((a, end))
            a, at = max(a, values[at][1]), at + 1
        if b - a >= 16:
            spans.append((a, b))
    spans = sorted(set(_trimmed(text, a, b) for a, b in spans), key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            if b - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, b)
        elif b - a >= 8:
            out.append((a, b))
    return out


def _pairs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A value, or the values of its own where it goes on with ``&name=`` (queries)."""
    out = []
    for m in (_NEXT_OF_ADDRESS if text[a] == "/" else _NEXT).finditer(text, a, b):
        out.append((a, m.start()))
        a = m.end()
    out.append((a, b))
    return [(x, y) for x, y in out if y - x >= 8]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in ".,-":
        b -= 1
    while a < b and text[a] in ".-=":
        a += 1
    return a, b


def parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """What of a long candidate is judged: its pieces, and windows over all of it."""
    pieces = [m.span() for m in _PIECE.finditer(text, a, b)]
    return sorted({*((x, y) for x, y in pieces if y - x <= LONG),
                   *((x, min(x + WINDOW, b)) for x in range(a, max(a + 1, b - WINDOW + STEP), STEP))})


def _whole(text: str, x: int, y: int, a: int, b: int) -> tuple[int, int]:
    """A part's ends, moved out to the ends of the letters and digits they lie in, within the candidate."""
    if x > a and text[x].isalnum():
        x = _BEFORE.search(text[max(a, x - WINDOW):x]).start() + max(a, x - WINDOW)
    if y < b and text[y - 1].isalnum():
        y = _AFTER.match(text, y, min(b, y + WINDOW)).end()
    return x, y


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that frequent words of three letters or more cover, longest first."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        size = next((k for k in range(min(14, len(low) - i), 2, -1) if low[i:i + k] in words), 0)
        covered += size
        i += size or 1
    return covered / max(1, len(low))


def describe(text: str, start: int, end: int, lexicon: Lexicon) -> list[float]:
    """The features of one candidate, in the order of ``FEATURES``."""
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    codes = _letters(np.frombuffer(value.encode("utf-8", "replace"), np.uint8))
    before = text[max(0, start - 40):start].lower()
    near = _WORD.findall(before)[-3:] + _WORD.findall(text[end:end + 20].lower())[:1]
    segments = [s for s in value.split("/") if s]
    return [
        math.log2(n), *(kinds.count(k) / n for k in range(4)), entropy,
        float(lexicon.transitions[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
        _coverage(value, lexicon.words), value.count("/") / n, value.count(".") / n,
        float(value.startswith("/") or len(segments) > 2 or bool(re.search(r"\.[a-z]{1,4}$", value))),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        max(counts.values()) / n,
        float(any(w in SECRET_NAMES for w in near)), float(any(w in HARMLESS_NAMES for w in near)),
        float(bool(re.search(r"[=:][ \t]*[\"']?$", before))), float(before[-1:] in ("'", '"')),
        float(bool(re.search(r"your|example|changeme|xxxx|0000|placeholder|dummy|test", value.lower()))),
    ]


def labelled_findings(words: list[str], n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): findings of both classes, half each, among ordinary ``words``."""
    rnd = random.Random(seed)
    words = words or ["the", "of", "and", "with", "for"]
    hexa, base62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def some(alphabet: str, size: int) -> str:
        return "".join(rnd.choice(alphabet) for _ in range(size))

    def joined(sep: str, k: int) -> str:
        return sep.join(rnd.choice(words) for _ in range(k))

    def coined() -> str:
        """A long word that no dictionary has: pieces of words run together."""
        out = ""
        while len(out) < rnd.randint(16, 28):
            word = rnd.choice(words)
            cut = rnd.randint(0, max(0, len(word) - 3))
            out += word[cut:cut + rnd.randint(2, 5)]
        return rnd.choice((out, out.capitalize(), out.upper()))

    def secret() -> str:
        return rnd.choice([
            lambda: some(hexa, rnd.choice((32, 40, 48, 64))), lambda: some(base62, rnd.randint(20, 48)),
            lambda: some(base62 + "+/", rnd.choice((27, 39, 43))) + "=",
            lambda: rnd.choice(("sk_live_", "ghp_", "xoxb-", "glpat-")) + some(base62, rnd.randint(20, 36)),
            lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            lambda: "eyJ" + some(base62, 20) + "." + some(base62, 40) + "." + some(base62, 30),
            lambda: some(base62 + "!@#%^*", rnd.randint(10, 18)),
        ])()

    def harmless() -> tuple[str, str]:
        value = rnd.choice([
            lambda: ("commit ", some(hexa, 40)), lambda: ("checksum: ", some(hexa, rnd.choice((32, 64)))),
            lambda: (f"{joined(' ', 1)} ", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
            lambda: ("id = ", some("0123456789", rnd.randint(10, 20))), lambda: (f"{joined(' ', 1)} ", some("0123456789", 16)),
            lambda: (f"{joined(' ', 1)} ", joined("", rnd.randint(3, 7))), lambda: ("", "/" + joined("/", rnd.randint(3, 6)) + rnd.choice(("", ".txt", ".py"))),
            lambda: (f"{joined(' ', 1)} = ", joined("_", rnd.randint(2, 5))), lambda: (rnd.choice(("token = ", "password: ", "api key = ")), rnd.choice(("your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme_please", "example_token_value", "0000000000000000", "placeholder_value"))),
            lambda: (f"{joined(' ', 1)}: ", joined(".", rnd.randint(2, 4)) + ".com"), lambda: (f"{joined(' ', 1)} ", joined("-", rnd.randint(3, 6))),
            lambda: (f"{joined(' ', 1)} ", coined()), lambda: (f"{joined(' ', 1)}. ", coined()), lambda: (f"{joined(' ', 1)}\n", coined()),
            lambda: (f"{joined(' ', 1)} {joined('.', 2)}@", f"mail{rnd.randint(1, 99)}.{joined('', 1)}.com"),
            lambda: (f"{joined(' ', 1)}: ", coined()), lambda: ("", rnd.choice("-=_.") * rnd.randint(16, 60)), lambda: ("version: ", ".".join(some("0123456789", 3) for _ in range(4))),
        ])()
        return value

    out = []
    for i in range(n):
        if i % 2:
            name = rnd.choice(("token", "secret", "password", "api key", "api_key", "auth token", "private key", "key"))
            lead, value = name + rnd.choice((" = ", "=", ": ", ' = "', '="', ': "', " ")), secret()
            if rnd.random() < 0.1:
                lead = joined(" ", 1) + rnd.choice((" = ", ": ", " "))
        else:
            lead, value = harmless()
        text = f"{joined(' ', rnd.randint(0, 5))} {lead}"
        tail = ('"' if lead.endswith('"') else "") + f" {joined(' ', rnd.randint(0, 3))}"
        out.append((text + value + tail, len(text), len(text) + len(value), i % 2))
    return out


@dataclass
class Forest:
    """A trained forest as arrays: per tree, feature (-1 at leaves), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def train_forest(spark: SparkSession, x: list[list[float]], y: list[int], trees: int = TREES, depth: int = DEPTH,
                 seed: int = SEED) -> Forest:
    """Spark ML's random forest, read back node by node (at most trees x 2^(depth + 1) rows)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y, strict=True)], ["label", "features"])
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8,
                                   featureSubsetStrategy="sqrt").fit(rows.coalesce(2))
    out = []
    for tree in model.trees:
        nodes: list[list] = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            stats = [float(s) for s in node.impurityStats().stats()]
            nodes.append([-1, 0.0, at, at, stats[1] / max(1e-9, sum(stats))])
            if node.subtreeDepth() > 0:
                split = node.split()
                nodes[at][:2] = [split.featureIndex(), split.threshold()]
                nodes[at][2] = walk(node.leftChild())
                nodes[at][3] = walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        columns = list(zip(*nodes, strict=True))
        out.append((np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64),
                    np.array(columns[3], np.int64), np.array(columns[4])))
    return Forest(out)


@dataclass
class SecretModel:
    lexicon: Lexicon
    forest: Forest

    def judge(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        out = [self.forest.probability(np.array([describe(text, a, b, self.lexicon) for a, b in spans[i:i + PARTS]]))
               for i in range(0, len(spans), PARTS)]
        return np.concatenate(out) if out else np.zeros(0)

    def findings(self, text: str, threshold: float) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the text's candidates in order; of a long one the parts at
        ``threshold`` or above, or the whole with its highest probability if there are none."""
        spans = candidates(text)
        short = [(a, b) for a, b in spans if b - a <= LONG]
        out = [(a, b, float(p)) for (a, b), p in zip(short, self.judge(text, short), strict=True)]
        for a, b in spans:
            if b - a > LONG:
                cut = parts(text, a, b)
                chance = self.judge(text, cut)
                hits: list[tuple[int, int, float]] = []
                for (x, y), p in sorted((_whole(text, *cut[i], a, b), float(chance[i]))
                                        for i in np.flatnonzero(chance >= threshold)):
                    if hits and x <= hits[-1][1]:
                        hits[-1] = (hits[-1][0], max(y, hits[-1][1]), max(p, hits[-1][2]))
                    else:
                        hits.append((x, y, p))
                out += hits or [(a, b, float(chance.max()))]
        return sorted(out)


def fit(docs: DataFrame, findings: int = FINDINGS) -> SecretModel:
    lexicon = build_lexicon(docs)
    made = labelled_findings(sorted(lexicon.words), findings)
    x = [describe(t, a, b, lexicon) for t, a, b, _ in made]
    return SecretModel(lexicon, train_forest(docs.sparkSession, x, [label for *_, label in made]))


def find(docs: DataFrame, model: SecretModel, threshold: float = 0.5, rejected: bool = False) -> DataFrame:
    """(doc_id, start, n_chars, value_sha256, probability) of every secret, in code points; with
    ``rejected`` also the candidates that the forest takes for harmless (secret = false)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for a, b, p in held.value.findings(text, threshold) if text else ():
                    if rejected or p >= threshold:
                        rows.append((doc_id, a, b - a, text[a:b], p, p >= threshold))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "start", "n_chars", "value", "probability", "secret"])

    found = map_batches(pick(docs, "doc_id", "text"), run, "doc_id bigint, start bigint, n_chars bigint, value string, "
                                                           "probability double, secret boolean")
    return found.select("doc_id", "start", "n_chars", F.sha2("value", 256).alias("value_sha256"), "probability", "secret")


def redact(docs: DataFrame, model: SecretModel, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all rows and columns, every secret in ``text`` replaced by ``mark`` (a column
    ``n_chars`` follows the new text)."""
    names = docs.columns
    plain = rename_all(docs)
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = plain.schema

    def clean(text: str | None) -> str | None:
        out, last = [], 0
        for a, b, p in held.value.findings(text, threshold) if text else ():
            if p >= threshold:
                out += [text[last:a], mark]
                last = b
        return "".join([*out, text[last:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                lengths = [n if a == b else len(b) for a, b, n in zip(old, new, columns[chars].to_pylist(), strict=True)]
                columns[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(plain, run, schema).toDF(*names)
