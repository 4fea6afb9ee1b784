"""URL filter: explicit rules, then the ratio of two character language models.

Rules (host, path) decide first: a rule fits its host and all subdomains if the url's path starts
with the rule's path, and the longest rule wins. Every other url is judged by two smoothed
variable-order Markov models over characters: one of the rejected urls (those a rule blocks and
those whose host holds a known spam word), one of all others. The model backs off from ``ORDER``
characters of context to none: p_k = (n(context, next) + BETA p_(k-1)) / (n(context) + BETA). A
url is blocked if log p(rejected) - log p(accepted), divided by its length, exceeds a threshold.

Counts are exact and grow with the input. A character with its ``ORDER`` characters of context is one
64-bit number (9 bits a character, 0 before the start); tasks sum their rows by it, and the counts of
all shorter contexts are sums over that one table. p of a url's character depends on this number
alone, so the model is a table of distinct numbers with their log ratio (in steps of 2^-32, so that
sums don't depend on their order), and a url's score is the sum over its characters. It is built by
joins in which at most 257 rows share a key. The ``BROADCAST_ROWS`` most frequent numbers are
broadcast; if there are more, the other (rare) ones are joined with those characters of distinct urls
that have them, which changes no score. The threshold is calibrated on all urls too, each scored
without its own counts (leave one out): the smallest value that blocks at most ``FALSE_BLOCKS`` of
the accepted ones.

Edge cases: a null url or one without ``://`` has an empty host and path and no rule; the method
allows a null or empty url; ``://`` alone gives an empty host; rules match whole host labels; if no
url is rejected (or none accepted, or the table is empty) the method allows all; repeated rows get
equal verdicts; a null page_id stays; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from presswork.llm.common import map_batches, pick, saved, slices, string_arrays

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SPAM_WORDS = ("pills", "casino", "ads-track", "adserver", "viagra", "lottery", "xxx", "betting")
ORDER, BETA = 5, 2.0
#: Bits of a character in a number, and steps of a log ratio.
BITS, STEPS = 9, 1 << 32
#: Rows of the model that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 1_000_000
#: Levels of a number's count per doubling, by which the most frequent ones are told.
LEVELS = 16
#: Distinct numbers that a task sums before it hands them on.
HELD = 500_000
FALSE_BLOCKS = 0.01
#: Bins of the scores' histogram, from -LIMIT to LIMIT.
BINS, LIMIT = 2000, 10.0


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as text (host and path), or null."""
    best = F.lit(None).cast("string")
    for name, start, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        best = F.when(fits, F.lit(name + start)).otherwise(best)
    return best


def _rejected(host: Column, rule: Column, rules, spam_words) -> Column:
    blocked = [name + start for name, start, verdict in rules if verdict == "block"]
    out = F.coalesce(rule.isin(blocked), F.lit(False)) if blocked else F.lit(False)
    for word in spam_words:
        out = out | (rule.isNull() & host.contains(word))
    return out


def _grams(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For every character: itself (lowest bits) and the ``ORDER`` characters before it, as one number."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(data), np.int64)
    for back in range(ORDER + 1):
        column = np.zeros(len(data), np.int64)
        column[back:] = data[:max(0, len(data) - back)]
        out |= np.where(place < back, 0, column + 1) << (BITS * back)
    return out


def _counts(urls: DataFrame) -> DataFrame:
    """(gram, n0, n1) over ``urls`` (text, class): how often accepted and rejected urls have each number."""
    def handed(held: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(held), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(sums), len(keys)).astype(np.int64)

    def packed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rejected = keys & 1
        return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(n * (1 - rejected)), pa.array(n * rejected)],
                                          names=["gram", "n0", "n1"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                offsets, data = string_arrays(part.column("text"))
                of = np.repeat(part.column("class").to_numpy(), np.diff(offsets))
                more, times = np.unique(_grams(offsets, data) << 1 | of, return_counts=True)
                keys, n = handed([keys, more], [n, times])
                if len(keys) > HELD:
                    yield packed(keys, n)
                    keys, n = keys[:0], n[:0]
        yield packed(keys, n)

    return (map_batches(urls, count, "gram bigint, n0 bigint, n1 bigint").groupBy("gram")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _ratios(counts: DataFrame) -> DataFrame:
    """(gram, n, ratio, own_ratio) of ``counts`` (gram, n0, n1, n): the log ratio of each number, also for
    an accepted url without its own counts."""
    above = None
    for order in range(ORDER + 1):
        cut = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order + 1)) - 1))
        grams = counts.groupBy(cut.alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n")])
        totals = grams.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
        now = grams.join(totals, F.shiftright("gram", BITS) == F.col("context"))
        if above is None:
            now = now.withColumns({p: F.lit(1 / 256) for p in ("q0", "q1", "q_own")})
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))
            now = now.join(above.select(F.col("gram").alias("shorter"), "q0", "q1", "q_own"), shorter == F.col("shorter"))
        less = F.greatest(F.col("n0") - 1, F.lit(0))
        above = now.select(
            "gram", "n", ((F.col("n0") + BETA * F.col("q0")) / (F.col("t0") + BETA)).alias("q0"),
            ((F.col("n1") + BETA * F.col("q1")) / (F.col("t1") + BETA)).alias("q1"),
            ((less + BETA * F.col("q_own")) / (F.greatest(F.col("t0") - 1, less) + BETA)).alias("q_own"))
    return above.select("gram", "n", *[F.round((F.log("q1") - F.log(q)) * STEPS).cast("bigint").alias(name)
                                       for q, name in (("q0", "ratio"), ("q_own", "own_ratio"))])


def _scored(rows: DataFrame, ratios: DataFrame, ratio: str, broadcast_rows: int) -> DataFrame:
    """``rows`` (with ``url``, not named like what is added) with ``score``: the mean ratio of the url's characters."""
    level = F.floor(F.log2("n") * LEVELS)
    least, have = None, 0
    for r in ratios.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if have + r["count"] > broadcast_rows:
            least = r.level + 1
            break
        have += r["count"]
    head = ratios if least is None else ratios.filter(level >= least)
    got = head.select("gram", ratio).toArrow()  # at most broadcast_rows rows
    keys, values = (got.column(c).to_numpy() for c in ("gram", ratio))
    order = np.argsort(keys)
    held = rows.sparkSession.sparkContext.broadcast((keys[order], values[order]))

    def looked_up(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        offsets, data = string_arrays(column)
        grams, (known, value) = _grams(offsets, data), held.value
        if not len(known):
            return offsets, grams, np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        found = known[at] == grams
        return offsets, grams, found, np.where(found, value[at], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url", most=1 << 20):
                offsets, _, _, value = looked_up(part.column("url"))
                sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(value)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums[offsets[1:]] - sums[offsets[:-1]])],
                                                 names=[*part.schema.names, "steps"])

    steps = F.col("steps")
    out = map_batches(rows, run, StructType([*rows.schema.fields, StructField("steps", LongType())]))
    if least is not None:
        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "url", most=1 << 20):
                    offsets, grams, found, _ = looked_up(part.column("url"))
                    row = np.repeat(np.arange(part.num_rows), np.diff(offsets))[~found]
                    yield pa.RecordBatch.from_arrays([part.column("k1").take(pa.array(row)), part.column("k2").take(pa.array(row)),
                                                      pa.array(grams[~found])], names=["k1", "k2", "gram"])

        # two hashes with different seeds: 128 bits stand for a url
        k1, k2 = F.xxhash64("url"), F.xxhash64(F.lit(1), F.col("url"))
        asked = map_batches(rows.select("url").filter("url <> ''").distinct().select("url", k1.alias("k1"), k2.alias("k2")),
                            rest, "k1 bigint, k2 bigint, gram bigint")
        tail = ratios.filter(level < least).select("gram", ratio)
        sums = asked.join(tail, "gram").groupBy("k1", "k2").agg(F.sum(ratio).alias("rest"))
        out = out.join(sums, (k1 == F.col("k1")) & (k2 == F.col("k2")), "left")
        steps = steps + F.coalesce("rest", F.lit(0))
    size = F.greatest(F.coalesce(F.octet_length("url"), F.lit(0)), F.lit(1))
    return out.select(*rows.columns, (steps / F.lit(float(STEPS)) / size).alias("score"))


@dataclass
class UrlModel:
    counts: DataFrame  # gram, n0, n1: of accepted and rejected urls
    ratios: DataFrame  # gram, n, ratio, own_ratio
    threshold: float = np.inf


def _labelled(pages: DataFrame, rules, spam_words) -> DataFrame:
    rows = pick(pages, "url").filter("url is not null and url <> ''")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return rows.select(F.col("url").alias("text"), _rejected(host, rule_of(host, path, rules), rules, spam_words)
                       .cast("int").alias("class"))


def fit(pages: DataFrame, rules=RULES, spam_words=SPAM_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> UrlModel:
    urls = _labelled(pages, rules, spam_words)
    counts = saved(_counts(urls), "url-counts")
    ratios = saved(_ratios(counts.withColumn("n", F.col("n0") + F.col("n1"))), "url-ratios")
    model = UrlModel(counts, ratios)
    if not all(counts.agg(F.sum("n0"), F.sum("n1")).first()):
        return model
    accepted = urls.filter("class = 0").select(F.col("text").alias("url"))
    place = F.floor((F.col("score") + LIMIT) * BINS / (2 * LIMIT))
    bins = _scored(accepted, ratios, "own_ratio", broadcast_rows).groupBy(
        F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin")).agg(F.count("*").alias("n")).toArrow()
    sums = np.zeros(BINS)
    sums[bins.column("bin").to_numpy()] = bins.column("n").to_numpy()
    above = np.append(np.cumsum(sums[::-1])[::-1][1:], 0)  # accepted urls in higher bins
    first = int(np.argmax(above <= FALSE_BLOCKS * sums.sum()))
    model.threshold = max(0.0, -LIMIT + (first + 1) * 2 * LIMIT / BINS)
    return model


def judge(pages: DataFrame, model: UrlModel | None = None, rules=RULES, spam_words=SPAM_WORDS,
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url)."""
    if model is None:
        model = fit(pages, rules, spam_words, broadcast_rows)
        ratios = model.ratios
    else:  # numbers that the model has not counted get a ratio too
        own = _counts(_labelled(pages, rules, spam_words)).select(
            "gram", F.lit(0).cast("bigint").alias("n0"), F.lit(0).cast("bigint").alias("n1"), (F.col("n0") + F.col("n1")).alias("n"))
        ratios = saved(_ratios(model.counts.withColumn("n", F.col("n0") + F.col("n1")).unionByName(own)), "url-ratios")
    scored = _scored(pick(pages, "page_id", "url"), ratios, "ratio", broadcast_rows)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    verdict_of = F.create_map(*[F.lit(x) for name, start, v in rules for x in (name + start, v)]) if rules else None
    by_method = F.when(F.col("score") > F.lit(float(model.threshold)), "block").otherwise("allow")
    by_rule = verdict_of[F.col("rule")] if rules else F.lit(None).cast("string")
    named = scored.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"), "score")
    return named.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule)
                        .otherwise(by_method).alias("verdict"), "score")


def keep_allowed(pages: DataFrame) -> DataFrame:
    """The rows of ``pages``, with all their columns, whose url is allowed (rows of one id stand or
    fall by their own url)."""
    names = pages.columns
    plain = pages.toDF(*[f"c{i}" for i in range(len(names))])
    url = plain.columns[names.index("url")]
    verdicts = judge(plain.select(F.xxhash64(url).alias("page_id"), F.col(url).alias("url")).distinct())
    gone = verdicts.filter("verdict = 'block'").select("page_id").distinct()
    return plain.join(gone, F.xxhash64(url) == gone.page_id, "left_anti").toDF(*names)
