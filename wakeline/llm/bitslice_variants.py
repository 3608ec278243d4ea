"""Spelling variants of a corpus vocabulary by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point turns one into the other.

1. Words are counted over all texts; those frequent enough are the vocabulary.
2. The words of a class t have t or t + 1 code points. The places 0..t of the first difference are cut into ranges; a pair
   whose first difference lies in a range agrees before it and, but for the shift, after it. So each word is dealt once per
   class and range by a digest of what lies outside, and each near pair meets in exactly one bucket. Buckets with more than
   `limit` words have their range halved until it is one place, where the alphabet bounds them: none is skipped.
3. Whole buckets are laid out in 64-bit lanes. For each (place, letter) a bitset tells which words have that letter there.
   A query word reads its letters from left to right and carries, for all words of its bucket at once, the set without an
   error and the sets with one: replaced (same place), inserted (one place on) and deleted (one place back). Bits are in
   order of falling count, so the lowest set bit is the most frequent near word.
4. Forms (the near word of largest count, if `ratio` times as frequent) are followed to their roots by pointer doubling.

Null and empty texts, and texts without letters, have no words; a null doc_id is written as an empty string in the edit's
key. Equal counts are ordered by code points. Repeated rows count again; extra columns are ignored; an empty table gives no
rows. Long texts are counted whole; long words are cut into more ranges.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import group_bounds, join_facts, whole_groups
from wakeline.session import durable

RUNS = "A-Za-zÀ-ÿ"    # fixed: letters of a word
LIMIT = 4096        # words of a bucket from which its range is halved
RANGE = 16          # places of a range at first, at most
FLUSH_WORDS = 300_000
ROWS = 32_768       # bits of a batch; a bucket is never cut
CELLS = 2_000_000   # 64-bit cells of query states, or of the index, held at a time


def corpus_words(docs: DataFrame, min_chars: int, min_count: int, delete_every: int | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, with at least `min_chars` code points and `min_count` occurrences.

    With `delete_every`, a run whose crc32 of `<doc_id>:<run>` it divides loses one code point before it is counted.
    """
    find = re.compile(f"[{RUNS}]{{{min_chars},}}").findall

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(find(text or "")).items():
                    word = w.encode().lower()       # of bytes, only A-Z change
                    if delete_every:
                        h = zlib.crc32(word, prefix)
                        if h % delete_every == 0:
                            chars = word.decode()
                            at = h % len(chars)
                            if len(chars) <= min_chars:
                                continue
                            word = (chars[:at] + chars[at + 1:]).encode()
                    held[word] += n
                if len(held) > FLUSH_WORDS:
                    yield flush()
        yield flush()
    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Add the bucket's digest: what lies before place a, and the last z code points."""
    outside = F.concat_ws("|", "t", "a", "z", F.expr("substring(word, 1, a)"), F.expr("right(word, z)"))
    return rows.withColumn("key", F.unhex(F.md5(outside)))


def buckets(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n, t, a, z, key: each near pair has exactly one key in common (`words`: distinct, durable)."""
    size = F.length("word")
    rows = words.filter(size > 0).select("word", "n", F.explode(F.array_distinct(F.array(F.greatest(F.lit(1), size - 1), size))).alias("t"))
    parts = F.greatest(F.lit(2), F.ceil(F.col("t") / RANGE)).cast("int")
    rows = rows.withColumn("_p", parts).withColumn("_j", F.explode(F.expr("sequence(0, _p - 1)")))
    rows = rows.select("word", "n", "t", F.expr("cast(_j * t div _p as int) AS a"), F.expr("t - cast((_j + 1) * t div _p as int) AS z"))
    rows = _keyed(rows.filter("a + z < t OR z = 0"))
    while True:
        hot = durable(rows.groupBy("key").agg(F.count("*").alias("weight"), F.first(F.expr("t - a - z")).alias("g"))
                      .filter((F.col("weight") > limit) & (F.col("g") > 1)).select("key", "weight", F.lit(True).alias("hot")))
        if hot.isEmpty():
            return rows
        half = F.expr("cast((t - a - z) div 2 as int)")
        split = F.array(F.struct((F.col("a") + half).alias("a"), F.col("z").alias("z")),
                        F.struct(F.col("a").alias("a"), (F.col("t") - F.col("a") - half).alias("z")))
        same = F.array(F.struct("a", "z"))
        rows = join_facts(rows, hot, "key", "weight", ["word"]).withColumn("_s", F.explode(F.when(F.col("hot"), split).otherwise(same)))
        rows = _keyed(rows.select("word", "n", "t", F.col("_s.a").alias("a"), F.col("_s.z").alias("z")))


class Index:
    """Bitsets per (place, letter) over consecutive buckets of words."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.n, self.size = len(size), size
        self.start = np.cumsum(size) - size
        letters, self.code = np.unique(flat, return_inverse=True)
        self.lanes, self.letters = -(-self.n // 64), max(1, len(letters))
        self.places = int(size.max(initial=0)) + 2
        self.bits = np.zeros((self.places, self.letters, self.lanes), np.uint64)
        row = np.repeat(np.arange(self.n), size)
        place = np.arange(len(flat)) - self.start[row]
        np.bitwise_or.at(self.bits, (place, self.code, row // 64), np.uint64(1) << (row % 64).astype(np.uint64))

    def of(self, flags: np.ndarray) -> np.ndarray:
        """Bitset of the flagged words."""
        out = np.zeros(self.lanes, np.uint64)
        at = np.flatnonzero(flags)
        np.bitwise_or.at(out, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        return out


def near_in_buckets(flat: np.ndarray, size: np.ndarray, bounds: np.ndarray, gap: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words of each word within its bucket: how many, and the first of them (-1: none).

    `flat`, `size`: code points of the words' ranges; `bounds`: starts of the buckets and the end; `gap`: places of a
    bucket's range; `tail`: whether a first difference may lie behind the shorter word.
    """
    index = Index(flat, size)
    n, one = index.n, np.uint64(1)
    bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low, high = bounds[bucket], bounds[bucket + 1]
    short, long = index.of(size == gap[bucket]), index.of(size == gap[bucket] + 1)
    many, first = np.zeros(n, np.int64), np.full(n, n, np.int64)
    spans = (high - 1) // 64 - low // 64 + 1
    spans[high - low < 2] = 0       # alone in its bucket
    order = np.argsort(-size, kind="stable")
    order = order[spans[order] > 0]
    if not len(order):
        return many, np.full(n, -1)
    cuts = np.searchsorted(np.cumsum(spans[order]), np.arange(CELLS // 8, int(spans[order].sum()) + CELLS // 8, CELLS // 8), "right")
    for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        q = order[a:z]
        rep = spans[q]
        q = np.repeat(q, rep)
        lane = low[q] // 64 + np.arange(len(q)) - np.repeat(np.cumsum(rep) - rep, rep)
        lo, hi = np.clip(low[q] - lane * 64, 0, 64), np.clip(high[q] - lane * 64, 0, 64)
        none = _below(hi) & ~_below(lo)
        own = lane == q // 64
        none[own] &= ~(one << (q[own] % 64).astype(np.uint64))
        replaced, inserted, deleted = np.zeros_like(none), np.zeros_like(none), np.zeros_like(none)
        ends, m, g = tail[bucket[q]], size[q], gap[bucket[q]]
        for i in range(int(m.max(initial=0))):
            k = int(np.searchsorted(-m, -i, "left"))        # longer words come first: those with a letter at place i
            c, at = index.code[index.start[q[:k]] + i], lane[:k]
            here, on = index.bits[i, c, at], index.bits[i + 1, c, at]
            back = index.bits[i - 1, c, at] if i else np.zeros(k, np.uint64)
            fault = none[:k] & ~here
            replaced[:k] = (replaced[:k] & here) | fault
            inserted[:k] = (inserted[:k] | fault) & on
            deleted[:k] = (deleted[:k] & back) | np.where((i < g[:k]) | ends[:k], fault, np.uint64(0))
            none[:k] &= here
        inserted |= np.where(ends, none, np.uint64(0))
        is_short = m == g
        hits = np.where(is_short, (replaced & short[lane]) | (inserted & long[lane]), deleted & short[lane])
        got = np.flatnonzero(hits)
        h, r = hits[got], q[got]
        np.add.at(many, r, np.bitwise_count(h).astype(np.int64))
        np.minimum.at(first, r, lane[got] * 64 + np.bitwise_count((h & (~h + one)) - one).astype(np.int64))
    return many, np.where(first == n, -1, first)


def _below(k: np.ndarray) -> np.ndarray:
    """Bits under place k, 0 to 64."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(k >= 64, full, ~(full << np.minimum(k, 63).astype(np.uint64)))


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, near, near_n: how many near words, and the most frequent of them; words without one are left out."""
    rows = buckets(words, limit).select("key", "n", "word", F.expr("t - a - z").alias("gap"), (F.col("z") == 0).alias("tail"),
                                        F.expr("substring(word, a + 1, length(word) - a - z)").alias("middle"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.desc("n"), "word")

    def run(batches):
        for table in whole_groups(batches, ["key"], ROWS):
            yield from _near_batch(table)
    found = rows.mapInArrow(run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", F.col("_b.near").alias("near"), (-F.col("_b.m")).alias("near_n"))


def _near_batch(table: pa.Table):
    """Batches of the found words; buckets are taken together as long as the index stays under `CELLS` cells."""
    key = np.asarray(table.column("key").to_numpy(zero_copy_only=False))
    bounds = group_bounds(key)
    middle, n = table.column("middle").to_pylist(), table.column("n").to_numpy()
    gap, tail = table.column("gap").to_numpy(), table.column("tail").to_numpy(zero_copy_only=False).astype(bool)
    size = np.fromiter(map(len, middle), np.int64, len(middle))
    wide = np.maximum.reduceat(size, bounds[:-1]) if len(middle) else size
    at = 0
    while at < len(bounds) - 1:
        z, most = at + 1, int(wide[at])
        while z < len(bounds) - 1:
            most = max(most, int(wide[z]))
            if (most + 2) * 96 * ((bounds[z + 1] - bounds[at]) // 64 + 1) > CELLS:
                break
            z += 1
        a, e = int(bounds[at]), int(bounds[z])
        flat = np.frombuffer("".join(middle[a:e]).encode("utf-32-le"), np.uint32)
        starts = bounds[at:z]
        many, first = near_in_buckets(flat, size[a:e], bounds[at:z + 1] - a, gap[starts], tail[starts])
        hit = np.flatnonzero(many)
        if len(hit):
            part = table.slice(a, e - a)
            words = part.column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(hit)), pa.array(many[hit]), words.take(pa.array(first[hit])), pa.array(n[a:e][first[hit]])],
                ["word", "n_near", "near", "near_n"])
        at = z


def roots(forms: DataFrame) -> DataFrame:
    """word, root: `form` followed to the last; counts grow at least by the ratio a step, so there are no circles."""
    cur = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        to = cur.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        nxt = durable(cur.join(to, "root", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        cur = nxt.drop("_moved")
        if nxt.filter("_moved").isEmpty():
            return cur


def variants(words: DataFrame, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of words and counts (repeated words are added up, null ones dropped)."""
    words = durable(words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    is_form = F.col("near_n") >= ratio * F.col("n")
    out = durable(words.join(near_words(words, limit), "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")))
    root = roots(out.filter(F.col("form").isNotNull()))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, delete_every: int | None = None) -> DataFrame:
    """The variants of the vocabulary of `docs`."""
    return variants(corpus_words(docs, min_chars, min_count, delete_every), ratio)
