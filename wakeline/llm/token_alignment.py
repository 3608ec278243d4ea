"""Alignment of the tokens of two tokenizers by pointer jumping, and corpus-wide counts of linked ids.

1. Each text is encoded by both. Tokens of a slice of texts lie on one line of bytes, text after text.
2. Every token points to the token farthest right that overlaps it: the other tokenizer's token over its last byte if that
   one ends later, or at the same byte in B; else itself. Successors are doubled (next = next[next]) until nothing changes:
   then every token holds the terminal token of its component, which labels the group.
3. A group's last tokens of A and B end together: a link. Links are counted by id pair over all texts, each task first.
4. Pairs with at least `share` of all links, of which there can be 1 / share at most (16 bytes each), are written to the
   shared folder as sorted arrays, which the workers of a machine map and look up in place; links of other pairs go to their
   counts by a shuffle. Nothing is left out.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty
digest. Special tokens' strings are plain text. Rows are independent, so null ids, ties and extra columns change nothing;
repeated rows count again in the corpus. An empty table gives no rows. A very long text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import pieces_finder
from wakeline.llm.files import make_folder, put, view
from wakeline.llm.lexicon_transducer import _byte_symbols, slices
from wakeline.session import durable, shared_folder

SLICE_CHARS = 1_000_000
MAX_PIECES = 400_000    # pieces a worker remembers, per tokenizer
SHARE = 1e-7            # of all links: at most ten million pairs, 160 MB, are looked up in place
HELD_PAIRS = 4_000_000  # pairs a counting task holds before it adds them up
ID_BITS = 32            # a pair is a << ID_BITS | b


class ByteLevelSide:
    """Tokenizer A: pieces of a byte-level tokenizer are encoded once and remembered."""

    def __init__(self, path: str, pattern: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        byte_of = {s: b for b, s in _byte_symbols().items()}
        with open(path, encoding="utf-8") as f:
            special = {t["id"] for t in json.load(f)["added_tokens"]}
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if i not in special:
                self.bytes[i] = bytes(byte_of[c] for c in t)
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        _, self.unusual, self.find = pieces_finder(pattern)
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; texts whose characters the pattern's engines may class otherwise go to the library whole."""
        cut = [None if self.unusual(t) else self.find(t) for t in texts]
        fresh = list(set().union(*(c for c in cut if c is not None)).difference(self.known))
        self.known.update(zip(fresh, self._library(fresh), strict=True))
        out = [self._library([t])[0] if c is None else b"".join(map(self.known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        return out

    def joined(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))


class PieceSide:
    """Tokenizer B (sentencepiece). Where its vocabulary has no piece across a place, no merge crosses it: texts are cut in front of
    words and around line ends if that holds, and parts are encoded once and remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes = [b"" if self.sp.is_control(i) or self.sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.sp.is_byte(i)
                      else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.lead = self.sp.encode("\n")
        crossing = any(re.search("[^▁]▁|\n", p) for p in names)
        self.cut = None if crossing or self.lead != [*self.sp.encode(""), *self.lead] or len(self.lead) != 2 else re.compile(r"\n+| *[^ \n]+| +").findall
        self.known: dict[str, bytes | None] = {}

    def _part(self, part: str) -> bytes | None:
        """Ids of a part of a text; None if they do not spell it. A line end in front keeps the library from adding a space."""
        ids = self.sp.encode(part[1:]) if part[0] == " " and len(part) > 1 else self.sp.encode("\n" + part)[2:]
        return np.array(ids, "<i4").tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == part.encode() else None

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, which the library starts with a space; None if their bytes are not space + text."""
        out: list[bytes | None] = []
        known = self.known
        for t in texts:
            got = None
            if self.cut is not None and "▁" not in t:
                parts = self.cut(" " + t)
                for p in set(parts).difference(known):
                    known[p] = self._part(p)
                ids = list(map(known.__getitem__, parts))
                got = None if None in ids else b"".join(ids)
            if got is None:     # some part is not given back as it was: the library decides on the whole text
                ids = self.sp.encode(t)
                got = np.array(ids, "<i4").tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == b" " + t.encode() else None
            out.append(got)
            if len(known) > MAX_PIECES:
                known.clear()
        return out


def sides(a_path: str, pattern: str, b_path: str, _made={}) -> tuple[ByteLevelSide, PieceSide]:
    key = (a_path, pattern, b_path)
    if key not in _made:
        _made[key] = ByteLevelSide(a_path, pattern), PieceSide(b_path)
    return _made[key]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal token (an index into B) of each token of A and B, from the ends of both over the same bytes, ascending."""
    nb = len(end_b)
    over_a = np.searchsorted(end_b, end_a)      # B's token over the last byte of each token of A; never ends earlier
    over_b = np.searchsorted(end_a, end_b)
    nxt = np.concatenate([np.where(end_a[over_b] > end_b, nb + over_b, np.arange(nb)), over_a]) if nb else np.zeros(0, np.int64)
    while True:
        far = nxt[nxt]
        if np.array_equal(far, nxt):
            return far[nb:], far[:nb]
        nxt = far


class Aligned:
    """Tokens of a slice of texts and their groups."""

    def __init__(self, ids_a: list[bytes], ids_b: list[bytes], size_a: np.ndarray, size_b: np.ndarray):
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.frombuffer(b"".join(ids), "<i4").astype(np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.of_a, self.of_b = terminals(end_a, end_b)
        self.last_b = np.unique(self.of_b)          # one terminal a group, in order
        self.group_a, self.group_b = np.searchsorted(self.last_b, self.of_a), np.searchsorted(self.last_b, self.of_b)
        self.last_a = np.searchsorted(self.group_a, np.arange(len(self.last_b)), "right") - 1
        doc_end = np.cumsum(self.n_b)
        self.group_at = np.concatenate([[0], np.searchsorted(self.last_b, doc_end)])     # groups before each text

    def links(self) -> np.ndarray:
        return (self.a[self.last_a] << ID_BITS) | self.b[self.last_b]

    def written(self, names: list[str]) -> list[str]:
        """`a1,a2|b1;...` of each text: every id with the sign behind it, A's and B's tokens of a group in turn."""
        na, nb = len(self.a), len(self.b)
        first_a, first_b = self.last_a + 1, self.last_b + 1
        place_a = np.arange(na) + np.concatenate([[0], first_b])[self.group_a]
        place_b = np.arange(nb) + first_a[self.group_b] if nb else np.zeros(0, np.int64)
        code = np.zeros(na + nb, np.int64)
        sign_a, sign_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        sign_a[self.last_a], sign_b[self.last_b] = 1, 2
        code[place_a], code[place_b] = self.a * 3 + sign_a, self.b * 3 + sign_b
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        code = code.tolist()
        return ["".join(map(names.__getitem__, code[x:y]))[:-1] for x, y in pairwise(cuts)]


def _names(n: int) -> list[str]:
    return [f"{i}{s}" for i in range(n) for s in ",|;"]


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs and times (distinct linked id pairs and how often) and, if wanted, the groups' text."""
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>" + ", groups string" * with_groups

    def run(batches):
        side_a, side_b = sides(a_path, pattern, b_path)
        names = _names(max(len(side_a.bytes), len(side_b.bytes)))
        for part, texts in slices(batches, SLICE_CHARS):
            ids_b = [side_b.encode([t])[0] if t else None for t in texts]
            want = [i for i, x in enumerate(ids_b) if x is not None]
            ids_a = dict(zip(want, side_a.encode([" " + texts[i] for i in want]), strict=True))
            size = {i: int(side_a.size[np.frombuffer(x, "<i4")].sum()) for i, x in ids_a.items()}
            bad = [i for i in want if size[i] != int(side_b.size[np.frombuffer(ids_b[i], "<i4")].sum()) or side_a.joined(ids_a[i]) != b" " + texts[i].encode()]
            for i in bad:
                ids_b[i] = None
            got = Aligned([b"" if x is None else ids_a[i] for i, x in enumerate(ids_b)], [x or b"" for x in ids_b], side_a.size, side_b.size)
            text, links = got.written(names), got.links()
            n_groups = np.diff(got.group_at)
            sums = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
            row = np.repeat(np.arange(len(texts)), n_groups)
            order = np.lexsort((links, row))
            links, row = links[order], row[order]
            new = np.ones(len(links), bool)
            new[1:] = (links[1:] != links[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(links)))
            off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(texts)))]).astype(np.int32))
            cols = [part.column(0), pa.array(got.n_a), pa.array(got.n_b), pa.array(n_groups), pa.array(sums, pa.string()),
                    pa.ListArray.from_arrays(off, pa.array(links[at])), pa.ListArray.from_arrays(off, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(text, pa.string())] * with_groups, [c.split()[0] for c in schema.split(", ")])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(keys) else n


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best (n is the highest of its B id) over all texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        keys, n, held = [], [], 0

        def flush():
            k, v = _added(np.concatenate(keys), np.concatenate(n))
            return k, v
        for b in batches:
            keys.append(b.column(0).flatten().to_numpy())
            n.append(b.column(1).flatten().to_numpy().astype(np.int64))
            held += len(keys[-1])
            if held > HELD_PAIRS:
                k, v = flush()
                keys, n, held = [k], [v], len(k)
                if held > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["pair", "n"])
                    keys, n, held = [], [], 0
        if held:
            k, v = flush()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["pair", "n"])
    counts = durable(aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = (F.col("pair").bitwiseAND((1 << ID_BITS) - 1)).alias("b")
    top = counts.groupBy(b).agg(F.max("n").alias("top"))    # one row per id of B's vocabulary
    return counts.select("pair", "n", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def score(aligned: DataFrame, share: float = SHARE, parts: int = 8) -> DataFrame:
    """`aligned` (durable) with n_best (links whose pair is the best of its B id) and count_sum (counts of all links)."""
    spark = aligned.sparkSession
    counts = durable(pair_counts(aligned))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= F.lit(share * total)
    folder = make_folder(f"{shared_folder(spark)}/pairs/{uuid.uuid4().hex}")

    def write(batches):
        held: dict[int, list] = {}
        for b in batches:
            part = b.column(0).to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append(np.stack([b.column(1).to_numpy()[part == p], b.column(2).to_numpy()[part == p]]))
        for p, got in held.items():
            put(folder, f"{p}.bin", np.concatenate(got, 1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])
    frequent = counts.filter(often).select(F.pmod("pair", F.lit(parts)).cast("int").alias("part"), "pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("value"))
    frequent.repartition(parts, "part").sortWithinPartitions("part", "pair").mapInArrow(write, "n long").agg(F.sum("n")).first()
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    doc_cols = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    types = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    schema = "_row long, " + ", ".join(f"{c} {types[c]}" for c in doc_cols) + ", n_best long, count_sum long, rest array<long>, rest_times array<int>"

    def look_up(batches):
        maps = _often(folder, parts)
        for b in batches:
            pairs, times = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            sizes = np.diff(pairs.offsets.to_numpy())
            key, t = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            row, value, part = np.repeat(np.arange(b.num_rows), sizes), np.full(len(key), -1, np.int64), key % parts
            for p, (keys, values) in maps.items():
                own = np.flatnonzero(part == p)
                k = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                value[own] = np.where(keys[k] == key[own], values[k], -1)
            hit = value >= 0
            rh, th, sums = row[hit], t[hit], np.zeros(b.num_rows, np.int64)
            np.add.at(sums, rh, (value[hit] >> 1) * th)
            n_best = np.bincount(rh, th * (value[hit] & 1), b.num_rows).astype(np.int64)
            off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=b.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(n_best), pa.array(sums), pa.ListArray.from_arrays(off, pa.array(key[~hit])),
                 pa.ListArray.from_arrays(off, pa.array(t[~hit].astype(np.int32)))], [c.split()[0] for c in schema.split(", ")])
    # row numbers hold for one write of the table only
    known = durable(rows.select("_row", *doc_cols, "pairs", "times").mapInArrow(look_up, schema))
    rest = known.select("_row", F.explode(F.arrays_zip("rest", "rest_times")).alias("_x")).select("_row", F.col("_x.rest").alias("pair"), F.col("_x.rest_times").alias("t"))
    rest = rest.join(counts.filter(~often), "pair").select("_row", F.when(F.col("best"), F.col("t")).otherwise(0).cast("long").alias("n_best"), (F.col("n") * F.col("t")).alias("count_sum"))
    rest = rest.groupBy("_row").agg(F.sum("n_best").alias("_best"), F.sum("count_sum").alias("_sum"))
    out = known.drop("rest", "rest_times").join(rest, "_row", "left")
    return out.select(*doc_cols[:4], F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def _often(folder: str, parts: int, _made={}) -> dict[int, np.ndarray]:
    """Frequent pairs of each part, ascending, with 2 * count + (1 if it is the best)."""
    if folder not in _made:
        _made.clear()
        _made[folder] = {p: d.view("<i8").reshape(2, -1) for p in range(parts) if (d := view(folder, f"{p}.bin")) is not None}
    return _made[folder]


def alignment_report(docs: DataFrame, a_path: str, pattern: str, b_path: str, share: float = SHARE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    return score(durable(align(docs, a_path, pattern, b_path)), share)
