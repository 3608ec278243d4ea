"""BPE of words by a minimal acyclic transducer of frequent words; other words are merged exactly.

1. Words (pieces of the tokenizer's pattern after its normalisation) are counted over all texts.
2. Words with at least `share` of all occurrences, of which there can be 1 / share at most, are the lexicon. It is dealt to
   `shards` by a hash. Each shard is compiled, in byte order, into a minimal acyclic transducer: arcs carry token ids, pushed
   towards the start, so that equal suffixes share their states. It is written as flat arrays and mapped into memory.
3. The distinct words of a slice of texts walk the arrays together, one byte a step. Words that do not end in a final state
   are merged by rank, which gives the same ids: the lexicon saves time and decides nothing.

Null and empty texts have no ids. Strings of special tokens inside a text are those tokens, as in the library. Rows are
independent: ties, repeated rows, null ids and extra columns change nothing. An empty table gives an empty lexicon and no
rows. Very long texts are one slice of their own; very long words are merged in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import pieces_finder
from wakeline.llm.files import make_folder, put, view
from wakeline.session import durable, shared_folder

SHARE = 1e-6            # of all word occurrences: a lexicon has at most a million words
SHARDS = 8
SLICE_CHARS = 4_000_000  # characters of text encoded at a time
FLUSH_WORDS = 200_000   # distinct words a counting task holds
MAX_MERGED = 300_000    # merged words a worker remembers
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """What a tokenizer file states: merges by rank, word-end symbols, special tokens, and how texts become words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [s["type"] for s in spec["normalizer"]["normalizers"]]
        cuts = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] \
                or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        byte_of = _byte_symbols()
        self.byte_of = {s: b for b, s in byte_of.items()}
        self.inner = [vocab[byte_of[b]] for b in range(256)]
        self.last = [vocab[byte_of[b] + suffix] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        vals = np.array([r << 32 | new for r, new in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_vals = keys[order], vals[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens must be plain strings")
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        _, self.unusual, self.find = pieces_finder(cuts[0]["pattern"]["Regex"])

    def _words(self, text: str) -> list[str]:
        if not self.unusual(text) and "İ" not in text:     # the one Latin letter whose lower case is two characters
            return self.find(text.lower())
        plain = self.library.normalizer.normalize_str(text)
        return [bytes(self.byte_of[c] for c in s).decode() for s, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def words(self, text: str) -> list:
        """Words of a text in order; a special token's string gives its id."""
        if self.cut_special is None or "<" not in text and not any(s in text for s in self.special):
            return self._words(text)
        out: list = []
        for i, part in enumerate(self.cut_special(text)):
            out += [self.special[part]] if i % 2 else self._words(part)
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | new id of pairs of ids; NONE where they do not merge."""
        key = (a << 32) | b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[k] == key) & (b >= 0), self.pair_vals[k], NONE)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the leftmost pair of lowest rank is merged until none is left."""
        return self._merge_long([self.inner[b] for b in word[:-1]] + [self.last[word[-1]]])

    def merge_many(self, words: list[bytes], rows: int = 8192, long: int = 48) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers: words of like length merge one pair each, all at once."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        short = order[:np.searchsorted(size[order], long)]
        for i in order[len(short):].tolist():
            ids = self.merge(words[i])
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        inner, last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        for at in range(0, len(short), rows):
            own = short[at:at + rows]
            width = int(size[own[-1]])
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in own.tolist()), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < size[own][:, None], inner[raw], -1)
            ids[np.arange(len(own)), size[own] - 1] = last[raw[np.arange(len(own)), size[own] - 1]]
            pairs = self._pair(ids[:, :-1], ids[:, 1:])
            while len(own):
                best = pairs.argmin(1) if pairs.shape[1] else np.zeros(len(own), np.int64)
                low = pairs[np.arange(len(own)), best] if pairs.shape[1] else np.full(len(own), NONE)
                end = low == NONE
                for i, r in zip(own[end].tolist(), ids[end].astype("<i4"), strict=True):
                    out[i] = r[r >= 0].tobytes()
                own, ids, pairs, best, low = own[~end], ids[~end], pairs[~end], best[~end], low[~end]
                if not len(own):
                    break
                r = np.arange(len(own))
                ids[r, best] = low & 0xFFFFFFFF
                at_id, at_pair = np.arange(ids.shape[1] - 1), np.arange(pairs.shape[1] - 1)
                ids = np.take_along_axis(ids, at_id + (at_id > best[:, None]), 1)
                pairs = np.take_along_axis(pairs, at_pair + (at_pair > best[:, None]), 1)
                for k in (best - 1, best):
                    ok = (k >= 0) & (k < pairs.shape[1])
                    pairs[r[ok], k[ok]] = self._pair(ids[r[ok], k[ok]], ids[r[ok], k[ok] + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of candidate pairs over a linked list."""
        n, get = len(ids), self.merges.get
        left, right, ids = list(range(-1, n - 1)), [*range(1, n), -1], list(ids)
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i] if i >= 0 else -1
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(path: str, _made={}) -> Vocabulary:
    """One per Python worker, whatever number of tasks it serves."""
    if path not in _made:
        _made[path] = Vocabulary(path)
    return _made[path]


class Builder:
    """Minimal acyclic transducer of words added in byte order: frozen states with equal arcs and outputs are one state."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.frozen: list[tuple] = []
        self.path = [self._open()]
        self.before = b""

    @staticmethod
    def _open() -> list:
        return [[], None]       # arcs [byte, target, output], output at the end of a word (None: no word ends here)

    def _freeze(self, node: list) -> int:
        key = (node[1], tuple((a[0], a[1], a[2]) for a in node[0]))
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.frozen)
            self.frozen.append(key)
        return at

    def _close(self, keep: int) -> None:
        while len(self.path) > keep + 1:
            node = self.path.pop()
            self.path[-1][0][-1][1] = self._freeze(node)

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if word <= self.before:
            raise ValueError("words must come once, in byte order, and not be empty")
        p = 0
        while p < len(self.before) and word[p] == self.before[p]:
            p += 1
        self._close(p)
        for i in range(p):      # outputs move down where the new word does not share them
            arc, below = self.path[i][0][-1], self.path[i + 1]
            k = 0
            while k < len(arc[2]) and k < len(ids) and arc[2][k] == ids[k]:
                k += 1
            held = arc[2][k:]
            if held:
                arc[2] = arc[2][:k]
                for a in below[0]:
                    a[2] = held + a[2]
                if below[1] is not None:
                    below[1] = held + below[1]
            ids = ids[k:]
        for i in range(p, len(word)):
            self.path[-1][0].append([word[i], -1, ids if i == p else ()])
            self.path.append(self._open())
        self.path[-1][1] = () if p < len(word) else ids
        self.before = word

    def finish(self) -> bytes:
        """Flat arrays: arcs sorted by state * 256 + byte, their targets and outputs, outputs of final states, output pool."""
        self._close(0)
        root = self._freeze(self.path[0])
        pool: dict[tuple, int] = {(): 0}

        def output(ids: tuple) -> int:
            return pool.setdefault(ids, len(pool))
        keys, to, out, final = [], [], [], []
        for s, (end, arcs) in enumerate(self.frozen):
            final.append(-1 if end is None else output(end))
            for byte, target, ids in arcs:
                keys.append(s * 256 + byte)
                to.append(target)
                out.append(output(ids))
        at = np.cumsum([0, *map(len, pool)])
        arrays = [np.array(keys, "<i8"), np.array(to, "<i4"), np.array(out, "<i4"), np.array(final, "<i4"), at.astype("<i8"),
                  np.array([i for ids in pool for i in ids], "<i4")]
        head = struct.pack("<8q", 1, root, *map(len, arrays))
        return head + b"".join(a.tobytes() for a in arrays)


class Automaton:
    """A compiled lexicon read in place."""

    def __init__(self, data: np.ndarray):
        version, self.root, *sizes = np.frombuffer(data[:64], "<i8").tolist()
        if version != 1:
            raise ValueError(f"lexicon version {version}")
        at, got = 64, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "<i4", "<i8", "<i4"), strict=True):
            size = n * np.dtype(kind).itemsize
            got.append(data[at:at + size].view(kind))
            at += size
        self.keys, self.to, self.out, self.final, self.pool_at, self.pool = got

    def walk(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words (bytes raw[start:start + size]) at once: found, ids per word, ids of the found words one after the other."""
        n = len(start)
        state, alive = np.full(n, self.root, np.int64), size > 0
        rows, outs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(int(size.max(initial=0))):
            w = np.flatnonzero(alive & (size > i))
            if not len(w) or not len(self.keys):
                alive[w] = False
                break
            key = state[w] * 256 + raw[start[w] + i]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            alive[w[~hit]] = False
            w, k = w[hit], k[hit]
            state[w] = self.to[k]
            o = self.out[k].astype(np.int64)
            rows.append(w[o > 0])
            outs.append(o[o > 0])
        end = np.where(alive, self.final[state] if len(self.final) else -1, -1).astype(np.int64)
        rows.append(np.flatnonzero(end > 0))
        outs.append(end[end > 0])
        row, out = np.concatenate(rows), np.concatenate(outs)
        own = end[row] >= 0
        row, out = row[own], out[own]
        order = np.argsort(row, kind="stable")      # parts were gathered byte by byte
        row, out = row[order], out[order]
        many = self.pool_at[out + 1] - self.pool_at[out]
        first = np.cumsum(many) - many
        ids = self.pool[np.repeat(self.pool_at[out] - first, many) + np.arange(int(many.sum()))]
        return end >= 0, np.bincount(row, many, n).astype(np.int64), ids


class Encoder:
    """Words of a slice through the shards of a lexicon, the others by merging."""

    def __init__(self, vocab: Vocabulary, folder: str | None, shards: int):
        self.vocab, self.merged, self.unseen = vocab, {}, 0
        self.shards = [None if folder is None or (d := view(folder, f"{s}.fst")) is None else Automaton(d) for s in range(shards)]

    def table(self, words: list) -> dict:
        """Ids, as little-endian 32-bit integers, of each distinct word."""
        known: dict = {w: struct.pack("<I", w) for w in words if isinstance(w, int)}
        words = [w for w in words if not isinstance(w, int)]
        data = [w.encode() for w in words]
        shard = np.fromiter(map(zlib.crc32, data), np.int64, len(data)) % max(1, len(self.shards))
        size = np.fromiter(map(len, data), np.int64, len(data))
        start, raw, rest = np.cumsum(size) - size, np.frombuffer(b"".join(data), np.uint8), []
        for s, fst in enumerate(self.shards):
            mine = np.flatnonzero(shard == s)
            if fst is None:
                found = np.zeros(len(mine), bool)
            else:
                found, many, ids = fst.walk(raw, start[mine], size[mine])
                buf, at = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(many)])).tolist()
                for k in np.flatnonzero(found).tolist():
                    known[words[mine[k]]] = buf[at[k]:at[k + 1]]
            rest += mine[~found].tolist()
        fresh = [k for k in rest if data[k] not in self.merged]
        got = dict(zip((data[k] for k in fresh), self.vocab.merge_many([data[k] for k in fresh]), strict=True))
        self.unseen += len(fresh)
        for k in rest:
            known[words[k]] = got[data[k]] if data[k] in got else self.merged[data[k]]
        if len(self.merged) + len(got) > MAX_MERGED:
            self.merged.clear()
        self.merged.update(got)
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.vocab.words(t) for t in texts]
        known = self.table(list(set().union(*cut)))
        return [b"".join(map(known.__getitem__, c)) for c in cut]


def decode(ids: Iterable[int], tokens: dict[int, str]) -> str:
    """The library's text of ids for a tokenizer without a decoder: tokens joined by one space, unknown ids left out."""
    return " ".join(tokens[i] for i in ids if i in tokens)


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of (id, text) cut so that a slice has about `chars` characters; one longer text is a slice of its own."""
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        at = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > chars:
                yield b.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t)
        if at < len(texts):
            yield b.slice(at), texts[at:]


def word_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """word, n over all texts; each task adds up its words before they are shuffled."""
    def run(batches):
        vocab, held = vocabulary(tokenizer_path), Counter()

        def flush():
            kept = [(w, n) for w, n in held.items() if not isinstance(w, int)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(vocab.words(t or ""))
                if len(held) > FLUSH_WORDS:
                    yield flush()
        yield flush()
    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, share: float = SHARE, shards: int = SHARDS) -> str:
    """Compile the frequent words of `docs` and return the folder that holds the shards."""
    spark = docs.sparkSession
    folder = make_folder(f"{shared_folder(spark)}/lexicon/{uuid.uuid4().hex}")
    counts = durable(word_counts(docs, tokenizer_path))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= F.lit(share * total)).select(F.pmod(F.crc32("word"), F.lit(shards)).cast("int").alias("shard"), "word")

    def run(batches):
        vocab, build, at, n = vocabulary(tokenizer_path), None, None, 0

        def done():
            put(folder, f"{at}.fst", build.finish())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([len(build.frozen)], pa.int64())],
                                              ["shard", "words", "states"])
        for b in batches:
            for s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != at:
                    if build is not None:
                        yield done()
                    build, at, n = Builder(), s, 0
                word = w.encode()
                build.add(word, tuple(vocab.merge(word)))
                n += 1
        if build is not None:
            yield done()
    built = rows.repartition(shards, "shard").sortWithinPartitions("shard", "word").mapInArrow(run, "shard int, words long, states long")
    built.agg(F.sum("words")).first()
    return folder


def encoder(tokenizer_path: str, folder: str | None, shards: int, _made={}) -> Encoder:
    key = (tokenizer_path, folder, shards)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(vocabulary(tokenizer_path), folder, shards)
    return _made[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shards: int = SHARDS) -> DataFrame:
    """doc_id, ids (int array) of each text, through the lexicon in `folder` (none: every word is merged)."""
    def run(batches):
        enc = encoder(tokenizer_path, folder, shards)
        for part, texts in slices(batches):
            ids = enc.encode(texts)
            off = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), values)], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of each id array."""
    def run(batches):
        tokens = vocabulary(tokenizer_path).tokens
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or [], tokens) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 (text decoded from those ids)."""
    folder = build_lexicon(docs, tokenizer_path, share, shards)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(tokenizer_path, folder, shards)
        get = enc.vocab.tokens.__getitem__
        for part, texts in slices(batches):
            ids = enc.encode(texts)
            sums = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(" ".join(map(get, np.frombuffer(x, "<u4").tolist())).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums), pa.array(back)], [c.split()[0] for c in schema.split(", ")])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
