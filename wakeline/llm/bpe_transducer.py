"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

Every prefix of a piece has one merge-order tokenisation, and a sequence of tokens is the tokenisation of its bytes exactly
when each neighbouring pair is. So a state is (last emitted token, bytes read since): from these follow the last token of
the tokenisation at every offset, the offsets from which a longer token may still start, and their common ancestor in the
chain of tokens, up to which the output is certain and is emitted. The lookahead is bounded, as a token's length is. States
and transitions are built when first read; there are at most `max_states`, later ones are used once and not kept.

Texts are cut into pieces by the tokenizer's pattern; null is an empty text; empty texts have no ids. Rows are independent:
repeated rows, ties and extra columns change nothing. Ids outside the vocabulary raise KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import pieces_finder

MAX_STATES = 100_000     # states kept in a worker's transducer
MAX_PIECES = 1_000_000   # pieces whose ids a worker remembers (about 200 bytes each)
MAX_PAIRS = 400_000      # pairs of tokens whose verdict a worker remembers
LOOKAHEAD = 16           # pending bytes from which certain tokens are looked for


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the leftmost pair of lowest rank until no pair is in the vocabulary."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _State:
    """`pending`: bytes since the last emitted token; `ends[i]`: rank of the last token of the tokenisation up to offset i
    (`ends[0]`: the emitted one, -1 at the start of a piece); `live`: offsets from which a longer token may still start."""

    __slots__ = ("pending", "ends", "live", "to")

    def __init__(self, pending, ends, live):
        self.pending, self.ends, self.live, self.to = pending, ends, live, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, lookahead: int = LOOKAHEAD):
        self.ranks, self.max_states, self.lookahead = ranks, max_states, lookahead
        self.tokens = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}    # proper prefixes: a longer token may follow
        self.own: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.committed: dict[tuple[int, bytes], _State] = {}
        self.n_states = 1
        self.start = _State(b"", [-1], ())

    def _fits(self, a: int, b: int) -> bool:
        """May token b follow token a (none: -1)? Some entries of a vocabulary are reached as a whole piece only."""
        v = self.pairs.get((a, b))
        if v is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            left = [self.tokens[a]] if a >= 0 else []
            v = self.pairs[a, b] = merge_ranks(b"".join(left) + self.tokens[b], self.ranks) == [*left, self.tokens[b]]
        return v

    def _step(self, s: _State, byte: int):
        """Read one byte: find the last token at the new end, then emit what all live hypotheses share."""
        w = s.pending + bytes((byte,))
        n, ends, live, last = len(w), s.ends, [], None
        for i in (*s.live, n - 1):
            t = w[i:]
            if last is None:
                r = self.ranks.get(t)
                if r is not None and self._fits(ends[i], r):
                    last = r
            if t in self.prefixes:
                live.append(i)
        ends = [*ends, last]
        out, nxt = (), None
        if n >= self.lookahead:
            base, out = self._shared(ends, [*live, n])
            if base:
                key = (ends[base], w[base:])
                nxt = self.committed.get(key)
                w, ends, live = w[base:], ends[base:], [i - base for i in live]
        if nxt is None:
            nxt = _State(w, ends, live)
            if self.n_states < self.max_states:
                self.n_states += 1
                if out:
                    self.committed[key] = nxt
        if self.n_states < self.max_states:     # beyond the bound, states are used once and not kept
            s.to[byte] = (nxt, out)
        return nxt, out

    def _shared(self, ends: list[int], at: list[int]) -> tuple[int, list[int]]:
        """The last offset on the token chains of all of `at`, and the ids up to it."""
        seen: dict[int, int] = {}
        for i in at:
            while i:
                seen[i] = seen.get(i, 0) + 1
                i -= len(self.tokens[ends[i]])
        base = max((i for i, c in seen.items() if c == len(at)), default=0)
        return base, self._back(ends, base)

    def _back(self, ends: list[int], i: int) -> list[int]:
        out = []
        while i:
            out.append(ends[i])
            i -= len(self.tokens[ends[i]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; tokens leave as soon as no later byte can change them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        s, ids = self.start, []
        for byte in piece:
            hit = s.to.get(byte) or self._step(s, byte)
            s = hit[0]
            if hit[1]:
                ids += hit[1]
        return ids + self._back(s.ends, len(s.pending))     # end of input: the chain at the last offset holds


class _Pieces(dict):
    """Ids of a piece as little-endian 32-bit integers; the first `most` pieces are remembered."""

    def __init__(self, fst: Transducer, most: int):
        super().__init__()
        self.fst, self.most = fst, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.fst.encode(piece.encode("utf-8", "surrogatepass"))
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[piece] = got
        return got


class TextEncoder:
    """Pieces of a text through the transducer; frequent pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.fst, self.find = Transducer(ranks, max_states), pieces_finder(pattern)[0]
        self.known = _Pieces(self.fst, max_pieces)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


class Utf8Stream:
    """Incremental UTF-8: bytes of any cut go in, whole characters come out.

    The machine's state is the unfinished character: how many continuation bytes are due and the range of the next one (the
    ranges exclude overlong forms, surrogates and values past U+10FFFF). A byte that fits no transition gives U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _due(lead: int) -> tuple[int, int, int]:
        """Continuation bytes due after a lead byte, and the lowest and highest value of the first; 0 due: not a lead."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def _open(self, data: bytes) -> int:
        """Length of the unfinished but so far valid character at the end."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b & 0xC0 != 0x80:
                due, low, high = self._due(b)
                if due >= k and (k == 1 or low <= data[len(data) - k + 1] <= high):
                    return k
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode_stream(ids: Iterable[int], table: dict[int, bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, in parts that end at whole characters."""
    utf8, part = Utf8Stream(), []
    for i in ids:
        part.append(table[i])
        if len(part) == chunk:
            yield utf8.feed(b"".join(part))
            part = []
    yield utf8.feed(b"".join(part)) + utf8.end()


def _encoder(path: str, pattern: str, _made={}) -> TextEncoder:
    """One per Python worker, whatever number of tasks it serves."""
    if (path, pattern) not in _made:
        _made[path, pattern] = TextEncoder(load_ranks(path), pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, rows: int = 256) -> DataFrame:
    """doc_id, ids (int array) of each text. The vocabulary file is read where the task runs; it is never shipped."""
    schema = "doc_id long, ids array<int>"

    def run(batches):
        enc = _encoder(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = [enc.encode_bytes(text or "") for text in part.column(1).to_pylist()]
                off = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), values)], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text of each id array; parts are decoded as they come, characters cut between tokens are put together."""
    def run(batches):
        table = {v: k for k, v in load_ranks(ranks_path).items()}
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(["".join(decode_stream(x or [], table)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 (bytes decoded from the ids),
    decoded_chars (characters that the streaming decoder gave) and, if wanted, the ids in those bytes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        enc = _encoder(ranks_path, pattern)
        get = enc.fst.tokens.__getitem__
        for b in batches:
            out = ([], [], [], [], [])
            for text in b.column(1).to_pylist():
                raw = enc.encode_bytes(text or "")
                ids, sha, utf8, chars = np.frombuffer(raw, "<u4").tolist(), hashlib.sha256(), Utf8Stream(), 0
                for at in range(0, len(ids), 65536):
                    part = b"".join(map(get, ids[at:at + 65536]))
                    sha.update(part)
                    chars += len(utf8.feed(part))
                chars += len(utf8.end())
                for x, v in zip(out, (len(ids), hashlib.sha256(raw).hexdigest(), sha.hexdigest(), chars, raw if with_ids else None), strict=True):
                    x.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = [b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols[:len(names)], names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

