"""Token ids on disk: Simple-8b word-aligned coding in files that Spark tasks write and read back.

A file holds the documents of one range of doc_id, in ascending order (null last, ties by text). Its parts:

    magic "S8BT" | version | n_docs | n_ids | n_words | n_blocks | n_escapes      little-endian 64-bit each after the magic
    doc ids (int64), null flags (uint8), ids per document (int64)
    per block: first word, first escape (int64)             a block is BLOCK ids (the last one may have fewer)
    words (uint64) | escapes (uint64)

A word has a 4-bit selector in its top bits and packs count ids of width bits: PACKINGS[selector]. Selector 0 is an escape:
one id that needs over 60 bits, held in the block's escape list at the place that the word names. Blocks start at word
borders, so blocks decode independently and a whole file decodes in one vectorised pass per selector.

Null and empty texts have only the end id. Repeated rows are written as often as they come. An empty table has no files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.common import durable, pieces_finder
from wakeline.session import shared_folder

MAGIC, VERSION, BLOCK = b"S8BT", 1, 1024
PACKINGS = [(1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in PACKINGS], np.int64)
MAX_PIECES = 2_000_000   # pieces whose ids a worker remembers (about 200 bytes each)


def _widths(ids: np.ndarray) -> np.ndarray:
    w = np.zeros(len(ids), np.int64)
    left = ids.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = left >= (np.uint64(1) << np.uint64(s))
        w += big * s
        left = np.where(big, left >> np.uint64(s), left)
    return w + (left > 0)


_WIDTH_16 = _widths(np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, index (first word and escape of each block), escapes. All blocks advance together, a word each per step."""
    ids = np.asarray(ids)
    nb, stride = -(-len(ids) // block), block + 64          # zeros after each block stand in for the ids of the next
    pad = np.zeros((nb + 1, stride), ids.dtype if ids.dtype.kind == "u" else np.uint64)
    whole = len(ids) // block
    pad[:whole, :block] = ids[:whole * block].reshape(whole, block)
    pad[whole, :len(ids) - whole * block] = ids[whole * block:]
    pad = pad.reshape(-1)
    small = pad.dtype.itemsize <= 4 and (not len(ids) or int(ids.max()) < 1 << 16)
    width = _WIDTH_16[pad] if small else _widths(pad.astype(np.uint64)).astype(np.uint8)
    n = nb * stride
    selector = np.zeros(n, np.int8)
    reach = {1: width}
    for c in sorted(set(COUNTS[1:].tolist())):      # largest width of the next c ids, from two overlapping shorter spans
        if c not in reach:
            b = max(k for k in reach if k < c)
            span = reach[b]
            while 2 * b < c:
                span = np.maximum(span[:-b], span[b:])
                b *= 2
            reach[c] = np.maximum(span[:len(span) - (c - b)], span[c - b:])
    for s in range(len(PACKINGS) - 1, 0, -1):
        c, w = PACKINGS[s]
        m = min(n, len(reach[c]))
        selector[:m][reach[c][:m] <= w] = s
    length = np.minimum(len(ids) - np.arange(nb) * block, block)
    pos = np.arange(nb) * stride
    stop, starts, jump = pos + length, np.zeros(n, bool), COUNTS.astype(np.int64)
    while len(pos):
        starts[pos] = True
        pos = pos + jump[selector[pos]]
        keep = pos < stop
        pos, stop = pos[keep], stop[keep]
    first = np.flatnonzero(starts)
    sel = selector[first]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(PACKINGS)):
        c, w = PACKINGS[s]
        rows = np.flatnonzero(sel == s)
        if len(rows):
            at, word = first[rows], np.zeros(len(rows), np.uint64)
            for k in range(c):
                word |= pad[at + k].astype(np.uint64) << np.uint64(k * w)
            words[rows] |= word
    out = np.flatnonzero(sel == 0)
    escapes = pad[first[out]].astype(np.uint64)
    word_at = np.searchsorted(first, np.arange(nb) * stride)
    esc_at = np.searchsorted(first[out], np.arange(nb) * stride)
    words[out] |= (np.arange(len(out)) - esc_at[first[out] // stride]).astype(np.uint64)
    return words, np.stack([word_at, esc_at], 1).astype(np.int64), escapes


def decode_ids(words: np.ndarray, index: np.ndarray, escapes: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """All ids of a range of blocks: counts per word give the places, then one gather per selector."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    nb = len(index)
    edges = np.append(index[:, 0], len(words))
    of = np.repeat(np.arange(nb), np.diff(edges))
    count = COUNTS[sel]
    run = np.cumsum(count) - count
    base = run[edges[:-1]] if nb else np.zeros(0, np.int64)
    at = of * block + run - base[of]
    out = np.zeros(nb * block + 64, np.uint64)
    body = words & ((np.uint64(1) << np.uint64(60)) - np.uint64(1))
    # later words overwrite the zeros that pad the last word of the block before: write in order of place
    for s in range(1, len(PACKINGS)):
        c, w = PACKINGS[s]
        rows = np.flatnonzero(sel == s)
        if len(rows):
            mask = (np.uint64(1) << np.uint64(w)) - np.uint64(1)
            vals = (body[rows][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))) & mask
            to = at[rows][:, None] + np.arange(c)
            own = to < (of[rows][:, None] + 1) * block
            out[to[own]] = vals[own]
    rows = np.flatnonzero(sel == 0)
    out[at[rows]] = escapes[body[rows].astype(np.int64) + index[of[rows], 1]]
    return out[:n_ids]


def pack_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, index, escapes = encode_ids(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<6q", VERSION, len(doc_ids), len(ids), len(words), len(index), len(escapes))
    return b"".join([head, keys.tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), index.astype("<i8").tobytes(),
                     words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids per document, all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, n_docs, n_ids, n_words, n_blocks, n_escapes = struct.unpack_from("<6q", data, 4)
    if version != VERSION:
        raise ValueError(f"token file version {version}")
    at = 52

    def take(kind, n):
        nonlocal at
        a = np.frombuffer(data, kind, n, at)
        at += a.nbytes
        return a
    keys, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
    index, words, escapes = take("<i8", 2 * n_blocks).reshape(-1, 2), take("<u8", n_words), take("<u8", n_escapes)
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], lengths, decode_ids(words, index, escapes, n_ids)


class _Pieces:
    """Ids of a text by the tokenizers library.

    The byte-level tokenizer cuts a text by its pattern and treats each piece on its own, so pieces seen before need not be
    encoded again. Texts with characters whose class could differ between pattern libraries, or with a special token's
    string, go to the library whole.
    """

    def __init__(self, path: str, pattern: str):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        _, self.unusual, self.find = pieces_finder(pattern)
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(self.tok.get_vocab().values()) + 1, np.int64)      # bytes of a token: a letter stands for a byte
        self.sizes[np.fromiter(vocab.values(), np.int64, len(vocab))] = np.fromiter(map(len, vocab), np.int64, len(vocab))
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, pieces: list[str]) -> tuple[str, list[str]] | None:
        """The pieces as one text that is cut into them again, line feeds before those that could grow together; None if it is not."""
        row = [x for p in pieces for x in (("\n", p) if p[0] != " " else (p,))]
        text = "".join(row)
        return (text, row) if self.find(text) == row and not self.special(text) else None

    def learn(self, pieces: list[str], run: int = 256, batch: int = 2048) -> None:
        """Remember the ids of pieces. The library takes many as one text (a call a piece costs twice the time); tokens are
        dealt out by their bytes, and a run whose tokens do not end where its pieces end is encoded piece by piece."""
        alone = [p for p in pieces if p.isspace()]      # white space before a piece could be cut otherwise
        others = [p for p in pieces if not p.isspace()]
        runs = [others[at:at + run] for at in range(0, len(others), run)]
        for at in range(0, len(runs), max(batch // run, 1)):
            made = [(r, self._rows(r)) for r in runs[at:at + max(batch // run, 1)]]
            alone += [p for r, m in made if m is None for p in r]
            made = [(r, *m) for r, m in made if m is not None]
            found = self.tok.encode_batch_fast([text for _, text, _ in made], add_special_tokens=False)
            for (r, text, row), e in zip(made, found, strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(self.sizes[ids])
                cuts = np.cumsum([len(x.encode()) for x in row])
                to = np.searchsorted(ends, cuts)
                if not len(ends) or ends[-1] != cuts[-1] or (ends[to] != cuts).any():
                    alone += r
                    continue
                raw, last = ids.tobytes(), 0
                for x, z in zip(row, (4 * (to + 1)).tolist(), strict=True):
                    self.known[x] = raw[last:z]
                    last = z
        for at in range(0, len(alone), batch):
            part = alone[at:at + batch]
            self.known.update(zip(part, self._library(part), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [None if self.unusual(t) or self.special(t) else self.find(t) for t in texts]
        known = self.known
        fresh = list(set().union(*(c for c in cut if c is not None)).difference(known))
        self.learn(fresh)
        out = [self._library([t])[0] if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        if len(known) > MAX_PIECES:     # the memory is full: these pieces served these texts only
            for p in fresh:
                del known[p]
        return out


def _pieces(path: str, pattern: str, _made={}) -> _Pieces:
    """One per Python worker, whatever number of tasks it serves."""
    if (path, pattern) not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path, pattern] = _Pieces(path, pattern)
    return _made[path, pattern]


def _put(folder: str, name: str, data: bytes) -> str:
    """Write under a name of the attempt's own, then rename: a task that runs twice leaves one whole file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    final, own = f"{root}/{name}", f"{root}/_{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, final)
    return final


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str, end_id: int = 0,
                      file_ids: int = 2_000_000, parts: int | None = None) -> DataFrame:
    """Encode `docs` (doc_id, text), append `end_id` to each document and write files of about `file_ids` ids.

    Returns the manifest, durable: file (its place in the order), path, docs, ids. Partitions are ranges of doc_id from
    sampled splitters, sorted within; their number is `parts` or the session's shuffle partitions.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").isNull().alias("null_id"))
    rows = rows.repartitionByRange(n, "null_id", "doc_id").sortWithinPartitions("null_id", "doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc, part, k = _pieces(tokenizer_path, pattern), TaskContext.get().partitionId(), 0
        keys, lengths, held, n_held = [], [], [], 0
        end = struct.pack("<I", end_id)

        def flush():
            name = f"part-{part:06d}-{k:04d}.s8b"
            path = _put(folder, name, pack_file(keys, np.array(lengths, np.int64), np.frombuffer(b"".join(held), "<u4")))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([len(keys)], pa.int64()), pa.array([n_held], pa.int64())],
                                              ["file", "path", "docs", "ids"])
        for b in batches:
            for at in range(0, b.num_rows, 128):
                some = b.slice(at, 128)
                for key, raw in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    keys.append(key)
                    lengths.append(len(raw) // 4 + 1)
                    held += (raw, end)
                    n_held += lengths[-1]
                    if n_held >= file_ids:
                        yield flush()
                        keys, lengths, held, n_held, k = [], [], [], 0, k + 1
        if keys:
            yield flush()
    return durable(rows.select("doc_id", "text").mapInArrow(run, "file string, path string, docs long, ids long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files, read back through Spark: doc_id, start (ids before the document), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    starts = manifest.select("file", "ids", F.coalesce(F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for content, before in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                keys, lengths, ids = unpack_file(content.as_buffer())
                ids = ids.astype("<u4")
                cut = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(before + cut[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])
    # one row a file on both sides; the contents stay where they are read while the counts are few
    few = starts.count() <= 100_000
    joined = files.join(F.broadcast(starts) if few else starts, "file").select("content", "before")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Write the files under the shared folder, then read the documents back from them."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
    if folder.startswith("file:"):
        folder = folder[len("file:"):]
    folder = folder if "://" in folder else "file:///" + folder.lstrip("/")
    return read_token_files(write_token_files(docs, tokenizer_path, pattern, folder), folder)
