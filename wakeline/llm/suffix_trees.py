"""Word-level duplicates by suffix trees over groups of suffixes that share a prefix.

The suffixes that are dealt out start at content-chosen anchors (see `repeats`); a group holds those with one gram of K words at
the anchor and, where that gram has more distinct cells than fit in memory, goes on by its whole window. Copies that are equal
as a whole are put together by hash before. In each group the tree is built from the root down: a node is a run of suffixes,
its edge reaches as far as they agree, it branches by the word after that, and a branch of one suffix is a leaf. A node at
depth WINDOW or more is a repeat: of its occurrences the one with the smallest (doc_id, start) stays, all others are covered.

Null texts have no words; texts under WINDOW words lose nothing; a null doc_id is later than all others; rows of one id and
text are one document (neither is earlier); rows of one id with different texts are ordered by a hash of the text. Very long
texts are cut into overlapping chunks; an empty table gives an empty one; columns other than doc_id and text are carried along
in a struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import group_bounds, row_keys
from wakeline.llm.repeats import Coder, Hashes, covered, range_lists, repeated_ranges, with_ranges

WINDOW, K = 20, 5
MAX_WORDS = 300_000      # words whose hash a worker remembers


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = h
        return h


_KNOWN = _WordCodes()


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space (bytes.split cuts at just those six)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _words(column):
    offsets, out = [0], []
    for t in column.to_pylist():
        w = split_words(t)
        out.append(np.fromiter(map(_KNOWN.__getitem__, w), np.uint64, len(w)))
        offsets.append(offsets[-1] + len(w))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(offsets, np.int64)


def deep_nodes(group: np.ndarray, h: Hashes, codes: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of all groups at once, from the roots down. `start`: place of each suffix in `codes`, at least `depth` words
    before its end. Returns the suffixes under nodes at `depth` words or more, and the number of their node; such nodes are not
    grown further, since everything below them repeats."""
    rows = np.argsort(group, kind="stable")
    node, known = np.unique(group[rows], return_inverse=True)[1], np.zeros(len(rows), np.int64)
    out_rows, out_nodes, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    key = np.zeros(len(rows), np.uint64)
    while len(rows):
        bounds = group_bounds(node, key)
        size = np.diff(bounds)
        inner = np.repeat(size > 1, size)                  # a branch of one suffix is a leaf
        rows, known, size = rows[inner], known[inner], size[size > 1]
        if not len(rows):
            break
        first = np.cumsum(size) - size
        node = np.repeat(np.arange(len(size)), size)
        a, b = start[rows], start[rows[first]][node]
        low, high = known, np.full(len(rows), depth)
        while (low < high).any():                          # words that a suffix shares with the first of its node
            mid = (low + high + 1) // 2
            same = h.spans(a, a + mid) == h.spans(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        reach = np.minimum.reduceat(low, first)            # the node's depth: the edge ends where two of its suffixes part
        deep = (reach >= depth)[node]
        out_rows.append(rows[deep])
        out_nodes.append(node[deep] + made)
        made += len(size)
        rows, node = rows[~deep], node[~deep]
        key = codes[start[rows] + reach[node]]
        order = np.lexsort((key, node))
        rows, node, key = rows[order], node[order], key[order]
        known = reach[node] + 1
    return np.concatenate(out_rows), np.concatenate(out_nodes)


def coder(window: int = WINDOW, k: int = K) -> Coder:
    if window % k:
        raise ValueError("a window is a whole number of grams")
    return Coder(window, k, k, _words, deep_nodes)


def _cleaned(docs: DataFrame, window: int, k: int, how: dict) -> DataFrame:
    """Each row as `_row`, with n_words, n_removed, kept_sha256 and new_text (unchanged where nothing was removed)."""
    rows = row_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    ranges = repeated_ranges(docs, coder(window, k), keep_first=True, by_prefix=True, **how)
    rows = with_ranges(rows, ranges).select("_row", "ranges")
    row_type = rows.schema["_row"].dataType.simpleString()
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            new, n, removed, sha = [], [], [], []
            for text, r in zip(b.column(0).field(at).to_pylist(), range_lists(b.column(1)), strict=True):
                w = split_words(text)
                n.append(len(w))
                if r is not None:
                    mask = covered(r, len(w))
                    removed.append(int(mask.sum()))
                    w = [x for x, m in zip(w, mask.tolist(), strict=True) if not m]
                    text = b" ".join(w).decode("utf-8", "surrogatepass") if removed[-1] else text
                else:
                    removed.append(0)
                new.append(text)
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                             ["_row", "new_text", "n_words", "n_removed", "kept_sha256"])
    return rows.mapInArrow(run, f"_row {row_type}, new_text string, n_words long, n_removed long, kept_sha256 string")


def removal_report(docs: DataFrame, window: int = WINDOW, k: int = K, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _cleaned(docs.select("doc_id", "text"), window, k, how).select(F.col("_row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, **how) -> DataFrame:
    """The documents with repeated passages cut out of `text` (and `n_chars` counted anew, where there is such a column);
    documents of which nothing is left go."""
    out = _cleaned(docs, window, k, how).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*[new[c].alias(c) if c == "text" or (c == "n_chars" and c in docs.columns) else F.col(f"_row.`{c}`") for c in docs.columns])
