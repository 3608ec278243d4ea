"""Byte-level duplicates by a partitioned suffix array.

Suffixes that start at content-chosen anchors are dealt out by ranges of their leading token (TOKEN bytes), between splitters
that Spark samples; each range is sorted by multikey quicksort, token after token, and windows of LENGTH bytes that stay equal
to the last token are repeats. Equal windows have equal anchors (see `repeats`), so a window and its copies lie in one range
and no pair straddles a border. Every byte covered by a window that also starts anywhere else goes, the first one too.

Null texts are empty; texts under LENGTH bytes lose nothing; repeated rows are copies of each other; ties cannot arise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wakeline.llm.common import buffers, row_keys
from wakeline.llm.repeats import Coder, covered, mixed, range_lists, repeated_ranges, with_ranges

LENGTH, TOKEN = 200, 40
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bytes(column):
    offsets, raw = buffers(column)
    return _CODES[raw], offsets


def coder(length: int = LENGTH, token: int = TOKEN) -> Coder:
    if length % token:
        raise ValueError("a window is a whole number of tokens")
    return Coder(length, token, token, _bytes)


def remove_repeats(docs: DataFrame, length: int = LENGTH, token: int = TOKEN, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (remaining bytes), spans (removed [start, end) pairs)."""
    keyed = row_keys(docs.select("doc_id", "text"))
    ranges = repeated_ranges(docs, coder(length, token), keep_first=False, **how)

    def run(batches):
        for b in batches:
            offsets, raw = buffers(b.column(1))
            n, removed, spans, sha, kept, cuts = [], [], [], [], [], []
            for i, r in enumerate(range_lists(b.column(2))):
                own = raw[offsets[i]:offsets[i + 1]]
                n.append(len(own))
                if r is None:
                    data, edge = own.tobytes(), []
                    removed.append(0)
                else:
                    mask = covered(r, len(own))
                    removed.append(int(mask.sum()))
                    data = own[~mask].tobytes()
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                spans.append(len(edge) // 2)
                cuts.append(edge)
                sha.append(hashlib.sha256(data).hexdigest())
                kept.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(kept, pa.binary()), pa.array(cuts, pa.list_(pa.int64()))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
    rows = with_ranges(keyed, ranges).selectExpr("cast(doc_id AS long) doc_id", "text", "ranges")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>")
