"""Exact repeated windows of a corpus, shared by the byte and the word operator.

A window is W consecutive symbols of one text. Each window names an anchor, its leftmost k-gram of least hash, so equal windows
have equal anchors at equal places. Consecutive windows with the same anchor form a cell, and one row a cell is shuffled, not
one a window. Cells of one anchor gram meet: equal cells settle each other by their hash; what differs (the borders of
repeated passages) is fetched from the texts and compared window by window. Anchors that occur once end there.

Hashes have 64 bits and are compared inside one anchor's group only. Rows are keyed by (k1, k2) of `row_keys`: repeated rows
(same id, same text) share keys. Nothing is capped: a group of more distinct cells than MAX_CELLS goes on as rows of single
windows that Spark counts with map-side combination.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import buffers, durable, group_bounds, row_keys, whole_groups

CHUNK = 1 << 20          # symbols worked on at once
MAX_CELLS = 50_000       # rows of one anchor compared in memory
_B = 0x9E3779B97F4A7C15
_B_INV = np.uint64(pow(_B, -1, 1 << 64))
_B = np.uint64(_B)
CELL, RANGE, HOT = 0, 1, 2
CELLS = "kind byte, kh long, ch long, late boolean, k1 long, k2 long, lo int, n int, off int, settled boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, _made={}) -> tuple[np.ndarray, np.ndarray]:
    if _made.get("n", 0) < n:
        full = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)))
        _made.update(n=n, b=full(_B), i=full(_B_INV))
    return _made["b"][:n], _made["i"][:n]


class Hashes:
    """Hash of any span of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        power, self.inverse = _powers(len(codes) + 1)
        self.run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[:-1], out=self.run[1:])

    def spans(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mixed((self.run[z] - self.run[a]) * self.inverse[a])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.run) - k
        return mixed((self.run[k:] - self.run[:n]) * self.inverse[:n])


def anchors(gram: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least value in each run of w values (spans double until two overlap to w)."""
    val, idx, size = gram, np.arange(len(gram), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        less = val[step:] < val[:-step]
        idx = np.where(less, idx[step:], idx[:-step])
        val = np.where(less, val[step:], val[:-step])
        size += step
    return idx


def cells_of(codes: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Cells of texts laid end to end (bounds: their n + 1 offsets): text, first window, windows, place of the anchor in the
    first window, hash of the anchor gram, hash of the whole cell."""
    n = len(codes)
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    h = Hashes(codes)
    gram = h.grams(k)
    at = anchors(gram, window - k + 1)
    edge = np.zeros(n + 1, np.int32)
    size = np.diff(bounds)
    long = size >= window
    np.add.at(edge, bounds[:-1][long], 1)
    np.add.at(edge, bounds[1:][long] - window + 1, -1)
    valid = np.cumsum(edge[:len(at)]) > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    anchor = at[first].astype(np.int64)
    off = anchor - first
    whole = mixed(h.spans(first, first + count - 1 + window) + off.astype(np.uint64))
    text = np.searchsorted(bounds, first, side="right") - 1
    return text, first - bounds[text], count, off, gram[anchor], whole


class Coder:
    """Codes of the symbols of texts. `make` runs in the task: (Arrow text column) -> (codes, offsets). `classes` tells which
    windows of one group are equal: (group, hashes, codes, starts, window) -> (rows, class of each); sorting where it is None."""

    def __init__(self, window: int, k: int, token: int, make: Callable, classes: Callable | None = None):
        self.window, self.k, self.token, self.make, self.classes = window, k, token, make, classes


def _segments(offsets: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of (text, from, to): about CHUNK symbols each; longer texts are cut with window - 1 symbols of overlap."""
    chunk, n = [], 0
    for t in range(len(offsets) - 1):
        a, z = int(offsets[t]), int(offsets[t + 1])
        if z - a < window:
            continue
        while True:
            end = min(z, a + CHUNK + window - 1)
            chunk.append((t, a, end))
            n += end - a
            if n >= CHUNK:
                yield chunk
                chunk, n = [], 0
            if end == z:
                break
            a = end - window + 1
    if chunk:
        yield chunk


def _parts(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, so that codes of eight bytes a symbol stay small."""
    offsets = buffers(batch.column(text))[0]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _batch(**cols) -> pa.RecordBatch:
    kinds = {"kind": pa.int8(), "late": pa.bool_(), "settled": pa.bool_(), "lo": pa.int32(), "n": pa.int32(), "off": pa.int32()}
    arrays = []
    for k, v in cols.items():
        v = v.view(np.int64) if v.dtype == np.uint64 else v
        arrays.append(pa.array(v, kinds.get(k, pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, list(cols))


def _find(coder: Coder, keep_first: bool):
    """Cells of each batch, equal ones inside a chunk put together: all but the first (in order of the rows) are removed
    ranges; where every occurrence goes, so is the first, which stays as a settled cell for others to meet."""
    def run(batches):
        for b in (part for whole in batches for part in _parts(whole, 3)):
            codes, offsets = coder.make(b.column(3))
            late, k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for chunk in _segments(offsets, coder.window):
                text = np.array([c[0] for c in chunk])
                base = np.array([c[1] for c in chunk]) - offsets[text]
                bounds = np.concatenate([[0], np.cumsum([c[2] - c[1] for c in chunk])])
                part = codes[chunk[0][1]:chunk[-1][2]] if len(bounds) == 2 else np.concatenate([codes[a:z] for _, a, z in chunk])
                seg, lo, n, off, kh, ch = cells_of(part, bounds, coder.window, coder.k)
                lo = lo + base[seg]
                row = text[seg]
                order = np.lexsort((lo, k2[row], k1[row], late[row], ch, kh))
                row, lo, n, off, kh, ch = row[order], lo[order], n[order], off[order], kh[order], ch[order]
                start = group_bounds(kh, ch)
                size = np.diff(start)
                first = np.zeros(len(kh), bool)
                first[start[:-1]] = True
                settled = np.zeros(len(kh), bool)
                settled[start[:-1]] = (size > 1) & (not keep_first)
                repeat = ~first
                if keep_first:      # a repeated row of the first is no later one
                    head = np.repeat(start[:-1], size)
                    repeat &= ~((k1[row] == k1[row[head]]) & (k2[row] == k2[row[head]]) & (lo == lo[head]))
                else:
                    repeat |= settled
                yield _batch(kind=np.zeros(int(first.sum()), np.int8), kh=kh[first], ch=ch[first], late=late[row[first]], k1=k1[row[first]], k2=k2[row[first]],
                             lo=lo[first], n=n[first], off=off[first], settled=settled[first])
                if repeat.any():
                    r = row[repeat]
                    spread = mixed(kh[repeat] + lo[repeat].astype(np.uint64) + k1[r].view(np.uint64))      # ranges pass through, dealt evenly
                    yield _batch(kind=np.full(len(r), RANGE, np.int8), kh=spread, ch=spread, late=late[r], k1=k1[r], k2=k2[r], lo=lo[repeat],
                                 n=n[repeat], off=off[repeat], settled=np.ones(len(r), bool))
    return run


def _meet(keep_first: bool, max_cells: int):
    """Rows sorted by (kh, ch, order): repeats become ranges, distinct cells of a shared anchor go on, the rest end."""
    def work(t: pa.Table, hot_kh, last_ch, hot_tail: bool):
        col = {c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in t.column_names}
        passing = col["kind"] == RANGE
        out = [{c: v[passing] for c, v in col.items()}]
        col = {c: v[~passing] for c, v in col.items()}
        kh, ch = col["kh"], col["ch"]
        if len(kh):
            start = group_bounds(kh, ch)
            size, heads = np.diff(start), start[:-1]
            head = np.repeat(heads, size)
            first = np.zeros(len(kh), bool)
            first[heads] = True
            going_on = hot_kh is not None and kh[0] == hot_kh and ch[0] == last_ch      # its first row was in an earlier table
            many = (np.add.reduceat(np.ones(len(kh), np.int64), heads) > 1)
            if going_on:
                many[0] = True
            if keep_first:
                repeat = ~first & ~((col["k1"] == col["k1"][head]) & (col["k2"] == col["k2"][head]) & (col["lo"] == col["lo"][head]))
                if going_on:
                    repeat[0] = True
            else:
                repeat = np.repeat(many, size) & ~col["settled"]
            kept = first.copy()
            if keep_first and going_on:
                kept[0] = False
            groups = group_bounds(kh[heads])
            distinct = np.repeat(np.diff(groups), np.diff(groups)) > 1         # per head: other cells have its anchor
            hot = np.zeros(len(heads), bool)
            if hot_kh is not None:
                hot |= kh[heads] == hot_kh
            if hot_tail:
                hot |= kh[heads] == kh[-1]
            ranges = {c: v[repeat] for c, v in col.items()}
            ranges["kind"] = np.full(int(repeat.sum()), RANGE, np.int8)
            out.append(ranges)
            go = kept[heads] & (distinct | hot)
            rows = heads[go]
            cells = {c: v[rows] for c, v in col.items()}
            cells["kind"] = np.where(hot[go], HOT, CELL).astype(np.int8)
            if not keep_first:
                cells["settled"] = cells["settled"] | many[go]
            out.append(cells)
        for o in out:
            if len(o["kh"]):
                yield _batch(**o)

    def run(batches):
        held, n, hot_kh, last_ch = [], 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < 8192:
                continue
            t = pa.Table.from_batches(held)
            kh = t.column("kh").combine_chunks().to_numpy()
            other = np.flatnonzero(kh != kh[-1])
            at = int(other[-1]) + 1 if len(other) else 0
            if at:
                yield from work(t.slice(0, at), hot_kh, last_ch, False)
                if hot_kh is not None and kh[-1] != hot_kh:
                    hot_kh = last_ch = None
                t = t.slice(at)
            held, n = t.to_batches(), 0
            if t.num_rows >= max_cells:
                yield from work(t, hot_kh, last_ch, True)
                hot_kh, last_ch = kh[-1], t.column("ch")[t.num_rows - 1].as_py()
                held = []
        if held:
            yield from work(pa.Table.from_batches(held), hot_kh, last_ch, False)
    return run


def _fetch(coder: Coder):
    """Codes of the listed cells of each text."""
    def run(batches):
        for b in (part for whole in batches for part in _parts(whole, 0)):
            codes, offsets = coder.make(b.column(0))
            lists = b.column(1)
            flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())      # both follow the slice
            row = np.repeat(np.arange(b.num_rows), per)
            col = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            lo = col["lo"].to_numpy() + offsets[row]
            hi = lo + col["n"].to_numpy() - 1 + coder.window
            data = [codes[a:z].tobytes() for a, z in zip(lo.tolist(), hi.tolist(), strict=True)]
            for at in range(0, len(data), 4096):
                s = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([*(col[c][s] for c in FETCHED), pa.array(data[s], pa.binary())], [*FETCHED, "data"])
    return run


FETCHED = ["kind", "kh", "late", "k1", "k2", "lo", "n", "off", "settled"]


def equal_windows(label: np.ndarray, tokens: Callable[[np.ndarray, int], np.ndarray], depth: int) -> np.ndarray:
    """Multikey quicksort, all groups at once: each level sorts what is still equal by one more token and splits it there.
    Returns a class for each row, -1 where no other row is equal."""
    active = np.arange(len(label))
    label = label.astype(np.int64)
    for d in range(depth + 1):
        if d:
            key = tokens(active, d - 1)
            order = np.lexsort((key, label))
            active, label, key = active[order], label[order], key[order]
            start = group_bounds(label, key)
        else:
            order = np.argsort(label, kind="stable")
            active, label = active[order], label[order]
            start = group_bounds(label)
        size = np.diff(start)
        label = np.repeat(np.arange(len(size)), size)
        more = np.repeat(size > 1, size)
        active, label = active[more], label[more]
    return active, label


def _solve(coder: Coder, keep_first: bool, rows: int = 4096):
    """Compare the windows of each anchor's distinct cells; covered ranges come out."""
    W, tok = coder.window, coder.token

    def run(batches):
        for t in whole_groups(batches, ["kh"], rows):
            col = {c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in FETCHED}
            off8, raw = buffers(t.column("data"))
            codes, base = raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64), off8[:-1] // 8
            n = col["n"].astype(np.int64)
            cell = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            at = base[cell] + j
            gid = np.cumsum(np.append(0, col["kh"][1:] != col["kh"][:-1]))
            label = gid[cell] * (W + 1) + (col["off"][cell] - j)
            h = Hashes(codes)

            def token(rows_, d, at=at, h=h):
                a = at[rows_] + d * tok
                return h.spans(a, a + tok)
            active, cls = coder.classes(label, h, codes, at, W) if coder.classes else equal_windows(label, token, W // tok)
            if not len(active):
                continue
            if keep_first:
                c = cell[active]
                order = np.lexsort((col["lo"][c] + j[active], col["k2"][c], col["k1"][c], col["late"][c], cls))
                active, cls = active[order], cls[order]
                c, start = cell[active], col["lo"][cell[active]] + j[active]
                size = np.diff(group_bounds(cls))
                head = np.repeat(np.cumsum(size) - size, size)
                hit = ~((col["k1"][c] == col["k1"][c[head]]) & (col["k2"][c] == col["k2"][c[head]]) & (start == start[head]))
                active = active[hit]
            else:
                active = active[~col["settled"][cell[active]]]
            covered = np.zeros(len(cell), bool)
            covered[active] = True
            w = np.flatnonzero(covered)
            if not len(w):
                continue
            cut = np.ones(len(w), bool)
            cut[1:] = (cell[w[1:]] != cell[w[:-1]]) | (w[1:] != w[:-1] + 1)
            first = w[cut]
            last = w[np.append(np.flatnonzero(cut)[1:] - 1, len(w) - 1)]
            c = cell[first]
            yield pa.RecordBatch.from_arrays([pa.array(col["k1"][c]), pa.array(col["k2"][c]), pa.array((col["lo"][c] + j[first]).astype(np.int32)),
                                              pa.array((col["lo"][c] + j[last] + W).astype(np.int32))], ["k1", "k2", "s", "e"])
    return run


def _single_windows(coder: Coder):
    """One row for each window of a hot anchor's cells, with two independent hashes of the window."""
    W = coder.window

    def run(batches):
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in FETCHED}
            off8, raw = buffers(b.column(b.schema.get_field_index("data")))
            codes, base = raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64), off8[:-1] // 8
            n = col["n"].astype(np.int64)
            cell = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            a = base[cell] + j
            yield _batch(w1=Hashes(codes).spans(a, a + W), w2=Hashes(mixed(codes)).spans(a, a + W), late=col["late"][cell], k1=col["k1"][cell], k2=col["k2"][cell],
                         lo=(col["lo"][cell] + j).astype(np.int32))
    return run


def repeated_ranges(docs: DataFrame, coder: Coder, keep_first: bool, by_prefix: bool = False, max_cells: int = MAX_CELLS) -> DataFrame:
    """(k1, k2, s, e): ranges of symbols covered by repeated windows. docs has text, doc_id. keep_first: a window counts only
    where an equal one starts earlier (smaller id, null last; same text, earlier). by_prefix: groups are dealt out by the hash
    of their prefix; otherwise by ranges of it between sampled splitters."""
    keyed = row_keys(docs.select("doc_id", "text")).select(F.col("doc_id").isNull().alias("late"), "k1", "k2", "text")
    found = keyed.mapInArrow(_find(coder, keep_first), CELLS)
    met = durable(found.repartition("kh").sortWithinPartitions("kh", "ch", "late", "k1", "k2", "lo").mapInArrow(_meet(keep_first, max_cells), CELLS))
    ranges = met.filter(F.col("kind") == RANGE).select("k1", "k2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + coder.window).alias("e"))
    wanted = met.filter(F.col("kind") != RANGE).groupBy("k1", "k2").agg(F.collect_list(F.struct(*FETCHED)).alias("cells"))
    pieces = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "cells").mapInArrow(
        _fetch(coder), "kind byte, kh long, late boolean, k1 long, k2 long, lo int, n int, off int, settled boolean, data binary")
    hot = not met.filter(F.col("kind") == HOT).isEmpty()
    if hot:
        pieces = durable(pieces)
    cells = pieces.filter(F.col("kind") == CELL) if hot else pieces
    cells = cells.repartition("kh") if by_prefix else cells.repartitionByRange("kh")
    ranges = ranges.unionByName(durable(cells.sortWithinPartitions("kh").mapInArrow(_solve(coder, keep_first), "k1 long, k2 long, s int, e int")))
    if hot:
        single = durable(pieces.filter(F.col("kind") == HOT).mapInArrow(_single_windows(coder), "w1 long, w2 long, late boolean, k1 long, k2 long, lo int"))
        place = F.struct("late", "k1", "k2", "lo")
        seen = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).filter("c > 1")
        again = single.join(seen, ["w1", "w2"])
        if keep_first:
            again = again.filter(place > F.col("first"))
        ranges = ranges.unionByName(again.select("k1", "k2", F.col("lo").alias("s"), (F.col("lo") + coder.window).alias("e")))
    return ranges


def covered(ranges, n: int) -> np.ndarray:
    """Mask of n symbols from a list of (s, e)."""
    edge = np.zeros(n + 1, np.int64)
    if ranges is not None and len(ranges):
        np.add.at(edge, ranges[0], 1)
        np.add.at(edge, ranges[1], -1)
    return np.cumsum(edge[:-1]) > 0


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row of `docs` (with k1, k2) and `ranges`: its list of (s, e), null where it has none."""
    lists = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    return docs.join(lists, ["k1", "k2"], "left")


def range_lists(column) -> list:
    """Per row: (starts, ends) arrays, or None."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off, flat = c.offsets.to_numpy(), c.values
    s, e = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    return [(s[a:z], e[a:z]) if z > a else None for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
