"""Helpers shared by the corpus operators: words, row keys, skew-safe joins, grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import durable  # noqa: F401  (re-used by the operators)

WS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, also where a lambda inside the body reads it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text) -> Column:
    """Maximal runs of characters other than ASCII white space; null and blank texts have none."""
    t = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WS))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPLIT))


def row_keys(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add `k1`, `k2`: equal for repeated rows (same id, same text), different otherwise; never null."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    return df.withColumns({"k1": F.coalesce(F.col(doc_id).cast("long"), h), "k2": h})


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, spread: list[str], how: str = "left",
               small: int = 20_000, heavy_share: int = 4096) -> DataFrame:
    """Equi-join of many rows with one fact row per key, whatever share of the rows a key has.

    Facts that are counted to be few (and hold only a key and numbers) are broadcast. Otherwise the keys with over
    1/heavy_share of all rows, of which there can be at most `heavy_share`, are broadcast, and their rows are spread over
    the shuffle of the others by `spread`. `facts` is read several times: pass a durable table.
    """
    if facts.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(facts.drop(weight)), key, how)
    total = facts.agg(F.sum(weight)).first()[0] or 0
    cols = [c for c in facts.columns if c not in (key, weight)]
    hot = F.col(weight) * heavy_share > F.lit(total)
    heavy = facts.filter(hot).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in cols])
    light = facts.filter(~hot).select(key, F.lit(0).alias("_salt"), *cols)
    out = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0))
    out = out.join(light.withColumn("_light", F.lit(True)), [key, "_salt"], "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)))
    if how == "inner":
        out = out.filter(F.col("_hot") | F.col("_light"))
    return out.drop("_salt", "_hot", "_light", *[f"_hot_{c}" for c in cols])


def array_of(column, dtype=None) -> np.ndarray:
    """An Arrow column without nulls as numpy."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = c.to_numpy(zero_copy_only=False)
    return a if dtype is None else a.astype(dtype, copy=False)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary Arrow column (nulls are empty)."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.cast(pa.large_binary()) if not pa.types.is_large_binary(c.type) else c
    if c.null_count:
        c = c.fill_null(b"")
    off = np.frombuffer(c.buffers()[1], dtype=np.int64, count=len(c) + 1 + c.offset)[c.offset:]
    data = c.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - (off[0] if len(off) else 0), raw[off[0]:off[-1]]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Re-cut a stream sorted by `keys` into tables of about `rows` rows that never split a group."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table) -> int:
        last = table.num_rows
        same = np.ones(last, bool)
        for k in keys:
            c = table.column(k)
            v = np.asarray(c.to_numpy(zero_copy_only=False))
            same &= v == v[-1]
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            at = cut(table)
            if at:
                yield table.slice(0, at)
            rest = table.slice(at)
            held, n = rest.to_batches(), 0      # wait for as many new rows again before looking for the group's end
    if held:
        yield pa.Table.from_batches(held)


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (left, right) row numbers, left before right, inside consecutive groups."""
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.repeat(starts + sizes, sizes)
    rows = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(n)
    counts = ends - rows - 1
    left = np.repeat(rows, counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    right = np.arange(len(left)) - np.repeat(first, counts) + left + 1
    return left, right


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows, and the number of rows at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def pieces_finder(pattern: str, high: int = 0x250):
    """findall of a tokenizer's pattern for any text, a search that tells texts outside plain Latin, and findall for the others.

    In plain Latin texts the pattern's Unicode classes are written out for the standard library's engine, which gives the same
    matches in half the time; patterns with other classes, and all other texts, go to the regex package.
    """
    import re
    import unicodedata

    import regex

    full = regex.compile(pattern).findall
    unusual = re.compile(f"[^\t-\r -~\xa0-{chr(high - 1)}]").search

    def chars(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(high) if unicodedata.category(chr(c))[0] == kind)
    space, inside = "\t-\r \x85\xa0", pattern
    for name, body in (("\\p{L}", chars("L")), ("\\p{N}", chars("N")), ("\\s", space)):
        out, depth = [], 0
        for part in re.split(r"(\\p\{[LN]\}|\\.|\[|\])", inside):
            depth += (part == "[") - (part == "]")
            out.append((body if depth else f"[{body}]") if part == name else part)
        inside = "".join(out)
    plain = inside.replace("\\S", f"[^{space}]")
    if re.search(r"\\[pPSWwdDbBXkR]", plain):
        return full, unusual, full
    quick = re.compile(plain).findall
    return (lambda text: full(text) if unusual(text) else quick(text)), unusual, quick
