"""Operators 6 and 9 against brute force, with every path: plain groups, hot anchors, long texts cut into chunks."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_fixtures import awkward, empty, prose, with_hot_groups

from wakeline.llm import repeats, suffix_ranges, suffix_trees


def brute_bytes(rows, length):
    texts = [(t or "").encode() for t in rows]
    seen = Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                mask[p:p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    """rows: (doc_id, text); rows of one id and text are one document."""
    docs = [(i, suffix_trees.split_words(t)) for i, t in rows]
    first = {}
    order = defaultdict(list)
    for i, w in docs:
        for p in range(len(w) - window + 1):
            order[tuple(w[p:p + window])].append(((i is None, i if i is not None else 0), p))
    for k, v in order.items():
        first[k] = min(v)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if ((i is None, i or 0), p) > first[tuple(w[p:p + window])]:
                gone.update(range(p, p + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"max_cells": 2}, {"chunk": 700}])
def test_byte_repeats_equal_brute_force(spark, how, monkeypatch):
    if "chunk" in how:
        monkeypatch.setattr(repeats, "CHUNK", how.pop("chunk"))
    df = awkward(spark).filter("doc_id IS NULL OR doc_id <> 30").unionByName(
        spark.createDataFrame([(50, prose(7, 1500), "en", "s", 0, 7, "x", "y", "z"), (51, prose(7, 900) + prose(8, 90), "en", "s", 0, 7, "x", "y", "z")], awkward(spark).schema))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 40), strict=True))
    got = Counter(tuple(r) for r in suffix_ranges.remove_repeats(df, 40, 20, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want


@pytest.mark.parametrize("how", [{}, {"max_cells": 2}])
def test_word_repeats_equal_brute_force(spark, how):
    df = awkward(spark).filter("(doc_id IS NULL AND text IS NULL) OR doc_id NOT IN (30, 41)")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_words(rows, 10), strict=True))
    got = Counter(tuple(r) for r in suffix_trees.removal_report(df, 10, 5, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want


def test_hot_passages(spark):
    df = with_hot_groups(spark, 60)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_words(rows, 20), strict=True))
    for how in ({}, {"max_cells": 8}):
        assert sorted(tuple(r) for r in suffix_trees.removal_report(df, **how).collect()) == want
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 200), strict=True))
    got = suffix_ranges.remove_repeats(df, max_cells=8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cleaned_documents_keep_their_columns(spark):
    df = awkward(spark)
    out = suffix_trees.remove_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.filter("doc_id IS NOT NULL").collect()}
    assert got[0].text == df.filter("doc_id = 0").first().text and got[0].k1 == "z"
    assert 20 not in got                    # a whole copy of document 3
    assert got[22].n_chars == len(got[22].text)


def test_empty_tables(spark):
    assert suffix_trees.removal_report(empty(spark)).count() == 0
    assert suffix_trees.remove_repeats(empty(spark)).count() == 0
    assert suffix_ranges.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_tree_nodes_are_the_equal_windows(letters):
    """Nodes at the wanted depth against windows compared as tuples, in groups of random suffixes."""
    rnd = np.random.default_rng(letters)
    codes = repeats.mixed(rnd.integers(0, letters, 600).astype(np.uint64) + np.uint64(1))
    start = rnd.integers(0, 600 - 8, 400)
    group = rnd.integers(0, 7, 400)
    rows, node = suffix_trees.deep_nodes(group, repeats.Hashes(codes), codes, start, 8)
    want = defaultdict(set)
    for i, (g, s) in enumerate(zip(group.tolist(), start.tolist(), strict=True)):
        want[g, tuple(codes[s:s + 8].tolist())].add(i)
    got = defaultdict(set)
    for r, n in zip(rows.tolist(), node.tolist(), strict=True):
        got[n].add(r)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    none = np.zeros(0, np.int64)
    assert len(suffix_trees.deep_nodes(none, repeats.Hashes(codes), codes, none, 8)[0]) == 0
