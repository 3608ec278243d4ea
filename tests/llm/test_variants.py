"""Operator 12: spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpus_fixtures import awkward, empty

from wakeline.llm import bitslice_variants as var


def words_of(rows, min_chars, min_count, every):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_chars:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= min_count}


def brute(c, ratio=5):
    near, alike = defaultdict(set), defaultdict(set)
    for w in c:
        for i in range(len(w)):
            alike[w[:i], w[i + 1:]].add(w)
            d = w[:i] + w[i + 1:]
            if d in c:
                near[w].add(d)
                near[d].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in c:
        if near[w]:
            b = min(near[w], key=lambda x: (-c[x], x))
            if c[b] >= ratio * c[w]:
                form[w] = b
    out = []
    for w in c:
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, c[w], len(near[w]), c[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("limit", [4096, 5])
def test_dense_vocabulary(spark, limit):
    """Few letters, so that buckets are large and most words have many near words; long runs of one letter; very long words."""
    r = random.Random(3)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 8))) for _ in range(900)]
    words += ["x" * k for k in (33, 34, 35, 80, 81)] + ["a" * k + "b" * k for k in range(1, 25)] + ["y" * 3000, "y" * 1500 + "z" + "y" * 1500, "漢字漢字", "漢字漢"]
    c = Counter()
    for w in words:
        c[w] += r.choice([1, 2, 3, 20, 100, 500])
    rows = [(w, n - 1) for w, n in c.items()] + [(w, 1) for w in c] + [(None, 5)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert sorted(map(tuple, var.variants(df, limit=limit).collect())) == brute(c)


def test_each_near_pair_meets_once(spark):
    words = spark.createDataFrame([("abcdef", 9), ("abcdeg", 8), ("abcdeff", 7), ("xbcdef", 6), ("bcdefa", 5), ("aabcdef", 4)], "word string, n long")
    got = {r.word: (r.n_near, r.near) for r in var.near_words(words).collect()}
    assert got == {"abcdef": (4, "abcdeg"), "abcdeg": (1, "abcdef"), "abcdeff": (1, "abcdef"), "xbcdef": (1, "abcdef"), "aabcdef": (1, "abcdef")}


def test_documents(spark):
    df = awkward(spark)
    more = [(100 + i, " ".join(["Kingdom kingdom"] * 30 + ["kingdomm Kïngdom"] * 5)) for i in range(40)]
    df = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*r, "en") for r in more], "doc_id long, text string, lang string"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for every in (None, 7, 199):
        got = sorted(map(tuple, var.spelling_variants(df, delete_every=every).collect()))
        assert got == brute(words_of(rows, 6, 5, every)) and got
    assert var.spelling_variants(empty(spark)).count() == 0


def test_chains_of_forms(spark):
    c = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "zzzzzz": 1}
    df = spark.createDataFrame(list(c.items()), "word string, n long")
    got = {r.word: r.root for r in var.variants(df).collect()}
    assert got == {w: "zzzzzz" if w == "zzzzzz" else "abbbbb" for w in c}


def test_words_without_company(spark):
    """A batch in which every word is alone in its bucket."""
    df = spark.createDataFrame([("abcdef", 9)], "word string, n long")
    assert list(map(tuple, var.variants(df).collect())) == [("abcdef", None, "abcdef", 9, 0, None)]
    assert var.variants(df.limit(0)).count() == 0
