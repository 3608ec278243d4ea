"""Operator 13: alignment of two tokenizers against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_fixtures import awkward, empty, with_hot_groups
from tokenizers import Tokenizer

from wakeline.llm import token_alignment as ta
from wakeline.llm.lexicon_transducer import _byte_symbols

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned(text, libraries):
    """Ids of A and B, the groups as text and the linked pairs; None without tokens."""
    tok, sp = libraries
    if not text:
        return None
    e = tok.encode(" " + text, add_special_tokens=False)
    byte = {s: b for b, s in _byte_symbols().items()}
    a = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))]
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return None
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(c) + 1, ends[1].index(c) + 1
        groups.append(",".join(str(x) for x, _ in a[i:k]) + "|" + ",".join(str(x) for x, _ in b[j:m]))
        links.append((a[k - 1][0], b[m - 1][0]))
        i, j = k, m
    return len(a), len(b), groups, links


def brute(rows, libraries):
    docs = [(i, aligned(t, libraries)) for i, t in rows]
    n = Counter(x for _, d in docs if d for x in d[3])
    top = Counter()
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    return sorted(((i, d[0], d[1], len(d[2]), len(d[3]), sum(n[x] == top[x[1]] for x in d[3]), sum(n[x] for x in d[3]),
                    hashlib.sha256(";".join(d[2]).encode()).hexdigest()) if d else (i, 0, 0, 0, 0, 0, 0, "") for i, d in docs), key=str)


def test_terminals_are_components():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 60))
        end_a, end_b = (np.append(np.flatnonzero(r.random(n) < 0.4) + 1, n + 1) for _ in range(2))
        of_a, of_b = ta.terminals(end_a, end_b)
        common = np.intersect1d(end_a, end_b)
        assert (end_b[of_a] == common[np.searchsorted(common, end_a)]).all() and (end_b[of_b] == common[np.searchsorted(common, end_b)]).all()
    long_a, long_b = np.append(np.arange(2, 20_001, 2), 20_002), np.append(np.arange(3, 20_001, 2), 20_002)     # one long chain
    assert (ta.terminals(long_a, long_b)[0] == len(long_b) - 1).all()


@pytest.mark.parametrize("share", [1e-6, 1e-3, 2.0])
def test_report_of_unusual_texts(spark, libraries, share):
    r = random.Random(2)
    letters = "abc é漢🙂\n\t  ▁\x00　ﬁ<s></s><|endoftext|>'s 12\xa0́"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(None, None), (None, "a b"), (7, ""), (8, " "), (8, " "), (9, "\n"), (10, "  x  \n\n y "), (11, "<s>x</s> <|endoftext|> <unk> <0x41>"), (12, "x" * 9000), (13, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ta.alignment_report(df, A, PATTERN, B, share).collect()), key=str) == brute(rows, libraries)


def test_report_of_awkward_tables(spark, libraries):
    for df in (awkward(spark), with_hot_groups(spark, 15)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(tuple, ta.alignment_report(df, A, PATTERN, B).collect()), key=str) == brute(rows, libraries)
    assert ta.alignment_report(empty(spark), A, PATTERN, B).count() == 0


def test_groups_as_text_and_small_memories(spark, libraries, monkeypatch):
    monkeypatch.setattr(ta, "MAX_PIECES", 3)
    side_a, side_b = ta.ByteLevelSide(A, PATTERN), ta.PieceSide(B)
    texts = ["one two  three\nfour", "two\n\nfive ", "one"]
    for t in texts:
        assert ta.Aligned(side_a.encode([" " + t]), side_b.encode([t]), side_a.size, side_b.size).written(ta._names(51_000)) == [";".join(aligned(t, libraries)[2])]
    got = ta.align(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), A, PATTERN, B, with_groups=True).first()
    assert hashlib.sha256(got.groups.encode()).hexdigest() == got.groups_sha256
