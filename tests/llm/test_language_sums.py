"""Operator 5: forward sums and expected counts against all segmentations written out, and against plain dynamic programming."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from wakeline.llm import language_id as li

PIECES = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁abca", "cabcabcabcab"]


@pytest.fixture(scope="module")
def lattice():
    return li.Lattice(PIECES)


def cuts(word, at=0):
    if at == len(word):
        yield []
        return
    for end in range(at + 1, len(word) + 1):
        if word[at:end] in PIECES or end == at + 1:
            for rest in cuts(word, end):
                yield [word[at:end], *rest]


def table(langs=2):
    t = np.random.default_rng(1).random((len(PIECES) + 2, langs))
    t[len(PIECES)], t[len(PIECES) + 1] = 0.0, 1e-7
    return t


def prob(piece, t, k):
    return t[PIECES.index(piece) if piece in PIECES else len(PIECES) + 1, k]


def test_sums_over_all_segmentations(lattice):
    t = table()
    words = ["▁abc", "▁abcabca", "▁x", "▁abxcabcabcabcab", "▁"]
    got = lattice.log_scores(words, t)
    for w, g in zip(words, got, strict=True):
        for k in range(2):
            assert g[k] == pytest.approx(math.log(sum(math.prod(prob(p, t, k) for p in c) for c in cuts(w))), rel=1e-12)


def test_expected_counts(lattice, monkeypatch):
    t = table(1)[:, 0]
    words, counts = ["▁abc", "▁abcabca", "▁abxcab", "▁cabcabcabcabcab"], np.array([1.0, 2.0, 5.0, 3.0])
    want = np.zeros(len(PIECES) + 2)
    for w, n in zip(words, counts, strict=True):
        ways = [(math.prod(prob(p, t[:, None], 0) for p in c), c) for c in cuts(w)]
        for x, c in ways:
            for p in c:
                want[PIECES.index(p) if p in PIECES else len(PIECES) + 1] += n * x / sum(y for y, _ in ways)
    for long, rescale in ((64, 16), (64, 3), (1, 16), (1, 2)):      # in a matrix and word by word
        monkeypatch.setattr(li, "LONG", long)
        monkeypatch.setattr(li, "RESCALE", rescale)
        assert np.allclose(lattice.expected(words, counts, t), want, rtol=1e-9, atol=1e-12)


def test_long_runs_are_not_cut(lattice):
    t, r = table(), random.Random(2)
    words = ["▁" + "".join(r.choice("abcx") for _ in range(n)) for n in (30, 31, 62, 63, 64, 500, 5000)]
    for w, g in zip(words, lattice.log_scores(words, t), strict=True):
        for k in range(2):      # plain sums in logarithms
            a = [0.0]
            for j in range(1, len(w) + 1):
                ends = [a[j - m] + math.log(prob(w[j - m:j], t, k)) for m in range(1, min(j, 12) + 1) if m == 1 or w[j - m:j] in PIECES]
                top = max(ends)
                a.append(top + math.log(sum(math.exp(x - top) for x in ends)))
            assert g[k] == pytest.approx(a[-1], rel=1e-10)


def test_all_letter_pieces_of_the_vocabulary_are_used():
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    want = [p for p in names if p == "▁" or p.replace("▁", "", 1 if p[0] == "▁" else 0).isalpha() and p == p.lower()]
    assert li.load_pieces(path) == want and li.Lattice(want).longest == max(map(len, want)) > 8
