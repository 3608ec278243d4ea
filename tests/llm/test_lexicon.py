"""Operator 11: the lexicon transducer against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import awkward, empty, with_hot_groups
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wakeline.llm import lexicon_transducer as lex

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return lex.Encoder(lex.vocabulary(PATH), None, 4)


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_merging_equals_the_library(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250))), "Σας ΟΔΟΣ İstanbul ﬁ K Å ³", "x" * 20_000 + " abc", "a\x1cb\x85c d",
    "Hello <|startoftext|> world<|endoftext|><|endoftext|> <|ENDOFTEXT|> don't I'LL we've", "<|endoftext|>", "é<|endoftext|>́", ""])
def test_unusual_texts(encoder, library, text):
    got = ids(encoder, text)
    assert got == library.encode(text, add_special_tokens=False).ids
    assert lex.decode(got, encoder.vocab.tokens) == library.decode(got, skip_special_tokens=False)


def test_transducer_holds_its_words_and_no_others():
    r = random.Random(1)
    words = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 7))): tuple(r.randrange(1, 5) for _ in range(r.randint(1, 4))) for _ in range(400)}
    words[b"a" * 300] = (7,)
    build = lex.Builder()
    for w in sorted(words):
        build.add(w, words[w])
    fst = lex.Automaton(np.frombuffer(build.finish(), np.uint8))
    ask = sorted(words) + [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 9))) for _ in range(800)]
    size = np.array([len(w) for w in ask])
    found, many, out = fst.walk(np.frombuffer(b"".join(ask), np.uint8), np.cumsum(size) - size, size)
    at = np.cumsum(many) - many
    for i, w in enumerate(ask):
        assert found[i] == (w in words)
        if found[i]:
            assert tuple(out[at[i]:at[i] + many[i]].tolist()) == words[w]
    with pytest.raises(ValueError):
        build.add(b"a", (1,))


def test_equal_suffixes_share_states():
    build = lex.Builder()
    for i, w in enumerate(sorted(a + b"alking" for a in (b"b", b"st", b"t", b"w"))):
        build.add(w, (100 + i, 5))
    build.finish()
    assert len(build.frozen) == 9       # root, "s", and one chain of seven


def test_round_trip_of_awkward_rows(spark, library):
    df = awkward(spark)
    want = []
    for r in df.collect():
        e = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(e, skip_special_tokens=False)
        want.append((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for share in (1e-6, 1e-3, 2.0):     # all words, some words, none
        assert sorted(map(tuple, lex.round_trip(df, PATH, share, 3).collect()), key=str) == sorted(want, key=str)
    assert lex.round_trip(empty(spark), PATH).count() == 0


def test_lexicon_spares_merging_of_frequent_words(spark):
    df = with_hot_groups(spark, 20)
    folder = lex.build_lexicon(df, PATH, 1e-6, 3)
    enc = lex.Encoder(lex.vocabulary(PATH), folder, 3)
    enc.encode([r.text for r in df.collect()])
    assert enc.unseen == 0
    encoded = lex.encode_documents(df, PATH, folder, 3)
    assert lex.decode_documents(encoded, PATH).count() == df.count()


def test_full_memory_of_merged_words_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(lex, "MAX_MERGED", 2)
    enc = lex.Encoder(lex.vocabulary(PATH), None, 2)
    for t in ("one two three four", "four five two", "one"):
        assert ids(enc, t) == library.encode(t, add_special_tokens=False).ids
