"""Operators 1 and 8: exact round trips, equality with the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus_fixtures import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wakeline.llm import bpe_transducer, token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.mark.parametrize("high", [1, 2, 255, 50257, 1 << 32, 1 << 60, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 239, 1024, 1025, 4000])
def test_simple8b_round_trip(n, high):
    r = np.random.default_rng(n)
    ids = r.integers(0, high, n, np.uint64, endpoint=True)
    ids[r.random(n) < 0.4] = 0
    words, index, escapes = token_files.encode_ids(ids)
    assert (token_files.decode_ids(words, index, escapes, n) == ids).all()
    assert len(index) == -(-n // token_files.BLOCK)
    if n > 1025 and high == 50257:
        assert len(words) * 8 < 3 * n


def test_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50257, 5000).astype(np.uint64)
    ids[2100] = (1 << 63) + 5
    words, index, escapes = token_files.encode_ids(ids)
    a, z = index[2, 0], index[3, 0]
    own = index[2:3] - [[a, index[2, 1]]]
    got = token_files.decode_ids(words[a:z], own, escapes[index[2, 1]:index[3, 1]], 1024)
    assert (got == ids[2048:3072]).all()


def test_token_files_of_awkward_rows(spark):
    df = awkward(spark)
    extra = spark.createDataFrame([(60, "a special <|endoftext|> in a text 漢字 \x1c x")], "doc_id long, text string")
    df = df.select("doc_id", "text").unionByName(extra)
    tok = Tokenizer.from_file(JSON)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.round_trip(df, JSON, PATTERN).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.round_trip(empty(spark), JSON, PATTERN).count() == 0


def test_full_piece_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_PIECES", 3)
    enc, tok = token_files._Pieces(JSON, PATTERN), Tokenizer.from_file(JSON)
    texts = ["one two three four five", "two five six", "one one seven"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pieces_go_to_the_library_many_at_once():
    enc, tok, r = token_files._Pieces(JSON, PATTERN), Tokenizer.from_file(JSON), random.Random(8)

    class Counting:
        texts = 0

        def encode_batch_fast(self, texts, **kw):
            self.texts += len(texts)
            return tok.encode_batch_fast(texts, **kw)
    enc.tok = Counting()
    letters = "abcdefghijklmnopqrstuvwxyzéüñÄ"
    texts = [" ".join("".join(r.choices(letters, k=r.randint(3, 12))) for _ in range(50)) for _ in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.known) > 2500 and enc.tok.texts < 100


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab '’s<|>endoftext\n\t\r\x0b\xa0\x85é7²½.-_ß", max_size=30), max_size=6))
def test_joined_pieces_equal_the_library(texts):
    enc, tok = token_files._pieces(JSON, PATTERN), Tokenizer.from_file(JSON)
    enc.known.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_that_join_to_a_special_token():
    enc, tok = token_files._Pieces(JSON, PATTERN), Tokenizer.from_file(JSON)
    pieces = ["<|", "endoftext", "|>", " <|", " endoftext", "s", "'s", "\n", "  ", " '", "'"]
    enc.learn(pieces)
    assert {p: np.frombuffer(enc.known[p], "<u4").tolist() for p in pieces} == {p: tok.encode(p, add_special_tokens=False).ids for p in pieces}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_transducer.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe_transducer.TextEncoder(bpe_transducer.load_ranks(RANKS), PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_transducer_equals_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_bounded_states_and_long_pieces(library):
    ranks = bpe_transducer.load_ranks(RANKS)
    small = bpe_transducer.TextEncoder(ranks, PATTERN, max_states=50, max_pieces=5)
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice("aeinorst") for _ in range(r.randint(1, 300)))
        assert small.encode(t) == library.encode_ordinary(t)
    assert small.fst.n_states <= 50 and len(small.known) <= 5


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(1, 7), min_size=1, max_size=9))
def test_utf8_machine_takes_any_cut(data, cuts):
    s, at, out, k = bpe_transducer.Utf8Stream(), 0, [], 0
    while at < len(data):
        n = cuts[k % len(cuts)]
        out.append(s.feed(data[at:at + n]))
        at, k = at + n, k + 1
    assert "".join(out) + s.end() == data.decode("utf-8", "replace")


def test_encode_and_decode_tables(spark, library):
    df = awkward(spark)
    texts = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    enc = bpe_transducer.encode_documents(df, RANKS, PATTERN)
    assert sorted(((r.doc_id, r.ids) for r in enc.collect()), key=str) == sorted(((i, library.encode_ordinary(t)) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.text) for r in bpe_transducer.decode_documents(enc, RANKS).collect()), key=str) == texts
    got = bpe_transducer.round_trip(df, RANKS, PATTERN, with_ids=True).collect()
    want = sorted(((i, hashlib.sha256(t.encode()).hexdigest(), len(t)) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.decoded_sha256, r.decoded_chars) for r in got), key=str) == want
    assert bpe_transducer.round_trip(empty(spark), RANKS, PATTERN).count() == 0
