"""Operators 3 and 4: exact links and classes; fingerprints and edited texts."""

import hashlib
from collections import defaultdict

import pytest
import xxhash
from corpus_fixtures import awkward, empty, prose, sorted_rows, with_hot_groups

from wakeline.llm import imatch, jaccard_join
from wakeline.llm.suffix_trees import split_words


def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = split_words(t)
        sets.append((i, {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent, links = list(range(len(sets))), defaultdict(int)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and both * 5 >= 4 * (len(x) + len(y) - both):
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    members = defaultdict(list)
    for a in range(len(sets)):
        members[find(a)].append(sets[a][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return [(sets[a][0], least[find(a)], links[a]) for a in range(len(sets))]


@pytest.mark.parametrize("block,small", [(512, 64), (16, 64), (512, 2)])
def test_classes_equal_brute_force(spark, block, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    for df in (awkward(spark), with_hot_groups(spark, 40)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = sorted((x for x in brute_classes(rows) if x[0] is not None), key=str)
        got = jaccard_join.similarity_classes(df, block=block).filter("doc_id IS NOT NULL").select("doc_id", "class_id", "n_links")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_one_of_each_class_stays(spark):
    df = awkward(spark)
    out = jaccard_join.keep_one_of_each_class(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert ids.count(40) == 0 or ids.count(40) == 1
    assert 3 in ids and 20 not in ids and 24 in ids and 25 in ids
    assert jaccard_join.keep_one_of_each_class(empty(spark)).count() == 0


def test_pruning_bounds():
    need = jaccard_join.least_matches(0.8)
    assert len(need) == jaccard_join.HASHES // jaccard_join.STEP and need == sorted(need)
    assert all(n < 0.8 * jaccard_join.STEP * (i + 1) for i, n in enumerate(need))     # a pair at the threshold is not dropped for its mean
    assert need[-1] > 0.45 * jaccard_join.HASHES


def test_imatch_edited_texts_and_likeness(spark):
    df = awkward(spark)
    got = sorted_rows(imatch.compare(df), "doc_id", "n_chars", "edited_sha256")
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()), reverse=True)
    want = []
    for k, (i, t) in enumerate(rows):
        follow, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + follow[:half]).encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    full = imatch.compare(with_hot_groups(spark, 30)).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in full)
    prints = {r.doc_id: r.fingerprint for r in full}
    assert len({prints[i] for i in range(30)}) == 1                     # equal texts, equal fingerprints
    assert all(r.near_next == 1 for r in full if 1 <= r.doc_id < 30)


def test_imatch_small_tables(spark):
    assert imatch.compare(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "one small text of a few words")], "doc_id long, text string")
    r = imatch.compare(one).first()
    assert r.near_next == 1.0 and r.near_edited < 1.0
    assert imatch.fingerprints(awkward(spark)).count() == awkward(spark).count()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash64(values, seed=42):
    """64-bit hash of a list of byte strings or longs, each seeded with the hash before it."""
    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return signed(seed)


def brute_prints(texts, terms_of=None):
    """Fingerprints {slot: 32-bit hash} by plain loops; the lexicon is counted over `texts`."""
    df = defaultdict(int)
    for t in texts:
        for w in set(split_words(t)):
            df[w] += 1
    band = [hash64([w]) for w, n in df.items() if max(2, imatch.MIN_SHARE * len(texts)) <= n <= imatch.MAX_SHARE * len(texts)]
    levels = 1 + (len(band) // imatch.FIRST_SHARE).bit_length()
    drawn = {h: [j for j in range(levels * imatch.SUBSETS) if hash64([h, j]) % (imatch.FIRST_SHARE << (j // imatch.SUBSETS)) == 0] for h in band}

    def one(text):
        got = defaultdict(set)
        for w in split_words(text):
            for j in drawn.get(hash64([w]), []):
                got[j].add(hash64([w]))
        out = {j: hash64(sorted(s)) & 0xFFFFFFFF for j, s in got.items()}
        return out or {imatch.WHOLE: hash64(split_words(text)) & 0xFFFFFFFF}
    return one


def brute_likeness(a, b):
    touched = set(a) | set(b)
    per = defaultdict(int)
    for s in touched:
        per[s // imatch.SUBSETS] += 1
    use = {s for s in touched if 2 * per[s // imatch.SUBSETS] <= imatch.SUBSETS} or touched
    return sum(a.get(s) == b.get(s) for s in use) / len(use)


def test_imatch_equals_brute_force(spark):
    texts = [prose(i, 30 + 60 * (i % 7), 3000) for i in range(60)] + ["", "solitary", prose(1, 90, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = brute_prints(texts)
    got = {r.doc_id: r for r in imatch.compare(df).collect()}
    for i, t in enumerate(texts):
        follow = texts[i - 1]
        half = len(t) // 2
        a, e, n = one(t), one(t[:len(t) - half] + follow[:half]), one(follow)
        assert got[i].fingerprint == "".join(f"{s:04x}{h:08x}" for s, h in sorted(a.items())), i
        assert got[i].edited_fingerprint == "".join(f"{s:04x}{h:08x}" for s, h in sorted(e.items())), i
        assert got[i].near_edited == pytest.approx(brute_likeness(a, e)) and got[i].near_next == pytest.approx(brute_likeness(a, n)), i


@pytest.mark.parametrize("n_words", [150, 1500, 12000])
def test_imatch_half_kept_texts_are_nearer_than_the_next(spark, n_words):
    texts = [prose(500 + i, n_words, 40 * n_words) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = imatch.compare(df).collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 38
    assert sum(r.near_edited for r in got) / len(got) > 0.1
