"""Operators 2, 5, 7 and 10, the skew-safe join and the pipeline."""

import random
from collections import Counter, defaultdict

import public_tokenizers
from corpus_fixtures import awkward, empty, prose, with_hot_groups
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import bpe_transducer, language_id, quality_rules, source_mix, warc_index
from wakeline.llm.common import join_facts
from wakeline.llm.suffix_trees import split_words
from wakeline.session import durable

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_join_facts_spreads_hot_keys(spark):
    rows = spark.range(900).select((F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    facts = durable(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).filter("k <> 7"))
    want = sorted((tuple(r) for r in rows.join(facts.select("k", "s"), "k", "left").select("k", "id", "s").collect()), key=lambda r: r[1])
    for small in (1000, 0):
        got = join_facts(rows, facts, "k", "n", ["id"], small=small, heavy_share=4).select("k", "id", "s").collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert join_facts(rows, facts, "k", "n", ["id"], how="inner", small=0, heavy_share=4).count() == sum(r[2] is not None for r in want)


def test_loser_tree_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def captures(spark):
    rows = [(i, f"http://www.h{i % 4}.example.org/p{i % 3}?q={i}", 100 - i, "<p>" + "ab" * (i % 5 * 30) + "</p>") for i in range(40)]
    rows += [(50, None, None, None), (51, "http://[bad", 5, ""), (None, "http://x.y/", 7, rows[4][3]), (3, "http://h", 1, rows[3][3]), (3, "http://h", 1, rows[3][3])]
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, url string, ts long, payload string, k1 string"), rows


def test_archives_round_trip_in_global_order(spark, tmp_path):
    df, rows = captures(spark)
    folder = f"file://{tmp_path}/a"
    runs = warc_index.write_archives(df.repartition(5), folder)
    index = warc_index.merge_runs(runs, bucket_rows=7)
    order = [(r.urlkey, r.ts, r.id is None, r.id or 0) for r in sorted(index.collect(), key=lambda r: (r.bucket, r.place))]
    assert order == sorted(order) and len(order) == len(rows) and len({r.bucket for r in index.collect()}) > 2
    got = warc_index.read_archives(spark, folder).collect()
    first = {}
    for i, _, _, p in rows:
        if i is not None and len(p or "") >= 100:
            first[p] = min(first.get(p, i), i)
    want = Counter((i, len(p or ""), "revisit" if p in first and first[p] != i else "response", first[p] if p in first and first[p] != i else None) for i, _, _, p in rows)
    assert Counter((r.id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    assert warc_index.archive(df.limit(0)).count() == 0
    placed = warc_index.global_places(index).collect()                          # seven captures a bucket, one order over all of them
    assert sorted(r.place for r in placed) == list(range(len(placed)))
    keys = [(r.urlkey, r.ts, r.id is None, r.id or 0) for r in sorted(placed, key=lambda r: r.place)]
    assert keys == sorted(keys)


def test_language_held_out(spark):
    vocab = {"en": "the of and to in that with for this from have".split(), "de": "der die und nicht mit von das ist auch für".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang) for i in range(60) for lang in [("en", "de")[i % 2]]]
    rows += [(100, None, "en"), (101, "123 456 !", "de"), (None, "the of and", "en"), (102, "THE OF and", None), (103, "a" * 5000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {x.doc_id: x for x in language_id.identify(df, PIECES).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(60))
    assert (got[100].lang_pred, got[100].score) == ("und", 0.0) and got[101].lang_pred == "und"
    assert got[None].held_out is False and got[102].lang_pred == "en" and 0 <= got[103].score <= 1
    assert {i for i in range(60) if got[i].held_out} == {i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    assert language_id.identify(df.limit(0), PIECES).count() == 0
    assert {x.lang_pred for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}


def test_segmentations_are_summed():
    lattice = language_id.Lattice(["a", "b", "ab", "ba"])
    import numpy as np

    table = np.array([0.3, 0.2, 0.4, 0.1, 0.0, 1e-7])[:, None]
    assert abs(np.exp(lattice.log_scores(["aba"], table)[0, 0]) - (0.3 * 0.2 * 0.3 + 0.4 * 0.3 + 0.3 * 0.1)) < 1e-12
    counts = lattice.expected(["aba"], np.array([2.0]), table[:, 0])
    assert abs(counts @ np.array([1, 1, 2, 2, 0, 1]) - 6) < 1e-9       # every segmentation covers all letters


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        w = sum(weight[s] for s in rest)
        target = {s: weight[s] * (total - sum(stopped.values())) / w for s in rest}
        over = [s for s in rest if target[s] > cap * sizes[s]]
        if not over:
            return stopped | target
        stopped |= {s: cap * sizes[s] for s in over}


def test_mix_reaches_its_targets(spark):
    rows = [(i, prose(i, 20 + i % 60), ("big", "small", "tiny", None)[0 if i < 400 else 1 + i % 3]) for i in range(520)]
    rows += [(1000, None, "big"), (1001, "", "empty"), (1002, "one", "dot"), (None, "two words", "big"), (7, rows[7][1], "big"), (7, rows[7][1], "big")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, copies string")
    got = source_mix.mix(df)
    out = got.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(split_words(t))
    want = brute_targets(sizes)
    by = {(a.skey[1:] if a.skey[0] == "a" else None): a for a in got.groupBy("skey").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()}
    for s, w in want.items():
        assert abs(by[s].target - w) < 1e-6 * max(1, w) and by[s].size == sizes[s]
        assert abs(by[s].taken - w) <= max(5, 0.01 * w), s
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size and r.taken == r.copies * r["size"] for r in out)
    again = sorted((str(r.doc_id), r.taken) for r in source_mix.mix(df.repartition(7)).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in out)
    mixed = source_mix.materialise(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert source_mix.mix(df.limit(0)).count() == 0 and source_mix.materialise(df.limit(0)).count() == 0


def brute_stats(text):
    w = split_words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_equal_brute_force(spark):
    df = awkward(spark).unionByName(with_hot_groups(spark, 20)).unionByName(
        spark.createDataFrame([(70, "a b\n a b\na b\n\n#*$ %&|<> é", "en", "bad", 0, 7, "x", "y", "z"), (71, "x y z\x0bq " * 9, None, "bad", 0, 7, "x", "y", "z")], awkward(spark).schema))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(df).collect())
    want = Counter((r.doc_id, *(s := brute_stats(r.text)), s[0] < 10 or 100 * s[4] > 20 * s[0]) for r in df.collect())
    assert got == want


def test_bad_hosts_go_whole_and_clean_documents_stay(spark):
    rows = [(i, prose(i, 50), "good") for i in range(60)] + [(100 + i, "too short", "bad") for i in range(60)] + [(200, prose(200, 50), "bad"), (201, prose(201, 50), None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, _bad_host string")
    kept = {r.doc_id for r in quality_rules.judge(df).filter("kept").collect()}
    assert kept == set(range(60)) | {201}
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.filter_documents(df.limit(0)).count() == 0


def test_pipeline_stages_chain(spark, tmp_path):
    docs = with_hot_groups(spark, 25).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 0 in out and not any(i in out for i in range(1, 25))        # one of the copies
    assert sum(25 <= i < 50 for i in out) == 1                         # one of the near copies
    ids = out[0].ids
    text = docs.filter("doc_id = 0").first().text
    fst = bpe_transducer.TextEncoder(bpe_transducer.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    assert bytes(ids) == fst.encode_bytes(text)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_pipeline(spark, tmp_path):
    empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_of_equal_id_and_text(spark):
    """Rows that differ in source or in other columns only are all dealt copies, the same ones at every run."""
    rows = [(1, "a b c", s, "x") for s in ("s", "t", "u", "v")] + [(1, "a b c", "s", "y"), (1, "a b c", "s", "y"), (2, "d e f g", "t", None), (None, "a b c", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(5)
    given = Counter()
    for r in source_mix.mix(df).select("skey", "copies").collect():
        given[r.skey] += r.copies
    runs = [sorted(map(tuple, source_mix.materialise(df.repartition(n)).collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == sum(given.values())
    got = Counter(r[2] for r in runs[0])
    key = {r.source: r.skey for r in df.select("source", source_mix.source_key().alias("skey")).distinct().collect()}
    assert all(got[s] == given[k] for s, k in key.items())
