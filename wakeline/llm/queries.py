"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import (
    bitslice_variants,
    bpe_transducer,
    imatch,
    jaccard_join,
    language_id,
    lexicon_transducer,
    quality_rules,
    source_mix,
    suffix_ranges,
    suffix_trees,
    token_alignment,
    token_files,
    warc_index,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op10_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g), range(5) AS t(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', '')) AS wc,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS b, 100 * n_symbols > 10 * n_words AS y,
        100 * n_dup_lines > 30 * n_lines AS p FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (b) AS fb, count(*) FILTER (y) AS fy, count(*) FILTER (p) AS fp
      FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(fb / n) AS mb, var_pop(fb / n) AS vb, avg(fy / n) AS my, var_pop(fy / n) AS vy, avg(fp / n) AS mp, var_pop(fp / n) AS vp FROM h),
k AS (SELECT *, CASE WHEN vb > 1e-12 THEN greatest(1, least(1000, mb * (1 - mb) / vb - 1)) ELSE 1000 END AS sb,
        CASE WHEN vy > 1e-12 THEN greatest(1, least(1000, my * (1 - my) / vy - 1)) ELSE 1000 END AS sy,
        CASE WHEN vp > 1e-12 THEN greatest(1, least(1000, mp * (1 - mp) / vp - 1)) ELSE 1000 END AS sp FROM m),
v AS (SELECT source, greatest((fb + mb * sb) / (n + sb), (fy + my * sy) / (n + sy), (fp + mp * sp) / (n + sp)) > 0.5 AS bad FROM h, k)
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, b AS base_failed, NOT b AND NOT coalesce(bad, false) AS kept
FROM f LEFT JOIN v USING (source)""")
def op10(spark, sf):
    return quality_rules.judge(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op8_bpe_transducer")
def op8(spark, sf):
    return bpe_transducer.round_trip(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op7_source_mix")
def op7(spark, sf):
    return source_mix.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@_query("op1_token_files")
def op1(spark, sf):
    return token_files.round_trip(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@_query("op5_language_id")
def op5(spark, sf):
    return language_id.identify(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op2_warc_index", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, trim(url) AS u FROM pages),
d AS (SELECT page_id, u, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
  string_split(regexp_replace(lower(regexp_extract(u, '^[^:/]+://([^/?#]*)', 1)), '^www\.', ''), '.') AS labels,
  regexp_extract(u, '^[^:/]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS args FROM d),
k AS (SELECT *, CASE WHEN coalesce(u, '') = '' THEN '' ELSE array_to_string(list_reverse(labels), ',') || ')' ||
  CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN args = '' THEN '' ELSE '?' || args END END AS urlkey, 1700000000 + page_id AS ts FROM f)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to,
  urlkey, ts, row_number() OVER (ORDER BY urlkey, ts, page_id) - 1 AS place
FROM k""")
def op2(spark, sf):
    pages = _table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), "url", (F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))).alias("ts"), F.col("html").alias("payload"))
    return warc_index.archive(pages).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "place")


@_query("op4_imatch")
def op4(spark, sf):
    return imatch.compare(_table(spark, sf, "documents"))


@_query("op6_suffix_ranges")
def op6(spark, sf):
    return suffix_ranges.remove_repeats(_table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op9_suffix_trees", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(20) AS t(j)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""")
def op9(spark, sf):
    return suffix_trees.removal_report(_table(spark, sf, "documents"))


@_query("op3_jaccard_join")
def op3(spark, sf):
    return jaccard_join.similarity_classes(_table(spark, sf, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


@_query("op11_lexicon_transducer")
def op11(spark, sf):
    return lexicon_transducer.round_trip(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op12_bitslice_variants")
def op12(spark, sf):
    return bitslice_variants.spelling_variants(_table(spark, sf, "documents"), min_chars=6, min_count=5, ratio=5, delete_every=199)


@_query("op13_token_alignment")
def op13(spark, sf):
    return token_alignment.alignment_report(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
