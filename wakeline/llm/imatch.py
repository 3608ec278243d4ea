"""I-Match fingerprints: terms in a band of inverse document frequency, sorted and hashed over randomised lexicon subsets.

The lexicon is every term that MIN_SHARE to MAX_SHARE of all documents hold. Randomised subsets are independent draws from it, in
levels of SUBSETS draws each: a draw of the first level holds one term in FIRST_SHARE, each level after it half as many, until a
draw holds about one term of the lexicon. A text's fingerprint is the hash of its sorted distinct terms in each subset that it
touches, so at every length there are levels whose subsets see only a few of a text's terms, and an edit leaves many of them
alone. The likeness of two fingerprints is the share of touched subsets on which they agree, over the levels where the two
touch at most half of the draws (all levels if there is none). A text whose terms are in no subset is fingerprinted by its
whole word sequence, so unrelated short texts do not meet.

DataFrame functions only. A document holds some number of distinct terms, so at most (mean of that number) / MIN_SHARE terms
reach the band, whatever the corpus size; the lexicon is counted and broadcast up to MAX_BROADCAST rows, joined by a shuffle
beyond. Null texts are empty; texts without a word all have the same fingerprint; null ids come last in descending order, ties
are ordered by text, repeated rows are neighbours. Very long texts are taken whole; an empty table gives no rows; columns beside
doc_id and text are not read, so their names may clash with those used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.common import durable, words

MIN_SHARE, MAX_SHARE = 0.002, 0.10   # of all documents: the inverse-document-frequency band
SUBSETS = 64                         # draws of a level
FIRST_SHARE = 64                     # a draw of the first level holds each term with probability 1 / FIRST_SHARE
WHOLE = 0xFFFF                       # slot of the whole-text hash of texts whose terms are in no subset
MAX_BROADCAST = 4_000_000            # rows (term, slot)


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, subsets: int = SUBSETS) -> DataFrame:
    """(term, slot), durable: 64-bit hashes of the terms in the band, counted over all documents, and the subsets that drew them
    (slot = level * subsets + draw). The number of levels follows the size of the band."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words("text"))).alias("w")).select(F.xxhash64("w").alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = durable(df.filter((F.col("df") >= max(2, min_share * n)) & (F.col("df") <= max_share * n)).select("term"))
    levels = 1 + max(0, (band.count() // FIRST_SHARE).bit_length())

    def drawn(level: int) -> Column:
        first, one_in = level * subsets, F.lit(FIRST_SHARE << level).cast("long")
        draws = F.sequence(F.lit(first).cast("long"), F.lit(first + subsets - 1).cast("long"))
        return F.filter(draws, lambda j: F.pmod(F.xxhash64("term", j), one_in) == 0)
    slots = band.select("term", F.explode(F.concat(*[drawn(v) for v in range(levels)])).alias("slot"))
    return durable(slots.select("term", F.col("slot").cast("int").alias("slot")))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(a: Column, b: Column, subsets: int = SUBSETS) -> Column:
    """Share of the touched subsets on which both agree, over the levels where they touch at most half of the draws."""
    def slots(x):
        return F.transform(x, lambda v: F.shiftright(v, 32))

    def level(slot):
        return F.floor(slot / F.lit(subsets))

    def agreed(x, y):
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(slots(x), slots(y)))

    def crowded(touched):
        each = F.array_distinct(F.transform(touched, level))
        return F.filter(each, lambda v: 2 * F.size(F.filter(touched, lambda s: level(s) == v)) > subsets)

    def sparse(x, full):
        return F.filter(x, lambda v: ~F.array_contains(full, level(F.shiftright(v, 32))))
    pair = _let(F.array_union(slots(a), slots(b)), lambda t: _let(crowded(t), lambda full: F.struct(
        sparse(a, full).alias("a"), sparse(b, full).alias("b"))))
    return _let(pair, lambda p: F.when(F.size(p["a"]) + F.size(p["b"]) > 0, agreed(p["a"], p["b"])).otherwise(agreed(a, b)))


def as_text(fingerprint: Column) -> Column:
    """Four hexadecimal digits of the subset and eight of its hash, subset after subset."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 12, "0")), ""))


def _sliced(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, t) in range buckets of doc_id; the row that follows a bucket in descending order comes
    along as its guest. There are four edges and heads a shuffle partition."""
    spark = docs.sparkSession
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))     # several a task, so that they even out
    edges = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    edges = sorted(set(edges))
    cut = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<bigint>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cut, lambda e: e <= F.col("doc_id")))))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    last_text = rows.filter("doc_id IS NULL").agg(F.max("t")).first()[0] if any(h["bucket"] == -1 for h in heads) else None
    heads = sorted(heads, key=lambda h: -h["bucket"])
    host = {h["bucket"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}      # the first row follows the last bucket
    table = [(h["head"], host[h["bucket"]]) for h in heads if h["head"] is not None]
    to = spark.createDataFrame(table, "doc_id long, host int")
    rows = rows.join(F.broadcast(to), "doc_id", "left")
    guest_of = F.col("host")
    if last_text is not None:
        guest_of = F.when(F.col("doc_id").isNull() & (F.col("t") == F.lit(last_text)), F.lit(host[-1])).otherwise(guest_of)
    places = F.when(guest_of.isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(guest_of.cast("int").alias("b"), F.lit(True).alias("g"))))
    return rows.withColumn("p", F.explode(places)).select(F.col("p.b").alias("bucket"), F.col("p.g").alias("guest"), "doc_id", "t")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (second half replaced by the beginning of the next document), and the
    likeness of the text to both. The texts are shuffled once; windows and aggregations stay inside the range buckets."""
    lex = lexicon(docs)
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("t").desc())
    rows = _sliced(docs).withColumns({"rid": F.row_number().over(order), "next": F.lead("t").over(order)})
    n = F.length("t").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n.cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "guest", "rid", "doc_id", "t", n.alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"))
    facts = F.struct("guest", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    # the text, the edited text and, in the first place, what is known of the row
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("t").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    texts = rows.select("bucket", "rid", facts.alias("facts"), sides.alias("s")).select("bucket", "rid", "s.side", "s.text", F.when(F.col("s.side") == 0, F.col("facts")).alias("facts"))
    prints = _with_facts(texts, lex)
    both = prints.groupBy("bucket", "rid").agg(
        F.max("facts").alias("f"), F.max(F.when(F.col("side") == 0, F.col("print"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("print"))).alias("e"))
    again = W.partitionBy("bucket").orderBy("rid")
    both = both.withColumn("next", F.lead("a").over(again)).filter(~F.col("f.guest"))
    return both.select("f.doc_id", "f.n_chars", "f.edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"))


def _with_facts(texts: DataFrame, lex: DataFrame) -> DataFrame:
    """`print` of (bucket, rid, side, text): sorted array of (slot << 32 | hash). One row of each text passes the join without
    a term; it carries the whole-text hash and `facts`. Rows partitioned by a key are not shuffled again."""
    keys = ["bucket", "rid", "side"]
    mark = F.array(F.lit(None).cast("string"))
    terms = texts.filter(F.col("text").isNotNull()).select(*keys, "facts", words("text").alias("_w"))
    terms = terms.select(*keys, "facts", F.xxhash64("_w").alias("_whole"), F.explode(F.concat(mark, F.col("_w"))).alias("_t"))
    is_mark = F.col("_t").isNull()
    terms = terms.select(*keys, F.when(is_mark, F.col("facts")).alias("facts"), F.when(is_mark, F.col("_whole")).alias("_whole"),
                         F.when(is_mark, F.lit(0)).otherwise(F.xxhash64("_t")).alias("term"), is_mark.alias("_mark"))
    marked = texts.sparkSession.range(1).select(F.lit(0).cast("long").alias("term"), F.lit(-1).alias("slot"), F.lit(True).alias("_mark"))
    drawn = lex.select("term", "slot", F.lit(False).alias("_mark")).unionByName(marked)
    hit = terms.join(F.broadcast(drawn) if lex.count() <= MAX_BROADCAST else drawn, ["term", "_mark"])
    per = hit.groupBy(*keys, "slot").agg(F.collect_set("term").alias("_terms"), F.max("_whole").alias("_whole"), F.max("facts").alias("facts"))
    low = F.lit(0xFFFFFFFF)
    h = F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(F.xxhash64(F.sort_array("_terms")).bitwiseAND(low))
    per = per.select(*keys, F.when(F.col("slot") >= 0, h).alias("_h"), "_whole", "facts")
    out = per.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("_got"), F.max("_whole").alias("_whole"), F.max("facts").alias("facts"))
    whole = F.shiftleft(F.lit(WHOLE).cast("long"), 32).bitwiseOR(F.col("_whole").bitwiseAND(low))
    return out.select(*keys, "facts", F.when(F.size("_got") > 0, F.col("_got")).otherwise(F.array(whole)).alias("print"))


def fingerprints(docs: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint of each document (one row a document; repeated rows give equal rows)."""
    lex = lexicon(docs) if lex is None else lex
    rows = docs.select(F.struct("doc_id").alias("facts"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("bucket"), F.xxhash64("text").alias("rid"), F.lit(0).alias("side"))
    copies = durable(rows.groupBy("bucket", "rid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    out = _with_facts(rows.dropDuplicates(["bucket", "rid"]) if not copies.isEmpty() else rows, lex)
    out = out.join(copies, ["bucket", "rid"], "left")
    return out.select("facts.doc_id", as_text(F.col("print")).alias("fingerprint"), F.explode(F.array_repeat(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))).alias("_i")).drop("_i")
