"""Host-level quality rules: failures per host, rates shrunk by an empirical beta prior, host verdicts joined back.

DataFrame functions only. Null and blank texts have no words (and so fail). Documents without a host get no host verdict.
Repeated rows are judged row by row; extra columns pass through `filter_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import WS, durable, join_facts, let, words

MIN_WORDS = 10           # fewer words fail
WINDOW = 5               # words in a repeated window
REPEAT_PCT = 20          # more words in repeated windows fail
SYMBOL_PCT = 10          # more symbols per 100 words fail
DUP_LINE_PCT = 30        # more lines equal to an earlier one fail
SYMBOLS = "#*$%&|<>"
MAX_HOST_RATE = 0.5      # shrunk failure rate beyond which a host is rejected
STRENGTH = (1.0, 1000.0)  # bounds of the prior's pseudo-documents
RULES = ("base", "symbols", "dup_lines")


def _size(a) -> Column:
    return F.size(a).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text: windows are sorted by their 64-bit hash,
    equal neighbours name the positions, and the sorted positions give the covered words; n log n per text."""
    def marked(s):
        twins = F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)),
                                    lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
        return F.sort_array(F.array_distinct(F.flatten(twins)))

    def covered(p):
        return F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)),
                                      lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                           F.lit(0), lambda acc, x: acc + x).cast("long")

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                        lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]).alias("h"), i.alias("i")))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.sort_array(grams), lambda s: let(marked(s), covered)))


def document_stats(docs: DataFrame) -> DataFrame:
    """Add the counts of each text and the flags of the document-level rules (one pass, no shuffle)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    counted = let(words(text), lambda w: F.struct(_size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(_size(x).alias("n_lines"), (_size(x) - _size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.withColumns({
        "_w": counted, "_l": lined,
        "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    out = out.withColumns({"n_words": F.col("_w.n_words"), "n_repeat_words": F.col("_w.n_repeat_words"),
                           "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")}).drop("_w", "_l")
    return out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words")),
        "symbols_failed": 100 * F.col("n_symbols") > SYMBOL_PCT * F.col("n_words"),
        "dup_lines_failed": 100 * F.col("n_dup_lines") > DUP_LINE_PCT * F.col("n_lines")})


def host_failures(stats: DataFrame, host: str = "source") -> DataFrame:
    """Documents and failures by rule of each host (combined before the shuffle, so a hot host is no burden)."""
    return stats.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_fails") for r in RULES])


def host_verdicts(failures: DataFrame) -> DataFrame:
    """Add shrunk rates and `host_rejected` to a (durable) table of `host_failures`.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' raw rates; its strength is kept
    inside STRENGTH, and is the upper bound where the rates do not vary. Two numbers a rule reach the driver.
    """
    raw = {r: F.col(f"{r}_fails") / F.col("host_docs") for r in RULES}
    prior = failures.agg(*[f(raw[r]).alias(f"{r}_{n}") for r in RULES for n, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    bad, out = F.lit(False), failures
    for r in RULES:
        m, v = prior[f"{r}_mean"] or 0.0, prior[f"{r}_var"] or 0.0
        s = min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]) if v > 1e-12 else STRENGTH[1]
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_fails") + m * s) / (F.col("host_docs") + s))
        bad = bad | (F.col(f"{r}_rate") > MAX_HOST_RATE)
    return out.withColumn("host_rejected", bad)


def judge(docs: DataFrame) -> DataFrame:
    """One slim row per document: the counts, `base_failed`, the host's rates, `host_rejected` and `kept`."""
    stats = durable(document_stats(docs.select("doc_id", "text", "source")).drop("text"))
    hosts = durable(host_verdicts(durable(host_failures(stats))).withColumn("_n", F.col("host_docs"))
                    .select("source", "_n", "host_docs", *[f"{r}_rate" for r in RULES], "host_rejected"))
    out = join_facts(stats, hosts, "source", "_n", ["doc_id", "n_words"])
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns: base rules row by row, then the documents of rejected hosts go."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    failures = durable(host_failures(document_stats(docs.select("text", "source"))))
    hosts = durable(host_verdicts(failures).filter("host_rejected").select("source", "host_docs", F.lit(True).alias("_bad_host")))
    kept = document_stats(whole).filter(~F.col("base_failed")).select("_row", "doc_id", "source", "n_words")
    if not hosts.isEmpty():
        kept = join_facts(kept, hosts, "source", "host_docs", ["doc_id", "n_words"]).filter(F.col("_bad_host").isNull())
    return kept.select("_row.*")
