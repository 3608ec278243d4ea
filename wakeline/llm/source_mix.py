"""Mixing sources to target weights by entropy balancing.

Each document gets the rate r in (0, cap) that is closest, in relative entropy to a base rate of 1, to leaving the corpus as
it is, under one token constraint a source: sum of r * size = target. The solution is r = cap / (1 + (cap - 1) exp(-lambda x))
with x = size / mean size, an exponential tilt held under the cap; lambda solves the convex dual by Newton steps (with
bisection where a step leaves the bracket), each step one aggregation over (source, size) counts. Rates are rounded to whole
copies in size order, so a source misses its target by less than one document, and a few single copies close what is left.

Null texts have size 0 and are taken 0 times; a null source is a source of its own, the last; empty tables give empty
results; repeated rows are rows of their own. Everything depends on values only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.common import durable, join_facts, row_keys, words

CAP = 3                  # most copies of a document
NEWTON_STEPS = 40        # bound of the iterations; they end when all constraints hold to TOLERANCE
TOLERANCE = 1e-9
REPAIRS = 4              # single copies moved for each source after rounding
SLICES = 256             # hash slices of the documents of one (source, size)


def source_key(source: str = "source") -> Column:
    """Never null; sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))


def source_targets(sources: DataFrame, weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """Add `target` to (skey, source_size): the weights repeat over the sources in order and share all sizes; a source
    stops at cap times its own size and the excess goes to the others by weight. In order of cap * size / weight the
    stopped sources come first, so one running sum over the table of sources finds them."""
    order = F.row_number().over(W.orderBy("skey")) - 1
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(order, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_w = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / open_w).withColumn("stopped", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("stopped"), F.col("level"))).over(every)   # levels fall after the first open source
    return s.withColumn("target", F.when(F.col("stopped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)).select(
        "skey", "source_size", "target")


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-F.greatest(F.lit(-600.0), F.least(F.lit(600.0), lam * x))))


def newton(counts: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """`lam` and `mean_size` of each source. counts: (skey, size, n), size > 0; targets: (skey, source_size, target)."""
    means = counts.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)      # only the cap itself reaches it
    state = durable(targets.join(means, "skey").select("skey", "target", "mean_size", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), full.alias("full")))
    for _ in range(steps):
        x = F.col("size") / F.col("mean_size")
        r = _rate(F.col("lam"), x, cap)
        sums = counts.join(state.filter(~F.col("full")), "skey").groupBy("skey").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * r * (1 - r / cap) * x).alias("slope"))
        s = state.join(sums, "skey", "left").withColumn("gap", F.when(F.col("full"), 0.0).otherwise((F.col("target") - F.col("got")) / F.col("target")))
        s = s.withColumns({"lo": F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") + F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        done = F.coalesce(F.abs("gap") < TOLERANCE, F.lit(True))
        s = s.withColumn("lam", F.when(done, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).withColumn("done", done)
        s = durable(s.select("skey", "target", "mean_size", "lam", "lo", "hi", "full", "done"))
        state = s.drop("done")
        if s.filter(~F.col("done")).isEmpty():
            break
    return state.select("skey", "mean_size", F.when(F.col("full"), F.lit(None)).otherwise(F.col("lam")).alias("lam"))


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """One row per document: k1, k2 (row keys), doc_id, size, source_size, target, rate, copies, taken."""
    rows = row_keys(docs.select("doc_id", "text", "source")).select(
        "k1", "k2", "doc_id", source_key().alias("skey"), F.size(words("text")).cast("long").alias("size"))
    # position inside (source, size) by hash: slices of a group are counted first, so no group is ordered in one task
    rows = durable(rows.withColumn("h", F.xxhash64("k1", "k2", F.lit(7))).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int")))
    sliced = durable(rows.groupBy("skey", "size", "slice").agg(F.count(F.lit(1)).alias("m")))
    counts = durable(sliced.groupBy("skey", "size").agg(F.sum("m").alias("n")))
    sources = durable(counts.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs")))
    targets = durable(source_targets(sources.drop("source_docs"), weights, cap))
    worded = counts.filter("size > 0")
    dual = newton(worded, targets.filter("target > 0"), cap)
    # whole copies of each (source, size), in size order: the running sum of rates, rounded
    by = W.partitionBy("skey").orderBy("size")
    g = worded.join(dual, "skey").withColumn("rate", F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean_size"), cap)))
    g = g.withColumn("run", F.floor(F.sum(F.col("n") * F.col("rate")).over(by.rowsBetween(W.unboundedPreceding, 0)) + 0.5 + 1e-9))
    g = durable(g.withColumn("copies_all", F.least(cap * F.col("n"), F.col("run") - F.coalesce(F.lag("run").over(by), F.lit(0)))).select("skey", "size", "n", "rate", "copies_all"))
    for _ in range(REPAIRS):        # move one copy of the size nearest to what a source still lacks or has too much
        gap = g.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies_all")).alias("got")).join(targets, "skey").withColumn("gap", F.col("target") - F.col("got"))
        fit = g.join(gap.select("skey", "gap"), "skey").filter(
            (F.col("size") < 2 * F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies_all") < cap * F.col("n")).otherwise(F.col("copies_all") > 0))
        best = fit.groupBy("skey").agg(F.min_by(F.struct("size", F.signum("gap").cast("long").alias("move")), F.struct(F.abs(F.col("size") - F.abs("gap")), "size")).alias("b"))
        best = best.select("skey", F.col("b.size").alias("size"), F.col("b.move").alias("move"))
        g = durable(g.join(best, ["skey", "size"], "left").withColumn("copies_all", F.col("copies_all") + F.coalesce("move", F.lit(0))).drop("move"))
    # who gets them: floor(copies / documents) each, and one more for the first in hash order
    before = W.partitionBy("skey", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    plan = sliced.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(g, ["skey", "size"], "left")
    spread = plan.select("skey", "size", "slice", "m", "before", "n", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("copies_all", F.lit(0)).alias("copies_all"))
    inside = F.row_number().over(W.partitionBy("skey", "size", "slice").orderBy("h", "k1", "k2"))
    out = rows.join(spread, ["skey", "size", "slice"]).withColumn("place", F.col("before") + inside)
    each = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.floor(F.col("copies_all") / F.col("n")) + F.when(
        F.col("place") <= F.col("copies_all") % F.col("n"), 1).otherwise(0))
    out = out.withColumn("copies", each.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    facts = durable(targets.join(sources.select("skey", "source_docs"), "skey"))
    return join_facts(out.select("skey", "k1", "k2", "doc_id", "size", "rate", "copies", "taken"), facts, "skey", "source_docs", ["k1", "k2"])


def materialise(docs: DataFrame, weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """The mixed corpus: each document's own columns, as many times as it was given copies.

    Rows of one (id, text, source) share the copies of their group: each gets the floor, and those that are first by a hash
    of the whole row one more, so a rerun gives the same rows. Equal rows are counted before they are dealt copies.
    """
    given = mix(docs, weights, cap).select("k1", "k2", "skey", "copies")
    whole = row_keys(docs.select("doc_id", "text", source_key().alias("skey"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    whole = whole.select("k1", "k2", "skey", "_row")
    if not _repeated(docs):
        copies = whole.join(given.filter("copies > 0").select("k1", "k2", F.col("copies").alias("_copies")), ["k1", "k2"])
    else:
        key = ["k1", "k2", "skey"]
        taken = given.groupBy(*key).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).filter("_all > 0")
        kinds = whole.withColumn("_h", F.xxhash64(F.to_json("_row"))).groupBy(*key, "_h").agg(F.count(F.lit(1)).alias("_n"), F.first("_row").alias("_row"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        dealt = kinds.withColumn("_before", before).join(taken, key)
        more = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_all") % F.col("_rows") - F.col("_before")))
        copies = dealt.withColumn("_copies", F.floor(F.col("_all") / F.col("_rows")) * F.col("_n") + more).filter("_copies > 0")
    return copies.select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row")).select("_row.*")


def _repeated(docs: DataFrame) -> bool:
    keys = row_keys(docs.select("doc_id", "text")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"))
    return not keys.filter("c > 1").isEmpty()
