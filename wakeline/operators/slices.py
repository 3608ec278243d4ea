"""Ordered per-key calculations that survive one key holding much of the table.

A plain window over `partitionBy(key)` pulls the whole key into one task. Here each key is cut into slices along its
order (a time slice, a score bin); the window runs inside (key, slice), and one small summary row per slice carries the
neighbouring fix, the row offset and the running sums across slice borders. The summary has one row per (key, slice),
so its own window stays small; rows and summary share the hash partitioning on (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.session import broadcast_if_small, durable


def sliced(df: DataFrame, keys: list[str], order: list[str], slc: str, *, carry=(), prev: str | None = None,
           nxt: str | None = None, index: str | None = None, total: str | None = None,
           sums: dict[str, Column] | None = None) -> DataFrame:
    """Add any of: `prev` / `nxt` (struct of order + carry columns), 0-based `index`, key `total`,
    inclusive running `sums`. `slc` must be monotone in `order`; `order` must be unique within a key."""
    sums = sums or {}
    rec = F.struct(*order, *[c for c in carry if c not in order])
    named = [F.count(F.lit(1)).alias("_n")]
    if nxt:
        named.append(F.min(rec).alias("_first"))
    if prev:
        named.append(F.max(rec).alias("_last"))
    named += [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    edge = df.groupBy(*keys, slc).agg(*named)

    wk = W.partitionBy(*keys).orderBy(slc)
    before = wk.rowsBetween(W.unboundedPreceding, -1)
    cols = [*keys, slc]
    if prev:
        cols.append(F.lag("_last").over(wk).alias("_e_prev"))
    if nxt:
        cols.append(F.lead("_first").over(wk).alias("_e_next"))
    if index:
        cols.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_e_n0"))
    if total:
        cols.append(F.sum("_n").over(W.partitionBy(*keys)).alias(total))
    cols += [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_e_{n}") for n in sums]
    edge = edge.select(*cols)

    ws = W.partitionBy(*keys, slc).orderBy(*order)
    out = df.join(edge, [*keys, slc])
    if prev:
        out = out.withColumn(prev, F.coalesce(F.lag(rec).over(ws), F.col("_e_prev")))
    if nxt:
        out = out.withColumn(nxt, F.coalesce(F.lead(rec).over(ws), F.col("_e_next")))
    if index:
        out = out.withColumn(index, F.col("_e_n0") + F.row_number().over(ws) - 1)
    running = ws.rowsBetween(W.unboundedPreceding, W.currentRow)
    for n, e in sums.items():
        out = out.withColumn(n, F.col(f"_e_{n}") + F.coalesce(F.sum(e).over(running), F.lit(0)))
    return out.drop(*[c for c in out.columns if c.startswith("_e_")])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    bins: int = 64, few: int = 50_000) -> DataFrame:
    """Exact linear-interpolated quantiles per key without holding a crowded key's values in one buffer.

    Keys with at most `few` values sort them in one array; all others go through bins (`_binned_quantiles`).
    """
    rows = durable(df.filter(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")))
    crowded = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select(*keys))
    if crowded.isEmpty():
        return _sorted_quantiles(rows, keys, quantiles)
    rest = _sorted_quantiles(rows.join(broadcast_if_small(crowded), keys, "left_anti"), keys, quantiles)
    return rest.unionByName(_binned_quantiles(rows.join(broadcast_if_small(crowded), keys, "left_semi"), keys, quantiles, bins))


def _sorted_quantiles(rows: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    s = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    outs = []
    for name, q in quantiles.items():
        pos = (F.size("_s") - 1) * F.lit(float(q))
        lo, hi = F.get("_s", F.floor(pos).cast("int")), F.get("_s", F.ceil(pos).cast("int"))
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return s.select(*keys, *outs)


def _binned_quantiles(rows: DataFrame, keys: list[str], quantiles: dict[str, float], bins: int) -> DataFrame:
    """Equal values are first merged to counts (map-side), values fall into `bins` bins per key between approximate quantiles of
    the distinct values (so outliers do not empty the bins), a window over the at most `bins` bin counts finds where each
    needed rank lies, and only those bins are ordered value by value. The edges are a table, as approximate quantiles depend on the
    order in which parts arrive: computed once for the counts and once for the values, bins would not be the same.
    """
    counted = durable(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    span = durable(counted.groupBy(*keys).agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 20 * bins).alias("_edges"),
                                              F.sum("_c").alias("_n")))
    binned = counted.join(span, keys).withColumn("_b", F.size(F.filter("_edges", lambda e: e <= F.col("_v")))).drop("_edges")
    wk = W.partitionBy(*keys).orderBy("_b")
    b = (binned.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
         .withColumn("_b0", F.coalesce(F.sum("_bc").over(wk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    needs = []
    for name, q in quantiles.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        needs += [F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), fn(pos).cast("long").alias("rank"),
                           (pos - F.floor(pos)).alias("w"))
                  for side, fn in (("lo", F.floor), ("hi", F.ceil))]
    need = (b.select(*keys, "_b", "_b0", "_bc", F.explode(F.array(*needs)).alias("_q"))
            .filter((F.col("_q.rank") >= F.col("_b0")) & (F.col("_q.rank") < F.col("_b0") + F.col("_bc"))))
    hit = need.groupBy(*keys, "_b").agg(F.first("_b0").alias("_b0"), F.collect_list("_q").alias("_qs"))
    wb = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = (binned.select(*keys, "_b", "_v", "_c").join(hit, [*keys, "_b"])
               .withColumn("_end", F.col("_b0") + F.sum("_c").over(wb)))
    got = (ordered.withColumn("_m", F.filter("_qs", lambda s: (s["rank"] < F.col("_end"))
                                             & (s["rank"] >= F.col("_end") - F.col("_c"))))
           .select(*keys, "_v", F.explode("_m").alias("_q")))
    outs = []
    for name in quantiles:
        lo = F.max(F.when((F.col("_q.q") == name) & (F.col("_q.side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_q.q") == name) & (F.col("_q.side") == "hi"), F.col("_v")))
        w = F.max(F.when(F.col("_q.q") == name, F.col("_q.w")))
        outs.append((lo + (hi - lo) * w).alias(name))
    return got.groupBy(*keys).agg(*outs)
