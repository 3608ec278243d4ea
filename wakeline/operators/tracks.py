"""Track reconstruction and per-vessel calculations over the long table `track_fix`.

`track_fix` has one row per surviving fix: mmsi, t_us (epoch microseconds), t_h (hours on the analysis axis), slice,
lat, lon, sog, cog, heading, rot and the identity readings. Nothing here windows over a bare mmsi.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.functions import geo
from wakeline.functions.kernels import walk
from wakeline.functions.labels import nav_label, type_group, with_flag
from wakeline.operators.slices import sliced
from wakeline.session import broadcast_if_small, durable, shuffled

FIX = ["mmsi", "t_us", "t_h", "lat", "lon", "sog", "cog", "heading", "rot"]
IDENTITY = ["nav_status", "vessel_type", "name", "flag", "imo", "callsign", "length", "width", "draft"]


def time_axis(clean: DataFrame, reference_us: int, slice_h: float = C.SLICE_H) -> DataFrame:
    """Cleaned pings on the hour axis of a reference instant; null speed, course and turn rate become 0."""
    t_us = F.unix_micros("ts")
    t_h = (t_us - F.lit(reference_us)) / 3.6e9
    null = lambda c: F.lit(None).cast("string").alias(c)
    zero = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) if c in clean.columns else F.lit(0.0)).alias(c)
    return clean.select(
        "mmsi", t_us.alias("t_us"), t_h.alias("t_h"), F.floor(t_h / slice_h).alias("slice"), "seq",
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), zero("sog"), zero("cog"),
        "heading" if "heading" in clean.columns else F.lit(None).cast("double").alias("heading"), zero("rot"),
        *[F.col(c) if c in clean.columns else null(c) for c in IDENTITY])


def strict_time(fixes: DataFrame) -> DataFrame:
    """One fix per vessel and instant (the first in input order): the rest are out of time order.

    Same rows as a `lag(t) < t` window after a stable sort, but as an aggregate keyed by (mmsi, instant).
    """
    rest = [c for c in fixes.columns if c not in ("mmsi", "t_us", "seq")]
    return (fixes.groupBy("mmsi", "t_us").agg(F.min_by(F.struct("seq", *rest), "seq").alias("r"))
            .select("mmsi", "t_us", "r.*").select(*fixes.columns))


def min_points(fixes: DataFrame, n: int = C.MIN_TRACK_POINTS, most: int = 1_000_000) -> DataFrame:
    """Vessels with fewer than n fixes are dropped; counts come from an aggregate, not a window over the vessel.

    Up to `most` vessels (eight bytes each) go to the fixes; beyond, the fixes are shuffled by vessel."""
    enough = fixes.groupBy("mmsi").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("mmsi")
    return fixes.join(broadcast_if_small(enough, most), "mmsi", "left_semi")


_FOLD = "last struct<t_us:bigint,t_h:double,lat:double,lon:double>, kept array<bigint>"


def _fold_udf(max_kn: float):
    """Arrow-batched fold: one row per block in, last kept fix and kept instants out."""
    @F.pandas_udf(_FOLD)
    def fold(t_us: pd.Series, t: pd.Series, lat: pd.Series, lon: pd.Series, entry: pd.DataFrame) -> pd.DataFrame:
        last, kept = [], []
        for u, a, b, c, e0, e1, e2, e3 in zip(t_us, t, lat, lon, entry["t_us"], entry["t_h"], entry["lat"], entry["lon"]):
            e = None if pd.isna(e0) else (e1, e2, e3)
            k = walk(np.asarray(a), np.asarray(b), np.asarray(c), e, max_kn)
            ix = np.flatnonzero(k)
            kept.append(np.asarray(u)[ix])
            last.append((int(u[ix[-1]]), a[ix[-1]], b[ix[-1]], c[ix[-1]]) if ix.size else (int(e0), e1, e2, e3))
        return pd.DataFrame({"last": [dict(zip(("t_us", "t_h", "lat", "lon"), x)) for x in last], "kept": kept})
    return fold


def drop_fast(fixes: DataFrame, max_kn: float = C.MAX_SOG_KN, block: int = C.FOLD_BLOCK,
              max_passes: int | None = None) -> DataFrame:
    """Greedy speed filter: a fix stays if reachable from the last *kept* fix at `max_kn`.

    The rule is a fold, so each vessel is cut into blocks of `block` fixes. Every pass folds all blocks at once, each
    from the last kept fix that the block before it reported; passes repeat until no block's entry changes. Block i is
    right after pass i at the latest and in practice after two, because two folds agree from the first fix that both
    keep. Each pass is a durable checkpoint of one row per block.
    """
    ordered = sliced(fixes, ["mmsi"], ["t_us"], "slice", index="_i").withColumn(
        "_blk", F.floor(F.col("_i") / block))
    packed = ordered.groupBy("mmsi", "_blk").agg(
        F.sort_array(F.collect_list(F.struct("t_us", "t_h", "lat", "lon"))).alias("_f"))
    blocks = durable(packed.select("mmsi", "_blk", *[F.col(f"_f.{c}").alias(f"_{c}") for c in ("t_us", "t_h", "lat", "lon")]))
    fold = _fold_udf(max_kn)
    pt = "struct<t_us:bigint,t_h:double,lat:double,lon:double>"
    wk = W.partitionBy("mmsi").orderBy("_blk")
    state = blocks.select("mmsi", "_blk", F.lit(None).cast(pt).alias("_in"))
    n_pass = 0
    while True:
        folded = blocks.join(broadcast_if_small(state, 20_000), ["mmsi", "_blk"]).select(
            "mmsi", "_blk", "_in", fold("_t_us", "_t_h", "_lat", "_lon", "_in").alias("_r"))
        out = durable(folded.select("mmsi", "_blk", "_in", F.col("_r.last").alias("_out"), F.col("_r.kept").alias("_kept")))
        nxt = out.select("mmsi", "_blk", F.lag("_out").over(wk).alias("_new"), F.col("_in"))
        n_pass += 1
        if nxt.filter(~F.col("_new").eqNullSafe(F.col("_in"))).isEmpty():
            break
        if max_passes is not None and n_pass >= max_passes:
            raise RuntimeError(f"speed filter needs more than {max_passes} passes")
        state = nxt.select("mmsi", "_blk", F.col("_new").alias("_in"))
    kept = out.select("mmsi", F.explode("_kept").alias("t_us"))
    return fixes.join(shuffled(kept), ["mmsi", "t_us"])


def build_tracks(clean: DataFrame, reference_us: int, *, points: int = C.MIN_TRACK_POINTS,
                 max_kn: float = C.MAX_SOG_KN, slice_h: float = C.SLICE_H) -> DataFrame:
    """Usable pings -> `track_fix`. The first shuffle (one fix per vessel and instant) also merges exact copies, so the
    input needs no de-duplication of its own; its result is written once and read by every later step. The last step shuffles by
    vessel, so that readers find a vessel's fixes together and their sums by vessel start small."""
    base = durable(strict_time(time_axis(clean, reference_us, slice_h)))
    return min_points(durable(drop_fast(min_points(base, points), max_kn)), points, most=0)


# -- neighbours -------------------------------------------------------------------------------------------------------
def legs(fixes: DataFrame, *carry: str) -> DataFrame:
    """Consecutive fix pairs: the fix plus `nx` (struct of the next one); the last fix of a vessel has none."""
    out = sliced(fixes, ["mmsi"], ["t_us"], "slice", nxt="nx", carry=("t_h", "lat", "lon", *carry))
    return out.filter(F.col("nx").isNotNull())


def gaps(fixes: DataFrame, minutes: float = C.GAP_FLAG_MIN) -> DataFrame:
    """Silences longer than `minutes`."""
    dt = (F.col("nx.t_h") - F.col("t_h")) * 60.0
    return legs(fixes.select("mmsi", "t_us", "t_h", "slice", "lat", "lon")).select(
        "mmsi", F.col("t_h").alias("start_h"), F.col("nx.t_h").alias("end_h"), dt.alias("minutes")
    ).filter(F.col("minutes") > minutes)


def segments(fixes: DataFrame, split_min: float = C.GAP_SPLIT_MIN) -> DataFrame:
    """Segment number per fix: a new one after a silence longer than `split_min` (two window steps, both sliced)."""
    p = sliced(fixes, ["mmsi"], ["t_us"], "slice", prev="_p", carry=("t_h",))
    brk = F.when((F.col("t_h") - F.col("_p.t_h")) * 60.0 > split_min, 1).otherwise(0)
    marked = p.withColumn("_brk", brk).drop("_p")
    return sliced(marked, ["mmsi"], ["t_us"], "slice", sums={"segment": F.col("_brk")}, index="fix_index").drop("_brk")


def loitering(fixes: DataFrame, speed_kn: float = C.LOITER_KN, minutes: float = C.LOITER_MIN) -> DataFrame:
    """Maximal runs below `speed_kn` lasting at least `minutes`. The island number is the running count of fast fixes."""
    slow = F.col("sog") < speed_kn
    isl = sliced(fixes.select("mmsi", "t_us", "t_h", "slice", "sog"), ["mmsi"], ["t_us"], "slice",
                 sums={"_isl": F.when(slow, 0).otherwise(1)}).filter(slow)
    return (isl.groupBy("mmsi", "_isl")
            .agg(F.min("t_h").alias("start_h"), F.max("t_h").alias("end_h"), F.avg("sog").alias("mean_sog_kn"),
                 F.count(F.lit(1)).alias("n_fixes"))
            .withColumn("minutes", (F.col("end_h") - F.col("start_h")) * 60.0)
            .filter(F.col("minutes") >= minutes).drop("_isl"))


def diff_features(fixes: DataFrame) -> DataFrame:
    """Five first differences per vessel by time (first = 0); the course difference is wrapped to +-180."""
    src = fixes.select("mmsi", "t_us", "t_h", "slice", "lat", "lon", F.col("sog").alias("speed"),
                       F.col("cog").alias("course"), "rot")
    p = sliced(src, ["mmsi"], ["t_us"], "slice", prev="_p", carry=("lat", "lon", "speed", "course", "rot"))
    d = lambda c: F.coalesce(F.col(c) - F.col(f"_p.{c}"), F.lit(0.0))
    return (p.withColumn("course_diff", F.pmod(d("course") + 180.0, F.lit(360.0)) - 180.0)
            .withColumn("rot_diff", d("rot")).withColumn("speed_diff", d("speed"))
            .withColumn("lat_diff", d("lat")).withColumn("long_diff", d("lon")).drop("_p"))


def identity(fixes: DataFrame) -> DataFrame:
    """One row per vessel from its last surviving fix; the flag falls back to the MMSI prefix."""
    last = fixes.groupBy("mmsi").agg(F.max_by(F.struct(*IDENTITY), "t_us").alias("r")).select("mmsi", "r.*")
    named = with_flag(last.withColumnRenamed("flag", "_given"))
    text = lambda c, d: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")), F.lit(d))
    whole = lambda c: F.col(c).try_cast("double").try_cast("bigint")
    return named.select(
        "mmsi", text("name", "UNKNOWN").alias("name"),
        F.coalesce(F.when(F.trim("_given") != "", F.col("_given")), F.col("flag")).alias("flag"),
        type_group("vessel_type").alias("vessel_type"),
        F.when(whole("nav_status").isNotNull(), nav_label(whole("nav_status"))).alias("nav_status"),
        F.when(whole("imo") != 0, whole("imo")).alias("imo"), text("callsign", "").alias("callsign"),
        F.col("length").try_cast("double").alias("length_m"), F.col("width").try_cast("double").alias("width_m"))


def ping_features(fixes: DataFrame) -> DataFrame:
    """Eleven model inputs per fix; message type and accuracy are constants, status is the vessel's last one."""
    need = {"sog", "cog", "rot", "nav_status"} - set(fixes.columns)
    if need:
        raise KeyError(f"missing model features: {sorted(need)}")
    last = fixes.groupBy("mmsi").agg(F.max_by("nav_status", "t_us").try_cast("double").try_cast("int").alias("_st"))
    return (diff_features(fixes).join(last, "mmsi")
            .withColumn("msg_type", F.lit(1.0)).withColumn("accuracy", F.lit(1.0))
            .withColumn("status", F.coalesce("_st", F.lit(0)).cast("double")).drop("_st"))


# -- predicates -------------------------------------------------------------------------------------------------------
def covers(fixes: DataFrame, times: DataFrame, pad_h: float = 0.0) -> DataFrame:
    """`times` (mmsi, t_h) with a `covered` flag: inside the vessel's observed span, padded."""
    span = fixes.groupBy("mmsi").agg(F.min("t_h").alias("_a"), F.max("t_h").alias("_b"))
    return times.join(span, "mmsi", "left").withColumn("covered", F.coalesce(
        F.col("t_h").between(F.col("_a") - pad_h, F.col("_b") + pad_h), F.lit(False))).drop("_a", "_b")


def in_gap(gap: DataFrame, times: DataFrame, slice_h: float = C.SLICE_H) -> DataFrame:
    """Times that fall inside a flagged silence: semi join on (mmsi, slice) with the silence spread over its slices."""
    g = gap.select("mmsi", "start_h", "end_h", F.explode(F.sequence(
        F.floor(F.col("start_h") / slice_h), F.floor(F.col("end_h") / slice_h))).alias("slice"))
    t = times.withColumn("slice", F.floor(F.col("t_h") / slice_h))
    cond = ((t["mmsi"] == g["mmsi"]) & (t["slice"] == g["slice"])
            & (t["t_h"] >= g["start_h"]) & (t["t_h"] <= g["end_h"]))
    return t.join(g, cond, "left_semi").drop("slice")


def fixes_between(fixes: DataFrame, t0: float, t1: float, slice_h: float = C.SLICE_H) -> DataFrame:
    s0, s1 = int(t0 // slice_h), int(t1 // slice_h)
    return fixes.filter(F.col("slice").between(s0, s1) & F.col("t_h").between(t0, t1))


# -- summaries --------------------------------------------------------------------------------------------------------
def track_summary(fixes: DataFrame, flag_min: float = C.GAP_FLAG_MIN, split_min: float = C.GAP_SPLIT_MIN) -> DataFrame:
    """Points, span, box, gap and segment counts, mean positive speed: one pass over legs and one aggregate."""
    p = sliced(fixes, ["mmsi"], ["t_us"], "slice", prev="_p", carry=("t_h",))
    dt = (F.col("t_h") - F.col("_p.t_h")) * 60.0
    n_if = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return p.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("t_h").alias("first_seen_h"), F.max("t_h").alias("last_seen_h"),
        (F.max("t_h") - F.min("t_h")).alias("duration_h"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
        (n_if(dt > split_min) + 1).alias("n_segments"), n_if(dt > flag_min).alias("n_gaps"),
        F.coalesce(F.avg(F.when(F.col("sog") > 0, F.col("sog"))), F.lit(0.0)).alias("mean_sog_kn"))


def removal_counts(before: DataFrame, strict: DataFrame, after: DataFrame) -> DataFrame:
    """Per vessel: fixes lost to time order and to impossible speed."""
    n = lambda df, name: df.groupBy("mmsi").agg(F.count(F.lit(1)).alias(name))
    return (n(before, "_a").join(n(strict, "_b"), "mmsi").join(n(after, "_c"), "mmsi")
            .select("mmsi", (F.col("_a") - F.col("_b")).alias("out_of_time_order"),
                    (F.col("_b") - F.col("_c")).alias("impossible_speed")))


def dark_overlap(gap: DataFrame, t0: Column, t1: Column, minutes: float = C.GAP_FLAG_MIN) -> Column:
    """Hours of a silence inside a window; ends are rounded to 3 decimals as in the published method."""
    return F.greatest(F.lit(0.0), F.least(F.round("end_h", 3), t1) - F.greatest(F.round("start_h", 3), t0))


def track_metrics(fixes: DataFrame, t0: float, t1: float) -> DataFrame:
    """Speed range, mean positive speed, arithmetic mean course, longest silence inside the window."""
    base = fixes.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("sog").alias("sog_min_kn"), F.max("sog").alias("sog_max_kn"),
        F.coalesce(F.avg(F.when(F.col("sog") > 0, F.col("sog"))), F.lit(0.0)).alias("sog_mean_kn"),
        F.avg("cog").alias("mean_heading_deg"), geo.circular_mean("cog").alias("circular_heading_deg"))
    g = gaps(fixes)
    dark = g.groupBy("mmsi").agg((F.max(dark_overlap(g, F.lit(t0), F.lit(t1))) * 60.0).alias("_d"),
                                 F.count(F.lit(1)).alias("_g"))
    return (base.join(dark, "mmsi", "left").withColumn("longest_dark_min", F.coalesce("_d", F.lit(0.0)))
            .withColumn("n_gaps", F.coalesce("_g", F.lit(0))).drop("_d", "_g"))


def decimate(df: DataFrame, keys: list[str], order: list[str], slc: str, k: int) -> DataFrame:
    """Even thinning to at most k rows per key: rows at int(linspace(0, n-1, min(k, n)))."""
    d = sliced(df, keys, order, slc, index="_i", total="_n")
    i, n = F.col("_i"), F.col("_n")
    m = F.least(n, F.lit(k))
    step = (n - 1) / F.greatest(m - 1, F.lit(1))
    j = F.ceil(i / step)                        # the first sample at or after row i; kept if it truncates to i
    near = lambda jj: (jj >= 0) & (jj < m) & (F.when(jj == m - 1, n - 1).otherwise(F.floor(jj * step)) == i)
    keep = (n <= k) | near(j - 1) | near(j) | near(j + 1)
    return d.filter(F.when(m <= 1, i == 0).otherwise(keep)).drop("_i", "_n")
