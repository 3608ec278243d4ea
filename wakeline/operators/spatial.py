"""Range and as-of joins written as equi-joins on cell and time-slice keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.functions import geo
from wakeline.operators import blocks as bl
from wakeline.operators.slices import sliced
from wakeline.operators.tracks import legs
from wakeline.session import broadcast_if_small, durable, few_rows, shuffled

def salted_join(big: DataFrame, small: DataFrame, keys: list[str], max_broadcast_rows: int = 20_000,
                hot_rows: int = 20_000) -> DataFrame:
    """Inner equi-join for a side whose keys may be hot: broadcast the counted-small side, otherwise shuffle both. A key with
    over `hot_rows` rows on the big side is spread over as many tasks as it has that many rows; only its rows of the small
    side are repeated. The list of hot keys is `hot_rows` times shorter than the big side."""
    if few_rows(small, max_broadcast_rows):
        return big.join(F.broadcast(small), keys)
    n = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = durable(n.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_k")))
    if hot.isEmpty():
        return big.join(shuffled(small), keys)
    k = F.coalesce("_k", F.lit(1))
    b = big.join(broadcast_if_small(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys]), k).cast("int")).drop("_k")
    s = small.join(broadcast_if_small(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), k - 1))).drop("_k")
    return b.join(shuffled(s), [*keys, "_salt"]).drop("_salt")


def lat_lon_cells(lat, lon, reach_km, cell_deg: float = 1.0) -> Column:
    """Array of (cy, cx) cells touched by a disc; longitude cells wrap, near a pole the whole circle is taken."""
    lat, lon, reach = geo._c(lat), geo._c(lon), geo._c(reach_km)
    dlat = reach / 110.0 + 1e-6
    top = F.least(F.lit(90.0), F.abs(lat) + dlat)
    dlon = F.when(top >= 89.5, F.lit(180.0)).otherwise(
        F.least(F.lit(180.0), reach / (110.0 * F.cos(F.radians(top))) + 1e-6))
    n = int(360 / cell_deg)
    full = dlon >= 180.0 - cell_deg
    ys = F.sequence(F.floor((lat - dlat) / cell_deg), F.floor((lat + dlat) / cell_deg))
    xs = F.when(full, F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.floor((lon - dlon) / cell_deg), F.floor((lon + dlon) / cell_deg)),
                    lambda x: F.pmod(x, F.lit(n))))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def cell_of(lat, lon, cell_deg: float = 1.0) -> tuple[Column, Column]:
    n = int(360 / cell_deg)
    return F.floor(geo._c(lat) / cell_deg), F.pmod(F.floor(geo._c(lon) / cell_deg), F.lit(n))


def padded(incidents: DataFrame, radius_km: float = C.SEARCH_RADIUS_KM, pad_h: float = C.TIME_PAD_H) -> DataFrame:
    """Add the padded window and the reach to an incident table."""
    return (incidents.withColumn("p0_h", F.least("t0_h", "t1_h") - pad_h)
            .withColumn("p1_h", F.greatest("t0_h", "t1_h") + pad_h)
            .withColumn("reach_km", F.lit(radius_km) + F.coalesce("spread_km", F.lit(0.0))))


def _slices(a, b, slice_h) -> Column:
    return F.sequence(F.floor(geo._c(a) / slice_h), F.floor(geo._c(b) / slice_h))


def gate(fixes: DataFrame, incidents: DataFrame, *, radius_km: float = C.SEARCH_RADIUS_KM, pad_h: float = C.TIME_PAD_H,
         slice_h: float = C.SLICE_H, few: int = bl.FEW) -> DataFrame:
    """(incident, vessel) pairs with at least one fix in the padded window within reach of the origin.

    Vessels with up to `few` fixes are judged as whole tracks in blocks, all others fix by fix: no pair is shuffled but theirs."""
    if not few:
        return _gate_by_fix(fixes, incidents, radius_km, pad_h, slice_h)
    short, long_ = bl.by_length(fixes, few)
    out = bl.judged(short, incidents, radius_km=radius_km, pad_h=pad_h)
    return out if long_ is None else out.unionByName(_gate_by_fix(long_, incidents, radius_km, pad_h, slice_h))


def _gate_by_fix(fixes: DataFrame, incidents: DataFrame, radius_km: float, pad_h: float, slice_h: float) -> DataFrame:
    """The gate with a row a fix and near incident.

    Fixes carry one (cell, slice) key; an incident is spread over the cells of its reach and the slices of its window.
    Every near fix meets its incident in exactly one key, so the minimum needs no de-duplication.
    """
    inc = padded(incidents, radius_km, pad_h).select(
        "incident_id", "origin_lat", "origin_lon", "p0_h", "p1_h", "reach_km",
        F.explode(lat_lon_cells("origin_lat", "origin_lon", "reach_km")).alias("_c"))
    inc = inc.select("*", F.col("_c.cy").alias("_cy"), F.col("_c.cx").alias("_cx"),
                     F.explode(_slices("p0_h", "p1_h", slice_h)).alias("slice")).drop("_c")
    cy, cx = cell_of("lat", "lon")
    f = fixes.select("mmsi", "t_h", "lat", "lon", "slice", cy.alias("_cy"), cx.alias("_cx"))
    near = salted_join(f, inc, ["_cy", "_cx", "slice"]).filter(F.col("t_h").between(F.col("p0_h"), F.col("p1_h")))
    near = near.withColumn("_d", geo.haversine_km("lat", "lon", "origin_lat", "origin_lon"))
    return (near.filter(F.col("_d") <= F.col("reach_km")).groupBy("incident_id", "mmsi")
            .agg(F.min("_d").alias("min_km")))


def spans(fixes: DataFrame) -> DataFrame:
    """First and last fix per vessel, from one aggregate."""
    end = F.struct("t_h", "lat", "lon", "sog", "cog")
    return fixes.groupBy("mmsi").agg(F.min(end).alias("first"), F.max(end).alias("last"))


def gate_counts(fixes: DataFrame, incidents: DataFrame, kept: DataFrame, *, pad_h: float = C.TIME_PAD_H,
                slice_h: float = C.SLICE_H) -> DataFrame:
    """Per incident: vessels in, kept, rejected, and of those how many were not observed in the window at all.

    No far pair is listed: window edges and span ends are ranked together (running counts over time slices), and
    outside = spans that end before the window + spans that start after it.
    """
    inc = padded(incidents, 0.0, pad_h).select("incident_id", "p0_h", "p1_h")
    sp = spans(fixes)
    total = sp.agg(F.count(F.lit(1)).alias("n_input"))
    row = lambda df, end, v, kind, key: df.select(
        F.lit(end).alias("_end"), F.col(v).alias("_v"), F.lit(kind).alias("_kind"), F.col(key).cast("bigint").alias("_id"),
        F.floor(F.col(v) / slice_h).alias("_s"))
    # an edge sorts before equal span ends and after equal span starts: both comparisons are strict
    marks = (row(sp.select("mmsi", F.col("last.t_h").alias("v")), "last", "v", 1, "mmsi")
             .unionByName(row(inc, "last", "p0_h", 0, "incident_id"))
             .unionByName(row(sp.select("mmsi", F.col("first.t_h").alias("v")), "first", "v", 1, "mmsi"))
             .unionByName(row(inc, "first", "p1_h", 2, "incident_id")))
    ranked = sliced(marks, ["_end"], ["_v", "_kind", "_id"], "_s", sums={"_below": (F.col("_kind") == 1).cast("long")})
    edge = ranked.filter(F.col("_kind") != 1).groupBy(F.col("_id").alias("incident_id")).agg(
        F.max(F.when(F.col("_end") == "last", F.col("_below"))).alias("_l"),
        F.max(F.when(F.col("_end") == "first", F.col("_below"))).alias("_f"))
    n_kept = kept.groupBy("incident_id").agg(F.count(F.lit(1)).alias("_k"))
    k = F.coalesce(F.col("_k"), F.lit(0))
    return (edge.join(F.broadcast(total), F.lit(True))                    # total is one row
            .join(n_kept, "incident_id", "left")
            .select("incident_id", "n_input", k.alias("n_kept"), (F.col("n_input") - k).alias("n_rejected"),
                    (F.col("_l") + F.col("n_input") - F.col("_f")).alias("outside_window")))


def gate_reasons(candidates: DataFrame, fixes: DataFrame, incidents: DataFrame, *,
                 radius_km: float = C.SEARCH_RADIUS_KM, pad_h: float = C.TIME_PAD_H) -> DataFrame:
    """Gate verdict for named (incident, vessel) pairs: kept, outside_window, no_reports or too_far with its distance."""
    inc = padded(incidents, radius_km, pad_h).select("incident_id", "p0_h", "p1_h", "reach_km")
    sp = spans(fixes).select("mmsi", F.col("first.t_h").alias("_a"), F.col("last.t_h").alias("_b"))
    c = candidates.select("incident_id", "mmsi").distinct().join(inc, "incident_id").join(sp, "mmsi")
    out = (F.col("_b") < F.col("p0_h")) | (F.col("_a") > F.col("p1_h"))
    d = lambda e: geo.haversine_km(f"{e}_lat", f"{e}_lon", "origin_lat", "origin_lon")
    near = (pair_legs(c, fixes, incidents, radius_km=radius_km, pad_h=pad_h).groupBy("incident_id", "mmsi")
            .agg(F.min(F.least(F.when(F.col("a_in"), d("a")), F.when(F.col("b_in"), d("b")))).alias("min_km")))
    return (c.join(near, ["incident_id", "mmsi"], "left").select(
        "incident_id", "mmsi", F.when(out, "outside_window").when(F.col("min_km").isNull(), "no_reports")
        .when(F.col("min_km") > F.col("reach_km"), "too_far").otherwise("kept").alias("verdict"), "min_km"))


def pair_legs(pairs: DataFrame, fixes: DataFrame, incidents: DataFrame, *, radius_km: float = C.SEARCH_RADIUS_KM,
              pad_h: float = C.TIME_PAD_H, slice_h: float = C.SLICE_H) -> DataFrame:
    """Track legs with an end in the padded window, for each gated pair: equi-join on (mmsi, slice)."""
    inc = padded(incidents, radius_km, pad_h)
    p = pairs.select("incident_id", "mmsi").join(broadcast_if_small(inc), "incident_id").withColumn(
        "slice", F.explode(_slices("p0_h", "p1_h", slice_h))).withColumn("_s0", F.floor(F.col("p0_h") / slice_h))
    lg = legs(fixes.select("mmsi", "t_us", "t_h", "slice", "lat", "lon")).select(
        "mmsi", "t_us", F.col("t_h").alias("a_h"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
        F.col("nx.t_h").alias("b_h"), F.col("nx.lat").alias("b_lat"), F.col("nx.lon").alias("b_lon"),
        F.col("slice").alias("_l0"), F.explode(_slices("t_h", "nx.t_h", slice_h)).alias("slice"))
    j = lg.join(shuffled(p), ["mmsi", "slice"]).filter(F.col("slice") == F.greatest("_s0", "_l0"))   # meet once
    a_in, b_in = (F.col(c).between(F.col("p0_h"), F.col("p1_h")) for c in ("a_h", "b_h"))
    return (j.withColumn("a_in", a_in).withColumn("b_in", b_in).filter("a_in or b_in").drop("slice", "_s0", "_l0"))


def position_at(fixes: DataFrame, times: DataFrame, slice_h: float = C.SLICE_H) -> DataFrame:
    """Interpolating as-of join: add lat, lon, sog, cog at `t_h` of each row of `times` (mmsi, t_h, ...).

    Linear between fixes, clamped to the ends, course through unit vectors; legs are spread over the slices they cover,
    so each time meets exactly one leg under the key (mmsi, slice).
    """
    sp = spans(fixes)
    tq = F.least(F.greatest(F.col("t_h"), F.col("first.t_h")), F.col("last.t_h"))
    tm = times.join(sp, "mmsi").withColumn("_tq", tq)
    at_end = F.col("_tq") >= F.col("last.t_h")
    keep = times.columns
    end = tm.filter(at_end).select(*keep, *[F.col(f"last.{c}").alias(c) for c in ("lat", "lon", "sog", "cog")])
    lg = legs(fixes.select("mmsi", "t_us", "t_h", "slice", "lat", "lon", "sog", "cog"), "sog", "cog").select(
        F.col("mmsi"), F.col("t_h").alias("_a"), F.col("nx.t_h").alias("_b"),
        *[F.col(c).alias(f"_a_{c}") for c in ("lat", "lon", "sog", "cog")],
        *[F.col(f"nx.{c}").alias(f"_b_{c}") for c in ("lat", "lon", "sog", "cog")],
        F.explode(_slices("t_h", "nx.t_h", slice_h)).alias("_s"))
    mid = tm.filter(~at_end).withColumn("_s", F.floor(F.col("_tq") / slice_h))
    j = mid.join(shuffled(lg), ["mmsi", "_s"]).filter((F.col("_tq") >= F.col("_a")) & (F.col("_tq") < F.col("_b")))
    w = (F.col("_tq") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    lerp = lambda a, b: a + w * (b - a)
    lin = lambda c: lerp(F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(c)
    ra, rb = F.radians("_a_cog"), F.radians("_b_cog")
    cog = geo.wrap_360(F.degrees(F.atan2(lerp(F.sin(ra), F.sin(rb)), lerp(F.cos(ra), F.cos(rb))))).alias("cog")
    return j.select(*keep, lin("lat"), lin("lon"), lin("sog"), cog).unionByName(end)
