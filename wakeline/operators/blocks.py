"""Incidents and vessels judged inside tasks: blocks of vessels, each with its whole track, meet blocks of incidents.

No fix-incident or leg-incident pair becomes a row; what leaves a task is one row per gated pair. Tracks of more than `FEW` fixes
do not fit a block and go fix by fix (`spatial`, `evidence`), with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline import config as C
from wakeline.functions import geo
from wakeline.functions.kernels import Cases, approach, near_cases, series
from wakeline.session import broadcast_if_small, durable, few_rows, shuffled

FEW = 2048                  # fixes of a track up to which it goes through a block
VESSELS, INCIDENTS = 64, 512
UNIT = 8                    # blocks of vessels that share a task unit
REACHES = ((100.0, 1.0), (1000.0, 10.0), (None, 60.0))      # reach in km up to which cells have this many degrees
CELL = ["_cl", "_cy", "_cx"]
OWN = ["origin_lat", "origin_lon", "centroid_lat", "centroid_lon", "axis_deg", "prior_lo_h", "prior_hi_h"]
APPROACH = ["cpa_km", "cpa_time_h", "cpa_lat", "cpa_lon", "_in_h", "_ft", "_fla", "_flo", "_lt", "_lla", "_llo", "_mla", "_mlo", "dark_min"]
SERIES = ["_bt", "_bd", "_bo", "_mean"]


def by_length(fixes: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """Fixes of the vessels whose track fits a block, and those of all others (None if there are none)."""
    n = fixes.groupBy("mmsi").agg(F.count(F.lit(1)).alias("_n"))
    crowded = durable(n.filter(F.col("_n") > few).select("mmsi"))
    if crowded.isEmpty():
        return fixes, None
    pick = lambda how: fixes.join(broadcast_if_small(crowded), "mmsi", how)
    return pick("left_anti"), pick("left_semi")


def _reach_class() -> F.Column:
    c = F.lit(len(REACHES) - 1)
    for k in range(len(REACHES) - 2, -1, -1):
        c = F.when(F.col("reach_km") <= REACHES[k][0], k).otherwise(c)
    return c


def _homes(inc: DataFrame) -> DataFrame:
    """Each incident in the cell of its origin; cells are as large as its class of reach."""
    from wakeline.operators.spatial import cell_of
    inc = inc.withColumn("_cl", _reach_class())
    at = [cell_of("origin_lat", "origin_lon", deg) for _, deg in REACHES]
    pick = lambda i: F.coalesce(*[F.when(F.col("_cl") == k, at[k][i]) for k in range(len(REACHES))])
    return inc.withColumn("_cy", pick(0)).withColumn("_cx", pick(1))


def _tracks(fixes: DataFrame, reach: dict[int, float], carry: DataFrame | None) -> DataFrame:
    """One row a vessel: its track in order of time, and the home cells of incidents that a fix may lie within reach of."""
    from wakeline.operators.spatial import lat_lon_cells
    tag = lambda k: lambda c: F.struct(F.lit(k).alias("_cl"), c["cy"].alias("_cy"), c["cx"].alias("_cx"))
    cells = F.concat(*[F.transform(lat_lon_cells("lat", "lon", km, REACHES[k][1]), tag(k)) for k, km in sorted(reach.items())])
    fix = F.struct("t_us", "t_h", F.round("t_h", 3).alias("r"), "lat", "lon")
    v = fixes.groupBy("mmsi").agg(F.sort_array(F.collect_list(fix)).alias("f"), F.array_distinct(F.flatten(F.collect_set(cells))).alias("_c"))
    if carry is None:
        return v.withColumn("c", F.struct(F.lit(0).alias("none")))
    return v.join(shuffled(carry.select("mmsi", F.struct(*[c for c in carry.columns if c != "mmsi"]).alias("c"))), "mmsi")


def _judge(approached: bool, sampled: bool, radius_km: float, names: list[str]):
    """Arrow batches of (block of vessels, block of incidents) -> one batch of pairs each."""
    parts = (APPROACH if approached else []) + (SERIES if sampled else [])
    need = ["origin_lat", "origin_lon", "p0_h", "p1_h", "w0_h", "w1_h", "reach_km"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                v, i = (batch.column(c).slice(row, 1).flatten() for c in ("v", "i"))
                v, i = ({f.name: c for f, c in zip(x.type, x.flatten())} for x in (v, i))
                cases = Cases(*[i[c].to_numpy(zero_copy_only=False) for c in need])
                off, fix = v["f"].offsets.to_numpy(), v["f"].values
                off, fix = off - off[0], dict(zip([f.name for f in fix.type], fix.slice(off[0], off[-1] - off[0]).flatten()))
                t, r, lat, lon = (fix[c].to_numpy(zero_copy_only=False) for c in ("t_h", "r", "lat", "lon"))
                who, which, cols = [], [], {c: [] for c in ["min_km", "_n", "_samples", *parts]}
                for k, (a, z) in enumerate(zip(off[:-1], off[1:])):
                    track = t[a:z], lat[a:z], lon[a:z]
                    hit = near_cases(*track, cases)
                    if hit is None or (parts and z - a < 2):
                        continue
                    at, case, km, i0, i1 = hit              # incidents, their place in `case`, and of each case its number and window
                    who.append(np.full(len(at[0]), k))
                    which.append(at[0])
                    got = {"min_km": km, "_n": i1 - i0}
                    if approached:
                        got |= approach(*track, r[a:z], cases, case, i0, i1, radius_km, C.GAP_FLAG_MIN)
                    if sampled:
                        got |= series(*track, cases, case, C.ST_SIGMA_KM, C.ST_HALF_WIN_H)
                    for c, x in got.items():
                        cols[c].append(x[at[1]])
                if not who:
                    continue
                who, which = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
                out = {"incident_id": i["incident_id"].take(which), "mmsi": v["mmsi"].take(who), "c": v["c"].take(who)}
                out |= {c: i[c].take(which) for c in names if c in i and c not in out}
                out |= {c: pa.array(np.concatenate(x).astype(np.int64 if c in ("_n", "_samples") else np.float64)) for c, x in cols.items() if x}
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)
    return run


def judged(fixes: DataFrame, incidents: DataFrame, *, approached: bool = False, sampled: bool = False, carry: DataFrame | None = None,
           radius_km: float = C.SEARCH_RADIUS_KM, pad_h: float = C.TIME_PAD_H, few_incidents: int = 100_000) -> DataFrame:
    """Gated pairs with `min_km`; with `approached` and `sampled` also the sums that `evidence` makes its columns from, the incident's
    own columns, and a struct `c` of the vessel's `carry` columns.

    An incident lies in one cell and a vessel visits a cell once, so a pair is met once. Incidents above `few_incidents` are shuffled
    to the units of vessels, below they are broadcast."""
    from wakeline.operators.spatial import padded
    spark = fixes.sparkSession
    have = [c for c in OWN if c in incidents.columns]
    inc = padded(incidents, radius_km, pad_h).select(
        "incident_id", "reach_km", "p0_h", "p1_h", F.least("t0_h", "t1_h").alias("w0_h"), F.greatest("t0_h", "t1_h").alias("w1_h"),
        *[F.col(c).cast("double").alias(c) for c in have]).dropna(subset=["origin_lat", "origin_lon", "p0_h", "p1_h", "reach_km"])
    inc = durable(_homes(inc))
    reach = {r["_cl"]: r["km"] for r in inc.groupBy("_cl").agg(F.max("reach_km").alias("km")).collect()}    # at most three
    own = have if approached or sampled else []
    names = ["incident_id", "mmsi", "min_km", *(["c", "_n", *own] if approached or sampled else []), *(APPROACH if approached else []),
             *(["_samples", *SERIES] if sampled else [])]
    dbl = lambda c: T.StructField(c, T.LongType() if c in ("_n", "_samples") else T.DoubleType())
    if not reach:
        inc, reach = inc.limit(0), {0: 0.0}
    v = durable(_tracks(fixes.select("mmsi", "t_us", "t_h", "lat", "lon"), reach, carry))
    fixed = {"incident_id": inc.schema["incident_id"], "mmsi": v.schema["mmsi"], "c": v.schema["c"]}
    schema = T.StructType([fixed.get(c) or dbl(c) for c in names])

    lone = v.select("mmsi", F.inline("_c"))
    n_i = inc.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_i"))
    cells = durable(lone.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_v")).join(broadcast_if_small(n_i), CELL).select(
        *CELL, F.ceil(F.col("_v") / VESSELS).alias("_nv"), F.ceil(F.col("_i") / INCIDENTS).alias("_ni")))
    units = cells.agg(F.sum(F.ceil(F.col("_nv") / UNIT))).first()[0] or 1
    tasks = max(1, min(units, max(4 * spark.sparkContext.defaultParallelism, units // 4)))
    at = broadcast_if_small(cells)
    blk = F.pmod(F.xxhash64("mmsi"), F.col("_nv"))
    vb = v.select("mmsi", "f", "c", F.inline("_c")).join(at, CELL).withColumn("_vb", blk).withColumn("_u", F.floor(F.col("_vb") / UNIT))
    vb = vb.repartition(tasks, *CELL, "_u").groupBy(*CELL, "_u", "_vb").agg(F.collect_list(F.struct("mmsi", "f", "c")).alias("v"))
    cols = [c for c in inc.columns if c not in CELL]
    ib = inc.join(at, CELL).withColumn("_ib", F.pmod(F.xxhash64("incident_id"), F.col("_ni"))).groupBy(*CELL, "_ib", "_nv").agg(
        F.collect_list(F.struct(*cols)).alias("i"))
    if few_rows(inc, few_incidents):
        j = vb.join(F.broadcast(ib.select(*CELL, "i")), CELL)
    else:
        ib = ib.withColumn("_u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_nv") - 1) / UNIT))))
        j = vb.join(shuffled(ib.select(*CELL, "_u", "i")), [*CELL, "_u"])
    return j.select("v", "i").mapInArrow(_judge(approached, sampled, radius_km, names), schema)
