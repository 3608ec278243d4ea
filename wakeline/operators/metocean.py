"""Gridded wind and current: storage, provenance, tri-linear lookup, drift velocity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.functions import geo
from wakeline.functions.labels import douglas
from wakeline.operators.spatial import salted_join
from wakeline.session import broadcast_if_small

VALUES = ["wu", "wv", "cu", "cv"]


def write_fields(cells: DataFrame, path: str) -> None:
    """Store fields hashed to files by key (thousands of tiny directories would hurt the reader)."""
    cells.repartition("field_id").sortWithinPartitions("field_id", "ti", "yi", "xi").write.mode("overwrite").parquet(path)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_default_field(wanted: DataFrame, cells: DataFrame, default_id) -> DataFrame:
    """(key -> field) for incidents: the wanted field where stored, else the default one."""
    have = cells.select("field_id").distinct().withColumn("_ok", F.lit(True))
    return wanted.join(have, "field_id", "left").withColumn(
        "field_id", F.when(F.col("_ok"), F.col("field_id")).otherwise(F.lit(default_id))).drop("_ok")


def field_axes(cells: DataFrame) -> DataFrame:
    """Axis origin, span and counts per field."""
    aggs = []
    for ax, col, i in (("y", "lat", "yi"), ("x", "lon", "xi"), ("t", "t_h", "ti")):
        aggs += [F.min(col).alias(f"{ax}_lo"), F.max(col).alias(f"{ax}_hi"), (F.max(i) + 1).alias(f"n{ax}")]
    return cells.groupBy("field_id").agg(*aggs)


def cubes(cells: DataFrame, axes: DataFrame) -> DataFrame:
    """One row per grid cube with its eight corner vectors, so a lookup is one equi-join and no aggregate."""
    j = cells.join(broadcast_if_small(axes.select("field_id", "ny", "nx", "nt")), "field_id")

    def owners(i, n):
        # cube c has corners c and min(c + 1, n - 1), c in 0 .. max(n - 2, 0)
        i, n = F.col(i), F.col(n)
        as_lo = F.struct(i.alias("c"), F.lit(0).alias("s"))
        as_hi = F.struct((i - 1).alias("c"), F.lit(1).alias("s"))
        both = F.when(n == 1, F.array(as_lo, F.struct(i.alias("c"), F.lit(1).alias("s")))).otherwise(F.array(as_lo, as_hi))
        return F.filter(both, lambda o: (o["c"] >= 0) & (o["c"] <= F.greatest(n - 2, F.lit(0))))
    j = (j.withColumn("_t", F.explode(owners("ti", "nt"))).withColumn("_y", F.explode(owners("yi", "ny")))
         .withColumn("_x", F.explode(owners("xi", "nx"))))
    code = F.col("_t.s") * 4 + F.col("_y.s") * 2 + F.col("_x.s")
    return j.groupBy("field_id", F.col("_t.c").alias("t0"), F.col("_y.c").alias("y0"), F.col("_x.c").alias("x0")).agg(
        *[F.max(F.when(code == k, F.col(v))).alias(f"{v}{k}") for v in VALUES for k in range(8)])


def metocean_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """`points` (field_id, lat, lon, t_h, ...) with wu, wv, cu, cv interpolated, clamped at every face."""
    axes = field_axes(cells)
    p = points.join(broadcast_if_small(axes), "field_id")

    def index(v, ax):
        lo, hi, n = F.col(f"{ax}_lo"), F.col(f"{ax}_hi"), F.col(f"n{ax}")
        f = geo.clip((F.col(v) - lo) / F.greatest(hi - lo, F.lit(1e-9)), 0.0, 1.0) * (n - 1)
        c = F.least(F.floor(f), F.greatest(n - 2, F.lit(0))).cast("int")
        return c, f - c
    for v, ax in (("lat", "y"), ("lon", "x"), ("t_h", "t")):
        c, w = index(v, ax)
        p = p.withColumn(f"{ax}0", c).withColumn(f"_w{ax}", w)
    j = salted_join(p, cubes(cells, axes), ["field_id", "t0", "y0", "x0"])

    def lin(v):
        g = lambda k: F.col(f"{v}{k}")
        mix = lambda a, b, w: a * (1 - F.col(w)) + b * F.col(w)
        plane = lambda t: mix(mix(g(4 * t), g(4 * t + 1), "_wx"), mix(g(4 * t + 2), g(4 * t + 3), "_wx"), "_wy")
        return mix(plane(0), plane(1), "_wt").alias(v)
    return j.select(*points.columns, *[lin(v) for v in VALUES])


def conditions(at: DataFrame, lat_centre: str = "lat") -> DataFrame:
    """Speed and direction (wind from, current towards), knots, sea state, inertial period."""
    to = lambda u, v: geo.wrap_360(F.degrees(F.atan2(F.col(u), F.col(v))))
    ws, cs = F.hypot("wu", "wv"), F.hypot("cu", "cv")
    f = 2 * 7.292e-5 * F.sin(F.radians(F.abs(F.col(lat_centre)) + 1e-6))
    return (at.withColumn("wind_ms", ws).withColumn("wind_kn", ws * 1.94384)
            .withColumn("wind_from_deg", F.pmod(to("wu", "wv") + 180.0, F.lit(360.0)))
            .withColumn("current_ms", cs).withColumn("current_kn", cs * 1.94384).withColumn("current_to_deg", to("cu", "cv"))
            .withColumn("sea_state", douglas(ws))
            .withColumn("inertial_h", F.greatest(2 * math.pi / F.greatest(f, F.lit(1e-9)) / 3600.0, F.lit(12.0))))


def drift_uv(wu, wv, cu, cv, mean_lat) -> tuple[Column, Column]:
    """Surface drift: current + 3 % wind turned 17 degrees (right in the north, left in the south) + 1.2 % Stokes."""
    wu, wv, cu, cv = map(geo._c, (wu, wv, cu, cv))
    hemi = F.when(geo._c(mean_lat) >= 0, 1.0).otherwise(-1.0)
    c, s = math.cos(math.radians(C.WIND_DEFLECTION_DEG)), math.sin(math.radians(C.WIND_DEFLECTION_DEG))
    u = C.CURRENT_FACTOR * cu + C.WIND_FACTOR * (wu * c + wv * s * hemi) + C.STOKES_FACTOR * wu
    v = C.CURRENT_FACTOR * cv + C.WIND_FACTOR * (wv * c - wu * s * hemi) + C.STOKES_FACTOR * wv
    return u, v


def provenance(cells: DataFrame) -> DataFrame:
    """Box, window, grid shape and mean conditions at the centre per field."""
    ax = field_axes(cells)
    mid = ax.select("field_id", ((F.col("y_lo") + F.col("y_hi")) / 2).alias("lat"),
                    ((F.col("x_lo") + F.col("x_hi")) / 2).alias("lon"), F.lit(0.0).alias("t_h"))
    at = conditions(metocean_at(mid, cells)).select("field_id", "wind_ms", "wind_from_deg", "current_ms", "current_to_deg", "sea_state")
    return ax.join(at, "field_id")


def vector_grid(boxes: DataFrame, cells: DataFrame, n: int = 12) -> DataFrame:
    """n x n samples of wind and current over each box (field_id, w, s, e, n_lat, t_h)."""
    i = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = boxes.withColumn("gy", i()).withColumn("gx", i())
    g = g.select("field_id", "t_h", "gy", "gx", (F.col("s") + F.col("gy") * (F.col("n") - F.col("s")) / (n - 1)).alias("lat"),
                 (F.col("w") + F.col("gx") * (F.col("e") - F.col("w")) / (n - 1)).alias("lon"))
    return metocean_at(g, cells)
