"""Whole attribution of many incidents: gate -> evidence -> fusion -> rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.labels import vessel_prior
from wakeline.operators import evidence as ev
from wakeline.operators import spatial as sp
from wakeline.operators import tracks as tr
from wakeline.session import durable


def gather(fixes: DataFrame, incidents: DataFrame, *, pairs: DataFrame | None = None, drift_pos: DataFrame | None = None,
           anomaly: DataFrame | None = None, route: DataFrame | None = None) -> DataFrame:
    """All evidence per gated pair. With `drift_pos` the space-time score searches the oil cloud, else the origin point.
    A model that is not engaged leaves its component unavailable."""
    who = tr.identity(fixes).select("mmsi", "vessel_type", "name")
    if pairs is None and drift_pos is None:
        e = ev.pair_evidence(fixes, incidents, carry=who)
    else:
        if pairs is None:
            pairs = durable(sp.gate(fixes, incidents))
            e = ev.pair_evidence(fixes, incidents, series=False, carry=who)
        else:
            lg = durable(sp.pair_legs(pairs, fixes, incidents))       # read by every evidence aggregate
            e = ev.window_evidence(lg).join(who, "mmsi")
        if drift_pos is None:
            st = ev.st_score(lg, fixes)
        else:
            match = durable(ev.volume_match(pairs, fixes, drift_pos))
            st = ev.volume_score(match, ev.cloud_ceiling(drift_pos, ev.ceiling_steps(match)), incidents)
        e = e.join(st, ev.PAIR, "left")
    e = (e.withColumn("vessel_prior", vessel_prior("vessel_type")).withColumn("axis_alignment_available", F.col("axis_available")))
    if anomaly is not None:
        e = e.join(ev.anomaly_component(pairs, anomaly, incidents).select(*ev.PAIR, "ais_anomaly"), ev.PAIR, "left")
    if route is None:
        e = e.withColumn("route_deviation", F.lit(0.0)).withColumn("route_deviation_available", F.lit(False))
    else:
        e = e.join(route.select("mmsi", "route_deviation"), "mmsi", "left").withColumn(
            "route_deviation_available", F.col("route_deviation").isNotNull())
    return e


def rank_incidents(fixes: DataFrame, incidents: DataFrame, weights: dict[str, float] | None = None, **kw) -> DataFrame:
    return ev.rank(ev.fuse(gather(fixes, incidents, **kw), weights))


def rank_summaries(fixes: DataFrame):
    """Ranking callback for the feedback loop: hindcast summaries and their particle cloud -> ranked vessels."""
    def fn(summary: DataFrame, drift_pos: DataFrame) -> DataFrame:
        inc = summary.select(
            "incident_id", F.col("best_lat").alias("origin_lat"), F.col("best_lon").alias("origin_lon"), "t0_h", "t1_h", "spread_km",
            F.col("observed_lat").alias("centroid_lat"), F.col("observed_lon").alias("centroid_lon"),
            F.lit(None).cast("double").alias("axis_deg"), "prior_lo_h", "prior_hi_h")
        return ev.rank(ev.fuse(gather(fixes, inc, drift_pos=drift_pos)).select(*ev.PAIR, "score", "best_match_time_h"))
    return fn
