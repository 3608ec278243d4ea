"""Domain tables derived by arithmetic from the given tables, over all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import clean as cl
from wakeline.operators import tracks as tr
from wakeline.session import broadcast_if_small, durable

EPOCH_US = 1704067200000000
REFERENCE_US = EPOCH_US + 12 * 3600 * 1_000_000       # observation: t_h = 0
_MEMO: dict[tuple, DataFrame] = {}


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def memo(name: str, spark: SparkSession, sf: str, make) -> DataFrame:
    """A shared intermediate table, written once per application to the checkpoint folder."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        _MEMO[key] = durable(make())
    return _MEMO[key]


def forget() -> None:
    _MEMO.clear()


def events(spark, sf) -> DataFrame:
    e = load(spark, sf, "events")
    exact = F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div 60")
    return e.select("event_id", F.col("user_id").alias("u"), "value", "event_type",
                    F.get_json_object("props", "$.k").cast("int").alias("k"), exact.alias("t_us"))


def pings_raw(spark, sf) -> DataFrame:
    return memo("pings", spark, sf, lambda: _pings(spark, sf))


def _pings(spark, sf) -> DataFrame:
    """Dirty pings: some rows lack key, time or place; some are at null island; some events come twice."""
    th = F.col("t_us") / 3.6e9
    u, k = F.col("u"), F.col("k")
    jitter = (k - 50) * F.lit(0.0002)
    lat = F.lit(15.5) + ((13 * u % 41) - 20) * F.lit(0.02) + ((7 * u % 21) - 10) * F.lit(0.02) * (th - 6.0) + jitter
    lon = F.lit(73.1) + ((17 * u % 41) - 20) * F.lit(0.02) + ((11 * u % 21) - 10) * F.lit(0.02) * (th - 6.0) + jitter
    cog = ((37 * k + 11 * u) % 400).cast("double")
    copies = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events(spark, sf).withColumn("copy", F.explode(copies)).select(
        (F.col("event_id") * 2 + F.col("copy")).alias("seq"),
        F.when(k != 95, F.element_at(F.array(*[F.lit(x) for x in (419, 636, 563, 999)]), (u % 4 + 1).cast("int"))
               * F.lit(1000000).cast("bigint") + u).alias("mmsi"),
        F.when(k != 96, F.timestamp_micros(F.col("t_us") + F.lit(EPOCH_US))).alias("timestamp"),
        F.when(k == 99, 200.0).when(k == 97, 0.0).otherwise(lat).alias("latitude"),
        F.when(k == 98, None).when(k == 97, 0.0).otherwise(lon).alias("longitude"),
        (F.col("value") / 4).alias("sog"), cog.alias("cog"),
        F.when(k % 10 == 0, 511.0).otherwise(cog).alias("heading"), (3 * (k - 50)).cast("double").alias("rot"),
        (30 + (7 * u % 70)).alias("vessel_type"), (k % 16).alias("nav_status"), F.concat(F.lit("V"), u).alias("name"))


def clean(spark, sf) -> DataFrame:
    return cl.clean(pings_raw(spark, sf))


def axis(spark, sf) -> DataFrame:
    return tr.time_axis(clean(spark, sf), REFERENCE_US)


def tracks(spark, sf) -> DataFrame:
    return memo("tracks", spark, sf, lambda: tr.build_tracks(cl.usable(pings_raw(spark, sf)), REFERENCE_US))


def incidents(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    lat = F.lit(15.5) + ((5 * s % 61) - 30) * F.lit(0.1)
    lon = F.lit(73.1) + ((17 * s % 61) - 30) * F.lit(0.1)
    back = -(F.lit(6.0) + s % 6)
    known = s % 7 != 0
    return load(spark, sf, "supplier").select(
        s.alias("incident_id"), lat.alias("origin_lat"), lon.alias("origin_lon"),
        back.alias("t0_h"), F.lit(-1.0).alias("t1_h"), ((s % 4) * 2.5).alias("spread_km"),
        F.when(known, F.lit(15.6) + ((5 * s % 61) - 30) * F.lit(0.1)).alias("centroid_lat"),
        F.when(known, F.lit(73.22) + ((17 * s % 61) - 30) * F.lit(0.1)).alias("centroid_lon"),
        F.lit(None).cast("double").alias("axis_deg"),
        back.alias("prior_lo_h"), F.lit(-3.0).alias("prior_hi_h"),
        (F.lit(450.0) + F.lit(100.0) * (s % 20)).alias("width_m"), (F.lit(5.0) + s % 15).alias("area_km2"))


# -- zones, cases, users, alerts --------------------------------------------------------------------------------------
STUDY = [("STUDY-1", "Study area", "ZONE", None, (57.2, -21.0, 58.8, -19.8))]


def zones(spark) -> DataFrame:
    from wakeline.sources.zones import zone_catalogue
    return memo("zones", spark, "", lambda: zone_catalogue(spark, STUDY))


def zone_edges(spark) -> DataFrame:
    from wakeline.sources import zones as z
    return memo("edges", spark, "", lambda: z.zone_edges(z.polygons(zones(spark))))


def cases(spark, sf) -> DataFrame:
    """One case per order. Coordinates fall on tenths of a degree, so some lie exactly on zone borders."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pri = F.substring("o_orderpriority", 1, 1).cast("int")
    return load(spark, sf, "orders").select(
        o.alias("id"), o.alias("case_id"), F.expr("o_custkey div 15").alias("incident_id"),
        F.concat(F.lit("Case "), o).alias("title"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("RESOLVED").alias("status"),
        F.when(pri <= 2, "Oil-like anomaly").when(pri <= 4, "Likely look-alike").otherwise("No significant anomaly").alias("label"),
        F.when(o % 11 != 0, (F.floor(F.col("o_totalprice")) % 1000) / 1000).alias("confidence"),
        F.when(o % 4 != 0, (50 + c * 7 % 200) / 10).alias("lat"), F.when(o % 4 != 0, (600 + c * 13 % 360) / 10).alias("lon"),
        F.when(o % 3 == 0, (c % 16).cast("int")).alias("_z"), F.when(o % 3 == 1, (c % 14 + 1).cast("int")).alias("_c"),
        c.alias("vessel_id"), (F.lit(450.0) + c % 20 * 100).alias("width_m"), (F.lit(5.0) + c % 15).alias("area_km2")
    ).withColumn("jurisdiction_id", F.when(F.col("_z") > 0, F.col("_z"))).drop("_z")


def coded_cases(spark, sf) -> DataFrame:
    """Cases with a code list (padded, lower case) where they have no zone id."""
    code = zones(spark).select(F.col("zone_id").alias("_c"), F.array(F.concat(F.lit(" "), F.lower("code"))).alias("codes"))
    return cases(spark, sf).join(F.broadcast(code), "_c", "left").drop("_c")


def users(spark, sf) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    role = F.when(c % 10 == 0, "NATIONAL").when(c % 10 <= 3, "REGIONAL").otherwise("PILOT")
    second = F.when(c % 3 == 0, F.array(((n * 5) % 14 + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.when(n % 15 > 0, F.array((n % 15).cast("int"))).otherwise(F.array().cast("array<int>"))
    return load(spark, sf, "customer").select(
        c.alias("user_id"), role.alias("role"), (c % 7 != 0).alias("active"),
        F.array_distinct(F.concat(first, second)).alias("zone_ids"))


def alerts(spark, sf) -> DataFrame:
    u, k = F.col("u"), F.col("k")
    out = (F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "PENDING")
           .when(F.col("event_type") == "purchase", "MOCKED").otherwise("SENT"))
    return events(spark, sf).select(
        F.col("event_id").alias("alert_id"), F.lit("anomaly").alias("kind"), "t_us",
        (F.lit(5.0) + (u % 1500) * F.lit(0.05) + (k % 3 - 1) * F.lit(0.004)).alias("lat"),
        (F.lit(60.0) + (k % 10) * F.lit(0.05) + F.floor(u / 1500) * F.lit(0.6)).alias("lon"),
        out.alias("outcome"), (k == 7).alias("force"), F.col("event_type"), F.col("value"))


def scope_closure(spark) -> DataFrame:
    """Every zone as a scope of its own: (scope_id, zone_id)."""
    from wakeline.operators.scope import closure
    z = zones(spark)
    return memo("closure", spark, "", lambda: closure(z.select(F.col("zone_id").alias("scope_id"), "zone_id"), z))


# -- drift ------------------------------------------------------------------------------------------------------------
def drift_back(spark, sf) -> DataFrame:
    """One particle per order, nine recorded steps over the last 12 hours."""
    return memo("drift_back", spark, sf, lambda: _drift_back(spark, sf))


def _particles(spark, sf) -> DataFrame:
    o = load(spark, sf, "orders").select(F.expr("o_custkey div 15").alias("incident_id"), F.col("o_orderkey").alias("particle_id"))
    return o.join(broadcast_if_small(incidents(spark, sf).select("incident_id", "origin_lat", "origin_lon")), "incident_id")


def _drift_back(spark, sf) -> DataFrame:
    p, t = F.col("particle_id"), F.col("t_h")
    d = _particles(spark, sf).withColumn("t_h", F.explode(F.array(*[F.lit(-12.0 + 1.5 * s) for s in range(9)])))
    return d.select("incident_id", "particle_id", "t_h",
                    (F.col("origin_lat") + (p % 9 - 4) * F.lit(4e-3) * t + (p % 11 - 5) * F.lit(1e-2)).alias("lat"),
                    (F.col("origin_lon") + (p % 7 - 3) * F.lit(5e-3) * t + (p % 13 - 6) * F.lit(1e-2)).alias("lon"),
                    F.lit(False).alias("beached"))


def drift_forward(spark, sf) -> DataFrame:
    """Seventeen steps over 48 hours; in three of four incidents every fifth particle strands and stays put."""
    return memo("drift_fwd", spark, sf, lambda: _drift_forward(spark, sf))


def _drift_forward(spark, sf) -> DataFrame:
    p = F.col("particle_id")
    ash = (p % 5 == 0) & (F.col("incident_id") % 4 != 0)
    d = _particles(spark, sf).withColumn("t_h", F.explode(F.array(*[F.lit(3.0 * s) for s in range(17)])))
    te = F.when(ash, F.least(F.col("t_h"), F.lit(12.0) + p % 3 * 6)).otherwise(F.col("t_h"))
    return d.select("incident_id", "particle_id", "t_h",
                    (F.col("origin_lat") + ((p % 9 - 4) * F.lit(3e-3) + F.lit(2e-2)) * te + (p % 11 - 5) * F.lit(1e-2)).alias("lat"),
                    (F.col("origin_lon") + ((p % 7 - 3) * F.lit(2e-3) + F.lit(1e-2)) * te + (p % 13 - 6) * F.lit(1e-2)).alias("lon"),
                    ash.alias("beached"))


def fields(spark, sf) -> DataFrame:
    """One 4 x 4 x 5 wind and current grid per supplier, linear in its indexes."""
    return memo("fields", spark, sf, lambda: _fields(spark, sf))


def _fields(spark, sf) -> DataFrame:
    seq = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    d = (incidents(spark, sf).select(F.col("incident_id").alias("field_id"), "origin_lat", "origin_lon")
         .withColumn("yi", seq(4)).withColumn("xi", seq(4)).withColumn("ti", seq(5)))
    y, x, t = F.col("yi"), F.col("xi"), F.col("ti")
    return d.select(
        "field_id", "ti", "yi", "xi", (t * F.lit(24.0) - 48.0).alias("t_h"), (F.col("origin_lat") - 1.5 + y * F.lit(1.0)).alias("lat"),
        (F.col("origin_lon") - 1.5 + x * F.lit(1.0)).alias("lon"),
        (F.lit(4.0) + y * F.lit(0.5) - x * F.lit(0.3) + t * F.lit(0.2) + F.col("field_id") % 5 * F.lit(0.4)).alias("wu"),
        (F.lit(-2.0) + y * F.lit(0.25) + x * F.lit(0.15) - t * F.lit(0.1)).alias("wv"),
        (F.lit(0.1) + y * F.lit(0.02) + x * F.lit(0.03) + t * F.lit(0.01)).alias("cu"),
        (F.lit(0.05) - y * F.lit(0.01) + x * F.lit(0.02) + t * F.lit(0.015)).alias("cv"))


def drift_incidents(spark, sf) -> DataFrame:
    """Incidents with an observed centroid and their own field."""
    i = incidents(spark, sf)
    return i.select("incident_id", F.coalesce("centroid_lat", "origin_lat").alias("centroid_lat"),
                    F.coalesce("centroid_lon", "origin_lon").alias("centroid_lon"), "width_m", "area_km2",
                    F.col("incident_id").alias("field_id"))


def land_edges(spark) -> DataFrame:
    """A coastal box and a triangle south of it."""
    import json

    from wakeline.sources import zones as z
    shapes = [(1, [[73.4, 16.2], [75.0, 16.2], [75.0, 18.0], [73.4, 18.0], [73.4, 16.2]]),
              (2, [[73.5, 12.0], [75.5, 12.0], [74.5, 14.0], [73.5, 12.0]])]
    rows = [(i, json.dumps({"type": "Polygon", "coordinates": [r]})) for i, r in shapes]
    return memo("land", spark, "", lambda: z.zone_edges(z.polygons(spark.createDataFrame(rows, "zone_id int, geometry string"))))


def weather_input(spark, sf) -> DataFrame:
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 6
    oil = F.element_at(F.array(*[F.lit(o) for o in ("light_crude", "medium_crude", "heavy_crude", "diesel", "bunker", "unknown")]), n + 1)
    return load(spark, sf, "part").select(
        "p_partkey", (F.col("p_retailprice") / 50).alias("area_km2"), (F.lit(10.0) + F.col("p_size") % 25).alias("temp_c"), oil.alias("oil"),
        (F.col("p_retailprice") * 1.5).alias("width_m"))


# -- scenes -----------------------------------------------------------------------------------------------------------
def scene_pixels(spark, sf) -> DataFrame:
    """One pixel row per embedding, one column per element; a scene is a hundred rows."""
    return memo("pixels", spark, sf, lambda: _scene_pixels(spark, sf))


def _scene_pixels(spark, sf) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    return e.select(F.expr("cast(vec_id div 100 as int)").alias("scene_id"), (F.col("vec_id") % 100).cast("int").alias("row"), "col",
                    (F.lit(-12.0) + F.lit(4.0) * F.col("v").cast("double")).alias("sigma0_db"), F.lit(-11.5).alias("background_db"))


def scenes(spark, sf) -> DataFrame:
    p = scene_pixels(spark, sf).groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return p.select("scene_id", "width", "height", F.lit(60.0).alias("pixel_m"), F.lit(0.0036).alias("pixel_area_km2"),
                    (F.lit(73.0) + F.col("scene_id") * F.lit(0.1)).alias("w"), F.lit(15.0).alias("s"),
                    (F.lit(73.04) + F.col("scene_id") * F.lit(0.1)).alias("e"), F.lit(15.05).alias("n"))


def dark_pixels(spark, sf) -> DataFrame:
    return scene_pixels(spark, sf).filter(F.col("sigma0_db") < -12.3).select("scene_id", "row", "col")


def blocks(spark, sf) -> DataFrame:
    """Every pixel in a region: tiles of 20 x 16 (ragged at the last row)."""
    r = F.expr("row div 20") * 100 + F.expr("col div 16")
    return scene_pixels(spark, sf).select("scene_id", "row", "col", r.cast("bigint").alias("region_id"))


def region_rows(spark, sf) -> DataFrame:
    """Feature rows, one per line item."""
    q = F.col("l_quantity")
    return load(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 50).cast("int").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region_id"),
        F.col("l_partkey"), (F.col("l_discount") * 100).alias("mean_contrast_db"), (F.col("l_tax") * 5).alias("border_gradient_db_px"),
        (q * 2).alias("spreading"), (q / 5).alias("elongation"), (F.lit(1.0) + F.col("l_discount") * 20).alias("complexity"),
        (F.lit(0.4) + F.col("l_tax") * 5).alias("solidity"), (F.col("l_linenumber") * 2.5).alias("local_wind_ms"),
        (q / 20).alias("dist_to_land_km"), (F.col("l_extendedprice") % 1000 / 1000).alias("probability"),
        F.when(F.col("l_returnflag") == "A", 0.5).alias("threshold"), (F.col("l_returnflag") == "R").alias("is_real"),
        (F.col("l_linenumber") % 3 * 100.0).alias("width_m"), F.col("l_returnflag"))
