"""Zones and row-level scope: point in zone, closures, visibility, management, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.labels import chain
from wakeline.operators.cover import candidates, cell_cover, inside
from wakeline.operators.spatial import salted_join


def points_in_zones(points: DataFrame, edges: DataFrame, *, boundary: bool = True, cell_deg: float = 2.0,
                    key: str = "zone_id") -> DataFrame:
    """`points` (any columns with lat, lon) joined to every zone that covers them."""
    p = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    hit = candidates(p, cell_cover(edges, cell_deg=cell_deg, key=key)).filter(inside(boundary))
    return hit.select(*points.columns, key).distinct()


def zones_of(points: DataFrame, edges: DataFrame, zones: DataFrame, point_key: str = "id") -> DataFrame:
    """Zone chain per point, most specific first (a chain is as long as the hierarchy is deep); none -> empty."""
    hit = points_in_zones(points.select(point_key, "lat", "lon"), edges)
    spec = zones.select("zone_id", "code", "specificity")
    ch = (hit.join(F.broadcast(spec), "zone_id").groupBy(point_key)
          .agg(F.sort_array(F.collect_list(F.struct("specificity", "zone_id", "code"))).alias("_z")))
    return points.join(ch, point_key, "left").withColumn(
        "chain", F.coalesce(F.transform("_z", lambda z: z["code"]), F.array().cast("array<string>"))
    ).withColumn("primary_zone_id", F.get("_z", F.lit(0))["zone_id"]).drop("_z")


def closure(scopes: DataFrame, zones: DataFrame) -> DataFrame:
    """`scopes` (scope_id, zone_id) -> every zone under an assigned one, inclusive."""
    return scopes.sparkSession.sql("""
      WITH RECURSIVE down(scope_id, zone_id) AS (
        SELECT scope_id, zone_id FROM {scopes}
        UNION ALL
        SELECT d.scope_id, z.zone_id FROM down d JOIN {zones} z ON z.parent_id = d.zone_id)
      SELECT DISTINCT scope_id, zone_id FROM down""",
                                   scopes=scopes.select("scope_id", "zone_id").distinct(),
                                   zones=zones.select("zone_id", "parent_id"))


def accessible(users: DataFrame, zones: DataFrame) -> DataFrame:
    """(user_id, zone_id): all zones for NATIONAL, else the closure of the assigned ones (none -> no row)."""
    assigned = users.filter(F.col("role") != "NATIONAL").select(
        F.col("user_id").alias("scope_id"), F.explode("zone_ids").alias("zone_id"))
    every = zones.select("zone_id").agg(F.collect_set("zone_id").alias("_z"))
    nat = users.filter(F.col("role") == "NATIONAL").select(F.col("user_id").alias("scope_id")).join(
        F.broadcast(every), F.lit(True)).select("scope_id", F.explode("_z").alias("zone_id"))
    return closure(assigned, zones).unionByName(nat).withColumnRenamed("scope_id", "user_id")


def codes_to_ids(rows: DataFrame, zones: DataFrame, codes: str = "codes", key: str = "id") -> DataFrame:
    """Trimmed, upper-cased code lookup: (key, zone_id)."""
    c = rows.select(key, F.explode(codes).alias("_c")).select(key, F.upper(F.trim("_c")).alias("code")).distinct()
    return c.join(F.broadcast(zones.select("code", "zone_id")), "code").select(key, "zone_id")


def row_zones(rows: DataFrame, edges: DataFrame, zones: DataFrame, key: str = "id") -> DataFrame:
    """Every zone a row belongs to by id, by code or by coordinates: union of three, then distinct."""
    by_id = rows.filter(F.col("jurisdiction_id").isNotNull()).select(key, F.col("jurisdiction_id").alias("zone_id"))
    by_code = codes_to_ids(rows, zones, key=key)
    by_point = points_in_zones(rows.select(key, "lat", "lon"), edges).select(key, "zone_id")
    return by_id.unionByName(by_code).unionByName(by_point).distinct()


def visible(rows: DataFrame, scope_closure: DataFrame, edges: DataFrame, zones: DataFrame, key: str = "id") -> DataFrame:
    """(scope_id, key) pairs a scope may see. A row meets at most the ancestors of its few zones, never all scopes."""
    cl = scope_closure.select("scope_id", "zone_id")
    return salted_join(row_zones(rows, edges, zones, key), cl, ["zone_id"]).select("scope_id", key).distinct()


def visible_vessels(anomalies: DataFrame, scope_closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Vessels linked to an anomaly whose point lies in the closure."""
    hit = points_in_zones(anomalies.filter(F.col("vessel_id").isNotNull()).select("id", "vessel_id", "lat", "lon"), edges)
    linked = hit.select("vessel_id", "zone_id").distinct()
    return salted_join(linked, scope_closure.select("scope_id", "zone_id"), ["zone_id"]).select("scope_id", "vessel_id").distinct()


def subset(owned: DataFrame, scope_closure: DataFrame, owner: str = "user_id") -> DataFrame:
    """(scope_id, owner) where the owner's non-empty zone set lies inside the scope's closure."""
    z = owned.select(owner, F.array_distinct("zone_ids").alias("_z")).filter(F.size("_z") > 0)
    hit = (z.select(owner, F.size("_z").alias("_n"), F.explode("_z").alias("zone_id")).join(scope_closure, "zone_id")
           .groupBy("scope_id", owner, "_n").agg(F.count(F.lit(1)).alias("_k")))
    return hit.filter(F.col("_k") == F.col("_n")).select("scope_id", owner)


def manageable(users: DataFrame, regional_scope: DataFrame) -> DataFrame:
    """Pilot accounts a regional scope may manage (a national actor manages all but itself, no join needed)."""
    return subset(users.filter(F.col("role") == "PILOT"), regional_scope)


def count_active(users: DataFrame, role: str = "NATIONAL", exclude_id: int | None = None) -> DataFrame:
    u = users.filter((F.col("role") == role) & F.col("active"))
    return (u if exclude_id is None else u.filter(F.col("user_id") != exclude_id)).agg(F.count(F.lit(1)).alias("n"))


def zone_list(zones: DataFrame, allowed: DataFrame | None = None, with_geometry: bool = False) -> DataFrame:
    z = zones if allowed is None else zones.join(allowed.select("zone_id").distinct(), "zone_id", "left_semi")
    return z if with_geometry else z.drop("geometry")


def lookup(keys: DataFrame, rows: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Verdict per (scope_id, key): found, forbidden (exists but not visible) or missing. A row without coordinates is
    visible by its zone only; `may_create` is the check of new rows."""
    r = rows.select(key, F.lit(True).alias("_has"))
    s = seen.withColumn("_seen", F.lit(True))
    j = keys.join(r, key, "left").join(s, ["scope_id", key], "left")
    return j.withColumn("verdict", chain([(F.col("_has").isNull(), "missing"), (F.col("_seen"), "found")],
                                         "forbidden")).drop("_has", "_seen")


def may_create(points: DataFrame, scope_closure: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(scope_id, key) of new rows a scope may add: those without coordinates, and those whose point lies in its closure."""
    scopes = scope_closure.select("scope_id").distinct()
    free = points.filter(F.col("lat").isNull() | F.col("lon").isNull()).select(key)
    inside = points_in_zones(points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(key, "lat", "lon"), edges)
    near = inside.select(key, "zone_id").join(scope_closure, "zone_id").select("scope_id", key).distinct()
    every = free.withColumn("scope_id", F.explode(F.array(*[F.lit(r["scope_id"]) for r in scopes.collect()]))).select("scope_id", key)    # scopes are zones of the catalogue
    return near.unionByName(every)


def page(rows: DataFrame, offset: int, limit: int, key: str = "id") -> DataFrame:
    """Newest first; the page size is the report's own."""
    return rows.orderBy(F.col(key).desc()).offset(offset).limit(limit)


def is_land(points: DataFrame, land_edges: DataFrame, *, buffer_km: float = 0.0, cell_deg: float = 2.0, key: str = "id") -> DataFrame:
    """Add `on_land`: strictly inside a polygon, or within `buffer_km` / 111 degrees of its outline."""
    b = buffer_km / 111.0
    p = points.select(key, "lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    lat, lon = F.col("lat"), F.col("lon")

    def close(e):
        dx, dy = e["lon2"] - e["lon1"], e["lat2"] - e["lat1"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, ((lon - e["lon1"]) * dx + (lat - e["lat1"]) * dy) / F.when(len2 > 0, len2)).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(lon - e["lon1"] - t * dx, lat - e["lat1"] - t * dy) < b
    hit = inside(False)
    if b > 0:
        hit = hit | F.coalesce(F.exists("edges", close), F.lit(False))
    on = (candidates(p, cell_cover(land_edges, cell_deg=cell_deg, buffer_deg=b)).filter(hit)
          .select(key).distinct().withColumn("on_land", F.lit(True)))
    return points.join(on, key, "left").withColumn("on_land", F.coalesce("on_land", F.lit(False)))


def is_land_raster(points: DataFrame, land_pixels: DataFrame, scenes: DataFrame, key: str = "id") -> DataFrame:
    """Raster variant: the nearest pixel of the point's scene is a land cell (equi-join on the rounded index)."""
    from wakeline.functions.geo import ll_to_pixel
    c, r = ll_to_pixel("lat", "lon", "w", "s", "e", "n", "width", "height")
    p = points.join(scenes.select("scene_id", "w", "s", "e", "n", "width", "height"), "scene_id").select(
        key, "scene_id", F.rint(r).cast("int").alias("row"), F.rint(c).cast("int").alias("col"))
    on = p.join(land_pixels.select("scene_id", "row", "col"), ["scene_id", "row", "col"], "left_semi").select(key).distinct()
    return points.join(on.withColumn("on_land", F.lit(True)), key, "left").withColumn("on_land", F.coalesce("on_land", F.lit(False)))
