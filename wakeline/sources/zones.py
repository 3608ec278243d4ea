"""Zone polygons: GeoJSON source, edge table, fixed catalogue."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name, parent, west, south, east, north of the coastal boxes.
STATE_BOXES = [
    ("IN-GJ", "Gujarat Coastal Zone", "IN-WEST", 66.0, 20.4, 72.8, 24.5),
    ("IN-MH", "Maharashtra / Mumbai Coastal Zone", "IN-WEST", 68.5, 15.9, 73.6, 20.4),
    ("IN-GA-KA", "Goa & Karnataka Coastal Zone", "IN-WEST", 70.5, 13.5, 74.9, 15.9),
    ("IN-KL", "Kerala Coastal Zone", "IN-SOUTH", 72.0, 7.6, 77.2, 13.5),
    ("IN-TN", "Tamil Nadu Coastal Zone", "IN-SOUTH", 77.2, 7.6, 82.2, 13.4),
    ("IN-AP", "Andhra Pradesh Coastal Zone", "IN-EAST", 79.6, 13.4, 86.2, 19.3),
    ("IN-OD", "Odisha Coastal Zone", "IN-EAST", 83.4, 19.3, 88.1, 21.2),
    ("IN-WB", "West Bengal Coastal Zone", "IN-EAST", 86.4, 21.2, 89.9, 22.9),
    ("IN-AN", "Andaman & Nicobar Islands Zone", "IN-ISLANDS", 91.0, 5.5, 94.6, 14.2),
]
REGIONS = [("IN-WEST", "Western Maritime Region"), ("IN-SOUTH", "Southern Maritime Region"),
           ("IN-EAST", "Eastern Maritime Region"), ("IN-ISLANDS", "Island Territories Maritime Region")]
NATION = ("IN-NATIONAL", "India National Maritime Jurisdiction")
# Order from specific to general.
SPECIFICITY = {"COASTAL_STATE": 0, "PORT": 0, "MARITIME_REGION": 1, "REGION": 1, "EEZ": 2, "ZONE": 2, "NATION": 3}
ZONE_SCHEMA = "zone_id int, code string, name string, type string, parent_code string, geometry string"


def _ring(w, s, e, n):
    return [[w, s], [e, s], [e, n], [w, n], [w, s]]


def catalogue_rows(extra: list[tuple] = ()) -> list[tuple]:
    """Nation, regions, states in seeding order; `extra` rows (code, name, type, parent, box) follow, e.g. a study area."""
    multi = lambda boxes: json.dumps({"type": "MultiPolygon", "coordinates": [[_ring(*b)] for b in boxes]})
    one = lambda b: json.dumps({"type": "Polygon", "coordinates": [_ring(*b)]})
    rows = [(NATION[0], NATION[1], "NATION", None, multi([b[3:] for b in STATE_BOXES]))]
    rows += [(c, n, "MARITIME_REGION", NATION[0], multi([b[3:] for b in STATE_BOXES if b[2] == c])) for c, n in REGIONS]
    rows += [(b[0], b[1], "COASTAL_STATE", b[2], one(b[3:])) for r, _ in REGIONS for b in STATE_BOXES if b[2] == r]
    rows += [(c, n, t, p, one(box)) for c, n, t, p, box in extra]
    return [(i + 1, *r) for i, r in enumerate(rows)]


def zone_catalogue(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    return with_parents(spark.createDataFrame(catalogue_rows(extra), ZONE_SCHEMA))


def with_parents(zones: DataFrame) -> DataFrame:
    """Wire parent ids by code; add the specificity order."""
    parent = zones.select(F.col("code").alias("parent_code"), F.col("zone_id").alias("parent_id"))
    spec = F.create_map(*[F.lit(v) for kv in SPECIFICITY.items() for v in kv])
    return (zones.drop("parent_id", "specificity").join(parent, "parent_code", "left")
            .withColumn("specificity", F.coalesce(F.try_element_at(spec, F.col("type")), F.lit(5))))


def seed(existing: DataFrame, rows: DataFrame, key: str = "code") -> DataFrame:
    """Idempotent insert: existing rows stay untouched, absent keys are added, parents wired."""
    new = rows.join(existing.select(key), key, "left_anti")
    return with_parents(existing.unionByName(new, allowMissingColumns=True))


_POLY = "array<array<array<double>>>"


def polygons(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """GeoJSON geometry text -> one row per polygon part: keeps the other columns, adds `part` and `rings`."""
    t = features.withColumn("_t", F.get_json_object(geometry, "$.type"))
    coords = F.get_json_object(F.col(geometry), "$.coordinates")
    parts = (F.when(F.col("_t") == "Polygon", F.array(F.from_json(coords, _POLY)))
             .when(F.col("_t") == "MultiPolygon", F.from_json(coords, f"array<{_POLY}>")))
    keep = [c for c in features.columns if c != geometry]
    return t.select(*keep, F.posexplode(parts).alias("part", "rings")).filter(F.size("rings") > 0)


def read_land_geojson(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection, Feature or bare geometry list files -> (zone_id, geometry text); empty geometries dropped."""
    text = spark.read.text(path, wholetext=True)
    feats = F.coalesce(F.from_json(F.get_json_object("value", "$.features"), "array<struct<geometry:string>>"),
                       F.transform(F.from_json("value", "array<string>"), lambda s: F.struct(s.alias("geometry"))))
    single = F.array(F.struct(F.coalesce(F.get_json_object("value", "$.geometry"), F.col("value")).alias("geometry")))
    return (text.select(F.explode(F.coalesce(feats, single)).alias("f")).select("f.geometry")
            .filter(F.get_json_object("geometry", "$.type").isNotNull())
            .filter(F.coalesce(F.get_json_object("geometry", "$.coordinates"), F.lit("[]")) != "[]")
            .withColumn("zone_id", F.xxhash64("geometry")))


def zone_edges(parts: DataFrame, zone_key: str = "zone_id") -> DataFrame:
    """Ring points -> edges (zone, part, ring, seq, lon1, lat1, lon2, lat2); open rings are closed."""
    rings = parts.select(zone_key, "part", F.posexplode("rings").alias("ring", "_pts"))
    closed = F.when(F.element_at("_pts", 1) == F.element_at("_pts", -1), F.col("_pts")).otherwise(
        F.concat("_pts", F.array(F.element_at("_pts", 1))))
    pts = rings.withColumn("_pts", closed)
    pair = F.zip_with(F.slice("_pts", 1, F.size("_pts") - 1), F.slice("_pts", 2, F.size("_pts") - 1),
                      lambda a, b: F.struct(a[0].alias("lon1"), a[1].alias("lat1"), b[0].alias("lon2"), b[1].alias("lat2")))
    return pts.select(zone_key, "part", "ring", F.posexplode(pair).alias("seq", "_e")).select(
        zone_key, "part", "ring", "seq", "_e.*")


