"""The hierarchical cell cover against plain even-odd walks over all edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import cover as cv
from wakeline.operators import scope as sc

SCHEMA = "zone_id int, part int, ring int, seq int, lon1 double, lat1 double, lon2 double, lat2 double"


def ring(points, zone, part=0, ring_no=0):
    return [(zone, part, ring_no, i, *a, *b) for i, (a, b) in enumerate(zip(points, points[1:] + points[:1], strict=True))]


def coast(n, seed, lon=75.0, lat=15.0, radius=4.0):
    """A ragged ring of n points around a centre."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = 2 * math.pi * i / n
        r = radius * (1 + 0.2 * math.sin(7 * t) + 0.05 * math.sin(91 * t) + 0.01 * rnd.random())
        out.append((lon + r * math.cos(t), lat + r * math.sin(t)))
    return out


def odd(lat, lon, edges):
    n = 0
    for x1, y1, x2, y2 in edges:
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


def gap(lat, lon, edges):
    best = math.inf
    for x1, y1, x2, y2 in edges:
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(lon - x1 - t * dx, lat - y1 - t * dy))
    return best


def world():
    hole = [(74.0, 14.0), (76.0, 14.0), (76.0, 16.0), (74.0, 16.0)]
    rows = ring(coast(600, 1), 1) + ring(hole, 1, ring_no=1)                      # an island with a lake
    rows += ring([(70.0, 10.0), (80.0, 10.0), (80.0, 20.0), (70.0, 20.0)], 2)      # a box on round coordinates
    rows += ring(coast(80, 2, 60.0, -20.0, 9.0), 3) + ring(coast(50, 3, 78.0, 15.0, 1.0), 3, part=1)
    return rows


def scattered(n, seed):
    rnd = random.Random(seed)
    pts = [(rnd.uniform(5, 25), rnd.uniform(65, 85)) for _ in range(n)] + [(rnd.uniform(-30, -10), rnd.uniform(50, 70)) for _ in range(n // 4)]
    return [(i, *p) for i, p in enumerate(pts)]


@pytest.mark.parametrize("max_edges", [4, 32])
def test_cover_equals_even_odd_walk(spark, max_edges, monkeypatch):
    rows, pts = world(), scattered(400, 5)
    parts = {}
    for z, p, _, _, *e in rows:
        parts.setdefault((z, p), []).append(e)
    want = {(i, z) for i, la, lo in pts for (z, _), es in parts.items() if odd(la, lo, es)}
    made = cv.cell_cover(spark.createDataFrame(rows, SCHEMA), max_edges=max_edges)
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {(r.id, r.zone_id) for r in cv.candidates(p, made).filter(cv.inside(True)).collect()}
    assert got == want and len(want) > 100
    assert made.filter(F.size("edges") > max_edges).count() == 0


def test_land_with_a_buffer(spark):
    rows, pts = ring(coast(300, 4), 1), scattered(200, 6)
    edges = [r[4:] for r in rows]
    p = spark.createDataFrame([*pts, (9999, None, 75.0)], "id int, lat double, lon double")
    got = {r.id for r in sc.is_land(p, spark.createDataFrame(rows, SCHEMA), buffer_km=55.5).filter("on_land").collect()}
    assert got == {i for i, la, lo in pts if odd(la, lo, edges) or gap(la, lo, edges) < 0.5}


def test_long_coast_stays_in_bounded_rows(spark):
    """A coast of 100,000 edges: rows stay small, most of the land answers without an edge."""
    line = spark.createDataFrame(ring(coast(100_000, 8), 1), SCHEMA)
    made = cv.cell_cover(line)
    most = made.agg(F.max(F.size("edges"))).first()[0]
    assert most <= 32 and made.filter("edges IS NULL").count() > 100
    edges = [tuple(r) for r in line.select("lon1", "lat1", "lon2", "lat2").collect()]
    pts = scattered(24, 9)
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    assert {r.id for r in cv.candidates(p, made).filter(cv.inside(True)).collect()} == {i for i, la, lo in pts if odd(la, lo, edges)}


def test_no_polygons_and_repeated_points(spark):
    none = spark.createDataFrame([], SCHEMA)
    p = spark.createDataFrame([(1, 15.0, 75.0), (1, 15.0, 75.0), (2, 15.0, None)], "id int, lat double, lon double")
    assert sc.points_in_zones(p, none).count() == 0
    box = spark.createDataFrame(ring([(70.0, 10.0), (80.0, 10.0), (80.0, 20.0), (70.0, 20.0)], 2), SCHEMA)
    assert [r.id for r in sc.points_in_zones(p, box).collect()] == [1]
    lattice = [(i * 100 + j, 9.5 + i / 2, 69.5 + j / 2) for i in range(23) for j in range(23)]      # many on the outline and its lines
    q = spark.createDataFrame(lattice, "id int, lat double, lon double")
    for on, low, high in ((True, 0, 10), (False, 0.5, 9.5)):
        want = {k for k, la, lo in lattice if low <= la - 10 <= high and low <= lo - 70 <= high}
        assert {r.id for r in sc.points_in_zones(q, box, boundary=on).collect()} == want
    edge = spark.createDataFrame([(1, 10.0, 75.0), (2, 20.0, 80.0)], "id int, lat double, lon double")
    assert sc.points_in_zones(edge, box).count() == 2 and sc.points_in_zones(edge, box, boundary=False).count() == 0
