"""Geodesy as column expressions: every function takes and returns Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
EARTH_RADIUS_ROUND_KM = 6371.0      # the trajectory model measures with the rounded radius
DEG = math.pi / 180.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _half_angle(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s_lat = F.sin((lat2 - lat1) * DEG / 2)
    s_lon = F.sin((lon2 - lon1) * DEG / 2)
    a = s_lat * s_lat + F.cos(lat1 * DEG) * F.cos(lat2 * DEG) * s_lon * s_lon
    return F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return _half_angle(lat1, lon1, lat2, lon2) * (2 * EARTH_RADIUS_M)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000.0


def haversine_round_km(lat1, lon1, lat2, lon2) -> Column:
    return _half_angle(lat1, lon1, lat2, lon2) * (2 * EARTH_RADIUS_ROUND_KM)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Forward azimuth, clockwise from north, in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlon = (lon2 - lon1) * DEG
    east = F.sin(dlon) * F.cos(lat2 * DEG)
    north = (F.cos(lat1 * DEG) * F.sin(lat2 * DEG)
             - F.sin(lat1 * DEG) * F.cos(lat2 * DEG) * F.cos(dlon))
    return wrap_360(F.degrees(F.atan2(east, north)))


def destination(lat, lon, bearing, dist_m) -> tuple[Column, Column]:
    lat, lon, bearing, dist_m = map(_c, (lat, lon, bearing, dist_m))
    phi, theta, delta = lat * DEG, bearing * DEG, dist_m / EARTH_RADIUS_M
    sin2 = F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta)
    lon2 = lon + F.degrees(F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi),
                                   F.cos(delta) - F.sin(phi) * sin2))
    return F.degrees(F.asin(sin2)), F.pmod(lon2 + 540.0, F.lit(360.0)) - 180.0


def wrap_360(a) -> Column:
    return F.pmod(_c(a) + 360.0, F.lit(360.0))


def ang_diff(a, b) -> Column:
    """Signed difference b - a in [-180, 180)."""
    return F.pmod(_c(b) - _c(a) + 180.0, F.lit(360.0)) - 180.0


def axis_diff(course, axis) -> Column:
    """Difference to an undirected axis, folded to [0, 90]."""
    d = F.abs(ang_diff(course, axis))
    return F.least(d, 180.0 - d)


def metres_per_deg(lat) -> tuple[Column, Column]:
    p = _c(lat) * DEG
    m_lat = 111_132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p)
    m_lon = F.greatest(111_412.84 * F.cos(p) - 93.5 * F.cos(3 * p), F.lit(1e-6))
    return m_lat, m_lon


def to_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    m_lat, m_lon = metres_per_deg(lat0)
    return (_c(lon) - _c(lon0)) * m_lon, (_c(lat) - _c(lat0)) * m_lat


def to_ll(x, y, lat0, lon0) -> tuple[Column, Column]:
    m_lat, m_lon = metres_per_deg(lat0)
    return _c(lat0) + _c(y) / m_lat, _c(lon0) + _c(x) / m_lon


def bbox_size_m(w, s, e, n) -> tuple[Column, Column]:
    m_lat, m_lon = metres_per_deg((_c(s) + _c(n)) / 2.0)
    return (_c(e) - _c(w)) * m_lon, (_c(n) - _c(s)) * m_lat


def bbox_expand_km(w, s, e, n, km) -> tuple[Column, Column, Column, Column]:
    m_lat, m_lon = metres_per_deg((_c(s) + _c(n)) / 2.0)
    dlat, dlon = _c(km) * 1000.0 / m_lat, _c(km) * 1000.0 / m_lon
    return _c(w) - dlon, _c(s) - dlat, _c(e) + dlon, _c(n) + dlat


def bbox_for_scene(lat, lon, width_px, height_px, pixel_m):
    m_lat, m_lon = metres_per_deg(lat)
    hw = _c(width_px) * _c(pixel_m) / 2.0 / m_lon
    hh = _c(height_px) * _c(pixel_m) / 2.0 / m_lat
    return _c(lon) - hw, _c(lat) - hh, _c(lon) + hw, _c(lat) + hh


def pixel_to_ll(col, row, w, s, e, n, width, height) -> tuple[Column, Column]:
    """Centre of a north-up pixel."""
    lat = _c(n) - (_c(row) + 0.5) * (_c(n) - _c(s)) / _c(height)
    lon = _c(w) + (_c(col) + 0.5) * (_c(e) - _c(w)) / _c(width)
    return lat, lon


def ll_to_pixel(lat, lon, w, s, e, n, width, height) -> tuple[Column, Column]:
    col = (_c(lon) - _c(w)) / ((_c(e) - _c(w)) / _c(width)) - 0.5
    row = (_c(n) - _c(lat)) / ((_c(n) - _c(s)) / _c(height)) - 0.5
    return col, row


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def circular_mean(angle) -> Column:
    """Aggregate: mean direction through unit vectors, in [0, 360)."""
    a = _c(angle) * DEG
    return wrap_360(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))))
