"""Registered queries: fields, weathering, drift, origin density, forecast."""

from __future__ import annotations


from pyspark.sql import functions as F

from wakeline.functions import weathering as we
from wakeline.operators import attribution as at
from wakeline.operators import drift as dr
from wakeline.operators import evidence as ev
from wakeline.operators import metocean as mo
from wakeline.operators import scope as sc
from wakeline.plans import fixtures as fx
from wakeline.plans.q_evidence import PAIR, pairs
from wakeline.plans.registry import query, rd
from wakeline.plans.sqltext import cte, km, m_lat, m_lon, pmod, q, r
from wakeline.session import durable

N_TEST = dr.C.N_PARTICLES          # particles per incident in the registered drift runs

cte("part0", "SELECT o_custkey // 15 AS incident_id, o_orderkey AS p, i.origin_lat AS olat, i.origin_lon AS olon FROM orders JOIN incident i ON i.incident_id = o_custkey // 15", "incident")
cte("dback", """SELECT incident_id, p, t_h, olat + (p % 9 - 4) * 4e-3 * t_h + (p % 11 - 5) * 1e-2 AS lat,
  olon + (p % 7 - 3) * 5e-3 * t_h + (p % 13 - 6) * 1e-2 AS lon FROM part0, (SELECT -12e0 + 15e-1 * s AS t_h FROM range(9) g(s))""", "part0")
cte("dfwd", """SELECT incident_id, p, t_h, beached, olat + ((p % 9 - 4) * 3e-3 + 2e-2) * te + (p % 11 - 5) * 1e-2 AS lat,
  olon + ((p % 7 - 3) * 2e-3 + 1e-2) * te + (p % 13 - 6) * 1e-2 AS lon FROM (
  SELECT *, p % 5 = 0 AND incident_id % 4 <> 0 AS beached, CASE WHEN p % 5 = 0 AND incident_id % 4 <> 0 THEN least(t_h, 12e0 + p % 3 * 6) ELSE t_h END AS te
  FROM part0, (SELECT 3e0 * s AS t_h FROM range(17) g(s)))""", "part0")
cte("beach", """SELECT incident_id, p, min(t_h) FILTER (m <= 1e-7) AS beach_h FROM (SELECT *, abs(lat - lag(lat) OVER w) + abs(lon - lag(lon) OVER w) AS m FROM dfwd
  WHERE beached WINDOW w AS (PARTITION BY incident_id, p ORDER BY t_h)) GROUP BY 1, 2""", "dfwd")


def _field(fy, fx_, ft, f="f"):
    return {"wu": f"(4e0 + ({fy}) * 5e-1 - ({fx_}) * 3e-1 + ({ft}) * 2e-1 + {f} % 5 * 4e-1)", "wv": f"(-2e0 + ({fy}) * 25e-2 + ({fx_}) * 15e-2 - ({ft}) * 1e-1)",
            "cu": f"(1e-1 + ({fy}) * 2e-2 + ({fx_}) * 3e-2 + ({ft}) * 1e-2)", "cv": f"(5e-2 - ({fy}) * 1e-2 + ({fx_}) * 2e-2 + ({ft}) * 15e-3)"}


_FR = """SELECT {cols}, least(greatest((lat - (olat - 15e-1)) / 3e0, 0e0), 1e0) * 3 AS fy, least(greatest((lon - (olon - 15e-1)) / 3e0, 0e0), 1e0) * 3 AS fx,
  least(greatest((t_h + 48e0) / 96e0, 0e0), 1e0) * 4 AS ft FROM {src}"""
cte("fpt", _FR.format(cols="incident_id AS f, p, t_h, lat, lon", src="(SELECT d.*, i.origin_lat AS olat, i.origin_lon AS olon FROM dback d JOIN incident i USING (incident_id))"), "dback", "incident")
_V = _field("fy", "fx", "ft")
cte("fval", f"SELECT f, p, t_h, lat, lon, {', '.join(f'{v} AS {k}' for k, v in _V.items())} FROM fpt", "fpt")


def field_points(spark, sf):
    return fx.drift_back(spark, sf).select(F.col("incident_id").alias("field_id"), "particle_id", "t_h", "lat", "lon")


@query("j9_grid_interpolation", q(f"SELECT f AS field_id, p AS particle_id, t_h, {', '.join(r(k, 7) + ' AS ' + k for k in _V)} FROM fval", "fval"))
def j9_grid_interpolation(spark, sf):
    return mo.metocean_at(field_points(spark, sf), fx.fields(spark, sf)).select(
        "field_id", "particle_id", "t_h", *[rd(v, 7) for v in mo.VALUES])


@query("f20_drift_velocity", q(f"""
  SELECT field_id, particle_id, t_h, {r('cu + 3e-2 * (wu * c + wv * s) + 12e-3 * wu', 7)} AS u, {r('cv + 3e-2 * (wv * c - wu * s) + 12e-3 * wv', 7)} AS v
  FROM (SELECT f AS field_id, p AS particle_id, t_h, wu, wv, cu, cv, cos(radians(17e0)) AS c, sin(radians(17e0)) * CASE WHEN avg(lat) OVER (PARTITION BY f) >= 0 THEN 1 ELSE -1 END AS s FROM fval)""", "fval"))
def f20_drift_velocity(spark, sf):
    p = field_points(spark, sf)
    mean = p.groupBy("field_id").agg(F.avg("lat").alias("mean_lat"))
    u, v = mo.drift_uv("wu", "wv", "cu", "cv", "mean_lat")
    return mo.metocean_at(p, fx.fields(spark, sf)).join(mean, "field_id").select(
        "field_id", "particle_id", "t_h", F.round(u, 7).alias("u"), F.round(v, 7).alias("v"))


_TO = lambda u, v: pmod(f"degrees(atan2({u}, {v})) + 360e0", 360.0)


@query("f21_conditions", q(f"""
  SELECT f AS field_id, p AS particle_id, t_h, {r('sqrt(wu * wu + wv * wv)')} AS wind_ms, {r(pmod(_TO('wu', 'wv') + ' + 180e0', 360.0), 4)} AS wind_from_deg,
    {r('sqrt(cu * cu + cv * cv) * 1.94384')} AS current_kn, {r(_TO('cu', 'cv'), 4)} AS current_to_deg,
    CASE WHEN sqrt(wu * wu + wv * wv) < 3.3 THEN 2 WHEN sqrt(wu * wu + wv * wv) < 5.4 THEN 3 WHEN sqrt(wu * wu + wv * wv) < 7.9 THEN 4 ELSE 5 END AS sea_state,
    {r('greatest(2 * pi() / greatest(2 * 7.292e-5 * sin(radians(abs(lat) + 1e-6)), 1e-9) / 3600, 12e0)', 4)} AS inertial_h FROM fval""", "fval"))
def f21_conditions(spark, sf):
    c = mo.conditions(mo.metocean_at(field_points(spark, sf), fx.fields(spark, sf)))
    return c.select("field_id", "particle_id", "t_h", rd("wind_ms"), rd("wind_from_deg", 4), rd("current_kn"), rd("current_to_deg", 4),
                    "sea_state", rd("inertial_h", 4))


_MID = _field("1.5e0", "1.5e0", "2e0", "incident_id")


@query("s15_field_provenance", q(f"""
  SELECT incident_id AS field_id, {r('origin_lat - 15e-1', 5)} AS y_lo, {r('origin_lon + 15e-1', 5)} AS x_hi, -48.0::DOUBLE AS t_lo, 4 AS ny, 4 AS nx, 5 AS nt,
    {r(f"sqrt(pow({_MID['wu']}, 2) + pow({_MID['wv']}, 2))")} AS wind_ms FROM incident""", "incident"))
def s15_field_provenance(spark, sf):
    return mo.provenance(fx.fields(spark, sf)).select("field_id", rd("y_lo", 5), rd("x_hi", 5), F.col("t_lo"), "ny", "nx", "nt", rd("wind_ms"))


@query("s5_field_store_and_default", q("""
  SELECT i.incident_id, CASE WHEN i.incident_id % 3 = 0 THEN 1 ELSE i.incident_id END AS field_id, 80::BIGINT AS n_cells FROM incident i""", "incident"))
def s5_field_store_and_default(spark, sf):
    from wakeline.session import shared_folder
    path = f"{shared_folder(spark)}/fields-{abs(hash(sf))}"
    mo.write_fields(fx.fields(spark, sf), path)
    cells = mo.read_fields(spark, path)
    w = fx.incidents(spark, sf).select("incident_id", F.when(F.col("incident_id") % 3 != 0, F.col("incident_id")).otherwise(-1).alias("field_id"))
    n = cells.groupBy("field_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return mo.with_default_field(w, cells, 1).withColumn("field_id", F.col("field_id").cast("bigint")).join(n, "field_id")


_GV = _field("gy * 3e0 / 11", "gx * 3e0 / 11", "2e0", "field_id")


@query("d8_vector_grid", q(f"""
  SELECT field_id, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, {', '.join(r(v) + ' AS ' + k for k, v in _GV.items())}
  FROM (SELECT incident_id AS field_id, gy, gx FROM incident, range(12) a(gy), range(12) b(gx))""", "incident"))
def d8_vector_grid(spark, sf):
    b = fx.incidents(spark, sf).select(F.col("incident_id").alias("field_id"), (F.col("origin_lon") - 1.5).alias("w"), (F.col("origin_lat") - 1.5).alias("s"),
                                       (F.col("origin_lon") + 1.5).alias("e"), (F.col("origin_lat") + 1.5).alias("n"), F.lit(0.0).alias("t_h"))
    return mo.vector_grid(b, fx.fields(spark, sf)).select("field_id", "gy", "gx", *[rd(v) for v in mo.VALUES])


# -- age and weathering -----------------------------------------------------------------------------------------------
_AGE = "greatest(pow(greatest(width_m, 1.0) / 3.29, 2) - pow(450.0 / 3.29, 2), 0.0) / 16.0 / 3600.0"
cte("winput", """SELECT p_partkey, p_retailprice / 50 AS area_km2, 10e0 + p_size % 25 AS temp_c, p_retailprice * 15e-1 AS width_m,
  ['light_crude', 'medium_crude', 'heavy_crude', 'diesel', 'bunker', 'unknown'][CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 6 + 1] AS oil FROM part""")


@query("f10_f11_age_and_release_window", q(f"""
  SELECT p_partkey, {r('age')} AS age_point_h, {r('least(age * 2.2, 48.0) * -1')} AS t0_h, -0.5::DOUBLE AS t1_h,
    {r('-1 * least(greatest(age / 2.2, 0.5), 48.0)')} AS prior_hi_h, 'diffusive_width' AS age_source
  FROM (SELECT p_partkey, least(greatest({_AGE}, 0.5), 48.0) AS age FROM winput)""", "winput"))
def f10_f11_age_and_release_window(spark, sf):
    w = we.release_window(fx.weather_input(spark, sf))
    return w.select("p_partkey", rd("age_point_h"), rd("t0_h"), "t1_h", rd("prior_hi_h"), "age_source")


_EV = """CASE WHEN h * 60 < 1 THEN 0.0 ELSE least(greatest((CASE oil WHEN 'light_crude' THEN 2.86 + 0.045 * temp_c WHEN 'heavy_crude' THEN 0.39 + 0.013 * temp_c
  WHEN 'diesel' THEN 3.28 + 0.037 * temp_c WHEN 'bunker' THEN 0.13 + 0.013 * temp_c ELSE 1.65 + 0.045 * temp_c END) * ln(greatest(h * 60, 1)) / 100, 0.0), 0.75) END"""
_FAY = f"CASE WHEN h <= 0 THEN 0.0 ELSE pow(1.45, 2) * pi() * pow({1 - 870 / 1025} * 9.81 * pow(area_km2 * 1e3, 2) / sqrt(1e-6), 1e0 / 3e0) * sqrt(h * 3600) / 1e6 END"


@query("f12_f13_f14_weathering", q(f"""
  SELECT p_partkey, h AS t_h, {r('ev')} AS evaporated_fraction, {r('v0 * (1 - ev)', 4)} AS volume_remaining_m3, {r('a')} AS slick_km2,
         {r('v0 * (1 - ev) / (a * 1e6) * 1000')} AS thickness_mm
  FROM (SELECT p_partkey, h, area_km2 * 1e3 AS v0, {_EV} AS ev, greatest(area_km2, {_FAY}) AS a FROM winput, (SELECT unnest([0e0, 6e0, 12e0, 24e0, 48e0]) AS h))""", "winput"))
def f12_f13_f14_weathering(spark, sf):
    w = we.weather(fx.weather_input(spark, sf))
    return w.select("p_partkey", "t_h", rd("evaporated_fraction"), rd("volume_remaining_m3", 4), rd("slick_km2"), rd("thickness_mm"))


# -- particles --------------------------------------------------------------------------------------------------------
@query("d2_column_drift", q(f"""
  SELECT incident_id, CAST(k AS INTEGER) AS step, {r('(2e-1 + incident_id % 5 * 1e-2) * (k + 1) * 600 + 1e-5 * pow((k + 1) * 600, 2) / 2 - 1e-10 * pow((k + 1) * 600, 3) / 3', 4)} AS x_m,
         {r('-1e-1 * (k + 1) * 600 + 2e-10 * pow((k + 1) * 600, 3) / 3', 4)} AS y_m FROM incident, range(288) g(k)""", "incident"))
def d2_column_drift(spark, sf):
    d = fx.incidents(spark, sf).select("incident_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(287))))
    u = lambda t: F.lit(0.2) + F.col("incident_id") % 5 * F.lit(0.01) + 1e-5 * t - 1e-10 * t * t
    v = lambda t: F.lit(-0.1) + 2e-10 * t * t
    t = F.col("step") * 600.0
    d = d.select("incident_id", "step", *[f(t + o).alias(n + s) for n, f in (("u", u), ("v", v)) for s, o in (("0", 0.0), ("m", 300.0), ("1", 600.0))])
    return dr.drift_path(d, 600.0).select("incident_id", "step", rd("x_m", 4), rd("y_m", 4))


cte("orig", """SELECT incident_id, p, olat + (p % 9 - 4) * 4e-3 * -age + (p % 11 - 5) * 1e-2 AS lat, olon + (p % 7 - 3) * 5e-3 * -age + (p % 13 - 6) * 1e-2 AS lon,
  1e0 + p % 3 AS weight FROM (SELECT *, 5e-1 + p % 23 * 5e-1 AS age FROM part0)""", "part0")


def origin_points(spark, sf):
    p = F.col("particle_id")
    ages = fx.drift_back(spark, sf).select(*dr.PKEY).distinct().withColumn("age_h", F.lit(0.5) + p % 23 * F.lit(0.5))
    return fx.memo("origin", spark, sf, lambda: dr.origins(fx.drift_back(spark, sf), ages).withColumn("weight", F.lit(1.0) + p % 3))


@query("d4_j8_particle_origins", q(f"SELECT incident_id, p AS particle_id, {r('lat')} AS lat, {r('lon')} AS lon FROM orig", "orig"))
def d4_j8_particle_origins(spark, sf):
    return origin_points(spark, sf).select(*dr.PKEY, rd("lat"), rd("lon"))


@query("g19_origin_spread", q(f"""
  SELECT incident_id, {r('any_value(ma)', 9)} AS centroid_lat, {r('any_value(mo)', 9)} AS centroid_lon, {r('avg(' + km('lat', 'lon', 'ma', 'mo') + ')')} AS spread_km
  FROM (SELECT *, avg(lat) OVER (PARTITION BY incident_id) AS ma, avg(lon) OVER (PARTITION BY incident_id) AS mo FROM orig) GROUP BY 1""", "orig"))
def g19_origin_spread(spark, sf):
    return dr.spread_km(origin_points(spark, sf)).select("incident_id", rd("centroid_lat", 9), rd("centroid_lon", 9), rd("spread_km"))


cte("obox", f"""SELECT incident_id, w - 8000 / {m_lon('(s + n) / 2')} AS w, e + 8000 / {m_lon('(s + n) / 2')} AS e, s - 8000 / {m_lat('(s + n) / 2')} AS s, n + 8000 / {m_lat('(s + n) / 2')} AS n
  FROM (SELECT incident_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM orig GROUP BY 1)""", "orig")
cte("ocell", """SELECT incident_id, CAST(floor((lat - s) / (n - s) * 139) AS INTEGER) AS ri, CAST(floor((lon - w) / (e - w) * 139) AS INTEGER) AS ci, sum(weight) AS v
  FROM orig JOIN obox USING (incident_id) GROUP BY 1, 2, 3""", "orig", "obox")
cte("taps", "SELECT d, exp(-0.5 * pow(d / 2.2, 2)) / sum(exp(-0.5 * pow(d / 2.2, 2))) OVER () AS k FROM (SELECT unnest(range(-9, 10)) AS d)")
cte("osm", """SELECT incident_id, ri + a.d AS ri, ci + b.d AS ci, sum(v * a.k * b.k) AS v FROM ocell, taps a, taps b
  WHERE ri + a.d BETWEEN 0 AND 139 AND ci + b.d BETWEEN 0 AND 139 GROUP BY 1, 2, 3""", "ocell", "taps")
cte("ogrid", """SELECT o.*, v / sum(v) OVER (PARTITION BY incident_id) AS prob, s + ri * (n - s) / 139 AS lat, w + ci * (e - w) / 139 AS lon FROM osm o JOIN obox USING (incident_id)""", "osm", "obox")


@query("g16_origin_density", q(f"SELECT incident_id, CAST(ri AS INTEGER) AS ri, count(*) AS cells, {r('sum(prob)', 9)} AS prob, {r('sum(prob * ci)')} AS moment FROM ogrid GROUP BY 1, 2", "ogrid"))
def g16_origin_density(spark, sf):
    g = dr.origin_grid(origin_points(spark, sf))
    return g.groupBy("incident_id", "ri").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("prob"), 9).alias("prob"),
                                              F.round(F.sum(F.col("prob") * F.col("ci")), 6).alias("moment"))


@query("g16_best_origin_cell", q(f"""
  SELECT incident_id, {r('lat')} AS best_lat, {r('lon')} AS best_lon, {r('prob', 9)} AS best_prob FROM ogrid
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY prob DESC, ri, ci) = 1""", "ogrid"))
def g16_best_origin_cell(spark, sf):
    return dr.best_origin(origin_points(spark, sf)).select("incident_id", rd("best_lat"), rd("best_lon"), rd("best_prob", 9))


@query("g17_heat_map", q(f"""
  SELECT incident_id, count(*) AS points, {r('sum(rel)', 4)} AS total FROM (SELECT *, prob / max(prob) OVER (PARTITION BY incident_id) AS rel FROM ogrid
    QUALIFY rel >= 0.06) GROUP BY 1""".replace("QUALIFY rel >= 0.06", "QUALIFY prob / max(prob) OVER (PARTITION BY incident_id) >= 0.06"), "ogrid"))
def g17_heat_map(spark, sf):
    h = dr.heatmap(dr.origin_grid(origin_points(spark, sf)))
    return h.groupBy("incident_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("rel"), 4).alias("total"))


cte("oxy", f"""SELECT incident_id, (lon - mo) * {m_lon('ma')} AS x, (lat - ma) * {m_lat('ma')} AS y FROM
  (SELECT *, avg(lat) OVER (PARTITION BY incident_id) AS ma, avg(lon) OVER (PARTITION BY incident_id) AS mo FROM orig)""", "orig")


@query("g18_principal_axis", q(f"""
  SELECT incident_id, n, {r('h + rt', 2)} AS var_major, {r('h - rt', 2)} AS var_minor, {r('cos(an)', 5)} AS ax, {r('sin(an)', 5)} AS ay FROM (
    SELECT incident_id, count(*) AS n, (var_samp(x) + var_samp(y)) / 2 AS h, sqrt(pow((var_samp(x) - var_samp(y)) / 2, 2) + pow(covar_samp(x, y), 2)) AS rt,
      atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS an FROM oxy GROUP BY 1)""", "oxy"))
def g18_principal_axis(spark, sf):
    a = dr.principal_axis(origin_points(spark, sf))
    return a.select("incident_id", "n", rd("var_major", 2), rd("var_minor", 2), rd("ax", 5), rd("ay", 5))


@query("g18_confidence_ellipse")
def g18_confidence_ellipse(spark, sf):
    return dr.ellipse(origin_points(spark, sf)).select("incident_id", "k", rd("lat", 5), rd("lon", 5))


@query("w10_age_ramp", q(f"""
  SELECT incident_id, p AS particle_id, {r('least(greatest(2 + (u - lo) / (hi - lo) * 8, 0.5), 48.0)', 5)} AS age_h FROM (
    SELECT *, min(u) OVER (PARTITION BY incident_id) AS lo, max(u) OVER (PARTITION BY incident_id) AS hi FROM (
      SELECT o.incident_id, o.p, ((lon - mo) * {m_lon('ma')}) * cos(an) + ((lat - ma) * {m_lat('ma')}) * sin(an) AS u
      FROM (SELECT *, avg(lat) OVER (PARTITION BY incident_id) AS ma, avg(lon) OVER (PARTITION BY incident_id) AS mo FROM orig) o
      JOIN (SELECT incident_id, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS an FROM oxy GROUP BY 1) USING (incident_id)))""", "orig", "oxy"))
def w10_age_ramp(spark, sf):
    ages = fx.incidents(spark, sf).select("incident_id", F.lit(5.0).alias("age_point_h"), F.lit(2.0).alias("age_lo_h"), F.lit(10.0).alias("age_hi_h"))
    return dr.age_ramp(origin_points(spark, sf), ages).select(*dr.PKEY, rd("age_h", 5))


@query("w9_beach_time", q("SELECT incident_id, p AS particle_id, beach_h FROM beach", "beach"))
def w9_beach_time(spark, sf):
    return dr.beach_time(fx.drift_forward(spark, sf))


cte("snap0", "SELECT d.*, b.beach_h FROM dfwd d LEFT JOIN beach b USING (incident_id, p) WHERE t_h IN (6, 12, 24, 48)", "dfwd", "beach")
cte("snap1", "SELECT *, avg(lat) OVER w AS ma, avg(lon) OVER w AS mo FROM snap0 WINDOW w AS (PARTITION BY incident_id, t_h)", "snap0")


@query("g20_horizon_snapshot", q(f"""
  SELECT incident_id, t_h AS horizon_h, count(*) AS n_particles, {r('any_value(ma)', 9)} AS centroid_lat, {r('any_value(mo)', 9)} AS centroid_lon, {r('min(lon)')} AS west,
    {r('max(lat)')} AS north, {r('avg(CASE WHEN beach_h <= t_h THEN 1.0 ELSE 0.0 END)')} AS fraction_beached, {r('avg(' + km('lat', 'lon', 'ma', 'mo') + ')')} AS mean_radius_km,
    {r('quantile_cont(' + km('lat', 'lon', 'ma', 'mo') + ', 0.9)')} AS p90_radius_km FROM snap1 GROUP BY 1, 2""", "snap1"))
def g20_horizon_snapshot(spark, sf):
    d = fx.drift_forward(spark, sf)
    s = dr.snapshot(d, dr.beach_time(d))
    return s.select("incident_id", "horizon_h", "n_particles", rd("centroid_lat", 9), rd("centroid_lon", 9), *[rd(c) for c in ("west", "north", "fraction_beached", "mean_radius_km", "p90_radius_km")])


@query("g20_footprint_hull")
def g20_footprint_hull(spark, sf):
    return dr.hull(fx.drift_forward(spark, sf), ["incident_id", "t_h"])


@query("g21_coastal_impact", q(f"""
  SELECT incident_id, sum(b) > 0 AS will_beach, {r('avg(b)')} AS fraction_beached, CAST(sum(b) AS BIGINT) AS n_beached, min(beach_h) AS eta_h,
    {r('avg(lat) FILTER (b = 1)', 9)} AS landfall_lat, {r('arg_min(lat, beach_h * 1e9 + p) FILTER (b = 1)')} AS contact_lat
  FROM (SELECT d.*, CASE WHEN beached THEN 1 ELSE 0 END AS b, x.beach_h FROM dfwd d LEFT JOIN beach x USING (incident_id, p) WHERE t_h = 48) GROUP BY 1""", "dfwd", "beach"))
def g21_coastal_impact(spark, sf):
    d = fx.drift_forward(spark, sf)
    return dr.coastal_impact(d, dr.beach_time(d)).select("incident_id", "will_beach", rd("fraction_beached"), "n_beached", "eta_h", rd("landfall_lat", 9), rd("contact_lat"))


@query("g21_l5_contact_points", q("""
  SELECT incident_id, p AS particle_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY incident_id) AS n
    FROM dfwd WHERE beached AND t_h = 48) t WHERE n <= 40 OR EXISTS (SELECT 1 FROM range(40) g(j) WHERE CASE WHEN j = 39 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 39e0)) AS BIGINT) END = i)""", "dfwd"))
def g21_l5_contact_points(spark, sf):
    return dr.contact_points(fx.drift_forward(spark, sf)).select(*dr.PKEY)


cte("frame", """SELECT d.* FROM dfwd d JOIN (
    SELECT incident_id, t_h FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY t_h) - 1 AS i, count(*) OVER (PARTITION BY incident_id) AS n FROM (SELECT DISTINCT incident_id, t_h FROM dfwd)) x
    WHERE n <= 13 OR EXISTS (SELECT 1 FROM range(13) g(j) WHERE CASE WHEN j = 12 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 12e0)) AS BIGINT) END = i)) a USING (incident_id, t_h) JOIN (
    SELECT incident_id, p FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY incident_id) AS n FROM part0) x
    WHERE n <= 120 OR EXISTS (SELECT 1 FROM range(120) g(j) WHERE CASE WHEN j = 119 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 119e0)) AS BIGINT) END = i)) b USING (incident_id, p)""", "dfwd", "part0")


@query("g30_l5_centroid_path", q(f"SELECT incident_id, t_h, count(*) AS n, {r('avg(lat)', 9)} AS lat, {r('avg(lon)', 9)} AS lon FROM frame GROUP BY 1, 2", "frame"))
def g30_l5_centroid_path(spark, sf):
    f = dr.decimate_cloud(fx.drift_forward(spark, sf))
    return dr.centroid_path(f).select("incident_id", "t_h", "n", rd("lat", 9), rd("lon", 9))


cte("vpos", f"""SELECT p.incident_id, p.mmsi, g.t, coalesce(a.lat + (g.t - a.t_h) / (a.t2 - a.t_h) * (a.lat2 - a.lat), CASE WHEN g.t < s.f_h THEN s.f_lat ELSE s.l_lat END) AS lat,
  coalesce(a.lon + (g.t - a.t_h) / (a.t2 - a.t_h) * (a.lon2 - a.lon), CASE WHEN g.t < s.f_h THEN s.f_lon ELSE s.l_lon END) AS lon
  FROM pair p JOIN span s USING (mmsi) CROSS JOIN (SELECT -12e0 + 15e-1 * k AS t FROM range(9) r(k)) g
  LEFT JOIN track a ON a.mmsi = p.mmsi AND g.t >= a.t_h AND g.t < a.t2 WHERE g.t BETWEEN s.f_h - 0.25 AND s.l_h + 0.25""", "pair", "span", "track")
cte("vol", f"""SELECT v.incident_id, v.mmsi, v.t, avg(exp(-0.5 * pow(d / 7e0, 2))) AS overlap, min(d) AS nearest FROM (
  SELECT v.*, {km('v.lat', 'v.lon', 'd.lat', 'd.lon')} AS d FROM vpos v JOIN dback d ON d.incident_id = v.incident_id AND d.t_h = v.t) v GROUP BY 1, 2, 3""", "vpos", "dback")


@query("j10_cloud_volume_match", q(f"SELECT incident_id, mmsi, t AS t_h, {r('overlap')} AS overlap, {r('nearest')} AS nearest FROM vol", "vol"))
def j10_cloud_volume_match(spark, sf):
    m = ev.volume_match(pairs(spark, sf), fx.tracks(spark, sf), fx.drift_back(spark, sf))
    return m.select(*PAIR, "t_h", rd("overlap"), rd("nearest"))


@query("g7_cloud_ceiling", q(f"""
  SELECT incident_id, t_h, {r('max(m)')} AS ceiling FROM (SELECT a.incident_id, a.t_h, a.p, avg(exp(-0.5 * pow({km('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 7e0, 2))) AS m
    FROM dback a JOIN dback b ON a.incident_id = b.incident_id AND a.t_h = b.t_h GROUP BY 1, 2, 3) GROUP BY 1, 2""", "dback"))
def g7_cloud_ceiling(spark, sf):
    return ev.cloud_ceiling(fx.drift_back(spark, sf)).select("incident_id", "t_h", rd("ceiling"))


@query("g6_cloud_space_time_score")
def g6_cloud_space_time_score(spark, sf):
    d = fx.drift_back(spark, sf)
    m = ev.volume_match(pairs(spark, sf), fx.tracks(spark, sf), d)
    return ev.volume_score(m, ev.cloud_ceiling(d), fx.incidents(spark, sf))


@query("j11_land_test", q("""
  SELECT id, (lon > 73.4 AND lon < 75 AND lat > 16.2 AND lat < 18) OR (lat > 12 AND lat < 14 AND lon > 73.5 + (lat - 12) / 2 AND lon < 75.5 - (lat - 12) / 2) AS on_land
  FROM (SELECT id, coalesce(lat, 0e0) AS lat, coalesce(lon, 0e0) AS lon FROM kase)""", "kase"))
def j11_land_test(spark, sf):
    p = fx.cases(spark, sf).select("id", "lat", "lon")
    return sc.is_land(p, fx.land_edges(spark)).select("id", "on_land")


# -- assemblies -------------------------------------------------------------------------------------------------------
@query("d1_seed_particles")
def d1_seed_particles(spark, sf):
    return dr.seed_centroid(fx.drift_incidents(spark, sf), N_TEST)


@query("d3_particle_drift")
def d3_particle_drift(spark, sf):
    i = fx.drift_incidents(spark, sf)
    return dr.advect(dr.seed_centroid(i, N_TEST), i, fx.fields(spark, sf), hours=-48.0, record_every=1, seed=7, land=fx.land_edges(spark))


@query("d5_hindcast")
def d5_hindcast(spark, sf):
    return dr.hindcast(fx.drift_incidents(spark, sf), fx.fields(spark, sf), n=N_TEST, whole=False)["summary"]


@query("d6_forecast")
def d6_forecast(spark, sf):
    f = dr.forecast(fx.drift_incidents(spark, sf), fx.fields(spark, sf), n=N_TEST, land=fx.land_edges(spark), whole=False)
    return f["snapshot"].join(f["coast"].drop("fraction_beached"), "incident_id")


@query("d9_joint_drift")
def d9_joint_drift(spark, sf):
    h, f = dr.analyse(fx.drift_incidents(spark, sf), fx.fields(spark, sf), n=N_TEST, whole=False)
    return h["summary"].select("incident_id", "best_lat", "best_lon", "spread_km").join(f["snapshot"], "incident_id")


@query("d7_release_time_feedback")
def d7_release_time_feedback(spark, sf):
    """Every iteration of every incident, and beside it the origin, window and spread that the loop ended with."""
    log, final = dr.refine(fx.drift_incidents(spark, sf), durable(fx.fields(spark, sf)), at.rank_summaries(durable(fx.tracks(spark, sf))))
    last = final.select("incident_id", *[F.col(c).alias(f"final_{c}") for c in ("best_lat", "best_lon", "t0_h", "t1_h", "spread_km", "feedback")])
    return log.join(last, "incident_id", "left")


