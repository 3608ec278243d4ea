"""Oracle side: DuckDB expressions and the shared table definitions the oracle queries start from."""

from __future__ import annotations

R_M = 6371008.8


def hav(a, b, c, d, k=2 * R_M):
    """Great-circle distance in metres."""
    return (f"({k} * asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a}))"
            f" * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))))))")


def km(a, b, c, d):
    return f"({hav(a, b, c, d)} / 1000.0)"


def pmod(x, m):
    return f"(({x}) - {m} * floor(({x}) / {m}))"


def bearing(a, b, c, d):
    y = f"sin(radians(({d}) - ({b}))) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))"
    return pmod(f"degrees(atan2({y}, {x})) + 360.0", 360.0)


def axis_diff(a, b):
    d = f"abs({pmod(f'({b}) - ({a}) + 180.0', 360.0)} - 180.0)"
    return f"least({d}, 180.0 - {d})"


def m_lat(p):
    return f"(111132.92 - 559.82 * cos(2 * radians({p})) + 1.175 * cos(4 * radians({p})))"


def m_lon(p):
    return f"greatest(111412.84 * cos(radians({p})) - 93.5 * cos(3 * radians({p})), 1e-6)"


def clip(x, lo=0.0, hi=1.0):
    return f"least(greatest({x}, {lo}), {hi})"


def r(x, n=6):
    """Rounded, never minus zero."""
    return f"(round({x}, {n}) + 0.0)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    CTES[name] = (deps, text)


def q(text: str, *names: str) -> str:
    """Prefix a query with the definitions it needs."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    if not order:
        return text
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + text


# -- AIS pings ----------------------------------------------------------------------------------------------------
cte("ev", """
  SELECT event_id, user_id AS u, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (epoch_us(ts) - 1704067200000000) // 60 AS t_us,
         ((epoch_us(ts) - 1704067200000000) // 60) / 3.6e9 AS th
  FROM events""")
cte("pings", """
  SELECT event_id * 2 + copy AS seq,
         CASE WHEN k = 95 THEN NULL ELSE [419, 636, 563, 999][CAST(u % 4 AS INTEGER) + 1] * 1000000 + u END AS mmsi,
         CASE WHEN k = 96 THEN NULL ELSE t_us END AS t_us,
         CASE WHEN k = 96 THEN NULL ELSE th - 12.0 END AS t_h,
         CASE WHEN k = 99 THEN 200.0 WHEN k = 97 THEN 0.0 ELSE 15.5e0 + ((13 * u % 41) - 20) * 2e-2
              + ((7 * u % 21) - 10) * 2e-2 * (th - 6.0) + (k - 50) * 2e-4 END AS latitude,
         CASE WHEN k = 98 THEN NULL WHEN k = 97 THEN 0.0 ELSE 73.1e0 + ((17 * u % 41) - 20) * 2e-2
              + ((11 * u % 21) - 10) * 2e-2 * (th - 6.0) + (k - 50) * 2e-4 END AS longitude,
         value / 4 AS sog, CAST((37 * k + 11 * u) % 400 AS DOUBLE) AS cog,
         CAST(CASE WHEN k % 10 = 0 THEN 511 ELSE (37 * k + 11 * u) % 400 END AS DOUBLE) AS heading,
         CAST(3 * (k - 50) AS DOUBLE) AS rot, 30 + (7 * u % 70) AS vessel_type, k % 16 AS nav_status,
         'V' || u AS name
  FROM ev, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS c(copy)""", "ev")
cte("classed", """
  SELECT *, CASE WHEN mmsi IS NULL THEN 'no_mmsi' WHEN t_us IS NULL THEN 'time'
                 WHEN latitude IS NULL OR longitude IS NULL OR abs(latitude) > 90 OR abs(longitude) > 180 THEN 'coords'
                 WHEN abs(latitude) < 1e-6 AND abs(longitude) < 1e-6 THEN 'null_island' END AS reason
  FROM pings""", "pings")
cte("clean", """
  SELECT seq, mmsi, t_us, t_h, latitude AS lat, longitude AS lon,
         CASE WHEN sog BETWEEN 0 AND 80 THEN sog END AS sog0, CASE WHEN cog >= 0 AND cog < 360 THEN cog END AS cog0,
         CASE WHEN heading >= 0 AND heading < 360 THEN heading END AS heading,
         CASE WHEN rot BETWEEN -128 AND 128 THEN rot END AS rot0, vessel_type, nav_status, name
  FROM classed WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY mmsi, t_us, round(latitude, 6), round(longitude, 6) ORDER BY seq) = 1""",
    "classed")
cte("strict", """
  SELECT *, coalesce(sog0, 0.0) AS sog, coalesce(cog0, 0.0) AS cog, coalesce(rot0, 0.0) AS rot FROM clean
  QUALIFY row_number() OVER (PARTITION BY mmsi, t_us ORDER BY seq) = 1""", "clean")
cte("st", """
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_us) AS i, count(*) OVER (PARTITION BY mmsi) AS n FROM strict
  QUALIFY n >= 2""", "strict")
cte("walk", f"""
  SELECT mmsi, i, true AS keep, t_h AS lt, lat AS la, lon AS lo FROM st WHERE i = 1
  UNION ALL
  SELECT s.mmsi, s.i, x.ok, CASE WHEN x.ok THEN s.t_h ELSE w.lt END, CASE WHEN x.ok THEN s.lat ELSE w.la END,
         CASE WHEN x.ok THEN s.lon ELSE w.lo END
  FROM walk w JOIN st s ON s.mmsi = w.mmsi AND s.i = w.i + 1,
       LATERAL (SELECT {hav('w.la', 'w.lo', 's.lat', 's.lon')} / ((s.t_h - w.lt) * 3600.0) * (1.0 / 0.514444) <= 45.0 AS ok) x
  """, "st")
cte("track", """
  SELECT s.*, row_number() OVER p AS fix, lead(s.t_h) OVER p AS t2, lead(s.lat) OVER p AS lat2, lead(s.lon) OVER p AS lon2
  FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS n2 FROM walk WHERE keep) w
  JOIN st s ON s.mmsi = w.mmsi AND s.i = w.i WHERE n2 >= 2
  WINDOW p AS (PARTITION BY s.mmsi ORDER BY s.t_us)""", "walk", "st")
cte("gap", "SELECT mmsi, t_h AS start_h, t2 AS end_h, (t2 - t_h) * 60.0 AS minutes FROM track WHERE (t2 - t_h) * 60.0 > 20.0",
    "track")
# -- incidents ------------------------------------------------------------------------------------------------------
cte("incident", """
  SELECT s_suppkey AS incident_id, 15.5e0 + ((5 * s_suppkey % 61) - 30) * 1e-1 AS origin_lat,
         73.1e0 + ((17 * s_suppkey % 61) - 30) * 1e-1 AS origin_lon,
         -(6e0 + s_suppkey % 6) AS w0, -1e0 AS w1, (s_suppkey % 4) * 2.5e0 AS spread_km,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 15.6e0 + ((5 * s_suppkey % 61) - 30) * 1e-1 END AS centroid_lat,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 73.22e0 + ((17 * s_suppkey % 61) - 30) * 1e-1 END AS centroid_lon,
         -(6e0 + s_suppkey % 6) AS prior0, -3e0 AS prior1, 450e0 + 100e0 * (s_suppkey % 20) AS width_m,
         5e0 + s_suppkey % 15 AS area_km2, CAST(s_nationkey AS INTEGER) AS nationkey, s_acctbal AS acctbal
  FROM supplier""")
cte("win", "SELECT *, w0 - 2.0 AS p0, w1 + 2.0 AS p1, 25.0 + spread_km AS reach_km FROM incident", "incident")
cte("inwin", f"""
  SELECT i.incident_id, t.mmsi, count(*) AS n_in, min({km('t.lat', 't.lon', 'i.origin_lat', 'i.origin_lon')}) AS min_km,
         min(i.reach_km) AS reach_km
  FROM win i JOIN track t ON t.t_h BETWEEN i.p0 AND i.p1 GROUP BY 1, 2""", "win", "track")
cte("pair", "SELECT incident_id, mmsi, n_in, min_km FROM inwin WHERE min_km <= reach_km", "inwin")

# -- evidence ---------------------------------------------------------------------------------------------------------
cte("span", """SELECT mmsi, min(t_h) AS f_h, max(t_h) AS l_h, arg_min(lat, t_h) AS f_lat, arg_min(lon, t_h) AS f_lon,
  arg_max(lat, t_h) AS l_lat, arg_max(lon, t_h) AS l_lon, arg_max(sog, t_h) AS l_sog, arg_max(cog, t_h) AS l_cog
  FROM track GROUP BY mmsi""", "track")
cte("pl", """SELECT p.incident_id, p.mmsi, i.* EXCLUDE (incident_id), t.* EXCLUDE (mmsi), t.t_h BETWEEN i.p0 AND i.p1 AS a_in,
  t.t2 BETWEEN i.p0 AND i.p1 AS b_in
  FROM pair p JOIN win i USING (incident_id) JOIN track t USING (mmsi)
  WHERE t.t2 IS NOT NULL AND (t.t_h BETWEEN i.p0 AND i.p1 OR t.t2 BETWEEN i.p0 AND i.p1)""", "pair", "win", "track")
cte("cpa0", f"""SELECT incident_id, mmsi, t_us, t_h, t2, origin_lat, origin_lon,
  (lon - origin_lon) * {m_lon('origin_lat')} AS ax, (lat - origin_lat) * {m_lat('origin_lat')} AS ay,
  (lon2 - origin_lon) * {m_lon('origin_lat')} AS bx, (lat2 - origin_lat) * {m_lat('origin_lat')} AS by_ FROM pl""", "pl")
cte("cpa1", f"""SELECT *, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) < 1e-9 THEN 0.0 ELSE
  {clip('-(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2))')} END AS s FROM cpa0""", "cpa0")
cte("cpa", f"""SELECT incident_id, mmsi, sqrt(pow(ax + s * (bx - ax), 2) + pow(ay + s * (by_ - ay), 2)) / 1000.0 AS cpa_km,
  t_h + s * (t2 - t_h) AS cpa_time_h, origin_lat + (ay + s * (by_ - ay)) / {m_lat('origin_lat')} AS cpa_lat,
  origin_lon + (ax + s * (bx - ax)) / {m_lon('origin_lat')} AS cpa_lon, origin_lat, origin_lon FROM cpa1
  QUALIFY row_number() OVER (PARTITION BY incident_id, mmsi ORDER BY cpa_km, t_us) = 1""", "cpa1")
cte("inw", f"""SELECT p.incident_id, p.mmsi, t.t_h, t.lat, t.lon, i.origin_lat, i.origin_lon, i.centroid_lat, i.centroid_lon,
  {km('t.lat', 't.lon', 'i.origin_lat', 'i.origin_lon')} <= 25.0 AS near,
  lead(t.t_h) OVER w AS n_h, lead({km('t.lat', 't.lon', 'i.origin_lat', 'i.origin_lon')} <= 25.0) OVER w AS n_near
  FROM pair p JOIN win i USING (incident_id) JOIN track t ON t.mmsi = p.mmsi AND t.t_h BETWEEN i.p0 AND i.p1
  WINDOW w AS (PARTITION BY p.incident_id, p.mmsi ORDER BY t.t_h)""", "pair", "win", "track")
cte("dwell", f"""SELECT incident_id, mmsi, count(*) AS n, CASE WHEN count(*) > 1 AND max(t_h) > min(t_h) THEN
  {clip('coalesce(sum(n_h - t_h) FILTER (near OR n_near), 0.0) / (max(t_h) - min(t_h))')} ELSE 0.0 END AS dwell,
  CASE WHEN count(*) > 1 THEN coalesce(sum(n_h - t_h) FILTER (near OR n_near), 0.0) * 60 ELSE 0.0 END AS minutes_in_radius,
  CASE WHEN count(*) > 1 THEN (max(t_h) - min(t_h)) * 60 ELSE 0.0 END AS observed_minutes FROM inw GROUP BY 1, 2""", "inw")
cte("axis0", f"""SELECT incident_id, mmsi, {bearing('any_value(origin_lat)', 'any_value(origin_lon)', 'any_value(centroid_lat)', 'any_value(centroid_lon)')} AS axis_deg,
  CASE WHEN count(*) > 1 THEN {bearing('arg_min(lat, t_h)', 'arg_min(lon, t_h)', 'arg_max(lat, t_h)', 'arg_max(lon, t_h)')} END AS course_deg,
  {km('avg(lat)', 'avg(lon)', 'any_value(centroid_lat)', 'any_value(centroid_lon)')} AS centroid_km FROM inw GROUP BY 1, 2""", "inw")
cte("axis", f"""SELECT *, {axis_diff('course_deg', 'axis_deg')} AS axis_diff_deg,
  CASE WHEN course_deg IS NULL OR axis_deg IS NULL THEN 0.0 ELSE {clip("1.0 - " + axis_diff('course_deg', 'axis_deg') + " / 55.0")} END AS axis_alignment
  FROM axis0""", "axis0")
cte("dark", """SELECT p.incident_id, p.mmsi, coalesce(max(greatest(0.0, least(round(g.end_h, 3), i.w1) - greatest(round(g.start_h, 3), i.w0))), 0.0) * 60 AS dark_min
  FROM pair p JOIN incident i USING (incident_id) LEFT JOIN gap g USING (mmsi) GROUP BY 1, 2""", "pair", "incident", "gap")
cte("st0", """SELECT p.incident_id, p.mmsi, g.i, greatest(CAST((i.p1 - i.p0) * 6 AS INTEGER) + 2, 8) AS n,
  greatest(i.p0, s.f_h) AS a, least(i.p1, s.l_h) AS b, i.origin_lat, i.origin_lon, i.prior0, i.prior1
  FROM pair p JOIN win i USING (incident_id) JOIN span s USING (mmsi),
       LATERAL (SELECT unnest(range(greatest(CAST((i.p1 - i.p0) * 6 AS INTEGER) + 2, 8))) AS i) g""", "pair", "win", "span")
cte("st1", """SELECT *, CASE WHEN i = n - 1 THEN b ELSE i * ((b - a) / (n - 1)) + a END AS t FROM st0""", "st0")
cte("st2", f"""SELECT s.incident_id, s.mmsi, s.i, s.t, prior0, prior1, {km('x.lat + (s.t - x.t_h) / (coalesce(x.t2, x.t_h + 1) - x.t_h) * (coalesce(x.lat2, x.lat) - x.lat)', 'x.lon + (s.t - x.t_h) / (coalesce(x.t2, x.t_h + 1) - x.t_h) * (coalesce(x.lon2, x.lon) - x.lon)', 's.origin_lat', 's.origin_lon')} AS d
  FROM st1 s JOIN track x ON x.mmsi = s.mmsi AND s.t >= x.t_h AND (s.t < x.t2 OR x.t2 IS NULL)""", "st1", "track")
cte("st3", """SELECT *, exp(-0.5 * pow(d / 7.0, 2)) AS ov FROM st2""", "st2")
cte("st4", """SELECT *, first_value(t) OVER w AS bt, first_value(d) OVER w AS bd, first_value(ov) OVER w AS bo FROM st3
  WINDOW w AS (PARTITION BY incident_id, mmsi ORDER BY ov DESC, i)""", "st3")
cte("stx", f"""SELECT incident_id, mmsi, any_value(bt) AS best_t, any_value(bd) AS best_km, any_value(bo) AS overlap, count(*) AS n_samples,
  avg(ov) FILTER (abs(t - bt) <= 1.5) AS consist,
  CASE WHEN any_value(bt) < any_value(prior0) - 8 OR any_value(bt) > any_value(prior1) + 8 THEN 0.8 ELSE 1.0 END AS prior,
  {clip("(0.42 * exp(-0.5 * pow(any_value(bd) / 5.0, 2)) + 0.36 * least(any_value(bo), 1.0) + 0.22 * least(avg(ov) FILTER (abs(t - bt) <= 1.5), 1.0)) * CASE WHEN any_value(bt) < any_value(prior0) - 8 OR any_value(bt) > any_value(prior1) + 8 THEN 0.8 ELSE 1.0 END")} AS st
  FROM st4 GROUP BY 1, 2""", "st4")
cte("vtype", """SELECT mmsi, CASE WHEN v BETWEEN 80 AND 89 THEN 1.0 WHEN v BETWEEN 70 AND 79 THEN 0.72 WHEN v BETWEEN 60 AND 69 THEN 0.35
  WHEN v BETWEEN 40 AND 49 THEN 0.25 WHEN v = 30 THEN 0.3 WHEN v IN (31, 32) OR v BETWEEN 50 AND 59 THEN 0.4
  WHEN v BETWEEN 33 AND 35 THEN 0.2 WHEN v IN (36, 37) THEN 0.15 ELSE 0.3 END AS prior
  FROM (SELECT mmsi, arg_max(vessel_type, t_us) AS v FROM track GROUP BY mmsi)""", "track")
cte("evid", """SELECT c.incident_id, c.mmsi, st.st, ax.axis_alignment AS ax, ax.axis_deg IS NOT NULL AS ax_ok,
  CASE WHEN c.cpa_km >= 25 THEN 0.0 ELSE greatest(0.0, 1.0 - sqrt(c.cpa_km / 25.0)) END AS pr, d.dwell AS dw,
  least(dk.dark_min / 120.0, 1.0) AS bl, v.prior AS vp, c.cpa_km, st.best_t
  FROM cpa c JOIN stx st USING (incident_id, mmsi) JOIN axis ax USING (incident_id, mmsi) JOIN dwell d USING (incident_id, mmsi)
  JOIN dark dk USING (incident_id, mmsi) JOIN vtype v USING (mmsi)""", "cpa", "stx", "axis", "dwell", "dark", "vtype")

cte("fused", """SELECT *, least(greatest(raw * gate, 0.0), 100.0) AS total FROM (
  SELECT *, (0.3 * st + CASE WHEN ax_ok THEN 0.18 ELSE 0.0 END * ax + 0.14 * pr + 0.1 * dw + 0.1 * bl + 0.09 * vp) * 100.0
         / (0.3 + CASE WHEN ax_ok THEN 0.18 ELSE 0.0 END + 0.14 + 0.1 + 0.1 + 0.09) AS raw,
         (0.3 + CASE WHEN ax_ok THEN 0.18 ELSE 0.0 END + 0.14 + 0.1 + 0.1 + 0.09) AS den,
         least(greatest(greatest(st, pr) / 0.12, 0.0), 1.0) AS gate FROM evid)""", "evid")

cte("based", """SELECT *, least(greatest(raw * gate, 0.0), 100.0) AS total FROM (
  SELECT *, (0.45 * st + CASE WHEN ax_ok THEN 0.3 ELSE 0.0 END * ax + 0.15 * pr + 0.1 * dw + 0.0 * bl + 0.0 * vp) * 100.0
         / (0.45 + CASE WHEN ax_ok THEN 0.3 ELSE 0.0 END + 0.15 + 0.1 + 0.0 + 0.0) AS raw,
         (0.45 + CASE WHEN ax_ok THEN 0.3 ELSE 0.0 END + 0.15 + 0.1 + 0.0 + 0.0) AS den,
         least(greatest(greatest(st, pr) / 0.12, 0.0), 1.0) AS gate FROM evid)""", "evid")

cte("ranked", """SELECT *, round(total, 2) AS score, row_number() OVER (PARTITION BY incident_id ORDER BY round(total, 2) DESC, mmsi) AS rank,
  CASE WHEN total >= 70 THEN 'PRIME_SUSPECT' WHEN total >= 45 THEN 'PERSON_OF_INTEREST' WHEN total >= 20 THEN 'WEAK_LEAD'
  WHEN total < 8 THEN 'CLEARED' ELSE 'BACKGROUND_TRAFFIC' END AS assessment FROM fused""", "fused")
