"""Registered queries: zones, scope, alerts, records, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import alerts as al
from wakeline.operators import evidence as ev
from wakeline.operators import records as rec
from wakeline.operators import scope as sc
from wakeline.plans import fixtures as fx
from wakeline.plans.q_evidence import ranked, ranked_full
from wakeline.plans.registry import query, rd
from wakeline.plans.sqltext import cte, q, r
from wakeline.sources import zones as zn

_BOXES = [(b[0], *b[3:]) for b in zn.STATE_BOXES]
_ROWS = zn.catalogue_rows(fx.STUDY)
_ID = {row[1]: row[0] for row in _ROWS}
_PARENT = {row[1]: row[4] for row in _ROWS}


def _under(code):
    return [b for b in _BOXES if code in (b[0], _PARENT[b[0]], _PARENT[_PARENT[b[0]]])]


_ZONE_VALUES = ", ".join(
    f"({row[0]}, '{row[1]}', {_ID[row[4]] if row[4] else 'NULL'}, '{row[3]}', {zn.SPECIFICITY[row[3]]})" for row in _ROWS)
_BOX_VALUES = ", ".join(f"({_ID[row[1]]}, {w}e0, {s}e0, {e}e0, {n}e0)" for row in _ROWS
                        for _, w, s, e, n in (_under(row[1]) or [("", *fx.STUDY[0][4])]))
cte("zone", f"SELECT * FROM (VALUES {_ZONE_VALUES}) AS z(zone_id, code, parent_id, ztype, spec)")
cte("zbox", f"SELECT * FROM (VALUES {_BOX_VALUES}) AS b(zone_id, w, s, e, n)")
cte("down", """SELECT zone_id AS scope_id, zone_id FROM zone UNION ALL
  SELECT d.scope_id, z.zone_id FROM down d JOIN zone z ON z.parent_id = d.zone_id""", "zone")
cte("kase", """SELECT o_orderkey AS id, o_custkey AS c, o_custkey // 15 AS incident_id,
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'RESOLVED' END AS status,
  CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 2 THEN 'Oil-like anomaly' WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 4
       THEN 'Likely look-alike' ELSE 'No significant anomaly' END AS label,
  CASE WHEN o_orderkey % 11 <> 0 THEN (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000 END AS confidence,
  CASE WHEN o_orderkey % 4 <> 0 THEN (50 + o_custkey * 7 % 200) / 10 END AS lat,
  CASE WHEN o_orderkey % 4 <> 0 THEN (600 + o_custkey * 13 % 360) / 10 END AS lon,
  CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 16 > 0 THEN o_custkey % 16 END AS zid,
  CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 14 + 1 END AS cid FROM orders""")
cte("hit", "SELECT DISTINCT k.id, z.zone_id, z.code, z.spec FROM kase k JOIN zbox b ON k.lat BETWEEN b.s AND b.n AND k.lon BETWEEN b.w AND b.e JOIN zone z USING (zone_id)",
    "kase", "zbox", "zone")
cte("rowz", """SELECT id, zone_id FROM hit UNION SELECT id, zid FROM kase JOIN zone ON zone_id = zid UNION
  SELECT id, cid FROM kase WHERE cid IS NOT NULL""", "hit", "kase", "zone")
cte("usr", """SELECT c_custkey AS user_id, c_custkey % 7 <> 0 AS active,
  CASE WHEN c_custkey % 10 = 0 THEN 'NATIONAL' WHEN c_custkey % 10 <= 3 THEN 'REGIONAL' ELSE 'PILOT' END AS role,
  list_distinct(CASE WHEN c_nationkey % 15 > 0 THEN [c_nationkey % 15] ELSE [] END || CASE WHEN c_custkey % 3 = 0 THEN [c_nationkey * 5 % 14 + 1] ELSE [] END) AS zs
  FROM customer""")


@query("j2_s6_s7_zones_of_points", q("""
  SELECT k.id, coalesce(string_agg(h.code, '>' ORDER BY h.spec, h.zone_id), '') AS chain, arg_min(h.zone_id, h.spec * 100 + h.zone_id) AS primary_zone_id
  FROM kase k LEFT JOIN hit h USING (id) GROUP BY k.id""", "kase", "hit"))
def j2_s6_s7_zones_of_points(spark, sf):
    z = sc.zones_of(fx.cases(spark, sf).select("id", "lat", "lon"), fx.zone_edges(spark), fx.zones(spark))
    return z.select("id", F.array_join("chain", ">").alias("chain"), "primary_zone_id")


@query("j3_zone_closure", q("""
  SELECT user_id, zone_id FROM usr, zone WHERE role = 'NATIONAL'
  UNION SELECT u.user_id, d.zone_id FROM (SELECT user_id, unnest(zs) AS z FROM usr WHERE role <> 'NATIONAL') u JOIN down d ON d.scope_id = u.z""",
                            "usr", "zone", "down"))
def j3_zone_closure(spark, sf):
    return sc.accessible(fx.users(spark, sf), fx.zones(spark))


@query("j4_row_visibility", q("SELECT DISTINCT d.scope_id, z.id FROM rowz z JOIN down d USING (zone_id)", "rowz", "down"))
def j4_row_visibility(spark, sf):
    return sc.visible(fx.coded_cases(spark, sf), fx.scope_closure(spark), fx.zone_edges(spark), fx.zones(spark))


@query("j5_vessel_visibility", q("SELECT DISTINCT d.scope_id, k.c AS vessel_id FROM kase k JOIN hit USING (id) JOIN down d USING (zone_id)",
                                "kase", "hit", "down"))
def j5_vessel_visibility(spark, sf):
    return sc.visible_vessels(fx.cases(spark, sf), fx.scope_closure(spark), fx.zone_edges(spark))


@query("j6_codes_to_ids", q("SELECT id, cid AS zone_id FROM kase WHERE cid IS NOT NULL", "kase"))
def j6_codes_to_ids(spark, sf):
    return sc.codes_to_ids(fx.coded_cases(spark, sf), fx.zones(spark))


@query("j7_u3_manageable_users", q("""
  SELECT d.scope_id, u.user_id FROM (SELECT user_id, len(zs) AS n, unnest(zs) AS zone_id FROM usr WHERE role = 'PILOT') u JOIN down d USING (zone_id)
  GROUP BY d.scope_id, u.user_id HAVING count(*) = max(u.n)""", "usr", "down"))
def j7_u3_manageable_users(spark, sf):
    return sc.manageable(fx.users(spark, sf), fx.scope_closure(spark))


@query("g28_active_administrators", q("SELECT count(*) AS n FROM usr WHERE role = 'NATIONAL' AND active AND user_id <> 10", "usr"))
def g28_active_administrators(spark, sf):
    return sc.count_active(fx.users(spark, sf), exclude_id=10)


@query("p24_zone_list_in_scope", q("""
  SELECT z.zone_id, z.code, count(*) AS n_users FROM zone z JOIN down d USING (zone_id) JOIN (SELECT user_id, unnest(zs) AS scope_id FROM usr) u USING (scope_id)
  GROUP BY 1, 2""", "zone", "down", "usr"))
def p24_zone_list_in_scope(spark, sf):
    held = fx.users(spark, sf).select("user_id", F.explode("zone_ids").alias("scope_id"))
    per = fx.scope_closure(spark).join(held.groupBy("scope_id").agg(F.count(F.lit(1)).alias("_n")), "scope_id")
    n = per.groupBy("zone_id").agg(F.sum("_n").alias("n_users"))
    return sc.zone_list(fx.zones(spark), per).join(n, "zone_id").select("zone_id", "code", "n_users")


@query("j16_keyed_lookup", q("""
  SELECT x.scope_id, x.id, CASE WHEN k.id IS NULL THEN 'missing'
    WHEN EXISTS (SELECT 1 FROM rowz z JOIN down d USING (zone_id) WHERE z.id = x.id AND d.scope_id = x.scope_id) THEN 'found' ELSE 'forbidden' END AS verdict
  FROM (SELECT o_custkey % 15 + 1 AS scope_id, o_orderkey + o_orderkey % 2 * 7 AS id FROM orders) x LEFT JOIN kase k USING (id)""", "kase", "rowz", "down"))
def j16_keyed_lookup(spark, sf):
    c = fx.coded_cases(spark, sf)
    keys = fx.load(spark, sf, "orders").select((F.col("o_custkey") % 15 + 1).cast("int").alias("scope_id"),
                                               (F.col("o_orderkey") + F.col("o_orderkey") % 2 * 7).alias("id"))
    seen = sc.visible(c, fx.scope_closure(spark), fx.zone_edges(spark), fx.zones(spark))
    return sc.lookup(keys, c, seen).select("scope_id", "id", "verdict")


@query("l4_scoped_newest_page", q("""
  SELECT id, status FROM kase WHERE id IN (SELECT z.id FROM rowz z JOIN down d USING (zone_id) WHERE d.scope_id = 2) ORDER BY id DESC LIMIT 200 OFFSET 40""",
                                 "kase", "rowz", "down"))
def l4_scoped_newest_page(spark, sf):
    c = fx.coded_cases(spark, sf)
    mine = sc.visible(c, fx.scope_closure(spark).filter("scope_id = 2"), fx.zone_edges(spark), fx.zones(spark))
    return sc.page(c.join(mine, "id", "left_semi").select("id", "status"), 40, 200)


@query("s13_idempotent_seed", q("""
  SELECT u.n AS users_with_zone, z.zone_id, z.code, z.parent_id FROM zone z LEFT JOIN (SELECT unnest(zs) AS zone_id, count(*) AS n FROM usr GROUP BY 1) u USING (zone_id)""",
                                 "zone", "usr"))
def s13_idempotent_seed(spark, sf):
    z = fx.zones(spark).drop("parent_id", "specificity")
    s = zn.seed(z.filter(F.col("type") != "COASTAL_STATE"), z)
    n = fx.users(spark, sf).select(F.explode("zone_ids").alias("zone_id")).groupBy("zone_id").agg(F.count(F.lit(1)).alias("users_with_zone"))
    return s.join(n, "zone_id", "left").select("users_with_zone", "zone_id", "code", "parent_id")


# -- alerts -----------------------------------------------------------------------------------------------------------
cte("alert", """SELECT event_id AS alert_id, t_us, 5e0 + (u % 1500) * 5e-2 + (k % 3 - 1) * 4e-3 AS lat,
  6e1 + (k % 10) * 5e-2 + floor(u / 1500) * 6e-1 AS lon, k = 7 AS force, event_type, value,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'MOCKED' ELSE 'SENT' END AS outcome FROM ev""", "ev")
cte("printed", """SELECT *, '60m:' || CAST(floor(t_us / 3.6e9) AS BIGINT) AS time_bucket, substr(sha256('anomaly|' || round(round_even(lat / 5e-2, 0) * 5e-2, 4) || '|'
  || round(round_even(lon / 5e-2, 0) * 5e-2, 4) || '|60m:' || CAST(floor(t_us / 3.6e9) AS BIGINT) || '|-'), 1, 24) AS fingerprint FROM alert""", "alert")


def printed(spark, sf):
    a = fx.alerts(spark, sf)
    fp = al.fingerprint(F.col("kind"), F.col("lat"), F.col("lon"), F.col("t_us") / 1e6)
    return a.withColumns(fp)


@query("f15_alert_fingerprint", q("SELECT alert_id, time_bucket, fingerprint FROM printed", "printed"))
def f15_alert_fingerprint(spark, sf):
    return printed(spark, sf).select("alert_id", "time_bucket", "fingerprint")


@query("f16_geometry_signature", q("""
  SELECT z.code, count(k.id) AS n_cases, any_value(g.sig) AS geometry_signature FROM zone z JOIN (
    SELECT zone_id, round(min(w), 2) || ',' || round(min(s), 2) || ',' || round(max(e), 2) || ',' || round(max(n), 2) || ',' || round(sum((e - w) * (n - s)), 3) AS sig
    FROM zbox GROUP BY zone_id) g USING (zone_id) LEFT JOIN hit k USING (zone_id) GROUP BY z.code""", "zone", "zbox", "hit"))
def f16_geometry_signature(spark, sf):
    e = fx.zone_edges(spark)
    n = sc.points_in_zones(fx.cases(spark, sf).select("id", "lat", "lon"), e).groupBy("zone_id").agg(F.count(F.lit(1)).alias("_n"))
    return (al.geo_signature(e).join(fx.zones(spark).select("zone_id", "code"), "zone_id").join(n, "zone_id", "left")
            .select("code", F.coalesce("_n", F.lit(0)).alias("n_cases"), "geometry_signature"))


@query("j12_near_alerts", q("""
  SELECT a.alert_id, max(h.alert_id) AS near_id FROM alert a JOIN alert h ON h.outcome IN ('SENT', 'MOCKED', 'PENDING') AND h.lat IS NOT NULL
    AND (h.t_us < a.t_us OR (h.t_us = a.t_us AND h.alert_id < a.alert_id)) AND h.t_us >= a.t_us - 10800000000
    AND abs(h.lat - a.lat) <= 5e-2 AND abs(h.lon - a.lon) <= 5e-2 GROUP BY 1""", "alert"))
def j12_near_alerts(spark, sf):
    a = fx.alerts(spark, sf)
    h = a.withColumn("status", F.col("outcome")).withColumn("dedup_of_id", F.lit(None).cast("bigint"))
    return al.near_alerts(a, h)


@query("a1_exact_suppression", q("""
  , f AS (SELECT fingerprint, min(alert_id) AS first_id FROM printed WHERE outcome <> 'FAILED' GROUP BY 1),
  l AS (SELECT p.*, f.first_id, outcome <> 'FAILED' AND (force OR alert_id = first_id) AS live FROM printed p LEFT JOIN f USING (fingerprint))
  SELECT alert_id, CASE WHEN NOT force AND alert_id > coalesce(first_id, 9e18) THEN 'SUPPRESSED' ELSE outcome END AS status,
    CASE WHEN NOT force AND alert_id > coalesce(first_id, 9e18) THEN max(CASE WHEN live THEN alert_id END) OVER
      (PARTITION BY fingerprint ORDER BY alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS dedup_of_id FROM l""", "printed"))
def a1_exact_suppression(spark, sf):
    return al.suppress_exact(printed(spark, sf)).select("alert_id", "status", "dedup_of_id")


@query("a1_near_suppression", q("""
  , near AS MATERIALIZED (SELECT a.alert_id, h.alert_id AS h FROM alert a JOIN alert h ON NOT a.force AND h.outcome <> 'FAILED'
    AND (h.t_us < a.t_us OR (h.t_us = a.t_us AND h.alert_id < a.alert_id)) AND h.t_us >= a.t_us - 10800000000
    AND abs(h.lat - a.lat) <= 5e-2 AND abs(h.lon - a.lon) <= 5e-2),
  walk AS (SELECT alert_id, outcome, CASE WHEN force THEN 'free' ELSE 'open' END AS s, 0 AS n FROM alert
    UNION ALL
    SELECT w.alert_id, w.outcome, CASE WHEN w.s <> 'open' THEN w.s WHEN bool_or(p.s = 'free') THEN 'shut' WHEN bool_or(p.s = 'open') THEN 'open' ELSE 'free' END, w.n + 1
    FROM walk w LEFT JOIN near e USING (alert_id) LEFT JOIN walk p ON p.alert_id = e.h
    WHERE EXISTS (SELECT 1 FROM walk WHERE s = 'open') GROUP BY w.alert_id, w.outcome, w.s, w.n),
  done AS (SELECT * FROM walk WHERE n = (SELECT max(n) FROM walk)),
  original AS (SELECT e.alert_id, max(e.h) AS near_id FROM near e JOIN done d ON d.alert_id = e.h AND d.s = 'free' GROUP BY 1)
  SELECT d.alert_id, CASE WHEN near_id IS NOT NULL THEN 'SUPPRESSED' ELSE outcome END AS status, near_id AS dedup_of_id
  FROM done d LEFT JOIN original USING (alert_id)""", "alert"))
def a1_near_suppression(spark, sf):
    return al.suppress_near(fx.alerts(spark, sf))


@query("a1_suppression", q("""
  , posted AS (SELECT alert_id, t_us, force, outcome, CASE WHEN event_type <> 'signup' THEN lat END AS lat, CASE WHEN event_type <> 'signup' THEN lon END AS lon,
    CASE WHEN event_type <> 'signup' THEN fingerprint ELSE substr(sha256('anomaly|na|na|' || time_bucket || '|-'), 1, 24) END AS fp FROM printed),
  prior AS MATERIALIZED (SELECT a.alert_id, h.alert_id AS h, a.fp = h.fp AS same FROM posted a JOIN posted h ON NOT a.force AND h.outcome <> 'FAILED'
    AND (h.t_us < a.t_us OR (h.t_us = a.t_us AND h.alert_id < a.alert_id)) AND h.t_us >= a.t_us - 10800000000
    AND (a.fp = h.fp OR (abs(h.lat - a.lat) <= 5e-2 AND abs(h.lon - a.lon) <= 5e-2))),
  walk AS (SELECT alert_id, outcome, CASE WHEN force THEN 'free' ELSE 'open' END AS s, 0 AS n FROM posted
    UNION ALL
    SELECT w.alert_id, w.outcome, CASE WHEN w.s <> 'open' THEN w.s WHEN bool_or(p.s = 'free') THEN 'shut' WHEN bool_or(p.s = 'open') THEN 'open' ELSE 'free' END, w.n + 1
    FROM walk w LEFT JOIN prior e USING (alert_id) LEFT JOIN walk p ON p.alert_id = e.h
    WHERE EXISTS (SELECT 1 FROM walk WHERE s = 'open') GROUP BY w.alert_id, w.outcome, w.s, w.n),
  done AS (SELECT * FROM walk WHERE n = (SELECT max(n) FROM walk)),
  original AS (SELECT e.alert_id, coalesce(max(e.h) FILTER (same), max(e.h)) AS dup FROM prior e JOIN done d ON d.alert_id = e.h AND d.s = 'free' GROUP BY 1)
  SELECT d.alert_id, CASE WHEN dup IS NOT NULL THEN 'SUPPRESSED' ELSE outcome END AS status, dup AS dedup_of_id
  FROM done d LEFT JOIN original USING (alert_id)""", "printed"))
def a1_suppression(spark, sf):
    """Exact before near; alerts that stem from sign-ups have no place."""
    a = fx.alerts(spark, sf)
    here = lambda c: F.when(F.col("event_type") != "signup", F.col(c))
    a = a.withColumns({"lat": here("lat"), "lon": here("lon")})
    return al.suppress(a.withColumns(al.fingerprint(F.col("kind"), F.col("lat"), F.col("lon"), F.col("t_us") / 1e6)))


@query("a2_delivery_outcomes", q("""
  SELECT alert_id, CASE WHEN due AND NOT capped THEN CASE WHEN o IN ('SENT', 'MOCKED') THEN o ELSE 'FAILED' END ELSE outcome END AS status,
    CAST(attempts + CASE WHEN due AND NOT capped THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN due THEN 2 ELSE 1 END AS log_entries,
    CASE WHEN capped THEN 'retry cap (3) reached' WHEN due AND o = 'FAILED' THEN 'timeout' WHEN NOT due AND outcome = 'FAILED' THEN 'first' END AS last_error
  FROM (SELECT *, outcome IN ('FAILED', 'PENDING') AS due, outcome IN ('FAILED', 'PENDING') AND attempts >= 3 AS capped FROM (
    SELECT *, alert_id % 5 AS attempts, CASE WHEN value > 30 THEN 'FAILED' WHEN value > 10 THEN 'SENT' ELSE 'MOCKED' END AS o FROM alert))""", "alert"))
def a2_delivery_outcomes(spark, sf):
    a = fx.alerts(spark, sf)
    o = a.select("alert_id", F.when(F.col("value") > 30, "FAILED").when(F.col("value") > 10, "SENT").otherwise("MOCKED").alias("status"),
                 F.when(F.col("value") > 30, "timeout").alias("error"))
    entry = F.struct(F.lit(1).alias("attempt"), F.col("outcome").alias("status"), F.lit(None).cast("string").alias("error"))
    t = (a.select("alert_id", F.col("outcome").alias("status"), (F.col("alert_id") % 5).cast("int").alias("attempts"),
                  F.array(entry).alias("error_log"), F.when(F.col("outcome") == "FAILED", "first").alias("last_error")))
    return al.apply_outcomes(t, o).select("alert_id", "status", "attempts", F.size("error_log").alias("log_entries"), "last_error")


# -- records ----------------------------------------------------------------------------------------------------------
def fused_cases(spark, sf):
    return fx.cases(spark, sf).drop("_c")


@query("s8_vessel_upsert", q("""
  SELECT mmsi, coalesce(CASE WHEN mmsi % 2 = 0 THEN t.name END, d.name) AS name, coalesce(t.vt, d.vt) AS vessel_type, d.length_m AS length_m FROM
  (SELECT mmsi, arg_max(name, t_us) AS name, arg_max(vessel_type, t_us) AS vt FROM track GROUP BY mmsi) t
  FULL JOIN (SELECT 419000000 + c_custkey AS mmsi, c_name AS name, c_custkey % 100 AS vt, c_acctbal AS length_m FROM customer) d USING (mmsi)""", "track"))
def s8_vessel_upsert(spark, sf):
    dim = fx.load(spark, sf, "customer").select((F.lit(419000000) + F.col("c_custkey")).alias("mmsi"), F.col("c_name").alias("name"),
                                                (F.col("c_custkey") % 100).alias("vessel_type"), F.col("c_acctbal").alias("length_m"))
    t = fx.tracks(spark, sf).groupBy("mmsi").agg(F.max_by("name", "t_us").alias("name"), F.max_by("vessel_type", "t_us").alias("vessel_type"))
    t = t.withColumn("name", F.when(F.col("mmsi") % 2 == 0, F.col("name"))).withColumn("length_m", F.lit(None).cast("double"))
    return rec.upsert_vessels(dim, t)


cte("anom", """SELECT id AS case_id, NULL::BIGINT AS mmsi, CASE WHEN label = 'Oil-like anomaly' THEN 'OIL_LIKE' ELSE 'OTHER' END AS type, 'SAR' AS source,
  label, CAST(confidence AS DOUBLE) AS confidence FROM kase
  UNION ALL SELECT k.id, r.mmsi, CASE WHEN r.rank = 1 THEN 'ROUTE_DEVIATION' ELSE 'OTHER' END, 'FUSION',
  CASE WHEN r.rank = 1 THEN 'Attributed vessel' ELSE 'Candidate vessel' END, least(r.score / 100.0, 1.0) FROM kase k JOIN ranked r USING (incident_id)""",
    "kase", "ranked")


@query("s9_emit_anomalies", q(f"SELECT case_id, mmsi, type, source, label, {r('confidence', 4)} AS confidence FROM anom", "anom"))
def s9_emit_anomalies(spark, sf):
    return rec.emit_anomalies(fused_cases(spark, sf), ranked(spark, sf)).select(
        "case_id", "mmsi", "type", "source", "label", rd("confidence", 4))


@query("s10_replace_fusion", q("""
  SELECT source, type, count(*) AS n FROM (SELECT * FROM anom WHERE NOT (source = 'FUSION' AND case_id % 2 = 0)
  UNION ALL SELECT * FROM anom WHERE source = 'FUSION' AND case_id % 2 = 0 AND mmsi % 2 = 0
  UNION ALL SELECT * FROM anom WHERE false) GROUP BY 1, 2""", "anom"))
def s10_replace_fusion(spark, sf):
    a = rec.emit_anomalies(fused_cases(spark, sf), ranked(spark, sf))
    rerun = a.filter(F.col("case_id") % 2 == 0).select("case_id")
    new = a.filter((F.col("source") == "FUSION") & (F.col("case_id") % 2 == 0) & (F.col("mmsi") % 2 == 0))     # some cases rank nobody now
    kept = rec.replace_fusion(a, new, rerun)
    return kept.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


@query("j15_case_evidence_join", q("""
  SELECT k.id AS case_id, e.kind, count(e.kind) AS n, min(CASE WHEN e.kind = 'alert' THEN e.ref END) AS first_alert, max(CASE WHEN e.kind = 'alert' THEN e.ref END) AS last_alert
  FROM kase k LEFT JOIN (SELECT case_id, 'anomaly' AS kind, 0::BIGINT AS ref FROM anom UNION ALL SELECT alert_id % (SELECT count(*) FROM kase), 'alert', alert_id FROM alert) e ON e.case_id = k.id GROUP BY 1, 2""",
                                  "kase", "anom", "alert"))
def j15_case_evidence_join(spark, sf):
    a = rec.emit_anomalies(fused_cases(spark, sf), ranked(spark, sf))
    l = fx.alerts(spark, sf).withColumn("case_id", F.col("alert_id") % fx.cases(spark, sf).count())
    j = rec.case_join(fx.cases(spark, sf).select("case_id"), a, l)
    ref = F.when(F.col("kind") == "alert", F.col("ref_id"))
    return j.groupBy("case_id", "kind").agg(F.count("kind").alias("n"), F.min(ref).alias("first_alert"), F.max(ref).alias("last_alert"))


@query("s11_evidence_document")
def s11_evidence_document(spark, sf):
    c = fused_cases(spark, sf)
    rk = ranked_full(spark, sf)
    l = al.suppress_exact(printed(spark, sf)).withColumn("case_id", F.col("alert_id") % c.count())
    ch = sc.zones_of(c.select("id", "lat", "lon"), fx.zone_edges(spark), fx.zones(spark)).select(
        F.col("id").alias("case_id"), F.explode("chain").alias("code"))
    return rec.dossier(c, rec.emit_anomalies(c, rk), l, rk, zones=ch, top=8)


@query("s11_document_entries", q("""
  SELECT case_id, section, count(*) AS n FROM (SELECT id AS case_id, 'case' AS section FROM kase
    UNION ALL SELECT k.id, 'candidates' FROM kase k JOIN ranked USING (incident_id) UNION ALL SELECT case_id, 'anomalies' FROM anom
    UNION ALL SELECT alert_id % (SELECT count(*) FROM kase), 'alerts' FROM alert) GROUP BY 1, 2""", "kase", "ranked", "anom", "alert"))
def s11_document_entries(spark, sf):
    """Entries of each section of the evidence documents, counted in the JSON itself."""
    d = s11_evidence_document(spark, sf)
    entries = F.when(F.col("section") == "case", F.lit(1)).otherwise(F.json_array_length("document"))
    return d.groupBy("case_id", "section").agg(F.sum(entries).alias("n"))


@query("s14_trim_stage_results", q("""
  SELECT incident_id, least(count(*), 8) AS n_candidates, min(score) FILTER (rank <= 8) AS last_score FROM ranked GROUP BY 1""", "ranked"))
def s14_trim_stage_results(spark, sf):
    from wakeline.operators import drift as dr
    from wakeline.plans.q_drift import origin_points
    t = rec.trim_case(ranked(spark, sf), dr.heatmap(dr.origin_grid(origin_points(spark, sf))), 1200, 8).filter("candidates IS NOT NULL")
    return t.select("incident_id", F.size("candidates").cast("long").alias("n_candidates"), F.element_at("candidates", -1)["score"].alias("last_score"))


@query("p17_alert_eligibility", q("""
  SELECT k.id AS case_id, k.label = 'Oil-like anomaly' AND coalesce(k.confidence >= 0.75, false) AND r.mmsi IS NOT NULL AS alert,
    CASE WHEN k.label = 'Oil-like anomaly' THEN 'IN_PROGRESS' ELSE 'RESOLVED' END AS status
  FROM kase k LEFT JOIN ranked r ON r.incident_id = k.incident_id AND r.rank = 1""", "kase", "ranked"))
def p17_alert_eligibility(spark, sf):
    a = rec.alertable(fused_cases(spark, sf).drop("status"), ranked(spark, sf))
    return a.select("case_id", F.coalesce("alert", F.lit(False)).alias("alert"), "status")


@query("p19_row_validation", q("""
  SELECT seq, CASE WHEN abs(latitude) > 90 THEN 'lat' WHEN abs(longitude) > 180 THEN 'lon' WHEN NOT (sog / 40 BETWEEN 0 AND 1) THEN 'confidence'
    WHEN nav_status = 3 THEN 'title' WHEN nav_status = 4 THEN 'type' END AS reject_reason FROM pings""", "pings"))
def p19_row_validation(spark, sf):
    p = fx.pings_raw(spark, sf)
    rows = p.select("seq", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), (F.col("sog") / 40).alias("confidence"),
                    F.when(F.col("nav_status") == 3, "  ").otherwise(F.col("name")).alias("title"),
                    F.when(F.col("nav_status") == 4, "STRANGE").otherwise("OTHER").alias("type"))
    return rec.validate(rows).select("seq", "reject_reason")


@query("p19_default_zone", q("""
  SELECT k.id, coalesce(k.zid, (SELECT arg_min(h.zone_id, h.spec * 100 + h.zone_id) FROM hit h WHERE h.id = k.id)) AS jurisdiction_id FROM kase k""", "kase", "hit"))
def p19_default_zone(spark, sf):
    c = fx.cases(spark, sf)
    z = sc.zones_of(c.select("id", "lat", "lon", "jurisdiction_id"), fx.zone_edges(spark), fx.zones(spark))
    return z.select("id", F.coalesce("jurisdiction_id", "primary_zone_id").cast("long").alias("jurisdiction_id"))


@query("u2_keyed_override", q("""
  SELECT mmsi, coalesce(b.v, a.v) AS n FROM (SELECT mmsi, count(*) AS v FROM clean GROUP BY 1) a LEFT JOIN (SELECT mmsi, -count(*) AS v FROM track WHERE mmsi % 2 = 0 GROUP BY 1) b USING (mmsi)""",
                             "clean", "track"))
def u2_keyed_override(spark, sf):
    n = lambda df: df.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))
    new = n(fx.tracks(spark, sf)).filter(F.col("mmsi") % 2 == 0).withColumn("n", -F.col("n"))
    return rec.merge_views(n(fx.clean(spark, sf)), new, ["mmsi"])


@query("j13_track_view_enrichment", q("""
  SELECT p.incident_id, p.mmsi, r.rank, r.score, coalesce(r.rank = 1, false) AS is_prime FROM inwin p LEFT JOIN ranked r USING (incident_id, mmsi)
  WHERE p.min_km <= 2 * p.reach_km""", "inwin", "ranked"))
def j13_track_view_enrichment(spark, sf):
    from wakeline.operators.spatial import gate
    wide = gate(fx.tracks(spark, sf), fx.incidents(spark, sf).withColumn("spread_km", F.col("spread_km") * 2 + 25.0))
    return rec.enrich_views(wide.select(*ev.PAIR), ranked(spark, sf)).select(
        *ev.PAIR, "rank", "score", F.coalesce("is_prime", F.lit(False)).alias("is_prime"))


@query("g26_operations_kpis", q(f"""
  SELECT c.*, a.* FROM (SELECT count(*) AS investigations, count(*) FILTER (label = 'Oil-like anomaly' AND status IN ('OPEN', 'IN_PROGRESS')) AS active,
    count(*) FILTER (coalesce(confidence, 0) >= 0.75) AS high_confidence, count(*) FILTER (r.mmsi IS NOT NULL) AS prime_suspects,
    count(*) FILTER (label = 'Likely look-alike') AS look_alikes, count(*) FILTER (r.mmsi % 2 = 0) AS top1_correct, count(r.mmsi) AS top1_known,
    {r('avg(confidence)')} AS mean_confidence FROM kase k LEFT JOIN ranked r ON r.incident_id = k.incident_id AND r.rank = 1) c,
  (SELECT count(*) FILTER (outcome IN ('SENT', 'MOCKED')) AS delivered, 0::BIGINT AS suppressed, count(*) FILTER (outcome = 'FAILED') AS failed FROM alert) a""",
                               "kase", "ranked", "alert"))
def g26_operations_kpis(spark, sf):
    prime = ranked(spark, sf).filter("rank = 1").select("incident_id", (F.col("mmsi") % 2 == 0).alias("truth_first"))
    c = fused_cases(spark, sf).join(prime, "incident_id", "left").withColumn("prime", F.col("truth_first").isNotNull())
    k = rec.kpis(c, fx.alerts(spark, sf).withColumn("status", F.col("outcome")))
    return k.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("g26_tallies", q("""
  SELECT 'status' AS facet, status AS value, count(*) AS n FROM kase GROUP BY status UNION ALL SELECT 'verdict', label, count(*) FROM kase GROUP BY label
  UNION ALL SELECT 'all', 'all', count(*) FROM kase""", "kase"))
def g26_tallies(spark, sf):
    return rec.tallies(fx.cases(spark, sf))


@query("g29_case_timeline", q("""
  SELECT i.incident_id, e.event, CAST(least(greatest(e.a, -48), 48) AS DOUBLE) AS start_h, CAST(least(greatest(e.b, -48), 48) AS DOUBLE) AS end_h
  FROM incident i LEFT JOIN (SELECT p.incident_id, min(s.f_h) AS f FROM pair p JOIN span s USING (mmsi) GROUP BY 1) s USING (incident_id),
  LATERAL (SELECT unnest([{'event': 'ais', 'a': coalesce(s.f, -12.0)::DOUBLE, 'b': 0.0::DOUBLE}, {'event': 'release_window', 'a': i.w0::DOUBLE, 'b': i.w1::DOUBLE},
    {'event': 'detection', 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}, {'event': 'horizon_6', 'a': 6.0::DOUBLE, 'b': 6.0::DOUBLE}, {'event': 'horizon_12', 'a': 12.0::DOUBLE, 'b': 12.0::DOUBLE},
    {'event': 'horizon_24', 'a': 24.0::DOUBLE, 'b': 24.0::DOUBLE}, {'event': 'horizon_48', 'a': 48.0::DOUBLE, 'b': 48.0::DOUBLE}], recursive := true)) e""",
                             "incident", "pair", "span"))
def g29_case_timeline(spark, sf):
    from wakeline.operators.spatial import spans
    from wakeline.plans.q_evidence import pairs
    seen = pairs(spark, sf).join(spans(fx.tracks(spark, sf)).select("mmsi", F.col("first.t_h").alias("first_seen_h")), "mmsi")
    return rec.timeline(fx.incidents(spark, sf), seen)


@query("f18_json_path_reads", """
  SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS value, 'none' AS missing FROM events""")
def f18_json_path_reads(spark, sf):
    e = fx.load(spark, sf, "events").select("event_id", "props")
    a = rec.json_value(e, "props", "$.k", 0)
    return a.select("event_id", "value", F.coalesce(F.get_json_object("props", "$.sar.confidence"), F.lit("none")).alias("missing"))


