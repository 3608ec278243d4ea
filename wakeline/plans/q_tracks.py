"""Registered queries: AIS cleaning, tracks, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import labels as lb
from wakeline.operators import clean as cl
from wakeline.operators import tracks as tr
from wakeline.plans import fixtures as fx
from wakeline.plans.registry import query, rd
from wakeline.plans.sqltext import pmod, q, r
from wakeline.sources import ais


@query("s2_header_aliases", q("""
  SELECT seq, mmsi, t_us, latitude, longitude, sog, name FROM pings""", "pings"))
def s2_header_aliases(spark, sf):
    p = fx.pings_raw(spark, sf)
    odd = p.select("seq", F.col("mmsi").alias("﻿MMSI"), F.col("timestamp").alias("BaseDateTime"),
                   F.lit(-1.0).alias("lat"), F.col("latitude").alias("LAT "), F.col("longitude").alias("Lng"),
                   F.col("sog").alias("Speed Over Ground"), F.col("name").alias("ShipName"))
    c = ais.canonicalise(odd)
    return c.select("seq", "mmsi", (F.unix_micros("timestamp") - fx.EPOCH_US).alias("t_us"),
                    "latitude", "longitude", "sog", "name")


@query("s3_u1_union_record_groups", q("""
  SELECT mmsi, 2 * count(*) AS n, sum(CASE WHEN seq % 2 = 0 THEN 2 ELSE 2 END)::BIGINT AS w FROM pings GROUP BY mmsi""", "pings"))
def s3_u1_union_record_groups(spark, sf):
    p = fx.pings_raw(spark, sf)
    groups = p.select(F.array(F.struct("mmsi", "seq", F.col("latitude").alias("lat"))).alias("records"))
    two = ais.union_tracks([groups, p.select(F.array(F.struct("mmsi", "seq")).alias("records"))])
    return two.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1).cast("long")).alias("w"))


@query("p1_parse_time", """
  WITH s AS (SELECT event_id, date_trunc('second', ts) AS s FROM events)
  SELECT event_id, epoch_us(s) AS iso, epoch_us(s) AS zulu, epoch_us(s) AS spaced, epoch_us(s) AS slashed,
         epoch_us(s) AS dmy, epoch_us(date_trunc('minute', s)) AS minutes, epoch_us(s) AS epoch_s, epoch_us(s) AS epoch_ms,
         CAST(NULL AS BIGINT) AS junk, CAST(NULL AS BIGINT) AS digits
  FROM s""")
def p1_parse_time(spark, sf):
    s = F.date_trunc("second", F.col("ts").cast("timestamp"))
    f = lambda p: F.date_format(s, p)
    e = fx.load(spark, sf, "events").select(
        "event_id", f("yyyy-MM-dd'T'HH:mm:ss").alias("iso"), f("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("zulu"),
        f("yyyy-MM-dd HH:mm:ss").alias("spaced"), f("yyyy/MM/dd HH:mm:ss").alias("slashed"),
        f("dd-MM-yyyy HH:mm:ss").alias("dmy"), f("yyyy-MM-dd HH:mm").alias("minutes"),
        F.unix_seconds(s).alias("epoch_s"), (F.unix_seconds(s) * 1000).alias("epoch_ms"),
        F.concat(F.lit("at "), f("HH:mm")).alias("junk"), F.unix_seconds(s).cast("string").alias("digits"))
    t = dict(e.dtypes)
    return e.select("event_id", *[F.unix_micros(cl.parse_ts(c, t[c])).alias(c) for c in e.columns[1:]])


@query("p2_finite_float", """
  SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'click') THEN NULL ELSE value END AS v FROM events""")
def p2_finite_float(spark, sf):
    e = fx.load(spark, sf, "events")
    text = (F.when(F.col("event_type") == "error", "NaN").when(F.col("event_type") == "view", "-Infinity")
            .when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string")))
    return e.select("event_id", lb.finite(text).alias("v"))


@query("p3_reject_classes", q("SELECT seq, reason AS reject_reason FROM classed", "classed"))
def p3_reject_classes(spark, sf):
    return cl.classify(fx.pings_raw(spark, sf)).select("seq", "reject_reason")


@query("p4_domain_nulling", q("SELECT seq, sog0 AS sog, cog0 AS cog, heading, rot0 AS rot FROM clean", "clean"))
def p4_domain_nulling(spark, sf):
    return fx.clean(spark, sf).select("seq", "sog", "cog", "heading", "rot")


@query("p5_dedup_pings", q("""
  SELECT seq, CASE WHEN row_number() OVER (PARTITION BY mmsi, t_us, round(latitude, 6), round(longitude, 6) ORDER BY seq) > 1
         THEN 'duplicate' END AS reject_reason FROM classed WHERE reason IS NULL""", "classed"))
def p5_dedup_pings(spark, sf):
    c = cl.classify(fx.pings_raw(spark, sf)).filter(F.col("reject_reason").isNull())
    return cl.mark_duplicates(c).select("seq", "reject_reason")


@query("g1_cleaning_report", q("""
  SELECT count(*) AS "input", (SELECT count(*) FROM clean) AS kept,
         count(*) FILTER (reason = 'no_mmsi') AS dropped_no_mmsi, count(*) FILTER (reason = 'time') AS dropped_time,
         count(*) FILTER (reason = 'coords') AS dropped_coords, count(*) FILTER (reason = 'null_island') AS dropped_null_island,
         count(*) FILTER (reason IS NULL) - (SELECT count(*) FROM clean) AS dropped_duplicate,
         count(DISTINCT mmsi) FILTER (reason IS NULL) AS vessels FROM classed""", "clean"))
def g1_cleaning_report(spark, sf):
    return cl.clean_report(fx.pings_raw(spark, sf))


@query("p6_p7_p9_type_status_bands", q("""
  SELECT seq, CASE WHEN vessel_type BETWEEN 80 AND 89 THEN 'TANKER' WHEN vessel_type BETWEEN 70 AND 79 THEN 'CARGO'
    WHEN vessel_type BETWEEN 60 AND 69 THEN 'PASSENGER' WHEN vessel_type BETWEEN 40 AND 49 THEN 'HSC'
    WHEN vessel_type = 30 THEN 'FISHING' WHEN vessel_type IN (31, 32) OR vessel_type BETWEEN 50 AND 59 THEN 'TUG'
    WHEN vessel_type BETWEEN 33 AND 35 THEN 'MILITARY' WHEN vessel_type IN (36, 37) THEN 'PLEASURE'
    WHEN vessel_type BETWEEN 90 AND 99 THEN 'OTHER' ELSE 'UNKNOWN' END AS type_group,
    CASE nav_status WHEN 0 THEN 'Under way using engine' WHEN 1 THEN 'At anchor' WHEN 2 THEN 'Not under command'
    WHEN 3 THEN 'Restricted manoeuvrability' WHEN 4 THEN 'Constrained by draught' WHEN 5 THEN 'Moored'
    WHEN 6 THEN 'Aground' WHEN 7 THEN 'Engaged in fishing' WHEN 8 THEN 'Under way sailing' WHEN 11 THEN 'Under tow astern'
    WHEN 12 THEN 'Under tow alongside' WHEN 15 THEN 'Undefined' ELSE 'Status ' || nav_status END AS nav_label,
    CASE WHEN cog / 4 >= 70 THEN 'PRIME_SUSPECT' WHEN cog / 4 >= 45 THEN 'PERSON_OF_INTEREST' WHEN cog / 4 >= 20 THEN 'WEAK_LEAD'
    WHEN cog / 4 < 8 THEN 'CLEARED' ELSE 'BACKGROUND_TRAFFIC' END AS assessment,
    CASE WHEN cog / 400 >= 0.7 THEN 'HIGH' WHEN cog / 400 >= 0.45 THEN 'MEDIUM' WHEN cog / 400 >= 0.3 THEN 'LOW' ELSE 'REJECTED' END AS band,
    CASE WHEN sog < 1.104481 THEN 'normal' WHEN sog / 1.104481 >= 5 THEN 'critical' WHEN sog / 1.104481 >= 2 THEN 'high'
    ELSE 'elevated' END AS severity,
    CASE WHEN sog < .5 THEN 0 WHEN sog < 1.5 THEN 1 WHEN sog < 3.3 THEN 2 WHEN sog < 5.4 THEN 3 WHEN sog < 7.9 THEN 4
    WHEN sog < 10.7 THEN 5 WHEN sog < 13.8 THEN 6 WHEN sog < 17.1 THEN 7 WHEN sog < 20.7 THEN 8 ELSE 9 END AS douglas
  FROM pings""", "pings"))
def p6_p7_p9_type_status_bands(spark, sf):
    return fx.pings_raw(spark, sf).select(
        "seq", lb.type_group("vessel_type").alias("type_group"), lb.nav_label("nav_status").alias("nav_label"),
        lb.score_band(F.col("cog") / 4).alias("assessment"), lb.confidence_band(F.col("cog") / 400).alias("band"),
        lb.severity("sog").alias("severity"), lb.douglas("sog").alias("douglas"))


@query("p8_flag_from_mmsi", q("""
  SELECT coalesce(substr(CAST(mmsi AS VARCHAR), 1, 3), '-') AS prefix,
         CASE substr(CAST(mmsi AS VARCHAR), 1, 3) WHEN '419' THEN 'India' WHEN '636' THEN 'Liberia'
         WHEN '563' THEN 'Singapore' ELSE 'Unknown' END AS flag, count(*) AS n FROM pings GROUP BY 1, 2""", "pings"))
def p8_flag_from_mmsi(spark, sf):
    return (lb.with_flag(fx.pings_raw(spark, sf))
            .groupBy(F.coalesce(F.substring(F.col("mmsi").cast("string"), 1, 3), F.lit("-")).alias("prefix"), "flag")
            .agg(F.count(F.lit(1)).alias("n")))


@query("p10_deviation_and_wind_bands", q("""
  SELECT seq, CASE WHEN sog / 20 <= 0.19 THEN 'expected' WHEN sog / 20 <= 0.63 THEN 'unremarkable'
    WHEN sog / 20 <= 3 * 0.63 THEN 'deviated' WHEN sog IS NOT NULL THEN 'sharp_manoeuvre' END AS verdict,
    CASE WHEN sog < 2 THEN 'POOR' WHEN sog < 3 THEN 'MARGINAL' WHEN sog <= 10 THEN 'OPTIMAL'
    WHEN sog <= 13 THEN 'MARGINAL' ELSE 'POOR' END AS detectability FROM pings""", "pings"))
def p10_deviation_and_wind_bands(spark, sf):
    return fx.pings_raw(spark, sf).select("seq", lb.deviation_verdict(F.col("sog") / 20).alias("verdict"),
                                          lb.detectability("sog").alias("detectability"))


@query("w1_strict_time", q("SELECT mmsi, t_us, seq FROM strict", "strict"))
def w1_strict_time(spark, sf):
    return tr.strict_time(fx.axis(spark, sf)).select("mmsi", (F.col("t_us") - fx.EPOCH_US).alias("t_us"), "seq")


@query("p22_min_points", q("SELECT mmsi, count(*) AS n FROM strict GROUP BY mmsi HAVING count(*) >= 60", "strict"))
def p22_min_points(spark, sf):
    return (tr.min_points(tr.strict_time(fx.axis(spark, sf)), 60).groupBy("mmsi")
            .agg(F.count(F.lit(1)).alias("n")))


@query("w2_impossible_speed_filter", q("SELECT mmsi, t_us, seq FROM track", "track"))
def w2_impossible_speed_filter(spark, sf):
    return fx.tracks(spark, sf).select("mmsi", (F.col("t_us") - fx.EPOCH_US).alias("t_us"), "seq")


@query("w3_gap_flags", q(f"SELECT mmsi, {r('start_h')} AS start_h, {r('end_h')} AS end_h, {r('minutes', 4)} AS minutes FROM gap", "gap"))
def w3_gap_flags(spark, sf):
    return tr.gaps(fx.tracks(spark, sf)).select("mmsi", rd("start_h"), rd("end_h"), rd("minutes", 4))


@query("w4_track_segments", q("""
  SELECT mmsi, segment, CAST(min(i) AS BIGINT) AS i0, CAST(max(i) + 1 AS BIGINT) AS i1, count(*) AS n FROM (
    SELECT mmsi, fix - 1 AS i, CAST(sum(b) OVER (PARTITION BY mmsi ORDER BY fix) AS BIGINT) AS segment FROM (
      SELECT mmsi, fix, CASE WHEN (t_h - lag(t_h) OVER (PARTITION BY mmsi ORDER BY fix)) * 60 > 60 THEN 1 ELSE 0 END AS b
      FROM track)) GROUP BY 1, 2""", "track"))
def w4_track_segments(spark, sf):
    # the split length is a parameter: 60 minutes here, since the 12-hour fixture has no 6-hour silence
    return (tr.segments(fx.tracks(spark, sf), 60.0).groupBy("mmsi", "segment")
            .agg(F.min("fix_index").alias("i0"), (F.max("fix_index") + 1).alias("i1"), F.count(F.lit(1)).alias("n")))


@query("w5_loitering", q(f"""
  SELECT mmsi, {r('min(t_h)')} AS start_h, {r('max(t_h)')} AS end_h, {r('(max(t_h) - min(t_h)) * 60', 4)} AS minutes,
         {r('avg(sog)')} AS mean_sog_kn FROM (
    SELECT *, fix - row_number() OVER (PARTITION BY mmsi ORDER BY fix) AS island FROM track WHERE sog < 9)
  GROUP BY mmsi, island HAVING (max(t_h) - min(t_h)) * 60 >= 30""", "track"))
def w5_loitering(spark, sf):
    return tr.loitering(fx.tracks(spark, sf), speed_kn=9.0).select(
        "mmsi", rd("start_h"), rd("end_h"), rd("minutes", 4), rd("mean_sog_kn"))


_DIFF = f"""
  SELECT mmsi, t_us, nav_status, lat, lon, sog, cog, rot,
         {pmod('coalesce(cog - lag(cog) OVER w, 0.0) + 180.0', 360.0)} - 180.0 AS course_diff,
         coalesce(rot - lag(rot) OVER w, 0.0) AS rot_diff, coalesce(sog - lag(sog) OVER w, 0.0) AS speed_diff,
         coalesce(lat - lag(lat) OVER w, 0.0) AS lat_diff, coalesce(lon - lag(lon) OVER w, 0.0) AS long_diff,
         last_value(nav_status) OVER (PARTITION BY mmsi ORDER BY fix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_status
  FROM track WINDOW w AS (PARTITION BY mmsi ORDER BY fix)"""


@query("w6_difference_features", q(f"""
  SELECT mmsi, t_us, {r('course_diff')} AS course_diff, {r('rot_diff')} AS rot_diff, {r('speed_diff')} AS speed_diff,
         {r('lat_diff', 9)} AS lat_diff, {r('long_diff', 9)} AS long_diff FROM ({_DIFF})""", "track"))
def w6_difference_features(spark, sf):
    return tr.diff_features(fx.tracks(spark, sf)).select(
        "mmsi", (F.col("t_us") - fx.EPOCH_US).alias("t_us"), rd("course_diff"), rd("rot_diff"), rd("speed_diff"),
        rd("lat_diff", 9), rd("long_diff", 9))


@query("p23_model_feature_frame", q(f"""
  SELECT mmsi, count(*) AS n, {r('sum(sog)', 3)} AS speed, {r('sum(cog)', 3)} AS course, {r('sum(course_diff)', 3)} AS course_diff,
         {r('sum(rot)', 3)} AS rot, CAST(sum(last_status) AS DOUBLE) AS status, CAST(count(*) AS DOUBLE) AS msg_type,
         CAST(count(*) AS DOUBLE) AS accuracy FROM ({_DIFF}) GROUP BY mmsi""", "track"))
def p23_model_feature_frame(spark, sf):
    s = lambda c, n=3: F.round(F.sum(c), n).alias(c)
    return tr.ping_features(fx.tracks(spark, sf)).groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n"), s("speed"), s("course"), s("course_diff"), s("rot"), s("status"),
        s("msg_type"), s("accuracy"))


_SUMMARY = f"""
  SELECT mmsi, count(*) AS n_points, {r('min(t_h)')} AS first_seen_h, {r('max(t_h)')} AS last_seen_h,
         {r('max(t_h) - min(t_h)')} AS duration_h, {r('min(lon)')} AS west, {r('min(lat)')} AS south, {r('max(lon)')} AS east,
         {r('max(lat)')} AS north, count(*) FILTER ((t2 - t_h) * 60 > 360) + 1 AS n_segments,
         count(*) FILTER ((t2 - t_h) * 60 > 20) AS n_gaps, {r('coalesce(avg(sog) FILTER (sog > 0), 0.0)')} AS mean_sog_kn
  FROM track GROUP BY mmsi"""


@query("g2_track_summary", q(_SUMMARY, "track"))
def g2_track_summary(spark, sf):
    s = tr.track_summary(fx.tracks(spark, sf))
    return s.select("mmsi", "n_points", *[rd(c) for c in ("first_seen_h", "last_seen_h", "duration_h", "west", "south",
                                                           "east", "north")], "n_segments", "n_gaps", rd("mean_sog_kn"))


@query("g2_removed_fixes", q("""
  SELECT a.mmsi, a.n - b.n AS out_of_time_order, b.n - c.n AS impossible_speed
  FROM (SELECT mmsi, count(*) n FROM clean GROUP BY 1) a JOIN (SELECT mmsi, count(*) n FROM strict GROUP BY 1) b USING (mmsi)
  JOIN (SELECT mmsi, count(*) n FROM track GROUP BY 1) c USING (mmsi)""", "clean", "strict", "track"))
def g2_removed_fixes(spark, sf):
    a = fx.axis(spark, sf)
    return tr.removal_counts(a, tr.strict_time(a), fx.tracks(spark, sf))


@query("g3_g27_track_metrics", q(f"""
  SELECT a.*, {r('coalesce(d, 0.0)', 4)} AS longest_dark_min, coalesce(g, 0) AS n_gaps FROM (
    SELECT mmsi, count(*) AS n_points, {r('min(sog)')} AS sog_min_kn, {r('max(sog)')} AS sog_max_kn,
           {r('coalesce(avg(sog) FILTER (sog > 0), 0.0)')} AS sog_mean_kn, {r('avg(cog)')} AS mean_heading_deg,
           {r(pmod('degrees(atan2(avg(sin(radians(cog))), avg(cos(radians(cog))))) + 360.0', 360.0), 4)} AS circular_heading_deg
    FROM track GROUP BY mmsi) a LEFT JOIN (
    SELECT mmsi, max(greatest(0.0, least(round(end_h, 3), -2.0) - greatest(round(start_h, 3), -9.0))) * 60 AS d, count(*) AS g
    FROM gap GROUP BY mmsi) b USING (mmsi)""", "track", "gap"))
def g3_g27_track_metrics(spark, sf):
    m = tr.track_metrics(fx.tracks(spark, sf), -9.0, -2.0)
    return m.select("mmsi", "n_points", *[rd(c) for c in ("sog_min_kn", "sog_max_kn", "sog_mean_kn", "mean_heading_deg")],
                    rd("circular_heading_deg", 4), rd("longest_dark_min", 4), "n_gaps")


@query("l5_even_decimation", q("""
  SELECT mmsi, fix - 1 AS i FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS cnt FROM track) t
  WHERE cnt <= 20 OR EXISTS (SELECT 1 FROM range(20) g(j)
     WHERE (CASE WHEN g.j = 19 THEN cnt - 1 ELSE CAST(floor(g.j * ((cnt - 1) / 19.0)) AS BIGINT) END) = fix - 1)""", "track"))
def l5_even_decimation(spark, sf):
    t = tr.sliced(fx.tracks(spark, sf).select("mmsi", "t_us", "slice"), ["mmsi"], ["t_us"], "slice", index="i")
    return tr.decimate(t, ["mmsi"], ["t_us"], "slice", 20).select("mmsi", "i")


@query("p21_identity_of_last_fix", q("""
  SELECT mmsi, name, CASE substr(CAST(mmsi AS VARCHAR), 1, 3) WHEN '419' THEN 'India' WHEN '636' THEN 'Liberia'
         WHEN '563' THEN 'Singapore' ELSE 'Unknown' END AS flag, vessel_type, CAST(nav_status AS INTEGER) AS nav_code
  FROM (SELECT *, vessel_type AS vt FROM track QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t_us DESC) = 1)""", "track"))
def p21_identity_of_last_fix(spark, sf):
    t = fx.tracks(spark, sf)
    code = t.groupBy("mmsi").agg(F.max_by("nav_status", "t_us").alias("nav_code"), F.max_by("vessel_type", "t_us").alias("_vt"))
    ident = tr.identity(t).join(code, "mmsi")
    same = (ident["nav_status"] == lb.nav_label("nav_code")) & (ident["vessel_type"] == lb.type_group("_vt"))
    return ident.filter(same).select("mmsi", "name", "flag", F.col("_vt").alias("vessel_type"), "nav_code")


@query("p21_covers_and_in_gap", q("""
  SELECT p.seq, coalesce(p.t_h BETWEEN s.a - 0.25 AND s.b + 0.25, false) AS covered,
         EXISTS (SELECT 1 FROM gap g WHERE g.mmsi = p.mmsi AND p.t_h BETWEEN g.start_h AND g.end_h) AS dark
  FROM clean p LEFT JOIN (SELECT mmsi, min(t_h) a, max(t_h) b FROM track GROUP BY mmsi) s USING (mmsi)""", "clean", "track", "gap"))
def p21_covers_and_in_gap(spark, sf):
    t = fx.tracks(spark, sf)
    times = fx.axis(spark, sf).select("seq", "mmsi", "t_h")
    dark = tr.in_gap(tr.gaps(t), times).select("seq", F.lit(True).alias("dark"))
    return tr.covers(t, times, 0.25).join(dark, "seq", "left").select(
        "seq", "covered", F.coalesce("dark", F.lit(False)).alias("dark"))


@query("p21_fixes_between", q("SELECT mmsi, t_us FROM track WHERE t_h BETWEEN -8.5 AND -3.25", "track"))
def p21_fixes_between(spark, sf):
    return tr.fixes_between(fx.tracks(spark, sf), -8.5, -3.25).select("mmsi", (F.col("t_us") - fx.EPOCH_US).alias("t_us"))


