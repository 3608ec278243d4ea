"""Registered queries: models, evaluation, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.operators import evidence as ev
from wakeline.operators import models as md
from wakeline.operators import raster as ra
from wakeline.operators import tracks as tr
from wakeline.plans import fixtures as fx
from wakeline.plans.q_evidence import PAIR, pairs
from wakeline.plans.registry import query, rd
from wakeline.plans.sqltext import cte, hav, km, pmod, q, r
from wakeline.session import durable, shared_folder
from wakeline.streaming import live

TOP = "CASE WHEN abs(rot) > 60 THEN 'rot' WHEN cog > 180 THEN 'course' ELSE 'speed' END"


def stand_in_scores(spark, sf):
    """Pings with the speed as score, so that SQL can check what is built on scores."""
    return fx.tracks(spark, sf).withColumn("anomaly_score", F.col("sog") / 10).withColumn(
        "top_feature", F.when(F.abs("rot") > 60, "rot").when(F.col("cog") > 180, "course").otherwise("speed"))


@query("g4_vessel_rollup", q(f"""
  SELECT mmsi, count(*) AS pings, count(*) FILTER (sog / 10 >= 1.104481) AS flagged, {r('max(sog / 10)')} AS max_score, {r('avg(sog / 10)')} AS mean_score FROM track GROUP BY mmsi""", "track"))
def g4_vessel_rollup(spark, sf):
    return ev.vessel_rollup(stand_in_scores(spark, sf)).select("mmsi", "pings", "flagged", rd("max_score"), rd("mean_score"))


@query("g14_anomaly_near_slick", q(f"""
  SELECT incident_id, mmsi, CAST(sum(n) AS BIGINT) AS pings_near_slick, CAST(sum(k) AS BIGINT) AS flagged_pings, {r('max(m)')} AS peak_error,
    coalesce(string_agg(f, ',' ORDER BY k DESC, f) FILTER (k > 0), '') AS top_features, {r('least(greatest(ln(1 + max(m) / 1104481e-6) / ln(7e0), 0e0), 1e0)')} AS ais_anomaly FROM (
    SELECT i.incident_id, t.mmsi, {TOP} AS f, count(*) AS n, count(*) FILTER (sog / 10 >= 1.104481) AS k, max(sog / 10) AS m
    FROM pair p JOIN win i USING (incident_id) JOIN track t ON t.mmsi = p.mmsi AND t.t_h BETWEEN i.p0 AND i.p1 AND {km('t.lat', 't.lon', 'i.origin_lat', 'i.origin_lon')} <= 25 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
                                  "pair", "win", "track"))
def g14_anomaly_near_slick(spark, sf):
    a = ev.anomaly_component(pairs(spark, sf), stand_in_scores(spark, sf), fx.incidents(spark, sf))
    return a.select(*PAIR, "pings_near_slick", "flagged_pings", rd("peak_error"), F.array_join("top_features", ",").alias("top_features"), rd("ais_anomaly"))


@query("l3_top_contributing_features", q("""
  SELECT mmsi, t_us, list_aggregate(list_transform(list_sort([{'v': -abs(sog), 'k': 'speed'}, {'v': -abs(cog), 'k': 'course'}, {'v': -abs(rot), 'k': 'rot'}, {'v': -abs(lat), 'k': 'lat'}, {'v': -abs(lon), 'k': 'lon'}])[1:3],
    lambda x: x.k), 'string_agg', ',') AS top FROM track""", "track"))
def l3_top_contributing_features(spark, sf):
    t = fx.tracks(spark, sf)
    m = F.create_map(*[x for k, c in (("speed", "sog"), ("course", "cog"), ("rot", "rot"), ("lat", "lat"), ("lon", "lon")) for x in (F.lit(k), F.abs(F.col(c)))])
    return t.select("mmsi", (F.col("t_us") - fx.EPOCH_US).alias("t_us"), F.array_join(md.top_features(m, 3), ",").alias("top"))


@query("m1_reconstruction_error")
def m1_reconstruction_error(spark, sf):
    f = durable(tr.ping_features(fx.tracks(spark, sf)).select("mmsi", "t_us", *C.FEATURES))      # read by each fit and by the scores
    return md.score_pings(md.fit_ping_model(f, quantile=0.99), f).select("mmsi", "t_us", "anomaly_score", "is_anomaly", "severity", "top_feature")


# -- windows ----------------------------------------------------------------------------------------------------------
cte("w8", """SELECT *, fix - 1 AS idx, list(sog) OVER w AS hs, list(cog) OVER w AS hc, list(t_us) OVER w AS ht, list(lat) OVER w AS hla, list(lon) OVER w AS hlo, list(rot) OVER w AS hr
  FROM track WINDOW w AS (PARTITION BY mmsi ORDER BY fix ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""", "track")
cte("win8", """SELECT *, list_avg(hla) AS cla, list_avg(hlo) AS clo, list_median([(ht[2] - ht[1]) / 1e6, (ht[3] - ht[2]) / 1e6, (ht[4] - ht[3]) / 1e6, (ht[5] - ht[4]) / 1e6, (ht[6] - ht[5]) / 1e6, (ht[7] - ht[6]) / 1e6,
  (ht[8] - ht[7]) / 1e6]) AS cad, (t_us - ht[8]) / 1e6 AS gap FROM w8 WHERE len(ht) = 8""", "w8")


def windows(spark, sf, reread=False):
    return md.window_stats(md.rolling(fx.tracks(spark, sf), block=32, reread=reread))


@query("w7_rolling_window", q(f"""
  SELECT mmsi, idx AS "index", {r('cla')} AS centroid_lat, {r('clo')} AS centroid_lon, {r('cad', 3)} AS cadence_s, {r('gap', 3)} AS gap_s, cad > 0 AND gap > 4 * greatest(cad, 5) AS coverage_gap FROM win8""", "win8"))
def w7_rolling_window(spark, sf):
    return windows(spark, sf).select("mmsi", "index", rd("centroid_lat"), rd("centroid_lon"), rd("cadence_s", 3), rd("gap_s", 3), "coverage_gap")


@query("p15_input_envelope", q("""
  SELECT mmsi, idx AS "index", concat_ws(',', 'outside_box', CASE WHEN cad > 150 THEN 'slow_cadence' END, CASE WHEN NOT ((hc[6] + hc[7] + hc[8]) / 3 BETWEEN 200 AND 290 OR (hc[6] + hc[7] + hc[8]) / 3 BETWEEN 20 AND 110) THEN 'course_band' END,
    CASE WHEN list_avg(hs) < 0.5 THEN 'stationary' END, CASE WHEN list_max(hs) > 19.3 THEN 'speed_clipped' END) AS warnings, 'degraded' AS assessment FROM win8""", "win8"))
def p15_input_envelope(spark, sf):
    return md.assess(windows(spark, sf)).select("mmsi", "index", F.array_join("warnings", ",").alias("warnings"), "assessment")


@query("f19_feature_normalisation", q(f"""
  SELECT mmsi, idx AS "index", {r('(hla[8] - cla) / (0.5076533333333373::DOUBLE + 1e-9) + 5e-1')} AS lat8, {r('least(greatest(hs[1], 0e0), 193e-1) / 193e-1')} AS speed1, {r('sin(radians(hc[3]))')} AS sin3, {r('hr[8] / 128')} AS rot8 FROM win8""", "win8"))
def f19_feature_normalisation(spark, sf):
    n = md.normalise(windows(spark, sf))
    e = lambda i, a: F.round(F.element_at("model_input", i), 6).alias(a)
    return n.select("mmsi", "index", e(43, "lat8"), e(3, "speed1"), e(16, "sin3"), e(48, "rot8"))


cte("dead", f"""SELECT mmsi, idx, cad > 0 AND gap > 4 * greatest(cad, 5) AS cg, {hav('pla', 'plo', 'lat', 'lon', '2 * 6371.0')} AS dev FROM (
  SELECT *, degrees(p2) AS pla, {pmod('hlo[8] + degrees(atan2(sin(th) * sin(d) * cos(p1), cos(d) - sin(p1) * sin(p2))) + 540.0', 360.0)} - 180.0 AS plo FROM (
    SELECT *, asin(sin(p1) * cos(d) + cos(p1) * sin(d) * cos(th)) AS p2 FROM (
      SELECT *, radians(hla[8]) AS p1, radians(hc[8]) AS th, hs[8] * 0.514444 * cad / 6371008.8 AS d FROM win8)))""", "win8")


@query("m2_dead_reckoning", q(f'SELECT mmsi, idx AS "index", {r("dev")} AS deviation_km FROM dead', "dead"))
def m2_dead_reckoning(spark, sf):
    return md.dead_reckoning(windows(spark, sf)).select("mmsi", "index", rd("deviation_km"))


@query("p16_g15_route_deviation", q(f"""
  SELECT mmsi, count(*) AS windows_scored, {r('max(dev)')} AS max_km, {r('median(dev)')} AS median_km, {r('least(max(dev) / 315e-2, 1e0)')} AS route_deviation
  FROM (SELECT *, bool_and(cg) OVER (PARTITION BY mmsi) AS none FROM dead) WHERE none OR NOT cg GROUP BY 1""", "dead"))
def p16_g15_route_deviation(spark, sf):
    c = ev.route_component(md.dead_reckoning(windows(spark, sf)))
    return c.select("mmsi", "windows_scored", rd("max_km"), rd("median_km"), rd("route_deviation"))


@query("m2_fitted_next_position")
def m2_fitted_next_position(spark, sf):
    w = windows(spark, sf, reread=True)
    return md.predict_next(md.fit_next_position(w), w).select("mmsi", "index", "pred_lat", "pred_lon", "deviation_km")


# -- classifier -------------------------------------------------------------------------------------------------------
OIL = ["mean_contrast_db", "border_gradient_db_px", "spreading", "elongation", "complexity", "solidity", "dist_to_land_km"]


@query("m3_m4_oil_ensemble")
def m3_m4_oil_ensemble(spark, sf):
    d = fx.region_rows(spark, sf).withColumn("oil", (ra.rule_score() > 0.45).cast("double"))
    m = md.train_oil(d, OIL)
    p = md.predict_oil(m, d)
    return p.select("scene_id", "region_id", "oil", "probability", F.array_join(md.top_features(F.transform_values("contributions", lambda k, v: F.abs(v)), 6), ",").alias("top"))


cte("scored", "SELECT l.doc_id, l.quality AS truth, d.n_chars % 1000 / 1000 AS score, l.doc_id * 7919 % 10007 AS h FROM labels l JOIN documents d USING (doc_id)")


def scored(spark, sf):
    return fx.load(spark, sf, "labels").join(fx.load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("truth"), (F.col("n_chars") % 1000 / 1000).alias("score"), (F.col("doc_id") * 7919 % 10007).alias("h"))


@query("g25_classifier_metrics", q(f"""
  , c AS (SELECT count(*) FILTER (score >= 0.3 AND truth = 1) AS tp, count(*) FILTER (score >= 0.3 AND truth = 0) AS fp, count(*) FILTER (score < 0.3 AND truth = 1) AS fn, count(*) FILTER (score < 0.3 AND truth = 0) AS tn FROM scored),
  a AS (SELECT avg(CASE WHEN x.score > y.score THEN 1e0 WHEN x.score = y.score THEN 5e-1 ELSE 0e0 END) AS auc FROM scored x, scored y WHERE x.truth = 1 AND y.truth = 0),
  p AS (SELECT avg(cp / ca) AS ap FROM (SELECT truth, sum(truth) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS cp, count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS ca FROM scored) WHERE truth = 1)
  SELECT tp, fp, fn, tn, {r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r('tp / (tp + fp)')} AS "precision", {r('tp / (tp + fn)')} AS recall, {r('2 * tp / (2 * tp + fp + fn)')} AS f1, {r('auc')} AS roc_auc, {r('ap')} AS average_precision
  FROM c, a, p""", "scored"))
def g25_classifier_metrics(spark, sf):
    m = md.metrics(scored(spark, sf))
    return m.select("tp", "fp", "fn", "tn", *[rd(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")])


@query("m5_stratified_split", q("SELECT doc_id, h <= quantile_cont(h, 0.25) OVER (PARTITION BY truth) AS held_out FROM scored", "scored"))
def m5_stratified_split(spark, sf):
    return md.stratified_split(scored(spark, sf), "truth", "h").select("doc_id", "held_out")


# -- streams: a stored feed is replayed to completion, one time-ordered range of it per micro-batch --------------------
def replay(spark, df, order: str, files: int = 4, rows: int = 250_000):
    """Write a feed as time-ordered ranges (cut at its quartiles) and open it as a stream. A range is as many files as a quarter of
    the feed needs at `rows` rows a file, written side by side; a range with fewer is filled up with empty files, so that every
    trigger takes exactly one range."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    cuts = df.approxQuantile(order, [k / files for k in range(1, files)], 0.001)
    n = -(-df.count() // (files * rows)) or 1
    edges = [None, *cuts, None]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = df if lo is None else df.filter(F.col(order) > lo)
        part = part if hi is None else part.filter(F.coalesce(F.col(order) <= hi, F.lit(lo is None)))
        (part.repartition(n) if n > 1 else part.coalesce(1)).write.parquet(f"{path}/{i}")
        for _ in range(n - len(spark.read.schema(df.schema).parquet(f"{path}/{i}").inputFiles())):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).option("recursiveFileLookup", True).parquet(path)


def drain(stream, mode: str = "append"):
    """Run a stream over everything available and return what its sink holds."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", base + "-state").trigger(availableNow=True)
    qy = w.format("parquet").start(base)
    qy.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def feed(spark, sf):
    return fx.pings_raw(spark, sf).withColumn("t_us", F.unix_micros("timestamp"))


@query("x1_stream_clean_dedup", q("SELECT mmsi, count(*) AS n FROM clean GROUP BY 1", "clean"))
def x1_stream_clean_dedup(spark, sf):
    return drain(live.clean_stream(replay(spark, feed(spark, sf), "t_us"), "13 hours")).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))


def track_feed(spark, sf):
    """Surviving fixes as a feed, with one closing heartbeat per vessel far in the future that pushes the watermark. All come at one
    instant: a heartbeat two hours before the last one would be closed itself, as a session of the vessel."""
    t = fx.tracks(spark, sf).select("mmsi", "t_us", F.timestamp_micros("t_us").alias("ts"))
    last = t.agg((F.max("t_us") + F.lit(40 * 86_400_000_000)).alias("t_us"))
    end = t.select("mmsi").distinct().crossJoin(F.broadcast(last))      # one row
    return t.unionByName(end.withColumn("ts", F.timestamp_micros("t_us")))


@query("x2_track_sessions", q("""
  SELECT mmsi, CAST(min(t_us) AS BIGINT) AS first_us, count(*) AS n FROM (SELECT mmsi, t_us, sum(b) OVER (PARTITION BY mmsi ORDER BY fix) AS s FROM (
    SELECT mmsi, t_us, fix, CASE WHEN (t_h - lag(t_h) OVER (PARTITION BY mmsi ORDER BY fix)) * 60 > 60 THEN 1 ELSE 0 END AS b FROM track)) GROUP BY mmsi, s""", "track"))
def x2_track_sessions(spark, sf):
    s = drain(live.track_sessions(replay(spark, track_feed(spark, sf), "t_us"), "60 minutes", "1 hour"))
    return s.select("mmsi", (F.unix_micros("first_ts") - fx.EPOCH_US).alias("first_us"), "n")


@query("x3_dark_vessel_timer", q("SELECT mmsi, CAST(round((start_h + 12) * 3.6e9) AS BIGINT) AS start_us, CAST(round((end_h + 12) * 3.6e9) AS BIGINT) AS end_us FROM gap", "gap"))
def x3_dark_vessel_timer(spark, sf):
    d = drain(live.dark_vessels(replay(spark, track_feed(spark, sf), "t_us")))
    closed = d.filter((F.col("kind") == "gap") & (F.col("end_us") - F.col("start_us") < 39 * 86_400_000_000))
    return closed.select("mmsi", (F.col("start_us") - fx.EPOCH_US).alias("start_us"), (F.col("end_us") - fx.EPOCH_US).alias("end_us"))


@query("x4_alert_cooldown", q("""
  , al0 AS (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY t_us, alert_id) AS n FROM (
    SELECT alert_id, t_us, force, outcome, round_even(lat / 5e-2, 0) AS cy, round_even(lon / 5e-2, 0) AS cx FROM alert)),
  walk AS (SELECT cy, cx, n, alert_id, outcome AS status, NULL::BIGINT AS dup, CASE WHEN outcome <> 'FAILED' THEN t_us END AS last_t,
      CASE WHEN outcome <> 'FAILED' THEN alert_id END AS last_id FROM al0 WHERE n = 1
    UNION ALL SELECT cy, cx, n, alert_id, CASE WHEN d THEN 'SUPPRESSED' ELSE outcome END, CASE WHEN d THEN last_id END,
      CASE WHEN NOT d AND outcome <> 'FAILED' THEN t_us ELSE last_t END, CASE WHEN NOT d AND outcome <> 'FAILED' THEN alert_id ELSE last_id END
    FROM (SELECT a.*, w.last_t, w.last_id, coalesce(a.t_us - w.last_t <= 10800000000, false) AND NOT a.force AS d
      FROM walk w JOIN al0 a ON a.cy = w.cy AND a.cx = w.cx AND a.n = w.n + 1))
  SELECT alert_id, status, dup AS dedup_of_id FROM walk""", "alert"))
def x4_alert_cooldown(spark, sf):
    a = fx.alerts(spark, sf).select("alert_id", "t_us", F.timestamp_micros(F.col("t_us") + F.lit(fx.EPOCH_US)).alias("ts"), "lat", "lon", "force", "outcome")
    return drain(live.alert_cooldown(replay(spark, a, "t_us")))


def alert_feed(spark, sf):
    a = fx.alerts(spark, sf).select("t_us", F.timestamp_micros(F.col("t_us") + F.lit(fx.EPOCH_US)).alias("ts"), "kind")
    end = a.agg((F.max("t_us") + F.lit(40 * 86_400_000_000)).alias("t_us")).select("t_us", F.timestamp_micros(F.col("t_us") + F.lit(fx.EPOCH_US)).alias("ts"), F.lit("end").alias("kind"))
    return a.unionByName(end)


@query("x5_time_buckets", q("""
  SELECT 60 AS size_min, CAST(floor(t_us / 3.6e9) AS BIGINT) AS start_h, count(*) AS n FROM alert GROUP BY 2
  UNION ALL SELECT 180, CAST(floor(t_us / 3.6e9) AS BIGINT) - o, count(*) FROM alert, range(3) g(o) GROUP BY 2""", "alert"))
def x5_time_buckets(spark, sf):
    f = lambda size, slide, m: drain(live.bucket_counts(replay(spark, alert_feed(spark, sf), "t_us"), size, slide)).filter("kind = 'anomaly'").select(
        F.lit(m).alias("size_min"), F.floor((F.unix_micros("window.start") - F.lit(fx.EPOCH_US)) / 3.6e9).alias("start_h"), "n")
    return f("60 minutes", None, 60).unionByName(f("180 minutes", "60 minutes", 180))


@query("x6_late_rows")
def x6_late_rows(spark, sf):
    """Every tenth ping arrives shuffled to the end; rows past the delay land in the side table, none is lost."""
    t = fx.tracks(spark, sf).select("mmsi", "t_us", F.timestamp_micros("t_us").alias("ts")).withColumn(
        "arrival", F.col("t_us") + F.when(F.col("t_us") % 10 == 0, F.lit(6 * 3_600_000_000)).otherwise(0))
    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    w = live.split_late(replay(spark, t, "arrival"), base + "/ok", base + "/late", base + "/progress")
    w.option("checkpointLocation", base + "/state").trigger(availableNow=True).start().awaitTermination()
    rd_ = lambda n: spark.read.schema(t.schema).parquet(f"{base}/{n}").withColumn("table", F.lit(n))
    return rd_("ok").unionByName(rd_("late")).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


@query("s1_ais_csv_scan", q("SELECT seq, mmsi, latitude, longitude, sog FROM pings", "pings"))
def s1_ais_csv_scan(spark, sf):
    """Round trip through a headed text file: every field is read as text under its own header spelling."""
    from wakeline.functions.labels import finite
    from wakeline.sources.ais import read_ais_csv
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    p = fx.pings_raw(spark, sf)
    p.select("seq", F.col("mmsi").alias("MMSI"), F.col("timestamp").alias("BaseDateTime"), F.col("latitude").alias("LAT"), F.col("longitude").alias("LON"),
             F.col("sog").alias("SOG")).write.option("header", True).csv(path)
    c = read_ais_csv(spark, path)
    assert set(t for _, t in c.dtypes) == {"string"}
    return c.select(F.col("seq").cast("bigint").alias("seq"), F.col("mmsi").try_cast("bigint").alias("mmsi"), finite("latitude").alias("latitude"),
                    finite("longitude").alias("longitude"), finite("sog").alias("sog"))

