"""Registered queries: traffic gate, evidence, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.functions import labels as lb
from wakeline.operators import evidence as ev
from wakeline.operators import spatial as sp
from wakeline.operators import tracks as tr
from wakeline.operators.attribution import gather
from wakeline.plans import fixtures as fx
from wakeline.plans.registry import query, rd
from wakeline.plans.sqltext import bearing, q, r
from wakeline.session import broadcast_if_small, durable, shuffled

PAIR = ["incident_id", "mmsi"]


def pairs(spark, sf):
    return fx.memo("pairs", spark, sf, lambda: sp.gate(fx.tracks(spark, sf), fx.incidents(spark, sf)))


def pair_evidence(spark, sf, **parts):
    return ev.pair_evidence(fx.tracks(spark, sf), fx.incidents(spark, sf), **parts)


def evidence(spark, sf):
    """All evidence of every gated pair; the trajectory and ping models are not engaged here."""
    return gather(fx.tracks(spark, sf), fx.incidents(spark, sf))


def ranked(spark, sf):
    """Rank, score and band of every pair; nothing else of the evidence is kept."""
    return fx.memo("ranked", spark, sf, lambda: ev.rank(ev.fuse(evidence(spark, sf)).select(*PAIR, "score", "assessment")))


def ranked_top(spark, sf, n):
    """The `n` first of each incident with their components."""
    best = durable(ev.top_candidates(ranked(spark, sf), n))
    e = evidence(spark, sf).join(broadcast_if_small(best.select(*PAIR)), PAIR, "left_semi")
    return ev.fuse(e).select(*PAIR, "components").join(shuffled(best), PAIR)


def ranked_full(spark, sf):
    """Every pair with its components, for documents that list them."""
    return fx.memo("ranked_full", spark, sf, lambda: ev.rank(ev.fuse(evidence(spark, sf)).select(
        *PAIR, "score", "assessment", "cpa_km", "best_match_time_h", "components")))


@query("j1_traffic_gate", q(f"SELECT incident_id, mmsi, {r('min_km')} AS min_km FROM pair", "pair"))
def j1_traffic_gate(spark, sf):
    return sp.gate(fx.tracks(spark, sf), fx.incidents(spark, sf)).select(*PAIR, rd("min_km"))


@query("j1_gate_counts", q("""
  SELECT i.incident_id, n.n AS n_input, count(p.mmsi) AS n_kept, n.n - count(p.mmsi) AS n_rejected,
         (SELECT count(*) FROM span s WHERE s.l_h < i.p0 OR s.f_h > i.p1) AS outside_window
  FROM win i CROSS JOIN (SELECT count(*) AS n FROM span) n LEFT JOIN pair p USING (incident_id)
  GROUP BY i.incident_id, n.n, i.p0, i.p1""", "win", "span", "pair"))
def j1_gate_counts(spark, sf):
    t, i = fx.tracks(spark, sf), fx.incidents(spark, sf)
    return sp.gate_counts(t, i, sp.gate(t, i))              # pairs are counted as they come, not kept


@query("j1_gate_reasons", q(f"""
  SELECT c.incident_id, c.mmsi, CASE WHEN s.l_h < i.p0 OR s.f_h > i.p1 THEN 'outside_window' WHEN w.min_km IS NULL THEN 'no_reports'
         WHEN w.min_km > i.reach_km THEN 'too_far' ELSE 'kept' END AS verdict, {r('w.min_km')} AS min_km
  FROM (SELECT DISTINCT c_custkey // 15 AS incident_id, [419, 636, 563, 999][CAST(c_custkey * 7 % 150 % 4 AS INTEGER) + 1] * 1000000
        + c_custkey * 7 % 150 AS mmsi FROM customer) c
  JOIN win i USING (incident_id) JOIN span s USING (mmsi) LEFT JOIN inwin w USING (incident_id, mmsi)""", "win", "span", "inwin"))
def j1_gate_reasons(spark, sf):
    u = F.col("c_custkey") * 7 % 150
    mid = F.element_at(F.array(*[F.lit(x) for x in (419, 636, 563, 999)]), (u % 4 + 1).cast("int"))
    named = fx.load(spark, sf, "customer").select(F.expr("c_custkey div 15").alias("incident_id"),
                                                  (mid * F.lit(1000000).cast("bigint") + u).alias("mmsi"))
    g = sp.gate_reasons(named, fx.tracks(spark, sf), fx.incidents(spark, sf))
    return g.select(*PAIR, "verdict", rd("min_km"))


@query("g8_f8_closest_approach", q(f"""
  SELECT incident_id, mmsi, {r('cpa_km')} AS cpa_km, {r('cpa_time_h')} AS cpa_time_h, {r('cpa_lat')} AS cpa_lat,
         {r('cpa_lon')} AS cpa_lon, {r(bearing('origin_lat', 'origin_lon', 'cpa_lat', 'cpa_lon'), 3)} AS approach_deg,
         {r('CASE WHEN cpa_km >= 25 THEN 0.0 ELSE 1.0 - sqrt(cpa_km / 25.0) END')} AS proximity FROM cpa""", "cpa"))
def g8_f8_closest_approach(spark, sf):
    return pair_evidence(spark, sf, series=False).select(
        *PAIR, rd("cpa_km"), rd("cpa_time_h"), rd("cpa_lat"), rd("cpa_lon"), rd("approach_deg", 3), rd("proximity"))


@query("g5_dwell_fraction", q(f"""
  SELECT incident_id, mmsi, n AS fixes_in_window, {r('dwell')} AS dwell, {r('minutes_in_radius', 4)} AS minutes_in_radius,
         {r('observed_minutes', 4)} AS observed_minutes FROM dwell""", "dwell"))
def g5_dwell_fraction(spark, sf):
    return pair_evidence(spark, sf, series=False).select(
        *PAIR, "fixes_in_window", rd("dwell"), rd("minutes_in_radius", 4), rd("observed_minutes", 4))


@query("g9_g27_axis_alignment", q(f"""
  SELECT incident_id, mmsi, {r('axis_deg')} AS slick_axis_deg, {r('course_deg')} AS course_deg, {r('axis_diff_deg')} AS axis_diff_deg,
         {r('axis_alignment')} AS axis_alignment, {r('centroid_km')} AS centroid_km FROM axis""", "axis"))
def g9_g27_axis_alignment(spark, sf):
    return pair_evidence(spark, sf, series=False).select(
        *PAIR, *[rd(c) for c in ("slick_axis_deg", "course_deg", "axis_diff_deg", "axis_alignment", "centroid_km")])


@query("g10_blackout", q(f"""
  SELECT incident_id, mmsi, {r('dark_min', 4)} AS dark_min, {r('least(dark_min / 120.0, 1.0)')} AS blackout FROM dark""", "dark"))
def g10_blackout(spark, sf):
    return pair_evidence(spark, sf, series=False).select(*PAIR, rd("dark_min", 4), rd("blackout"))


@query("g6_space_time_kernel", q(f"""
  SELECT incident_id, mmsi, n_samples, {r('best_t')} AS best_match_time_h, {r('best_km')} AS best_km, {r('overlap')} AS kernel_overlap,
         {r('consist')} AS consistency, prior AS age_prior, {r('st')} AS spatiotemporal
  FROM (SELECT * REPLACE (CAST(prior AS DOUBLE) AS prior) FROM stx)""", "stx"))
def g6_space_time_kernel(spark, sf):
    return pair_evidence(spark, sf, window=False).select(
        *PAIR, F.col("n_samples").cast("long").alias("n_samples"), rd("best_match_time_h"), rd("best_km"),
        rd("kernel_overlap"), rd("consistency"), "age_prior", rd("spatiotemporal"))


@query("f9_vessel_prior", q("SELECT mmsi, CAST(prior AS DOUBLE) AS prior FROM vtype", "vtype"))
def f9_vessel_prior(spark, sf):
    return tr.identity(fx.tracks(spark, sf)).select("mmsi", lb.vessel_prior("vessel_type").alias("prior"))


_COMP = """SELECT incident_id, mmsi, c.component, c.v AS value, c.w / den AS weight, c.w / den * c.v * 100 * gate AS points, c.ok AS available
  FROM {t}, LATERAL (SELECT unnest([
    {{'component': 'spatiotemporal', 'v': st, 'w': {st}::DOUBLE, 'ok': true}},
    {{'component': 'axis_alignment', 'v': ax, 'w': CASE WHEN ax_ok THEN {ax} ELSE 0.0 END::DOUBLE, 'ok': ax_ok}},
    {{'component': 'proximity', 'v': pr, 'w': {pr}::DOUBLE, 'ok': true}}, {{'component': 'dwell', 'v': dw, 'w': {dw}::DOUBLE, 'ok': true}}{more}]) AS c)"""
_MORE = """, {'component': 'blackout', 'v': bl, 'w': 0.10::DOUBLE, 'ok': true},
    {'component': 'vessel_prior', 'v': CAST(vp AS DOUBLE), 'w': 0.09::DOUBLE, 'ok': true},
    {'component': 'route_deviation', 'v': 0.0::DOUBLE, 'w': 0.0::DOUBLE, 'ok': false}"""
_LONG = f"SELECT incident_id, mmsi, component, {r('value', 4)} AS value, {r('weight', 4)} AS weight, {r('points', 2)} AS points, available FROM "


@query("g11_weighted_fusion_evidence", q(_LONG + "(" + _COMP.format(t="fused", st=.30, ax=.18, pr=.14, dw=.10, more=_MORE) + ")", "fused"))
def g11_weighted_fusion_evidence(spark, sf):
    return ev.evidence_long(ev.fuse(evidence(spark, sf)))


@query("g12_baseline_score", q(f"""
  SELECT incident_id, mmsi, {r('total', 2)} AS score, {r('raw', 2)} AS raw_score FROM based""", "based"))
def g12_baseline_score(spark, sf):
    e = pair_evidence(spark, sf).withColumn("axis_alignment_available", F.col("axis_available"))
    return ev.fuse(e, C.BASELINE_WEIGHTS).select(*PAIR, "score", "raw_score")


@query("g11_w8_fused_ranking", q(f"""
  SELECT incident_id, mmsi, rank, {r('score', 2)} AS score, assessment, {r('gate', 3)} AS proximity_gate, score >= 8 AS reportable,
         CASE WHEN rank = 1 THEN {r('score - lead(score) OVER (PARTITION BY incident_id ORDER BY rank)', 2)} END AS margin_over_next,
         {r('cpa_km', 3)} AS cpa_km, {r('best_t', 2)} AS best_match_time_h FROM ranked""", "ranked"))
def g11_w8_fused_ranking(spark, sf):
    scored = ev.fuse(evidence(spark, sf)).select(*PAIR, "score", "assessment", "proximity_gate", "cpa_km", "best_match_time_h")
    return ev.rank(scored).select(
        *PAIR, "rank", "score", "assessment", rd("proximity_gate", 3), "reportable", "margin_over_next",
        rd("cpa_km", 3), rd("best_match_time_h", 2))


@query("g13_ranking_summary", q(f"""
  SELECT incident_id, count(*) AS n_candidates, count(*) FILTER (score >= 8) AS n_reportable, max(mmsi) FILTER (rank = 1) AS prime_mmsi,
         max(score) AS prime_score, max(assessment) FILTER (rank = 1) AS prime_assessment,
         {r('max(score) - coalesce(max(score) FILTER (rank = 2), 0.0)', 2)} AS margin_over_next,
         CASE WHEN max(score) < 45 THEN 'none' WHEN round(max(score) - coalesce(max(score) FILTER (rank = 2), 0.0), 2) >= 15 THEN 'separated'
         ELSE 'unresolved' END AS verdict FROM ranked GROUP BY incident_id""", "ranked"))
def g13_ranking_summary(spark, sf):
    return ev.rank_summary(ranked(spark, sf))


@query("l1_top_candidates", q("SELECT incident_id, mmsi, rank, score FROM ranked WHERE rank <= 8", "ranked"))
def l1_top_candidates(spark, sf):
    return ev.top_candidates(ranked(spark, sf), 8).select(*PAIR, "rank", "score")


@query("j14_truth_rank", q("""
  SELECT t.incident_id, t.truth_mmsi, r.rank AS rank_assigned, coalesce(r.rank = 1, false) AS correctly_ranked_first
  FROM (SELECT incident_id, min(mmsi) AS truth_mmsi FROM pair GROUP BY 1) t
  LEFT JOIN ranked r ON r.incident_id = t.incident_id AND r.mmsi = t.truth_mmsi""", "pair", "ranked"))
def j14_truth_rank(spark, sf):
    truth = pairs(spark, sf).groupBy("incident_id").agg(F.min("mmsi").alias("truth_mmsi"))
    return ev.truth_rank(ranked(spark, sf), truth)


@query("s12_explain_prime", q(f"""
  WITH c AS ({_COMP.format(t="(SELECT * FROM ranked WHERE rank = 1)", st=.30, ax=.18, pr=.14, dw=.10, more=_MORE)}),
  o AS (SELECT incident_id, mmsi, component, {r('points', 2)} AS points, row_number() OVER (PARTITION BY incident_id ORDER BY {r('points', 2)} DESC, component) AS rn FROM c)
  SELECT incident_id, mmsi, list_aggregate(list(component ORDER BY rn) FILTER (rn <= 3), 'string_agg', ',') AS findings FROM o GROUP BY 1, 2""".replace("WITH c AS", "SELECT * FROM (WITH c AS") + ")", "ranked"))
def s12_explain_prime(spark, sf):
    e = ev.explain_prime(ranked_top(spark, sf, 1))
    return e.select(*PAIR, F.array_join(F.transform("findings", lambda x: x["component"]), ",").alias("findings"))


@query("p20_resolve_incident", q("""
  SELECT incident_id, origin_lat, origin_lon, CAST(w0 AS DOUBLE) AS t0_h, CAST(w1 AS DOUBLE) AS t1_h, centroid_lat, centroid_lon,
         CAST(prior0 AS DOUBLE) AS prior_lo_h, CAST(prior1 AS DOUBLE) AS prior_hi_h,
         CASE WHEN spread_km = 0 THEN 1.25 ELSE CAST(spread_km AS DOUBLE) END AS spread_km FROM incident""", "incident"))
def p20_resolve_incident(spark, sf):
    i = fx.incidents(spark, sf)
    odd = F.col("incident_id") % 2 == 1                        # half explicit, half from an embedded hindcast
    raw = i.select(
        "incident_id", F.when(odd, F.col("origin_lat")).alias("origin_lat"), F.when(odd, F.col("origin_lon")).alias("origin_lon"),
        F.col("origin_lat").alias("hind_lat"), F.col("origin_lon").alias("hind_lon"),
        F.when(odd, F.col("t1_h") - 3.0).alias("window_a"), F.when(odd, F.col("t0_h") - 3.0).alias("window_b"),
        (F.col("t0_h") - 3.0).alias("hind_window_a"), (F.col("t1_h") - 3.0).alias("hind_window_b"),
        "centroid_lat", F.lit(None).cast("double").alias("hind_centroid_lat"), F.col("centroid_lon").alias("hind_centroid_lon"),
        (F.col("prior_hi_h") - 3.0).alias("prior_a"), (F.col("prior_lo_h") - 3.0).alias("prior_b"),
        "spread_km", F.lit(1.25).alias("hind_spread_km"), F.lit(3.0).alias("obs_h"))
    return ev.resolve_incident(raw).drop("axis_deg")


@query("j8_interpolated_positions", q(f"""
  SELECT x.event_id, {r("coalesce(a.lat + w * (a.lat2 - a.lat), CASE WHEN x.t < s.f_h THEN s.f_lat ELSE s.l_lat END)")} AS lat,
         {r("coalesce(a.lon + w * (a.lon2 - a.lon), CASE WHEN x.t < s.f_h THEN s.f_lon ELSE s.l_lon END)")} AS lon
  FROM (SELECT event_id, [419, 636, 563, 999][CAST(u % 4 AS INTEGER) + 1] * 1000000 + u AS mmsi, th - 12.3e0 AS t FROM ev) x
  JOIN span s USING (mmsi)
  LEFT JOIN LATERAL (SELECT *, (x.t - t.t_h) / (t.t2 - t.t_h) AS w FROM track t WHERE t.mmsi = x.mmsi AND x.t >= t.t_h AND x.t < t.t2) a ON true""",
        "ev", "span", "track"))
def j8_interpolated_positions(spark, sf):
    u = F.col("u")
    mid = F.element_at(F.array(*[F.lit(x) for x in (419, 636, 563, 999)]), (u % 4 + 1).cast("int"))
    times = fx.events(spark, sf).select("event_id", (mid * F.lit(1000000).cast("bigint") + u).alias("mmsi"),
                                        (F.col("t_us") / 3.6e9 - 12.3).alias("t_h"))
    return sp.position_at(fx.tracks(spark, sf), times).select("event_id", rd("lat"), rd("lon"))


