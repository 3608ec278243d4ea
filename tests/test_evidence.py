import math

import pytest

from test_tracks import fixes
from wakeline.operators import evidence as ev
from wakeline.operators import spatial as sp

INC = ("incident_id long, origin_lat double, origin_lon double, t0_h double, t1_h double, spread_km double, centroid_lat double, "
       "centroid_lon double, axis_deg double, prior_lo_h double, prior_hi_h double")


def leg(m, t0, t1, lat, lon, course, kn, step=120 / 3600, silent=None):
    out, k = [], 0
    while t0 + k * step <= t1:
        t = t0 + k * step
        d = kn * 1.852 * (t - t0)
        if not (silent and silent[0] < t < silent[1]):
            out.append((m, t, lat + d * math.cos(math.radians(course)) / 111.2, lon + d * math.sin(math.radians(course)) / (111.2 * math.cos(math.radians(lat)))))
        k += 1
    return out


def evidence(spark, rows, inc):
    f, i = fixes(spark, rows), spark.createDataFrame([inc], INC)
    lg = sp.pair_legs(sp.gate(f, i), f, i)
    e = ev.window_evidence(lg).join(ev.st_score(lg, f), ev.PAIR)
    return f, i, {r.mmsi: r for r in e.collect()}


def test_closest_approach_three_km_abeam(spark):
    off = 3.0 / (111.2 * math.cos(math.radians(15.5)))
    _, _, e = evidence(spark, leg(1, -12, -2, 15.0, 73.1 + off, 0, 10), (1, 15.5, 73.1, -10.0, -4.0, 0.0, 15.6, 73.1, None, None, None))
    assert e[1].cpa_km == pytest.approx(3.0, abs=0.15)
    assert e[1].axis_alignment > 0.99 and e[1].blackout == 0.0


def test_axis_perpendicular_and_half_tolerance(spark):
    rows = leg(1, -12, -2, 15.5, 72.5, 90, 8) + leg(2, -12, -2, 15.3, 72.9, 27.5, 8)
    _, _, e = evidence(spark, rows, (1, 15.5, 73.1, -10.0, -4.0, 30.0, None, None, 0.0, None, None))
    assert e[1].axis_alignment == 0.0
    assert e[2].axis_alignment == pytest.approx(0.5, abs=0.02)


def test_blackout_saturates_at_two_hours(spark):
    _, _, e = evidence(spark, leg(1, -12, -2, 15.2, 73.1, 0, 4, silent=(-8.0, -5.0)), (1, 15.5, 73.1, -10.0, -4.0, 0.0, 15.6, 73.1, None, None, None))
    assert e[1].blackout == 1.0 and e[1].dark_min > 170


def test_invariants_and_culprit_ranks_first(spark):
    # one vessel crosses the origin inside the window; others pass late, far, or at an angle
    rows = (leg(419111111, -14, -4, 15.20, 72.70, 52, 6) + leg(419000002, -3.5, 0, 15.4, 73.0, 52, 10)
            + leg(419000003, -14, -4, 18.0, 70.0, 90, 10) + leg(419000004, -14, -4, 15.75, 72.8, 140, 5))
    inc = (1, 15.50, 73.10, -14.0, -6.0, 0.0, 15.63, 73.26, None, -16.0, -4.0)
    f, i, e = evidence(spark, rows, inc)
    assert 419000003 not in e
    from wakeline.operators.attribution import gather
    fx = f
    for c in ("nav_status", "vessel_type", "name", "flag", "imo", "callsign", "length", "width", "draft"):
        from pyspark.sql import functions as F
        fx = fx.withColumn(c, F.lit(None).cast("string"))
    ranked = ev.rank(ev.fuse(gather(fx, i))).orderBy("rank").collect()
    assert ranked[0].mmsi == 419111111
    for r in ranked:
        w = sum(c.weight for c in r.components.values())
        assert w == pytest.approx(1.0, abs=1e-3) and 0 <= r.score <= 100
        assert not r.components["route_deviation"].available
        for k in ("spatiotemporal", "proximity", "dwell", "axis_alignment", "blackout"):
            assert 0.0 <= r[k] <= 1.0
    assert ranked[0].margin_over_next == pytest.approx(ranked[0].score - ranked[1].score, abs=0.011)


def test_missing_origin_is_an_error(spark):
    bad = spark.createDataFrame([(1, None, 73.0, -3.0, -1.0)], "incident_id long, origin_lat double, origin_lon double, window_a double, window_b double")
    with pytest.raises(Exception, match="origin"):
        ev.resolve_incident(bad).collect()


def test_position_clamps_and_hits(spark):
    f = fixes(spark, [(1, 0.0, 0.0, 0.0), (1, 10.0, 1.0, 2.0), (1, 11.0, 1.0, 2.0)])
    t = spark.createDataFrame([(1, -5.0), (1, 0.0), (1, 5.0), (1, 10.0), (1, 99.0)], "mmsi long, t_h double")
    got = {r.t_h: (r.lat, r.lon) for r in sp.position_at(f, t).collect()}
    assert got == {-5.0: (0.0, 0.0), 0.0: (0.0, 0.0), 5.0: (0.5, 1.0), 10.0: (1.0, 2.0), 99.0: (1.0, 2.0)}


def cloud_rows(seed, n_steps, sizes):
    import random
    r = random.Random(seed)
    rows = []
    for inc in (1, 2):
        for s in range(n_steps):
            centres = [(15 + r.random(), 73 + r.random()) for _ in range(3)]
            for p in range(sizes[s % len(sizes)]):
                la, lo = centres[r.randrange(3)]
                rows.append((inc, p, -float(s), la + r.gauss(0, 0.03 * (s + 1)), lo + r.gauss(0, 0.05), False))
    return rows


def brute_ceiling(rows, sigma=7.0):
    import numpy as np

    from wakeline.functions.kernels import haversine_m
    out = {}
    for key in {(r[0], r[2]) for r in rows}:
        la, lo = (np.array([r[c] for r in rows if (r[0], r[2]) == key]) for c in (3, 4))
        km = haversine_m(la[:, None], lo[:, None], la[None], lo[None]) / 1000
        out[key] = max(np.exp(-0.5 * (km / sigma) ** 2).mean(1).max(), 1e-6)
    return out


@pytest.mark.parametrize("grid", [32, 2])
def test_ceiling_equals_all_pairs(spark, grid, monkeypatch):
    rows = cloud_rows(3, 4, [400, 1, 60, 2]) + [(7, p, 0.0, 1.0, 179.9 if p % 2 else -179.9, False) for p in range(5)]
    df = spark.createDataFrame(rows, "incident_id long, particle_id long, t_h double, lat double, lon double, beached boolean")
    if grid != 32:
        whole = ev.ceiling_candidates
        monkeypatch.setattr(ev, "ceiling_candidates", lambda d: whole(d, grid=grid))
    want = brute_ceiling(rows)
    got = {(r.incident_id, r.t_h): r.ceiling for r in ev.cloud_ceiling(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    some = df.filter("t_h = -2").select("incident_id", "t_h")
    assert {(r.incident_id, r.t_h) for r in ev.cloud_ceiling(df, some).collect()} == {k for k in want if k[1] == -2}


def test_bounds_leave_most_cells_closed(spark):
    rows = cloud_rows(5, 1, [3000])
    df = spark.createDataFrame(rows, "incident_id long, particle_id long, t_h double, lat double, lon double, beached boolean")
    assert ev.ceiling_candidates(df).count() < 0.5 * len(rows)


def test_box_range_bounds_the_distance():
    import numpy as np

    from wakeline.functions.kernels import box_range_m, haversine_m
    r = np.random.default_rng(1)
    a, b = (np.sort(r.uniform(-60, 60, (50, 2)), 1) for _ in range(2))
    x, y = (np.sort(r.uniform(-180, 180, (50, 2)), 1) for _ in range(2))
    near, far = box_range_m(np.hstack([a, x]), np.hstack([b, y]))
    for _ in range(40):
        u, v, w, z = (r.random(50) for _ in range(4))
        d = haversine_m((a[:, 0] + u * (a[:, 1] - a[:, 0]))[:, None], (x[:, 0] + v * (x[:, 1] - x[:, 0]))[:, None],
                        (b[:, 0] + w * (b[:, 1] - b[:, 0]))[None], (y[:, 0] + z * (y[:, 1] - y[:, 0]))[None])
        assert (d >= near - 1e-6).all() and (d <= far + 1e-6).all()


def test_steps_of_few_particles_skip_the_bounds(spark, monkeypatch):
    rows = cloud_rows(3, 2, [400, 60])
    df = spark.createDataFrame(rows, "incident_id long, particle_id long, t_h double, lat double, lon double, beached boolean")
    assert "InPandas" not in ev.ceiling_candidates(df)._jdf.queryExecution().executedPlan().toString()
    whole, want = ev.ceiling_candidates, brute_ceiling(rows)
    for few in (0, 100):                                    # all steps by bounds; some of them
        monkeypatch.setattr(ev, "ceiling_candidates", lambda d, few=few: whole(d, few=few))
        got = {(r.incident_id, r.t_h): r.ceiling for r in ev.cloud_ceiling(df).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
