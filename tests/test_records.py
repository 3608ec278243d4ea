import random

import pytest

from wakeline.operators import alerts as al
from wakeline.operators import scope as sc
from wakeline.sources import zones as zn


@pytest.fixture(scope="module")
def zones(spark):
    z = zn.zone_catalogue(spark)
    return z, zn.zone_edges(zn.polygons(z))


def test_zone_chains(spark, zones):
    z, e = zones
    pts = [(1, 18.9, 72.0, "IN-MH>IN-WEST>IN-NATIONAL"), (2, 22.0, 69.0, "IN-GJ>IN-WEST>IN-NATIONAL"), (3, 10.0, 75.0, "IN-KL>IN-SOUTH>IN-NATIONAL"),
           (4, 10.0, 93.0, "IN-AN>IN-ISLANDS>IN-NATIONAL"), (5, 5.0, 60.0, "")]
    got = {r.id: ">".join(r.chain) for r in sc.zones_of(spark.createDataFrame([p[:3] for p in pts], "id int, lat double, lon double"), e, z).collect()}
    assert got == {p[0]: p[3] for p in pts}


def test_border_point_belongs_to_both(spark, zones):
    z, e = zones
    p = spark.createDataFrame([(1, 20.4, 70.0)], "id int, lat double, lon double")
    assert {r.zone_id for r in sc.points_in_zones(p, e).collect()} >= {r.zone_id for r in z.filter("code in ('IN-GJ', 'IN-MH')").collect()}
    assert sc.points_in_zones(p, e, boundary=False).count() == 0


def test_closure_and_management(spark, zones):
    z, _ = zones
    ids = {r.code: r.zone_id for r in z.collect()}
    users = spark.createDataFrame([(1, "NATIONAL", []), (2, "REGIONAL", [ids["IN-WEST"]]), (3, "PILOT", [ids["IN-MH"]]), (4, "PILOT", [ids["IN-MH"], ids["IN-KL"]]), (5, "PILOT", [])],
                                  "user_id int, role string, zone_ids array<int>")
    acc = sc.accessible(users, z)
    n = {r.user_id: r["count"] for r in acc.groupBy("user_id").count().collect()}
    assert n == {1: 14, 2: 4, 3: 1, 4: 2}
    scope = acc.filter("user_id = 2").withColumnRenamed("user_id", "scope_id")
    assert [r.user_id for r in sc.manageable(users, scope).collect()] == [3]


def test_polygon_with_hole(spark):
    g = '{"type": "Polygon", "coordinates": [[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}'
    e = zn.zone_edges(zn.polygons(spark.createDataFrame([(1, g)], "zone_id int, geometry string")))
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.0, 2.0), (3, 4.0, 5.0), (4, 11.0, 5.0)], "id int, lat double, lon double")
    assert {r.id for r in sc.points_in_zones(p, e).collect()} == {2, 3}


ALERTS = "alert_id long, t_us long, lat double, lon double, force boolean, outcome string"


def walked(rows):
    """Sequential walk in order of (time, id)."""
    live, want = [], {}
    for r in sorted((r for r in rows if None not in r[1:4]), key=lambda r: (r[1], r[0])):
        near = [x[0] for x in live if r[1] - x[1] <= 180 * 60_000_000 and abs(x[2] - r[2]) <= 0.05 and abs(x[3] - r[3]) <= 0.05]
        if near and not r[4]:
            want[r[0]] = ("SUPPRESSED", max(near))
            continue
        want[r[0]] = (r[5], None)
        if r[5] == "SENT":
            live.append(r)
    return want | {r[0]: (r[5], None) for r in rows if None in r[1:4]}


def near_verdicts(spark, rows, **blocks):
    return {r.alert_id: (r.status, r.dedup_of_id) for r in al.suppress_near(spark.createDataFrame(rows, ALERTS), **blocks).collect()}


@pytest.mark.parametrize("tile,span", [(64, 8), (1, 1), (2, 1)])
def test_near_suppression_equals_brute_force(spark, tile, span):
    rnd = random.Random(3)
    ids = rnd.sample(range(1000), 400)                                          # ids do not follow the time
    rows = [(i, rnd.randrange(0, 40 * 3600, 600) * 1_000_000, 10 + rnd.randrange(-8, 8) * 0.03, rnd.randrange(-8, 8) * 0.03, rnd.random() < 0.05,
             rnd.choice(["SENT", "SENT", "FAILED"])) for i in ids]
    rows += [(2000, None, 10.0, 0.0, False, "SENT"), (2001, 5, None, 0.0, False, "SENT"), (2002, 5, 10.0, None, None, "FAILED")]
    assert near_verdicts(spark, rows, tile=tile, span=span) == walked(rows)


@pytest.mark.parametrize("tile,span", [(64, 8), (1, 1)])
def test_suppression_is_exact_before_near(spark, tile, span):
    rnd = random.Random(8)
    rows = []
    for i in rnd.sample(range(1000), 300):
        la, lo = (None, None) if rnd.random() < 0.3 else (10 + rnd.randrange(-6, 6) * 0.03, rnd.randrange(-6, 6) * 0.03)
        kind = rnd.choice(["oil", "ais"])
        fp = f"{kind} na" if la is None else None if rnd.random() < 0.1 else f"{kind} {round(la / 0.05)} {round(lo / 0.05)}"
        rows.append((i, rnd.randrange(0, 30 * 3600, 600) * 1_000_000, la, lo, rnd.random() < 0.05, rnd.choice(["SENT", "MOCKED", "FAILED"]), fp))
    rows += [(2000, None, 10.0, 0.0, False, "SENT", "oil na"), (2001, 5, None, 0.0, False, "SENT", None), (2002, 6, float("nan"), 0.0, None, "SENT", "lone")]
    live, want = [], {2000: ("SENT", None), 2001: ("SENT", None), 2002: ("SENT", None)}
    for r in sorted((r for r in rows if r[0] < 2000), key=lambda r: (r[1], r[0])):
        held = [x for x in live if r[1] - x[1] <= 180 * 60_000_000]
        same = [x[0] for x in held if r[6] is not None and x[6] == r[6]]
        near = [x[0] for x in held if r[2] is not None and x[2] is not None and abs(x[2] - r[2]) <= 0.05 and abs(x[3] - r[3]) <= 0.05]
        dup = max(same or near, default=None)
        want[r[0]] = (r[5], None) if r[4] or dup is None else ("SUPPRESSED", dup)
        if want[r[0]][0] in ("SENT", "MOCKED"):
            live.append(r)
    df = spark.createDataFrame(rows, ALERTS + ", fingerprint string")
    assert {r.alert_id: (r.status, r.dedup_of_id) for r in al.suppress(df, tile=tile, span=span).collect()} == want


def test_near_suppression_of_a_regular_chain_takes_few_rounds(spark, monkeypatch):
    """One alert every two hours: each block that guesses its entry has every other verdict wrong until it sees the true one."""
    rows = [(k, k * 7_200_000_000, 10.0, 70.0, False, "SENT") for k in range(300)]
    rounds = []
    fold = al._fold
    monkeypatch.setattr(al, "_fold", lambda *a: rounds.append(a[3:]) or fold(*a))
    assert near_verdicts(spark, rows, span=1) == walked(rows)
    assert len(rounds) <= 11                                                    # 200 cooldowns are 8 doublings


@pytest.mark.parametrize("tile,span", [(1, 1), (4, 2)])
def test_late_rounds_open_only_what_is_near_a_change(spark, monkeypatch, tile, span):
    """A row of alerts 0.04 degrees and two hours apart is wrong from block to block; a crowd far from it settles at once."""
    rows = [(k, k * 7_200_000_000, 10.0 + 0.04 * (k % 20), 70.0, False, "SENT") for k in range(60)]
    rows += [(1000 + k, (k % 7) * 600_000_000, 40.0 + k, 20.0, False, "SENT") for k in range(40)]
    sizes = []
    fold = al._fold
    monkeypatch.setattr(al, "_fold", lambda part, *a: sizes.append(part.count()) or fold(part, *a))
    assert near_verdicts(spark, rows, tile=tile, span=span, few=1) == walked(rows)
    assert sizes[0] == 100 and len(sizes) > 2 and sizes[-1] <= 60
    rnd = random.Random(5)
    mixed = [(i, rnd.randrange(0, 60 * 3600, 600) * 1_000_000, 10 + rnd.randrange(-40, 40) * 0.03, rnd.randrange(-4, 4) * 0.03, rnd.random() < 0.05,
              rnd.choice(["SENT", "SENT", "FAILED"])) for i in rnd.sample(range(5000), 800)]
    assert near_verdicts(spark, mixed, tile=tile, span=span, few=1) == walked(mixed)


def test_near_suppression_small_tables(spark):
    assert near_verdicts(spark, []) == {}
    hot = [(k, 1000 * k, 10.0, 70.0, k % 3 == 0, "SENT") for k in range(30_000)]    # a hot cell, a third of it forced
    got = near_verdicts(spark, hot)
    assert got[0] == ("SENT", None) and all(got[k] == (("SENT", None) if k % 3 == 0 else ("SUPPRESSED", k - k % 3)) for k in range(1, 30_000))


def test_retry_cap_and_fingerprint(spark):
    log = "alert_id long, status string, attempts int, error_log array<struct<attempt:int,status:string,error:string>>, last_error string"
    a = spark.createDataFrame([(1, "FAILED", 3, [], None), (2, "FAILED", 1, [], None), (3, "SENT", 1, [], None)], log)
    o = spark.createDataFrame([(1, "SENT", None), (2, "SENT", None), (3, "FAILED", "x")], "alert_id long, status string, error string")
    got = {r.alert_id: (r.status, r.attempts, len(r.error_log)) for r in al.apply_outcomes(a, o).collect()}
    assert got == {1: ("FAILED", 3, 1), 2: ("SENT", 2, 1), 3: ("SENT", 1, 0)}
    assert [r.alert_id for r in al.retry_queue(a).collect()] == [2]


def test_land_sources(spark, tmp_path):
    poly = '{"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'
    texts = {"fc": '{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": %s}, {"type": "Feature", "geometry": null}]}' % poly,
             "one": '{"type": "Feature", "geometry": %s}' % poly, "bare": "[%s]" % poly, "geom": poly}
    for name, t in texts.items():
        f = tmp_path / f"{name}.json"
        f.write_text(t)
        g = zn.read_land_geojson(spark, str(f))
        assert zn.zone_edges(zn.polygons(g)).count() == 4, name
