"""Gate and evidence of whole tracks in blocks, against the same made fix by fix and leg by leg."""

import math
import random

import pytest
from pyspark.sql import functions as F

from test_evidence import INC
from test_tracks import fixes
from wakeline.operators import blocks as bl
from wakeline.operators import evidence as ev
from wakeline.operators import spatial as sp


def world(spark, seed=3):
    """Tracks and incidents around a common place, the date line and a pole; two vessels report much more often."""
    rnd = random.Random(seed)
    centres = [(15.5, 73.1), (0.2, 179.9), (-0.1, -179.95), (89.2, 10.0)]
    rows = []
    for m in range(1, 41):
        la, lo = centres[m % 4]
        la, lo, n = la + rnd.uniform(-.4, .4), lo + rnd.uniform(-.4, .4), 300 if m < 3 else rnd.randint(2, 40)
        t = sorted({round(rnd.uniform(-12, 0), 4) for _ in range(n)})
        lon = lambda x: (x + 180) % 360 - 180
        rows += [(m, x, min(la + .03 * (x + 6), 89.9), lon(lo + .05 * (x + 6))) for x in t]
    inc = []
    for i in range(1, 61):
        la, lo = centres[i % 4]
        la, lo, w = la + rnd.uniform(-.5, .5), lo + rnd.uniform(-.5, .5), rnd.choice((-9.0, -7.5))
        if i % 5 == 0:
            la, lo, w = inc[i - 5][1], inc[i - 5][2], inc[i - 5][3]          # the same place and window again
        known = i % 7 != 0
        inc.append((i, la, lo, w, -1.0, [0.0, 5.0, 140.0, 1500.0][i % 4] if i > 40 else 0.0, la + .1 if known else None, lo + .1 if known else None,
                    30.0 if i % 11 == 0 else None, -4.0 if i % 2 else None, -3.0 if i % 2 else None))
    inc.append((61, None, 73.0, -9.0, -1.0, 0.0, None, None, None, None, None))
    return fixes(spark, rows), spark.createDataFrame(inc, INC)


def table(df):
    return {(r.incident_id, r.mmsi): r.asDict() for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(want) > 300
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-7) if isinstance(v, float) else v), (k, c)


@pytest.mark.parametrize("few", [bl.FEW, 100])
def test_blocks_give_the_gate_and_evidence_of_single_legs(spark, few):
    f, i = world(spark)
    near = sp.gate(f, i, few=0)
    same(table(sp.gate(f, i, few=few)), table(near))
    lg = sp.pair_legs(near, f, i)
    want = ev.window_evidence(lg).join(ev.st_score(lg, f), ev.PAIR)
    who = f.select("mmsi").distinct().withColumn("label", F.concat(F.lit("V"), "mmsi"))
    got = table(ev.pair_evidence(f, i, carry=who, few=few))
    assert all(r["label"] == f"V{r['mmsi']}" for r in got.values())
    same(got, table(want))


def test_incidents_that_are_shuffled_meet_the_same_pairs(spark):
    f, i = world(spark, 4)
    same(table(bl.judged(f, i, few_incidents=1)), table(sp.gate(f, i, few=0)))


def test_no_pair_is_shuffled(spark):
    """A pair leaves the task that judged it; nothing is grouped or exchanged after the blocks have met."""
    f, i = world(spark)
    plan = ev.pair_evidence(f, i)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    assert "Exchange" in plan and math.isfinite(plan.index("Exchange"))
