"""Streams replayed against brute force, re-runs that rank nobody, scoped lookups, quantiles with an outlier."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wakeline.operators import records, scope
from wakeline.operators.alerts import LIVE
from wakeline.operators.slices import exact_quantiles
from wakeline.plans import all_queries
from wakeline.plans import fixtures as fx
from wakeline.session import shared_folder
from wakeline.streaming import live


def replay(spark, parts, schema):
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, spark):
    writer.option("checkpointLocation", f"{shared_folder(spark)}/s-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()


def test_cooldown_suppresses_forward_only(spark):
    m, live_status = 60_000_000, sorted(LIVE)[0]
    rows = [(1, 0, 1.0, False), (2, 100, 1.0, False), (3, 181, 1.0, False), (4, 200, 1.0, True), (5, 250, 1.0, False), (6, 10, 9.0, False)]
    late = [(7, 150, 1.0, False), (8, 1000, 1.0, False), (9, 1100, 9.0, False)]       # 7 is older than the cell's last live alert
    make = lambda part: [(i, pd.Timestamp((t + 1_000_000) * m // 1000, unit="ms").to_pydatetime(), lat, 2.0, f, live_status) for i, t, lat, f in part]
    stream = replay(spark, [make(rows), make(late)], "alert_id long, ts timestamp, lat double, lon double, force boolean, outcome string")
    out = live.alert_cooldown(stream, watermark="30 days")
    sink = f"{shared_folder(spark)}/o-{uuid.uuid4().hex}"
    run(out.writeStream.format("parquet").option("path", sink), spark)
    got = {r.alert_id: (r.status, r.dedup_of_id) for r in spark.read.parquet(sink).collect()}
    assert got[1] == (live_status, None) and got[2] == ("SUPPRESSED", 1)
    assert got[3] == (live_status, None) and got[4] == (live_status, None)      # past the cooldown; forced
    assert got[5] == ("SUPPRESSED", 4)
    assert got[7] == (live_status, None)                                        # late: nothing live before it is known to be near
    assert got[8] == (live_status, None) and got[9] == (live_status, None)


def test_cooldown_does_not_depend_on_arrow_batches(spark):
    import random
    r = random.Random(4)
    rows = [(i, pd.Timestamp((1_000_000 + 10 * i) * 60_000, unit="ms").to_pydatetime(), 1.0, 2.0, i % 17 == 5, sorted(LIVE)[0]) for i in range(90)]
    r.shuffle(rows)
    last, want = None, {}
    for i, ts, *_, force, outcome in sorted(rows):
        if last is not None and (ts - last[1]).total_seconds() <= live.C.COOLDOWN_MIN * 60 and not force:
            want[i] = ("SUPPRESSED", last[0])
        else:
            want[i], last = (outcome, None), (i, ts)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stream = replay(spark, [rows], "alert_id long, ts timestamp, lat double, lon double, force boolean, outcome string")
        sink = f"{shared_folder(spark)}/o-{uuid.uuid4().hex}"
        run(live.alert_cooldown(stream, watermark="30 days").writeStream.format("parquet").option("path", sink), spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {x.alert_id: (x.status, x.dedup_of_id) for x in spark.read.parquet(sink).collect()} == want


def test_sessions_hold_no_heartbeat_of_a_vessel_that_ends_early(spark, monkeypatch):
    minute = 60_000_000
    fixes = [(1, 0), (1, 10), (1, 700), (2, 0), (2, 5)]             # vessel 2 falls silent eleven hours before the feed ends
    track = spark.createDataFrame([(m, fx.EPOCH_US + t * minute) for m, t in fixes], "mmsi long, t_us long")
    monkeypatch.setattr(fx, "tracks", lambda spark, sf: track)
    got = sorted(tuple(r) for r in all_queries()[0]["x2_track_sessions"](spark, "").collect())
    assert got == [(1, 0, 2), (1, 700 * minute, 1), (2, 0, 2)]


def test_dark_vessels_share_a_state(spark):
    import random
    r, limit = random.Random(7), 20
    fixes = sorted({(m, r.randrange(0, 600)) for m in (1, 2, 3, 300, 301) for _ in range(25)} | {(9, 3)})
    ts = lambda t: pd.Timestamp((1_000_000 + t) * 60_000, unit="ms").to_pydatetime()
    parts = [[(m, ts(t)) for m, t in fixes if lo <= t < lo + 150] for lo in range(0, 600, 150)] + [[(3, ts(700))], [(3, ts(800))]]
    want = set()
    for m in {m for m, _ in fixes}:
        own = [t for k, t in fixes if k == m] + ([700, 800] if m == 3 else [])
        want |= {(m, a, b, "gap") for a, b in zip(own, own[1:]) if b - a > limit}
        want.add((m, own[-1], own[-1] + limit, "dark")) if m != 3 else None
    stream = replay(spark, parts, "mmsi long, ts timestamp")
    sink = f"{shared_folder(spark)}/d-{uuid.uuid4().hex}"
    run(live.dark_vessels(stream, limit, watermark="1 minute").writeStream.format("parquet").option("path", sink), spark)
    got = [(x.mmsi, x.start_us // 60_000_000 - 1_000_000, x.end_us // 60_000_000 - 1_000_000, x.kind) for x in spark.read.parquet(sink).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    assert {g for g in got if g[3] == "gap"} == {w for w in want if w[3] == "gap"}
    assert all((m, a) in {(k, t) for k, t in fixes} | {(3, 700)} for m, a, _, kind in got if kind == "dark")


def test_replay_takes_a_range_of_several_files_at_once(spark):
    all_queries()
    from wakeline.plans import q_models
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("t"), "id")     # the first quartile is one value
    stream = q_models.replay(spark, df, "t", rows=80)
    seen = []
    run(stream.writeStream.foreachBatch(lambda b, e: seen.append((b.select(F.input_file_name()).distinct().count(), b.count(), b.agg(F.min("t"), F.max("t")).first()))), spark)
    assert sum(n for _, n, _ in seen) == 1000 and max(f for f, *_ in seen) == 4
    full = [tuple(x) for *_, x in seen if x[0] is not None]
    assert all(a[1] < b[0] for a, b in zip(full, full[1:]))


def test_late_rows_survive_a_restart(spark):
    base = f"{shared_folder(spark)}/l-{uuid.uuid4().hex}"
    ts = lambda minute: pd.Timestamp(minute * 60, unit="s").to_pydatetime()
    path, schema = f"{base}/feed", "id long, ts timestamp"
    for part in ([(1, ts(0)), (2, ts(300))], [(3, ts(310)), (4, ts(10))], [(5, ts(250)), (6, ts(100))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        feed = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path)
        live.split_late(feed, f"{base}/ok", f"{base}/late", f"{base}/progress").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    ids = lambda n: sorted(r.id for r in spark.read.parquet(f"{base}/{n}").collect())
    assert ids("ok") == [1, 2, 3, 5] and ids("late") == [4, 6]


def test_rerun_that_ranks_nobody_clears_its_rows(spark):
    schema = "id long, case_id long, mmsi long, source string"
    old = spark.createDataFrame([(1, 1, 10, "FUSION"), (2, 2, 20, "FUSION"), (3, 1, None, "SAR"), (4, 3, 30, "FUSION")], schema)
    new = spark.createDataFrame([(5, 2, 21, "FUSION")], schema)
    got = records.replace_fusion(old, new, spark.createDataFrame([(1,), (2,)], "case_id long"))
    assert sorted(r.id for r in got.collect()) == [3, 4, 5]


def test_lookup_hides_rows_without_a_point(spark):
    rows = spark.createDataFrame([(1, 10.0, 70.0), (2, None, None), (3, None, None)], "id long, lat double, lon double")
    keys = spark.createDataFrame([(s, i) for s in (1, 2) for i in (1, 2, 3, 4)], "scope_id int, id long")
    seen = spark.createDataFrame([(1, 1), (1, 2)], "scope_id int, id long")
    got = {(r.scope_id, r.id): r.verdict for r in scope.lookup(keys, rows, seen).collect()}
    assert got == {(1, 1): "found", (1, 2): "found", (1, 3): "forbidden", (1, 4): "missing",
                   (2, 1): "forbidden", (2, 2): "forbidden", (2, 3): "forbidden", (2, 4): "missing"}


def test_quantiles_with_an_outlier_stay_exact_and_even(spark):
    v = np.append(np.random.default_rng(1).random(20_000), 1e9)
    df = spark.createDataFrame(pd.DataFrame({"k": np.zeros(len(v), np.int64), "v": v}))
    r = exact_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.999}).first()
    assert np.allclose([r.a, r.m, r.z], np.quantile(v, [0.1, 0.5, 0.999]))
    edges = df.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 20 * 64)).first()[0]
    assert np.bincount(np.searchsorted(edges, v, side="right")).max() < len(v) / 20
