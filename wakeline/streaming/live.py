"""Structured Streaming twins of the batch operators for live position and alert feeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline import config as C
from wakeline.operators.alerts import LIVE
from wakeline.operators.clean import usable


def clean_stream(pings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Row cleaning and de-duplication within the watermark."""
    u = usable(pings).withColumn("_la", F.round("latitude", 6)).withColumn("_lo", F.round("longitude", 6))
    return u.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["mmsi", "ts", "_la", "_lo"]).drop("_la", "_lo")


def track_sessions(pings: DataFrame, split: str = "360 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions per vessel; a fix exactly `split` later stays in the session."""
    return (pings.withWatermark("ts", watermark).groupBy("mmsi", F.session_window("ts", split))
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


SILENCE = np.dtype([("mmsi", "i8"), ("last", "i8"), ("told", "i8")])
CELL = np.dtype([("cy", "f8"), ("cx", "f8"), ("t", "i8"), ("id", "i8")])


def _held(state: GroupState, kind: np.dtype) -> list[tuple]:
    """Rows that a block of keys keeps in its state."""
    return np.frombuffer(state.get[0], kind).tolist() if state.exists else []


def _hold(state: GroupState, rows: list[tuple], kind: np.dtype) -> None:
    state.update((np.array(rows, kind).tobytes(),))


def dark_vessels(pings: DataFrame, minutes: float = C.GAP_FLAG_MIN, watermark: str = "1 hour", block: int = 256) -> DataFrame:
    """Silences longer than `minutes`: a closed row (kind 'gap') when the vessel is heard again, an open row (kind 'dark')
    when the event-time timer fires while it is still silent. State per vessel is one timestamp and whether its silence was
    told; `block` neighbouring MMSI numbers share a state, so a micro-batch makes a Python call a block, not a vessel."""
    limit = int(minutes * 60_000_000)
    nobody = -(1 << 62)

    def step(key, batches, state: GroupState):
        held = {m: (t, told) for m, t, told in _held(state, SILENCE)}
        out, heard = [], set()
        parts = [] if state.hasTimedOut else [(b["_m"].to_numpy(), b["t_us"].to_numpy()) for b in batches]
        if parts:
            ids, times = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((times, ids))
            for m, t in zip(ids[order].tolist(), times[order].tolist()):
                last = held[m][0] if m in held else t
                if t - last > limit:
                    out.append((m, last, t, "gap"))
                held[m] = (max(last, t), 0)
                heard.add(m)
        now, due = state.getCurrentWatermarkMs(), lambda t: (t + limit) // 1000 + 1
        for m, (t, told) in held.items():
            if not told and m not in heard and due(t) < now:
                out.append((m, t, t + limit, "dark"))
                held[m] = (t, 1)
        _hold(state, [(m, *v) for m, v in held.items()], SILENCE)
        waiting = [due(t) for t, told in held.values() if not told]
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting), now + 1))
        d = pd.DataFrame(out, columns=["mmsi", "start_us", "end_us", "kind"])
        d["mmsi"] = pd.array([None if m == nobody else m for m in d["mmsi"]], dtype="Int64")
        yield d
    p = pings.withWatermark("ts", watermark).select("ts", F.coalesce("mmsi", F.lit(nobody)).cast("long").alias("_m"), F.unix_micros("ts").alias("t_us"))
    return p.withColumn("_block", F.floor(F.col("_m") / block)).groupBy("_block").applyInPandasWithState(
        step, "mmsi long, start_us long, end_us long, kind string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def alert_cooldown(alerts: DataFrame, minutes: int = C.COOLDOWN_MIN, grid: float = C.DEDUP_GRID_DEG, watermark: str = "1 hour",
                   tile: int = 32) -> DataFrame:
    """Suppression per grid cell: an alert within the cooldown after the cell's last live one is suppressed and does not
    extend the cooldown. Alerts of a micro-batch are taken in order of time. A late alert is not suppressed by a later one and does not set the cooldown back. The state of a
    cell is one alert and is dropped when the watermark passes its cooldown; `tile` x `tile` cells share a state, so a micro-batch
    makes a Python call a tile, not a cell. Neighbouring cells are the batch operator's."""
    us = minutes * 60_000_000

    def step(key, batches, state: GroupState):
        held = {(cy, cx): (t, i) for cy, cx, t, i in _held(state, CELL)}
        parts = [] if state.hasTimedOut else [[b[c].to_numpy() for c in ("t_us", "alert_id", "force", "outcome", "_cy", "_cx")] for b in batches]
        if parts:               # the tile's alerts of the micro-batch in order of time, however Arrow has cut them
            times, ids, *rest = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((ids, times))
            times, ids, force, status, cy, cx = (c[order].tolist() for c in (times, ids, *rest))
            dup_of = [None] * len(ids)
            for i, cell in enumerate(zip(cy, cx)):
                last_t, last_id = held.get(cell, (None, None))
                if last_t is not None and 0 <= times[i] - last_t <= us and not force[i]:
                    dup_of[i], status[i] = last_id, "SUPPRESSED"
                elif status[i] in LIVE and (last_t is None or times[i] >= last_t):
                    held[cell] = (times[i], ids[i])
            for at in range(0, len(ids), 10_000):
                d = pd.DataFrame({"alert_id": ids[at:at + 10_000], "status": status[at:at + 10_000]})
                d["dedup_of_id"] = pd.array(dup_of[at:at + 10_000], dtype="Int64")
                yield d
        now, end = state.getCurrentWatermarkMs(), lambda t: (t + us) // 1000 + 1
        held = {cell: v for cell, v in held.items() if end(v[0]) >= now}
        if held:
            _hold(state, [(*cell, *v) for cell, v in held.items()], CELL)
            state.setTimeoutTimestamp(max(max(end(t) for t, _ in held.values()), now + 1))
        elif state.exists:
            state.remove()
    # alerts without a place, or with none that is a number, have a cell of their own beyond the grid
    cell = lambda c: F.coalesce(F.nanvl(F.rint(F.col(c) / grid), F.lit(-2e300)), F.lit(-1e300))
    a = alerts.withWatermark("ts", watermark).select("alert_id", "ts", F.unix_micros("ts").alias("t_us"), "force", "outcome",
                                                     cell("lat").alias("_cy"), cell("lon").alias("_cx"))
    tiles = {"_ty": F.floor(F.col("_cy") / tile), "_tx": F.floor(F.col("_cx") / tile)}
    return a.withColumns(tiles).groupBy(*tiles).applyInPandasWithState(
        step, "alert_id long, status string, dedup_of_id long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def bucket_counts(alerts: DataFrame, size: str = "60 minutes", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Alerts per time bucket, tumbling or sliding."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return alerts.withWatermark("ts", watermark).groupBy(win, "kind").agg(F.count(F.lit(1)).alias("n"))


def split_late(rows: DataFrame, on_time_path: str, late_path: str, progress_path: str, delay_min: float = 60.0):
    """foreachBatch writer: rows older than the running maximum (of earlier batches) minus the delay go to a side table.

    The maximum of each batch is a row under `progress_path`, so a restart goes on where it was; each batch writes its own
    `epoch=` folder and overwrites it, so a repeated batch leaves its rows once.
    """
    schema = "top long, epoch long"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tagged = batch.persist()
        top = tagged.agg(F.max(F.unix_micros("ts")).alias("top"))
        top.write.mode("overwrite").parquet(f"{progress_path}/epoch={epoch}")
        seen = spark.read.schema(schema).parquet(progress_path).filter(F.col("epoch") < epoch).agg(F.max("top")).first()[0]
        late = F.lit(False) if seen is None else F.unix_micros("ts") < seen - int(delay_min * 60_000_000)
        tagged.filter(~late).write.mode("overwrite").parquet(f"{on_time_path}/epoch={epoch}")
        tagged.filter(late).write.mode("overwrite").parquet(f"{late_path}/epoch={epoch}")
        tagged.unpersist()
    return rows.writeStream.foreachBatch(write)
