"""The line's operators on unbounded feeds: cube, coverage, frozen polls, runs, anonymous tracks, thinning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dwellscope.operators.core import assign, local_time


def live_cube(placed: DataFrame, segments: DataFrame, late: str = "2 hours", zone: str = "UTC") -> DataFrame:
    """Counted positions by service date, hour, pattern and segment; rows later than ``late`` are dropped by the watermark."""
    at = assign(placed.where(F.coalesce("count", F.lit(True))).withWatermark("ts", late), segments).where("seg_idx is not null")
    timed = local_time(at.withColumn("__ts", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz")), zone)
    return timed.groupBy(F.window("__ts", "1 hour"), "service_date", "hour", "pattern_uid", "seg_idx").agg(F.count(F.lit(1)).alias("obs")).drop("window")


def live_thin(fixes: DataFrame, tick: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    """The last fix of each track and tick; rows without a track stay out (they are no duplicates of each other)."""
    cols = [c for c in fixes.columns if c not in ("ts", "track_id")]
    held = fixes.where("track_id is not null").withWatermark("ts", late)
    last = held.groupBy(F.window("ts", tick), "track_id").agg(F.max_by(F.struct("ts", *cols), "ts").alias("r"))
    return last.select("track_id", "r.*")


def live_runs(fixes: DataFrame, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """First and last fix of each run of a track without a gap of that length."""
    return fixes.withWatermark("ts", late).groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max("s_m").alias("s_max")).drop("w")


def live_frozen(polls: DataFrame) -> DataFrame:
    """feed, ts, frozen of each poll: whether its digest equals that of the poll before, however long ago."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for r in rows.sort_values("ts").itertuples(index=False):
                out.append((key[0], r.ts, r.sha == before))
                before = r.sha
            state.update((before,))
            yield pd.DataFrame(out, columns=["feed", "ts", "frozen"])

    return polls.groupBy("feed").applyInPandasWithState(step, "feed string, ts timestamp, frozen boolean", "sha string", "append", GroupStateTimeout.NoTimeout)


def live_intervals(polls: DataFrame, cap_s: float = 40.0) -> DataFrame:
    """feed, ts, covered_s of each poll but the last: the time to the next live one, capped. The last waits in the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for t in sorted(rows["ts"]):
                now = t.value // 1000
                if last is not None and now > last:
                    out.append((key[0], pd.Timestamp(last, unit="us"), min((now - last) / 1e6, cap_s)))
                last = now if last is None else max(last, now)
            if last is not None:
                state.update((last,))
            yield pd.DataFrame(out, columns=["feed", "ts", "covered_s"])

    return polls.where("not frozen").select("feed", "ts").groupBy("feed").applyInPandasWithState(step, "feed string, ts timestamp, covered_s double", "last long", "append", GroupStateTimeout.NoTimeout)


def live_tracks(placed: DataFrame) -> DataFrame:
    """row_id, track_id of an anonymous feed's rows, by date and pattern, polls in the order of their times.

    Open tracks are the state; a date's key times out a day after its last poll.
    """
    from dwellscope.operators.tracker import GHOST_S, Tracker, _Track

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker(float("inf"))
        count = 0
        if state.exists:
            nos, times, places, count = state.get
            tracker.open = [_Track(n, t, p) for n, t, p in zip(nos, times, places, strict=True)]
        out = []
        for rows in batches:
            for t, poll in rows.groupby("t", sort=True):
                tracker.all = [None] * count
                found = sorted(((int(i), float(s)) for i, s in zip(poll["row_id"], poll["s_m"], strict=True)), key=lambda x: (-x[1], -x[0]))
                tracker.poll(float(t), [(i, s, float("-inf"), True) for i, s in found])
                count = len(tracker.all)
                out += [(r, f"{key[0]}/{key[1]}/{x.no}") for x in tracker.open for r in x.rows]
                for x in tracker.open:
                    x.rows = []
        live = [x for x in tracker.open if out]
        state.update(([x.no for x in live], [x.t for x in live], [x.pos for x in live], count))
        state.setTimeoutDuration(86_400_000 + int(GHOST_S * 1000))
        yield pd.DataFrame(out, columns=["row_id", "track_id"])

    rows = placed.select(F.col("service_date").cast("string").alias("service_date"), "pattern_uid", "row_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("s_m").cast("double").alias("s_m"))
    return rows.groupBy("service_date", "pattern_uid").applyInPandasWithState(step, "row_id long, track_id string", "nos array<int>, times array<double>, places array<double>, count int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_hours(cube: DataFrame, path: str):
    """A stream writer that replaces the hours a batch has: late rows correct hours already written.

    Each batch goes to its own folder; ``latest_hours`` reads the last value of each bin.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cube.writeStream.outputMode("update").foreachBatch(write)


def latest_hours(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    keys = ["service_date", "hour", "pattern_uid", "seg_idx"]
    return rows.groupBy(*keys).agg(F.max_by("obs", "batch").alias("obs"))
