"""Tracks of feeds without vehicle ids, and passages counted from tracks.

Vehicles of a pattern do not overtake, so the positions of each poll are matched front to back to open tracks. That is one
pass over a date's polls of a pattern, so it runs as a grouped Arrow function; a group is one pattern's day.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analysis import FLAGS
from .core import local_time, runs
from .tracks import line_passages

# How long an unseen vehicle lives, how far a detection may lie behind its track, top speed, when a track is stale, standing at a start.
GHOST_S, AHEAD_M, TOP_MS, STALE_S, STANDING_S = 300.0, 60.0, 25.0, 45.0, 100.0
# Distance of counting lines, place of the first, their distance to a stop.
LINE_STEP_M, LINE_FIRST_M, STOP_GAP_M = 10.0, 5.0, 10.0


@dataclass
class _Track:
    no: int
    t: float
    pos: float
    rows: list[int] = field(default_factory=list)


class Tracker:
    """Follows one pattern's vehicles through a date."""

    def __init__(self, end: float):
        self.end = end - 0.01
        self.open: list[_Track] = []
        self.all: list[_Track] = []

    def poll(self, t: float, found: list[tuple[int, float, float, bool]]) -> None:
        """One poll: (row, position, least position of its track, real) from the front to the back."""
        self.open = sorted((x for x in self.open if t - x.t <= GHOST_S), key=lambda x: -x.pos)
        queue = list(self.open)
        for row, pos, least, real in found:
            track = self._match(queue, t, pos, least, real)
            if track is None:
                track = _Track(len(self.all), t, pos)
                self.all.append(track)
                self.open.append(track)
            track.t, track.pos = t, max(track.pos, pos)
            track.rows.append(row)

    def _match(self, queue: list[_Track], t: float, pos: float, least: float, real: bool) -> _Track | None:
        """Takes the track that this detection continues from the front of ``queue``, passing over those it cannot be."""
        def reaches(x: _Track) -> bool:
            return pos - x.pos <= TOP_MS * (t - x.t) + AHEAD_M and x.pos >= least

        while queue:
            track = queue[0]
            if track.pos > pos + AHEAD_M:
                queue.pop(0)  # not seen in this poll
                continue
            if len(queue) > 1 and track.pos > pos and t - track.t > STALE_S:
                follower = queue[1]
                if follower.pos <= pos and t - follower.t <= STALE_S and reaches(follower):
                    queue.pop(0)  # vehicles do not reverse: a ghost just ahead is not this one
                    continue
            if not reaches(track):
                return None
            if real and pos >= self.end and track.pos >= self.end and len(queue) > 1 and reaches(queue[1]):
                return queue.pop(1)  # the vehicle that arrives, not the one parked there
            return queue.pop(0)
        return None

    def standing(self, t: list[float], s: list[float], at_stop: list[bool]) -> set[int]:
        """Rows with which tracks begin standing at a stop for STANDING_S or longer."""
        out: set[int] = set()
        for track in self.all:
            first = track.rows[0]
            if not at_stop[first]:
                continue
            still = []
            for r in track.rows:
                if abs(s[r] - s[first]) >= 1e-3:
                    break
                still.append(r)
            if t[still[-1]] - t[first] >= STANDING_S:
                out |= set(still)
        return out


_OUT = "row_id long, track_no int, waits boolean"


def _track_day(key, rows):
    by = rows.sort_by([("t", "ascending"), ("s_m", "descending"), ("row_id", "descending")])
    t, s, ids = (by.column(c).to_pylist() for c in ("t", "s_m", "row_id"))
    pos, flags, count = (by.column(c).to_pylist() for c in ("pos_m", "flags", "count"))
    layover = [bool(f & FLAGS["LAYOVER"]) for f in flags]
    tracker = Tracker(max(s))
    at = 0
    while at < len(t):
        end = at
        found = []
        while end < len(t) and t[end] == t[at]:
            pseudo_end = layover[end] and not count[end] and pos[end] > 0
            # a row put at the terminus only continues a track that was on the last link
            found.append((end, s[end], s[end] - pos[end] - AHEAD_M if pseudo_end else float("-inf"), count[end] or not layover[end]))
            end += 1
        tracker.poll(t[at], found)
        at = end
    no = [0] * len(t)
    for track in tracker.all:
        for r in track.rows:
            no[r] = track.no
    waits = tracker.standing(t, s, [bool(f & FLAGS["AT_STOP"]) and not x for f, x in zip(flags, layover, strict=True)])
    return pa.table({"row_id": pa.array(ids, pa.int64()), "track_no": pa.array(no, pa.int32()), "waits": pa.array([i in waits for i in range(len(t))], pa.bool_())})


def track_anonymous(placed: DataFrame) -> DataFrame:
    """Placed rows with track_id date/pattern/number where they have a place; rows with which a track stands waiting at a stop become layover.

    ``placed`` has service_date, pattern_uid, ts, s_m, pos_m, flags, count, row_id (unique).
    """
    known = placed.where("pattern_uid is not null and s_m is not null").select(
        "service_date", "pattern_uid", "row_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("s_m").cast("double").alias("s_m"),
        F.coalesce(F.col("pos_m").cast("double"), F.lit(0.0)).alias("pos_m"), F.coalesce(F.col("flags").cast("int"), F.lit(0)).alias("flags"), F.coalesce("count", F.lit(True)).alias("count"),
    )
    found = known.groupBy("service_date", "pattern_uid").applyInArrow(_track_day, _OUT)
    out = placed.join(found, "row_id", "left")
    name = F.when(F.col("track_no").isNotNull(), F.concat_ws("/", F.col("service_date").cast("string"), "pattern_uid", F.col("track_no").cast("string")))
    wait = F.coalesce("waits", F.lit(False))
    out = out.withColumn("track_id", F.coalesce(name, F.col("track_id").cast("string")) if "track_id" in placed.columns else name)
    out = out.withColumn("count", F.when(wait, F.lit(False)).otherwise(F.col("count"))).withColumn("flags", F.when(wait, F.col("flags").bitwiseOR(FLAGS["LAYOVER"])).otherwise(F.col("flags")))
    return out.drop("track_no", "waits")


def track_runs(placed: DataFrame) -> DataFrame:
    """Rows of tracks by date, pattern and track, numbered in runs, with the furthest position so far."""
    rows = placed.where("track_id is not null and s_m is not null and pattern_uid is not null")
    keyed = rows.withColumn("owner", F.col("track_id")).withColumn("track_id", F.concat_ws("|", "pattern_uid", F.col("service_date").cast("string"), F.col("track_id").cast("string")))
    return runs(keyed.withColumn("s_m", F.col("s_m").cast("double")), GHOST_S, 100.0)


def line_crossings(placed: DataFrame, step_m: float = LINE_STEP_M, first_m: float = LINE_FIRST_M) -> DataFrame:
    """service_date, pattern_uid, line, t (seconds) of every counting line that a run passes.

    Between fixes the time is in proportion to the way. A run that ends on the link to its own terminus (term_s_m) is taken
    to reach it: the lines beyond its last fix get that fix's time.
    """
    d = track_runs(placed).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = W.partitionBy("track_id", "run").orderBy("ts", "s_max")
    d = d.withColumn("s0", F.lag("s_max").over(w)).withColumn("t0", F.lag("t").over(w)).withColumn("last", F.lead("ts").over(w).isNull())
    line = lambda s: F.floor((s - first_m) / step_m)
    step = d.where("s_max > s0").withColumn("k0", F.greatest(line(F.col("s0")) + 1, F.lit(0))).withColumn("k1", line(F.col("s_max"))).where("k0 <= k1").withColumn("line", F.explode(F.sequence("k0", "k1")))
    part = (F.col("line") * step_m + first_m - F.col("s0")) / (F.col("s_max") - F.col("s0"))
    out = step.select("service_date", "pattern_uid", "line", (F.col("t0") + part * (F.col("t") - F.col("t0"))).alias("t"))
    if "term_s_m" not in placed.columns:
        return out
    ends = d.where("last and s0 is not null and term_s_m > s_max").withColumn("k0", F.greatest(line(F.col("s_max")) + 1, F.lit(0))).withColumn("k1", line(F.col("term_s_m"))).where("k0 <= k1")
    return out.unionByName(ends.withColumn("line", F.explode(F.sequence("k0", "k1"))).select("service_date", "pattern_uid", "line", "t"))


def counting_lines(links: DataFrame, step_m: float = LINE_STEP_M, first_m: float = LINE_FIRST_M) -> DataFrame:
    """pattern_uid, link_idx, line: the lines that count for each link.

    Those over 10 m from its stops; on a pattern's first link only in the second half, on its last only in the first; all
    inside where that leaves none.
    """
    n = links.groupBy("pattern_uid").agg(F.count(F.lit(1)).alias("n_links"))
    x = links.join(n, "pattern_uid").select("pattern_uid", "link_idx", "n_links", F.col("s0_m").alias("lo"), (F.col("s0_m") + F.col("len_m")).alias("hi"))
    x = x.withColumn("line", F.explode(F.sequence(F.greatest(F.floor((F.col("lo") - first_m) / step_m), F.lit(0)), F.floor((F.col("hi") - first_m) / step_m) + 1))).withColumn("at", F.col("line") * step_m + first_m)
    mid = (F.col("lo") + F.col("hi")) / 2
    inside = (F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))
    first, last = (F.col("link_idx") == 0) & (F.col("n_links") > 1), (F.col("link_idx") == F.col("n_links") - 1) & (F.col("n_links") > 1)
    good = F.when(first, (F.col("at") > mid) & (F.col("at") < F.col("hi") - STOP_GAP_M)).when(last, (F.col("at") > F.col("lo") + STOP_GAP_M) & (F.col("at") <= mid)).otherwise((F.col("at") > F.col("lo") + STOP_GAP_M) & (F.col("at") < F.col("hi") - STOP_GAP_M))
    x = x.withColumn("good", good).withColumn("any", F.max(good).over(W.partitionBy("pattern_uid", "link_idx")))
    return x.where(F.when(F.col("any"), F.col("good")).otherwise(inside)).select("pattern_uid", "link_idx", "line")


def feed_passages(crossings: DataFrame, links: DataFrame, zone: str = "UTC", start_s: int = 14400) -> DataFrame:
    """service_date, hour, pattern_uid, link_key, n_feed: the median of a link's lines, hours without any crossing of the pattern left out."""
    timed = local_time(crossings.withColumnRenamed("service_date", "own_date").withColumn("ts", F.timestamp_micros(F.floor(F.col("t") * 1e6).cast("long")).cast("timestamp_ntz")), zone, start_s)
    # the hour counts from the track's own service date
    hour = F.col("hour") + 24 * F.datediff("service_date", "own_date")
    counts = timed.groupBy("own_date", "pattern_uid", hour.alias("hour"), "line").agg(F.count(F.lit(1)).alias("n"))
    lines = counting_lines(links)
    named = counts.select(F.concat_ws("|", F.col("own_date").cast("string"), "pattern_uid").alias("day"), "hour", F.concat_ws("|", "pattern_uid", F.col("line").cast("string")).alias("line"), "n")
    keyed = lines.select(F.concat_ws("|", "pattern_uid", F.col("link_idx").cast("string")).alias("link_idx"), F.concat_ws("|", "pattern_uid", F.col("line").cast("string")).alias("line"))
    med = line_passages(named, keyed).withColumn("service_date", F.split_part("day", F.lit("|"), F.lit(1)).cast("date")).withColumn("pattern_uid", F.split_part("link_idx", F.lit("|"), F.lit(1))).withColumn("link_idx", F.split_part("link_idx", F.lit("|"), F.lit(2)).cast("int"))
    return med.join(links.select("pattern_uid", "link_idx", "link_key"), ["pattern_uid", "link_idx"]).select("service_date", "hour", "pattern_uid", "link_key", F.col("n").alias("n_feed"))


def all_passages(feed: DataFrame | None, events: DataFrame | None, mains: DataFrame, links: DataFrame) -> DataFrame:
    """PASSAGES: n_feed and n_events for each date, hour and link, n the larger; pattern_uid the day's main pattern that holds the link, else the busiest source's."""
    keys = ["service_date", "hour", "link_key"]
    none = (feed if feed is not None else events).limit(0)
    f = none.select(*keys, F.lit(0.0).alias("n_feed"), F.lit("").alias("pf")) if feed is None else feed.groupBy(*keys).agg(F.sum("n_feed").alias("n_feed"), F.max_by("pattern_uid", F.struct("n_feed", "pattern_uid")).alias("pf"))
    e = none.select(*keys, F.lit(0.0).alias("n_events"), F.lit("").alias("pe")) if events is None else events.groupBy(*keys).agg(F.sum("n_events").cast("double").alias("n_events"), F.min("pattern_uid").alias("pe"))
    both = f.join(e, keys, "full_outer")
    if feed is not None:
        both = both.fillna(0.0, ["n_feed"])
    if events is not None:
        both = both.fillna(0.0, ["n_events"])
    held = mains.join(links.select("pattern_uid", "link_key"), "pattern_uid").groupBy("service_date", "link_key").agg(F.min("pattern_uid").alias("pm"))
    out = both.join(held, ["service_date", "link_key"], "left")
    return out.select("service_date", "hour", F.coalesce("pm", "pf", "pe").alias("pattern_uid"), "link_key", "n_feed", "n_events", F.greatest("n_feed", "n_events").alias("n"))
