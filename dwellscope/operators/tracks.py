"""Operators along tracks and on the network; each returns a lazily planned DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import haversine_m


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def resample(placed: DataFrame, tick_s: int = 20, max_gap_s: int = 90) -> DataFrame:
    """Fixes on the grid of tick_s: at each instant between two fixes of a run the nearer one, beyond a run's ends up to half an interval.

    A run has one track and pattern and steps of at most max_gap_s. Rows without track or ``s_m`` stay as they are, fixes
    without a neighbour go. ``hour`` moves by the whole hours crossed. An instant equal to a run's first fix has no row.
    Each fix finds its own instants, so no pair of fixes is joined.
    """
    tick, far = tick_s * 1_000_000, max_gap_s * 1_000_000
    w = W.partitionBy("track_id").orderBy("ts", "s_m")
    known = F.col("track_id").isNotNull() & F.col("s_m").isNotNull()
    d = placed.where(known).withColumn("__t", _micros("ts"))

    def beside(shift) -> Column:
        near = shift(F.col("__t")) - F.col("__t")
        return F.when(shift(F.col("pattern_uid")).eqNullSafe(F.col("pattern_uid")) & (F.abs(near) <= far) & (near != 0), shift(F.col("__t")))

    d = d.withColumn("__p", beside(lambda c: F.lag(c).over(w))).withColumn("__n", beside(lambda c: F.lead(c).over(w)))
    d = d.where("__p is not null or __n is not null")
    a = F.expr(f"coalesce(__p div {tick} + 1, (3 * __t - __n + {2 * tick - 1}) div {2 * tick})")
    b = F.expr(f"coalesce(__n div {tick}, (3 * __t - __p) div {2 * tick})")
    d = d.withColumn("__a", a).withColumn("__b", b).where("__a <= __b").withColumn("__g", F.explode(F.sequence("__a", "__b"))).withColumn("__g", F.col("__g") * tick)
    before = F.when(F.col("__p").isNull(), F.col("__g") < F.col("__t")).otherwise(2 * (F.col("__g") - F.col("__p")) >= F.col("__t") - F.col("__p"))
    after = F.when(F.col("__n").isNull(), F.lit(True)).otherwise(2 * (F.col("__g") - F.col("__t")) < F.col("__n") - F.col("__t"))
    d = d.where(F.when(F.col("__g") <= F.col("__t"), before).otherwise(after))
    moved = {"ts": F.timestamp_micros("__g").cast(placed.schema["ts"].dataType)}
    if "hour" in placed.columns:
        moved["hour"] = (F.col("hour") + F.expr("__g div 3600000000 - __t div 3600000000")).cast(placed.schema["hour"].dataType)
    return d.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in placed.columns]).unionByName(placed.where(~known))


def crossings(runs: DataFrame, step_m: float) -> DataFrame:
    """Each line (multiple of step_m) that a run passes, with the time between the two fixes in proportion to the way.

    ``runs`` has track_id, run, ts and s_max, the furthest position so far.
    """
    w = W.partitionBy("track_id", "run").orderBy("ts", "s_max")
    d = runs.withColumn("t", _micros("ts")).withColumn("s0", F.lag("s_max").over(w)).withColumn("t0", F.lag("t").over(w)).where("s_max > s0")
    d = d.withColumn("k0", F.floor(F.col("s0") / step_m) + 1).withColumn("k1", F.floor(F.col("s_max") / step_m)).where("k0 <= k1").withColumn("line", F.explode(F.sequence("k0", "k1")))
    part = (F.col("line") * step_m - F.col("s0")) / (F.col("s_max") - F.col("s0"))
    return d.select("track_id", "run", "line", (F.col("t0") + part * (F.col("t") - F.col("t0"))).alias("at_us"))


def line_passages(counts: DataFrame, lines: DataFrame) -> DataFrame:
    """Passages of each link and hour: the median over the link's counting lines, lines without a crossing counted as 0.

    ``counts`` (day, hour, line, n), ``lines`` (link_idx, line). The zeros are added by number (a median of few values), not as rows.
    """
    size = lines.groupBy("link_idx").agg(F.count(F.lit(1)).alias("m"))
    got = counts.join(lines, "line").groupBy("day", "hour", "link_idx").agg(F.array_sort(F.collect_list("n")).alias("ns")).join(size, "link_idx")  # a link has tens of lines

    def at(position: Column) -> Column:
        index = position - (F.col("m") - F.size("ns"))
        return F.when(index < 1, F.lit(0)).otherwise(F.get("ns", (index - 1).cast("int")))

    n = (at(F.floor((F.col("m") + 1) / 2)) + at(F.floor(F.col("m") / 2) + 1)) / 2
    return got.select("day", "hour", "link_idx", n.alias("n")).where("n > 0")


def active_services(days: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(day, service_id) that run: calendar (service_id, start_date, end_date, days as an array of weekdays), with added (1) and removed (2) dates."""
    span = calendar.withColumn("day", F.explode(F.sequence("start_date", "end_date"))).where("array_contains(days, weekday(day))").select("service_id", "day")
    added, removed = (exceptions.where(F.col("exception_type") == k).select("service_id", F.col("date").alias("day")) for k in (1, 2))
    return span.unionByName(added).join(days.select("day").distinct(), "day", "left_semi").distinct().join(removed, ["service_id", "day"], "left_anti").select("day", "service_id")


def learned_aliases(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Last stop of the pattern whose other stops hold most rows of a terminus code; main patterns first, then by ``place``.

    ``rows`` (terminus_id, stop_id), ``stops`` (pattern_uid, stop_id, is_last, is_main, place).
    """
    held = rows.where("terminus_id is not null").groupBy("terminus_id", "stop_id").agg(F.count(F.lit(1)).alias("n"))
    other = stops.where("not is_last").select("pattern_uid", "is_main", "place", "stop_id").distinct()
    score = held.join(other, "stop_id").groupBy("terminus_id", "pattern_uid", "is_main", "place").agg(F.sum("n").alias("score"))
    best = score.groupBy("terminus_id").agg(F.max_by("pattern_uid", F.struct("score", "is_main", -F.col("place"))).alias("pattern_uid"))
    return best.join(stops.where("is_last").select("pattern_uid", F.col("stop_id").alias("last_stop")), "pattern_uid").select("terminus_id", "last_stop")


def near_points(fixes: DataFrame, points: DataFrame, max_m: float, max_lat: float | None = None) -> DataFrame:
    """Pairs of fixes (fix_id, lat, lon) and network points (point_id, lat, lon) at most max_m apart, by cells of that size.

    Points are put in the nine cells around them (the network is the small side), so each fix joins on one cell; cells span max_m at
    max_lat (the points' largest latitude unless given) and close at the 180th meridian.
    """
    lat_step = max_m / 111_000
    if max_lat is None:
        max_lat = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    around_globe = max(int(360 / (lat_step / max(math.cos(math.radians(min(max_lat + lat_step, 89.9))), 1e-3))), 3)
    lon_step = 360 / around_globe

    def cell(c: str, step) -> Column:
        return F.floor(F.col(c) / step)

    def wrapped(c: Column) -> Column:
        return F.pmod(c, F.lit(around_globe))

    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), cell("lat", lat_step).alias("y0"), cell("lon", lon_step).alias("x0"))
    spread = spread.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    spread = spread.select("point_id", "p_lat", "p_lon", (F.col("y0") + F.col("dy")).alias("y"), wrapped(F.col("x0") + F.col("dx")).alias("x"))
    keyed = fixes.withColumn("y", cell("lat", lat_step)).withColumn("x", wrapped(cell("lon", lon_step)))
    m = haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    return keyed.join(spread, ["y", "x"]).withColumn("m", m).where(F.col("m") <= max_m).select("fix_id", "point_id", "m")
