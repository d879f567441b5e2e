"""Feed health by local service date and hour: covered time, frozen time, stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analysis import FLAGS
from .core import local_time


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def polls(snapshots: DataFrame, tick_s: float = 20.0) -> DataFrame:
    """ts, frozen, t (seconds), next_any, next_live, run of each distinct time; a time is frozen if all its rows are.

    The next poll may lie on another day. Windows order the polls of a UTC day only; what a day hands on (its first polls,
    the number of live ones before it) travels in a table of a row a day. The last poll is followed by one after tick_s.
    ``run`` numbers the live polls so far, so consecutive frozen polls share it.
    """
    rows = snapshots.groupBy(F.col("ts").cast("timestamp").alias("ts")).agg(F.min(F.coalesce(F.col("frozen").cast("boolean"), F.lit(False))).alias("frozen"))
    rows = rows.withColumn("t", _seconds(F.col("ts"))).withColumn("day", F.to_date("ts"))
    live = F.when(~F.col("frozen"), F.col("t"))
    days = rows.groupBy("day").agg(F.min("t").alias("first_any"), F.min(live).alias("first_live"), F.count(live).alias("n_live"))
    later = W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)  # a row a day
    days = days.select(
        "day",
        F.min("first_any").over(later).alias("after_any"),
        F.min("first_live").over(later).alias("after_live"),
        F.coalesce(F.sum("n_live").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    w = W.partitionBy("day").orderBy("ts")
    ahead = W.partitionBy("day").orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, -1)  # grows by a row at a time
    out = rows.join(days, "day")
    next_any = F.coalesce(F.lead("t").over(w), "after_any", F.col("t") + tick_s)
    next_live = F.coalesce(F.min(live).over(ahead), "after_live", F.col("t") + tick_s)
    run = F.col("before") + F.sum((~F.col("frozen")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.select("ts", "frozen", "t", next_any.alias("next_any"), next_live.alias("next_live"), run.alias("run"))


def split_by_hour(spans: DataFrame, zone: str, start_s: int = 14400) -> DataFrame:
    """Spans [a, b) in seconds cut at local hours: other columns, service_date, hour, seconds. Empty spans go."""
    at = F.timestamp_micros(F.floor(F.col("a") * 1e6).cast("long")).cast("timestamp_ntz")
    offset = F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit(zone), at).cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    # clock changes move by whole hours, so the cuts of a span keep their place
    df = spans.where("b > a").withColumn("__o", offset)
    first, last = F.floor((F.col("a") + F.col("__o")) / 3600), F.ceil((F.col("b") + F.col("__o")) / 3600) - 1
    df = df.withColumn("__h", F.explode(F.sequence(first, F.greatest(first, last))))
    lo, hi = F.greatest("a", F.col("__h") * 3600 - F.col("__o")), F.least("b", (F.col("__h") + 1) * 3600 - F.col("__o"))
    df = df.withColumn("seconds", hi - lo).withColumn("ts", F.timestamp_micros((F.floor(lo) * 1000000).cast("long")).cast("timestamp_ntz"))
    return local_time(df, zone, start_s).drop("a", "b", "ts", "dow", "__o", "__h")


def stalls_of(rows: DataFrame, cap_s: float, max_frozen_s: float) -> DataFrame:
    """a, b of the runs of consecutive frozen polls that last over max_frozen_s, each poll for the time to the next, capped."""
    span = F.least(F.col("next_any") - F.col("t"), F.lit(cap_s))
    runs = rows.where("frozen").groupBy("run").agg(F.min("t").alias("a"), F.sum(span).alias("d")).where(F.col("d") > max_frozen_s)
    return runs.select("a", (F.col("a") + F.col("d")).alias("b"))


def feed_coverage(
    snapshots: DataFrame, zone: str = "Europe/Brussels", start_s: int = 14400, tick_s: float = 20.0, cap_s: float = 40.0, max_frozen_s: float = 300.0, min_coverage: float = 0.8, dates: tuple | None = None
) -> DataFrame:
    """COVERAGE: 24 rows for each service date, zero where the feed was silent.

    A live poll covers the time to the next live one, a frozen poll is frozen time up to the next of any kind, both capped
    and cut at local hours. An hour is FROZEN where a stall (a run of frozen polls over max_frozen_s) touches it.
    """
    rows = polls(snapshots, tick_s)
    end = lambda c: F.col("t") + F.least(F.col(c) - F.col("t"), F.lit(cap_s))
    live = rows.where("not frozen").select(F.lit("covered_s").alias("kind"), F.col("t").alias("a"), end("next_live").alias("b"))
    frozen = rows.where("frozen").select(F.lit("frozen_s").alias("kind"), F.col("t").alias("a"), end("next_any").alias("b"))
    stall = stalls_of(rows, cap_s, max_frozen_s).select(F.lit("stall_s").alias("kind"), "a", "b")
    pieces = split_by_hour(live.unionByName(frozen).unionByName(stall), zone, start_s).select("service_date", "hour", "kind", "seconds", F.lit(0).alias("n"))
    count = local_time(rows.where("not frozen").select(F.col("ts").cast("timestamp_ntz").alias("ts")), zone, start_s)
    pieces = pieces.unionByName(count.select("service_date", "hour", F.lit("n").alias("kind"), F.lit(0.0).alias("seconds"), F.lit(1).alias("n")))
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("seconds")).otherwise(0.0)).alias(k)
    hourly = pieces.groupBy("service_date", "hour").agg(total("covered_s"), total("frozen_s"), total("stall_s"), F.sum("n").alias("n_snapshots"))
    if dates is None:
        span = local_time(rows.select(F.col("ts").cast("timestamp_ntz").alias("ts")), zone, start_s).agg(F.min("service_date").alias("a"), F.max("service_date").alias("z"))
    else:
        span = snapshots.sparkSession.range(1).select(F.lit(dates[0]).cast("date").alias("a"), F.lit(dates[1]).cast("date").alias("z"))
    grid = span.where("a is not null").select(F.explode(F.sequence("a", "z")).alias("service_date"))
    grid = grid.select("service_date", F.explode(F.sequence(F.lit(start_s // 3600), F.lit(start_s // 3600 + 23))).alias("hour"))
    out = grid.join(hourly, ["service_date", "hour"], "left").fillna(0)
    share = F.least(F.greatest(F.col("covered_s") / 3600, F.lit(0.0)), F.lit(1.0))
    flags = F.when(share < min_coverage, FLAGS["LOW_COVERAGE"]).otherwise(0) + F.when(F.col("stall_s") > 0, FLAGS["FROZEN"]).otherwise(0)
    return out.select("service_date", "hour", "n_snapshots", "covered_s", share.alias("coverage"), "frozen_s", flags.alias("flags"))


def coverage_by_day(coverage: DataFrame, hours: tuple[int, int] = (6, 21)) -> DataFrame:
    """Mean coverage, hours of low coverage and frozen hours of each date, over the day's hours."""
    day = coverage.where((F.col("hour") >= hours[0]) & (F.col("hour") < hours[1]))
    has = lambda n: F.sum((F.col("flags").bitwiseAND(FLAGS[n]) != 0).cast("long"))
    return day.groupBy("service_date").agg(F.avg("coverage").alias("mean_coverage"), has("LOW_COVERAGE").alias("low_hours"), has("FROZEN").alias("frozen_hours"))


def inferred_polls(observations: DataFrame) -> DataFrame:
    """Distinct times of observations as live polls."""
    return observations.groupBy("ts").agg(F.count(F.lit(1)).alias("n_rows")).select("ts", "n_rows", F.lit(False).alias("frozen"))
