"""Patterns of a day, passages from stop events, overlap of stretches, speeds; each returns a lazily planned DataFrame or a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import local_time

#: Share of the busiest pattern's trips that a main pattern needs at least.
MAIN_SHARE = 0.25


def sub_offset(sub: Column, main: Column) -> Column:
    """First index (from 0) at which ``sub`` runs inside ``main``, null where it does not."""
    starts = F.when((F.size(sub) > 0) & (F.size(sub) <= F.size(main)), F.sequence(F.lit(1), F.size(main) - F.size(sub) + 1)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: F.slice(main, i, F.size(sub)) == sub), 0) - 1


def main_patterns(day_patterns: DataFrame, keys: list[str]) -> DataFrame:
    """keys and pattern_uid of the main pattern: the most scheduled links over itself and the patterns that run inside it.

    ``day_patterns`` has keys, pattern_uid, stop_ids and n_trips. Ties go to more trips, more stops, the smaller uid.
    Patterns meet only those of their own day and direction (tens).
    """
    top = day_patterns.groupBy(*keys).agg(F.max("n_trips").alias("top"))
    major = day_patterns.join(top, keys).where(F.col("n_trips") >= MAIN_SHARE * F.col("top")).drop("top")
    inner = day_patterns.select(*keys, F.col("stop_ids").alias("sub"), (F.col("n_trips") * (F.size("stop_ids") - 1)).alias("links"))
    score = major.join(inner, keys).where(sub_offset(F.col("sub"), F.col("stop_ids")).isNotNull()).groupBy(*keys, "pattern_uid", "n_trips", F.size("stop_ids").alias("len")).agg(F.sum("links").alias("score"))
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("n_trips"), F.desc("len"), "pattern_uid")
    return score.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*keys, "pattern_uid", "score")


def classified(patterns: DataFrame) -> DataFrame:
    """Kind of ``stop_ids`` beside ``main_ids``: main, short (with its offset), detour (half of its links are the main's) or other."""
    def pairs(c: str) -> Column:
        return F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c) - 1).alias("b"))

    several = F.size("stop_ids") > 1
    shared = F.size(F.filter(pairs("stop_ids"), lambda p: F.array_contains(pairs("main_ids"), p)))
    offset = sub_offset(F.col("stop_ids"), F.col("main_ids"))
    kind = F.when(F.col("stop_ids") == F.col("main_ids"), "main").when(offset.isNotNull(), "short").when(several & (2 * shared >= F.size("stop_ids") - 1), "detour").otherwise("other")
    return patterns.withColumn("kind", kind).withColumn("parent_offset", F.when(F.col("kind") == "short", offset))


def event_passages(events: DataFrame, links: DataFrame, zone: str = "UTC") -> DataFrame:
    """Trips (STOP_EVENT) that pass each link (a, b, link_key), by service date and hour of the middle of the way.

    Times missing between two known ones lie evenly between them; links beyond a trip's known times have no passage, and
    a link at their edge counts at the known end.
    """
    trip = W.partitionBy("service_date", "trip_key").orderBy("stop_sequence")
    t = F.unix_micros(F.coalesce("departure", "arrival").cast("timestamp"))
    ev = events.select("service_date", "trip_key", "stop_sequence", "stop_id", t.alias("t")).withColumn("k", F.row_number().over(trip))
    known = F.when(F.col("t").isNotNull(), F.struct("k", "t"))
    ev = ev.withColumn("p", F.last(known, True).over(trip.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.first(known, True).over(trip.rowsBetween(0, W.unboundedFollowing)))
    between = F.col("p.t") + (F.col("n.t") - F.col("p.t")) * (F.col("k") - F.col("p.k")) / (F.col("n.k") - F.col("p.k"))
    ev = ev.withColumn("e", F.when(F.col("t").isNotNull(), F.col("t").cast("double")).otherwise(between))
    ev = ev.withColumn("b", F.lead("stop_id").over(trip)).withColumn("next_seq", F.lead("stop_sequence").over(trip)).withColumn("eb", F.lead("e").over(trip))
    ev = ev.where("next_seq = stop_sequence + 1").withColumn("at", F.coalesce((F.col("e") + F.col("eb")) / 2, "e", "eb")).where("at is not null")
    timed = local_time(ev.select(F.col("service_date").alias("day"), F.timestamp_micros(F.floor("at")).cast("timestamp_ntz").alias("ts"), F.col("stop_id").alias("a"), "b"), zone)
    return timed.join(links.select("a", "b", "link_key"), ["a", "b"]).groupBy(F.col("day").alias("service_date"), "hour", "link_key").agg(F.count(F.lit(1)).alias("n_events"))


def combined_passages(feed: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Passages from tracks (n_feed) and stop events (n_events), n the larger of both; a side without a row counts 0."""
    both = feed.groupBy(*keys).agg(F.sum("n_feed").alias("n_feed")).join(events.groupBy(*keys).agg(F.sum("n_events").alias("n_events")), keys, "full_outer").fillna(0, ["n_feed", "n_events"])
    return both.withColumn("n", F.greatest("n_feed", "n_events"))


def tolerant_overlap(a: DataFrame, b: DataFrame, group: str, tol: int = 1) -> DataFrame:
    """Share of the positions j of both sets that have one of the other within ``tol``; groups in either set."""
    def near(x: DataFrame, y: DataFrame) -> DataFrame:
        wide = y.select(group, F.explode(F.sequence(F.col("j") - tol, F.col("j") + tol)).alias("j")).distinct().withColumn("hit", F.lit(1))
        return x.select(group, "j").distinct().join(wide, [group, "j"], "left").select(group, F.coalesce("hit", F.lit(0)).alias("hit"))

    return near(a, b).unionByName(near(b, a)).groupBy(group).agg(F.avg("hit").alias("overlap"))


def speed_kmh(opp: Column, len_m: Column, reports: Column, tick_s: float = 20.0) -> Column:
    """Speed over a segment from positions a passage: at most 80 km/h, null under 3 reports."""
    return F.when(reports >= 3, F.least(F.lit(80.0), 3.6 * len_m / F.greatest(opp * tick_s, F.lit(1e-9))))


def hotspot_kind(criterion: Column, fixed_score: Column, peak_ratio: Column, min_fixed: float, min_ratio: float) -> Column:
    """infrastructure, congestion or mixed from the criterion that found it, its fixed score and its peak ratio (nulls fail)."""
    fixed, peak = F.coalesce(fixed_score >= min_fixed, F.lit(False)), F.coalesce(peak_ratio >= min_ratio, F.lit(False))
    return F.when(criterion == "persistent", "infrastructure").when(criterion == "both", "mixed").when(fixed & ~peak, "infrastructure").when(peak & ~fixed, "congestion").otherwise("mixed")
