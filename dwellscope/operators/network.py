"""Patterns, links and their days from schedule feeds. Trips and calendars stay tables; a route's patterns (tens) have their
lines cut on the driver, where the key registry lives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import geometry as geo
from .indicators import feed_on, nearest_covered
from .patterns import classified, main_patterns
from .tracks import active_services

# Order of kinds among equally many days.
KINDS = ("main", "short", "detour", "other")
PATTERN = "pattern_uid string, route_id string, direction_id int, stop_ids array<string>, stop_names array<string>, length_m double, geometry array<array<double>>"
LINK = "pattern_uid string, link_idx int, link_key string, from_stop string, to_stop string, from_name string, to_name string, s0_m double, len_m double, geometry array<array<double>>"


def calendar_table(calendar: DataFrame) -> DataFrame:
    """calendar.txt as service_id, start_date, end_date and the weekdays (Monday 0) on which the service runs."""
    names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    days = F.filter(F.array(*[F.when(F.col(n).cast("int") == 1, F.lit(i)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return calendar.select("service_id", F.to_date(F.col("start_date").cast("string"), "yyyyMMdd").alias("start_date"), F.to_date(F.col("end_date").cast("string"), "yyyyMMdd").alias("end_date"), days.alias("days"))


def exception_table(calendar_dates: DataFrame) -> DataFrame:
    return calendar_dates.select("service_id", F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("date"), F.col("exception_type").cast("int").alias("exception_type"))


def service_span(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """first and last date of a feed's services."""
    both = calendar.select(F.col("start_date").alias("a"), F.col("end_date").alias("z")).unionByName(exceptions.where("exception_type = 1").select(F.col("date").alias("a"), F.col("date").alias("z")))
    return both.agg(F.min("a").alias("first"), F.max("z").alias("last"))


def trip_sequences(feed: dict[str, DataFrame]) -> DataFrame:
    """trip_id, service_id, route_id, direction_id, shape_id, stop_ids (repeats in a row once) of trips with two stops or more."""
    st = feed["stop_times"].select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"))
    stops = st.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda x: x["stop_id"]).alias("all"))  # a trip has tens of stops
    stops = stops.withColumn("stop_ids", F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1)))).drop("all").where(F.size("stop_ids") >= 2)
    t = feed["trips"]
    direction = F.coalesce(F.col("direction_id").cast("int"), F.lit(0)) if "direction_id" in t.columns else F.lit(0)
    shape = F.col("shape_id") if "shape_id" in t.columns else F.lit(None).cast("string")
    return t.select("trip_id", "service_id", "route_id", direction.alias("direction_id"), shape.alias("shape_id")).join(stops, "trip_id")


def _mode(c: str):
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {c})")


def sequence_table(trips: DataFrame) -> DataFrame:
    """direction_id, stop_ids, route_id, shape_id: the most frequent route and shape of each sequence, the smallest of equally many."""
    return trips.groupBy("direction_id", "stop_ids").agg(_mode("route_id").alias("route_id"), _mode("shape_id").alias("shape_id"), F.count(F.lit(1)).alias("n_trips"))


def build_patterns(spark: SparkSession, feed: dict[str, DataFrame], registry: geo.KeyRegistry) -> tuple[DataFrame, DataFrame]:
    """(PATTERN, LINK) of a feed; links of the busiest patterns enter the registry first, as their lines name new keys."""
    rows = sorted(sequence_table(trip_sequences(feed)).collect(), key=lambda r: (-r["n_trips"], r["stop_ids"]))  # a route's patterns
    stops = {r["stop_id"]: r for r in feed["stops"].collect()}
    shapes: dict[str, list] = {}
    if feed.get("shapes") is not None:
        wanted = [r["shape_id"] for r in rows if r["shape_id"] is not None]
        points = feed["shapes"].where(F.col("shape_id").isin(wanted)).groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct(F.col("shape_pt_sequence").cast("int").alias("n"), F.col("shape_pt_lon").cast("double").alias("x"), F.col("shape_pt_lat").cast("double").alias("y")))).alias("p"))
        shapes = {r["shape_id"]: [(q["x"], q["y"]) for q in r["p"]] for r in points.collect()}
    pats, links = [], []
    for r in rows:
        ids = r["stop_ids"]
        missing = [s for s in ids if s not in stops]
        if missing:
            raise ValueError(f"stops missing from the feed: {', '.join(missing[:5])}")
        places = [(float(stops[s]["stop_lon"]), float(stops[s]["stop_lat"])) for s in ids]
        names = [stops[s]["stop_name"] for s in ids]
        lines, lengths, _ = geo.slices(places, shapes.get(r["shape_id"]))
        whole = [lines[0][0].tolist()] + [p for x in lines for p in x[1:].tolist()]
        uid = geo.pattern_uid(ids, whole)
        pats.append((uid, r["route_id"], r["direction_id"], ids, names, float(lengths.sum()), whole))
        at = 0.0
        for i, (line, m) in enumerate(zip(lines, lengths.tolist(), strict=True)):
            links.append((uid, i, registry.key_for(ids[i], ids[i + 1], line, m), ids[i], ids[i + 1], names[i], names[i + 1], at, m, line.tolist()))
            at += m
    return spark.createDataFrame(pats, PATTERN), spark.createDataFrame(links, LINK)


def pattern_trips(feed: dict[str, DataFrame], patterns: DataFrame) -> DataFrame:
    """trip_id, service_id, direction_id, pattern_uid."""
    return trip_sequences(feed).join(patterns.select("direction_id", "stop_ids", "pattern_uid"), ["direction_id", "stop_ids"]).select("trip_id", "service_id", "direction_id", "pattern_uid")


def pattern_days(trips: DataFrame, patterns: DataFrame, services: DataFrame) -> DataFrame:
    """PATTERN_DAY: trips of each pattern on each date (``services``: day, service_id), the main one, and what the others are beside it."""
    n = trips.join(services.select(F.col("day").alias("service_date"), "service_id"), "service_id").groupBy("service_date", "direction_id", "pattern_uid").agg(F.count(F.lit(1)).alias("n_trips"))
    day = n.join(patterns.select("pattern_uid", "route_id", "stop_ids"), "pattern_uid")
    main = main_patterns(day, ["service_date", "direction_id"]).select("service_date", "direction_id", F.col("pattern_uid").alias("main_uid"))
    day = day.join(main, ["service_date", "direction_id"]).join(patterns.select(F.col("pattern_uid").alias("main_uid"), F.col("stop_ids").alias("main_ids")), "main_uid")
    out = classified(day)
    parent = F.when(F.col("kind").isin("short", "detour"), F.col("main_uid"))
    return out.select("service_date", "route_id", "direction_id", "pattern_uid", "n_trips", (F.col("pattern_uid") == F.col("main_uid")).alias("is_main"), "kind", parent.alias("parent_uid"), "parent_offset")


def pattern_kinds(days: DataFrame) -> DataFrame:
    """pattern_uid, kind, parent_uid, parent_offset: what a pattern is on most of its days (of equally many main, short, detour, other), with its usual parent."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    kinds = days.groupBy("pattern_uid", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern_uid").agg(F.max_by("kind", F.struct(F.col("n"), -order)).alias("kind"))
    mine = days.join(kinds, ["pattern_uid", "kind"]).groupBy("pattern_uid", "kind", "parent_uid", "parent_offset").agg(F.count(F.lit(1)).alias("n"))
    best = mine.groupBy("pattern_uid", "kind").agg(F.max_by(F.struct("parent_uid", "parent_offset"), F.struct("n", "parent_uid")).alias("p"))
    return best.select("pattern_uid", "kind", F.col("p.parent_uid").alias("parent_uid"), F.col("p.parent_offset").alias("parent_offset"))


def _sequences(links: DataFrame) -> DataFrame:
    return links.groupBy("pattern_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("link_idx", "link_key"))), lambda x: x["link_key"]).alias("keys"))  # tens of links


def display_pattern(days: DataFrame, links: DataFrame) -> DataFrame:
    """direction_id, pattern_uid: of the link sequence with most main days the pattern with most, the latest, the largest uid."""
    m = days.where("is_main").groupBy("direction_id", "pattern_uid").agg(F.count(F.lit(1)).alias("n"), F.max("service_date").alias("last")).join(_sequences(links), "pattern_uid")
    m = m.withColumn("ns", F.sum("n").over(W.partitionBy("direction_id", "keys")))
    return m.groupBy("direction_id").agg(F.max_by("pattern_uid", F.struct("ns", "n", "last", "pattern_uid")).alias("pattern_uid"))


def network_versions(days: DataFrame, links: DataFrame) -> DataFrame:
    """Runs of dates whose main pattern has the same links: direction_id, version, pattern_uid, first, last, n_days, display, links added and removed."""
    seq = _sequences(links)
    shown = display_pattern(days, links).join(seq, "pattern_uid").select("direction_id", F.col("pattern_uid").alias("shown_uid"), F.col("keys").alias("shown"))
    m = days.where("is_main").select("direction_id", "service_date", "pattern_uid").join(seq, "pattern_uid").withColumn("seq", F.array_join("keys", "|"))
    w = W.partitionBy("direction_id").orderBy("service_date")
    m = m.withColumn("new", F.coalesce((F.col("seq") != F.lag("seq").over(w)).cast("int"), F.lit(0))).withColumn("version", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = m.join(F.broadcast(shown), "direction_id").groupBy("direction_id", "version").agg(  # a row for each direction
        _mode("pattern_uid").alias("usual"), F.max(F.when(F.col("pattern_uid") == F.col("shown_uid"), F.col("pattern_uid"))).alias("own"), F.first("keys").alias("keys"), F.first("shown").alias("shown"),
        F.min("service_date").alias("first"), F.max("service_date").alias("last"), F.count(F.lit(1)).alias("n_days"),
    )
    return runs.select("direction_id", "version", F.coalesce("own", "usual").alias("pattern_uid"), "first", "last", "n_days", (F.col("keys") == F.col("shown")).alias("display"), F.array_except("keys", "shown").alias("links_added"), F.array_except("shown", "keys").alias("links_removed"))


def link_days(days: DataFrame, links: DataFrame) -> DataFrame:
    """Dates on which each link is part of its direction's main pattern."""
    return days.where("is_main").select("service_date", "direction_id", "pattern_uid").join(links.select("pattern_uid", "link_key"), "pattern_uid")


def calendar_proxy(dates: DataFrame, days: DataFrame) -> DataFrame:
    """Dates without patterns with the nearest date of the same weekday that has some: service_date, proxy_date."""
    covered = days.select(F.col("service_date").alias("day")).distinct()
    missing = dates.select(F.col("service_date").alias("day")).join(covered, "day", "left_anti")
    # by weekday: the calendar of each weekday is its own nearest-date problem
    week = lambda df: df.select(F.weekday("day").alias("dow"), "day")
    pairs = week(missing).withColumnRenamed("day", "service_date").join(week(covered), "dow")  # some hundreds of dates
    return pairs.groupBy("service_date").agg(F.min_by("day", F.struct(F.abs(F.datediff("service_date", "day")), "day")).alias("proxy_date"))


def trip_patterns(fixes: DataFrame, trips: DataFrame, of_version: DataFrame) -> DataFrame:
    """trip_id, version, pattern_uid, ridden_uid: the first pattern of a trip among a version's; a short working rides its parent."""
    found = fixes.select("version", "trip_id").where("trip_id is not null").distinct().join(trips.select("trip_id", "pattern_uid"), "trip_id").join(of_version, ["version", "pattern_uid"])
    first = found.groupBy("version", "trip_id").agg(F.min_by(F.struct("pattern_uid", "kind", "parent_uid"), F.struct("place", "pattern_uid")).alias("p"))
    return first.select("version", "trip_id", F.col("p.pattern_uid").alias("pattern_uid"), F.when(F.col("p.kind") == "short", F.coalesce("p.parent_uid", "p.pattern_uid")).otherwise(F.col("p.pattern_uid")).alias("ridden_uid"))


def feeds_on(dates: DataFrame, feeds: DataFrame, max_back: int | None = 14) -> DataFrame:
    """service_date and the path of the feed valid on it (``feeds``: valid_from, path): the latest before, at most max_back days."""
    day = feed_on(dates.select(F.col("service_date").alias("day")), feeds.select(F.col("valid_from").alias("day")), max_back)
    return day.join(feeds.select(F.col("valid_from").alias("feed"), "path"), "feed", "left").select(F.col("day").alias("service_date"), "path")


__all__ = ["active_services", "nearest_covered", "build_patterns", "pattern_days", "pattern_kinds", "pattern_trips", "network_versions", "service_span"]
