"""The whole analysis of a line: read, cover, build the network, place, count, analyse, describe; two periods; lengths."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellscope.config import Config, seconds_of
from dwellscope.operators import analysis as an
from dwellscope.operators import compare as cp
from dwellscope.operators import geometry as geo
from dwellscope.operators import grids, health, mapmatch, network, placement, tracker, tuning
from dwellscope.operators import hotspots as hs
from dwellscope.operators.core import assign, local_time, normalised_id, segment_grid, thin
from dwellscope.operators.patterns import event_passages
from dwellscope.operators.statistics import grid_cost
from dwellscope.operators.tracks import active_services, resample
from dwellscope.sources import readers, sinks
from dwellscope.sources.store import written


@dataclass
class Network:
    """Patterns, their days and links; trips; stops; the registry that named the links."""

    patterns: DataFrame
    pattern_days: DataFrame
    links: DataFrame
    trips: DataFrame
    stops: DataFrame
    registry: geo.KeyRegistry


def build_network(spark: SparkSession, source: readers.FeedSource, route: str | None, dates: list[dt.date], registry: geo.KeyRegistry | None = None) -> Network:
    """Every feed that is valid on some date, patterns of equal uid once (the first feed's)."""
    registry = registry or geo.KeyRegistry()
    parts: list[tuple[DataFrame, ...]] = []
    for path, days in source.by_feed(dates).items():
        feed = source.load(path, route)
        patterns, links = network.build_patterns(spark, feed, registry)
        trips = network.pattern_trips(feed, patterns)
        calendar = network.calendar_table(feed["calendar"]) if feed["calendar"] is not None else spark.createDataFrame([], "service_id string, start_date date, end_date date, days array<int>")
        exceptions = network.exception_table(feed["calendar_dates"]) if feed["calendar_dates"] is not None else spark.createDataFrame([], "service_id string, date date, exception_type int")
        wanted = spark.createDataFrame([(d,) for d in days], "day date")
        on = network.pattern_days(trips, patterns, active_services(wanted, calendar, exceptions))
        stops = feed["stops"].select("stop_id", "stop_name", F.col("stop_lon").cast("double").alias("stop_lon"), F.col("stop_lat").cast("double").alias("stop_lat"))
        parts.append((patterns, on, links, trips, stops))
    if not parts:
        raise ValueError("no schedule feed is valid on any date")
    both = [parts[0][i] for i in range(5)]
    for p in parts[1:]:
        both = [a.unionByName(b) for a, b in zip(both, p, strict=True)]
    patterns, days, links, trips, stops = both
    return Network(
        written(patterns.dropDuplicates(["pattern_uid"])), written(days), written(links.dropDuplicates(["pattern_uid", "link_idx"])), written(trips.dropDuplicates(["trip_id", "pattern_uid"])), written(stops.dropDuplicates(["stop_id"])), registry
    )


def segments_of(links: DataFrame, length: float = 30.0, phase: float = 0.0, grid: str = "equal", stop_zone: tuple[float, float] = (30.0, 60.0)) -> DataFrame:
    """SEGMENT of all links: bins of the grid, named by link, bin and grid, with the zone of any stop of the pattern that they touch."""
    up, down = stop_zone
    if grid == "fixed":
        bins, mark = grids.fixed_grid(links, length, phase), "f"
    elif grid == "stops":
        bins, mark = grids.stops_grid(grids.zoned_links(links, None, stop_zone), length).drop("zone"), f"s{down:g}_{up:g}"
    else:
        bins, mark = segment_grid(links, length, phase), ""
    x = bins.join(links.select("pattern_uid", "link_idx", "link_key", "s0_m"), ["pattern_uid", "link_idx"])
    x = x.withColumn("x0_m", F.col("s0_m") + F.col("lo")).withColumn("x1_m", F.col("s0_m") + F.col("hi"))
    stops = links.select("pattern_uid", F.col("s0_m").alias("s_m")).unionByName(links.groupBy("pattern_uid").agg(F.max(F.col("s0_m") + F.col("len_m")).alias("s_m")))
    zoned = grids.tagged(x, stops, up, down)
    key = F.concat(F.col("link_key"), F.lit("/"), F.col("k").cast("string"), F.lit(f"@{length:g}:{phase:g}{mark}"))
    return zoned.select("pattern_uid", "seg_idx", "link_idx", "link_key", key.alias("seg_key"), "k", F.col("lo").alias("offset_m"), "x0_m", (F.col("hi") - F.col("lo")).alias("len_m"), "zone", "lo", "hi")


def counted(placed: DataFrame, segments: DataFrame) -> DataFrame:
    """The cube: counted rows by date, hour, pattern and segment key."""
    rows = placed.where(F.coalesce("count", F.lit(True))).select("service_date", "hour", "pattern_uid", "link_idx", "pos_m")
    at = assign(rows, segments.select("pattern_uid", "link_idx", "hi", "seg_idx")).where("seg_idx is not null")
    return at.groupBy("service_date", "hour", "pattern_uid", "seg_idx").agg(F.count(F.lit(1)).alias("obs")).join(segments.select("pattern_uid", "seg_idx", "seg_key"), ["pattern_uid", "seg_idx"])


@dataclass
class Prepared:
    """All steps that do not depend on segments."""

    cfg: Config
    observations: DataFrame
    snapshots: DataFrame
    coverage: DataFrame
    network: Network
    located: DataFrame | None
    placed: DataFrame
    passages: DataFrame

    def segment_fn(self) -> Callable[..., DataFrame]:
        p = self.cfg.params
        return lambda length, phase=0.0, stop_zone=None: segments_of(self.network.links, length, phase, p.grid, stop_zone or p.stop_zone)

    def coverage_fn(self) -> Callable[[float], DataFrame]:
        return lambda gap_cap_s: feed_coverage(self.snapshots, replace(self.cfg, params=replace(self.cfg.params, gap_cap_s=gap_cap_s)))


def feed_coverage(snapshots: DataFrame, cfg: Config) -> DataFrame:
    return health.feed_coverage(snapshots, cfg.input.timezone, seconds_of(cfg.input.service_day_start), cfg.params.tick_s, cfg.params.gap_cap_s, cfg.quality.max_frozen_s, cfg.quality.min_hour_coverage, cfg.select.date_range())


def place(obs: DataFrame, net: Network, cfg: Config) -> tuple[DataFrame, DataFrame | None]:
    """(placed rows, located rows of linear feeds) by the kind of input."""
    p = cfg.params
    if cfg.input.kind == "latlon":
        of_date, of_version = placement.date_versions(obs.select("service_date").distinct(), net.pattern_days)
        roles = net.pattern_days.groupBy("pattern_uid").agg(F.first("parent_uid", True).alias("parent_uid"), F.first("parent_offset", True).alias("parent_offset"))
        fixes = obs.join(F.broadcast(of_date), "service_date").withColumnRenamed("row_id", "fix_id")  # a row a date
        of_version = of_version.join(roles, "pattern_uid", "left")
        ridden = network.trip_patterns(fixes, net.trips, of_version)
        by_trip = fixes.select("fix_id", "version", "trip_id").join(F.broadcast(ridden), ["version", "trip_id"])
        stops = net.links.select("pattern_uid", "link_idx", "s0_m", (F.col("s0_m") + F.col("len_m")).alias("s1_m"))
        length = net.patterns.select("pattern_uid", F.size("stop_ids").alias("n"))
        short = by_trip.where("pattern_uid <> ridden_uid").join(roles.select("pattern_uid", "parent_offset"), "pattern_uid").join(length, "pattern_uid")
        short = short.join(stops.select(F.col("pattern_uid").alias("ridden_uid"), F.col("link_idx").alias("parent_offset"), F.col("s0_m").alias("start_m")), ["ridden_uid", "parent_offset"])
        short = short.withColumn("end_link", F.col("parent_offset") + F.col("n") - 2).join(stops.select(F.col("pattern_uid").alias("ridden_uid"), F.col("link_idx").alias("end_link"), F.col("s1_m").alias("end_m")), ["ridden_uid", "end_link"])
        placed = mapmatch.place_latlon(fixes, of_version, net.patterns, net.links, p.max_lateral_m, p.layover_m, by_trip.select("fix_id", F.col("ridden_uid").alias("pattern_uid")), short.select("fix_id", "start_m", "end_m"))
        return placed.withColumnRenamed("fix_id", "row_id"), None
    rule = cfg.input.linear.id_normaliser
    norm = net.patterns.withColumn("stop_ids", F.transform("stop_ids", lambda x: F.coalesce(normalised_id(x, rule), x)))
    stops = net.stops.select(F.coalesce(normalised_id(F.col("stop_id"), rule), F.col("stop_id")).alias("stop_id"), "stop_name").groupBy("stop_id").agg(F.min("stop_name").alias("stop_name"))
    given = None
    if cfg.input.linear.terminus_aliases:
        given = obs.sparkSession.createDataFrame(list(cfg.input.linear.terminus_aliases.items()), "terminus_id string, stop_id string")
    located = written(placement.located(obs, norm, net.pattern_days, given, stops))
    flen = net.links.select("pattern_uid", "link_idx", F.col("len_m").alias("flen")) if cfg.input.linear.feed_length == "gtfs" else None
    placed = placement.place_linear(obs, norm, net.pattern_days, net.links, p.layover_m, given=given, flen=flen, stops=stops)
    placed = placed.withColumn("row_id", F.monotonically_increasing_id()).withColumn("track_id", F.col("vehicle_id"))
    placed = written(placed)
    if placed.where("track_id is not null").isEmpty():
        placed = tracker.track_anonymous(placed)
    return placed, located


def prepare(spark: SparkSession, cfg: Config, log: Callable[[str], None] | None = None) -> Prepared:
    """Reads, covers, builds the network, places and counts passages."""
    say = log or (lambda s: None)
    if not cfg.select.route:
        raise ValueError("select.route is required")
    start = seconds_of(cfg.input.service_day_start)
    obs = readers.read_observations(spark, cfg)
    obs = local_time(obs.withColumn("__ts", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz")), cfg.input.timezone, start).withColumn("ts", F.col("__ts")).drop("__ts")
    obs = written(obs.withColumn("row_id", F.monotonically_increasing_id()))
    n = obs.count()
    say(f"observations: {n}")
    if not n:
        raise ValueError(f"no observation of route {cfg.select.route}")
    snaps = readers.read_snapshots(spark, cfg)
    snaps = written(snaps if snaps is not None else health.inferred_polls(obs))
    cov = written(feed_coverage(snaps, cfg))
    span = cfg.select.date_range()
    dates = [r[0] for r in obs.select("service_date").distinct().collect()] if span is None else [span[0] + dt.timedelta(days=i) for i in range((span[1] - span[0]).days + 1)]
    dates = sorted(d for d in dates if d.weekday() in cfg.select.weekdays)
    net = build_network(spark, readers.FeedSource.of(spark, cfg), cfg.select.route, dates)
    placed, located = place(obs, net, cfg)
    placed = written(placed)
    say(f"placed: {placed.count()}")
    feed = tracker.feed_passages(tracker.line_crossings(placed), net.links, cfg.input.timezone, start)
    events = readers.read_events(spark, cfg)
    found = None
    if events is not None:
        pairs = net.links.groupBy(F.col("from_stop").alias("a"), F.col("to_stop").alias("b")).agg(F.min(F.struct("pattern_uid", "link_key")).alias("x")).select("a", "b", "x.link_key")
        found = event_passages(events, pairs, cfg.input.timezone).withColumn("pattern_uid", F.lit(None).cast("string"))
    pas = written(tracker.all_passages(feed, found, net.pattern_days.where("is_main"), net.links))
    if placed.where("track_id is not null").limit(1).count() and cfg.input.kind == "latlon":
        rows = placed.withColumn("s_m", F.col("s_m").cast("double"))
        placed = written(resample(rows, int(cfg.params.tick_s)) if cfg.params.per_vehicle == "resample" else thin(rows, int(cfg.params.tick_s)))
    return Prepared(cfg, obs, snaps, cov, net, located, placed, pas)


@dataclass
class Analysis:
    """An analysis of a cube: its tables are planned from the prepared ones; ``bins`` and ``hotspots`` on demand."""

    cfg: Config
    links: DataFrame
    segments: DataFrame
    cube: DataFrame
    coverage: DataFrame | None
    passages: DataFrame
    pattern_days: DataFrame
    day_status: DataFrame
    hours: DataFrame
    mains: DataFrame
    strata: DataFrame
    totals: DataFrame
    estimates: DataFrame
    display: DataFrame
    places: DataFrame
    versions: DataFrame
    contract: DataFrame
    agreement: DataFrame
    result: DataFrame
    stratify: bool = False
    hotspots: DataFrame | None = None

    def cells(self) -> DataFrame:
        return an.day_cells(self.hours, self.mains, self.segments, self.cube, self.passages)

    def bins(self, n_draws: int | None = None, seed: int = 0, keys: DataFrame | None = None, stratified: bool = True) -> DataFrame:
        """Bin statistics of the shown segments (or ``keys``), written."""
        p, q = self.cfg.params, self.cfg.quality
        keys = self.places if keys is None else keys
        cells = self.cells().join(keys.select("direction_id", "seg_key").distinct(), ["direction_id", "seg_key"], "left_semi")
        return written(hs.bin_statistics(cells, self.mains, n_draws or p.bootstrap, p.reference_hours, q.min_passages_per_day, seed=seed, stratified=stratified))

    def find_hotspots(self, n_draws: int | None = None, **kw) -> DataFrame:
        p = self.cfg.params
        return written(hs.hotspots(self.bins(n_draws), self.mains, self.places, self.links, p.tick_s, hours=self.cfg.select.hours, ref_hours=p.reference_hours, min_days=self.cfg.quality.min_days, **kw))

    def subset(self, first: str | None = None, last: str | None = None, params=None) -> Analysis:
        """The same on part of the dates, or with other parameters."""
        cfg = replace(self.cfg, params=params or self.cfg.params)
        return analyse(cfg, self.cube, self.coverage, self.passages, self.segments, self.links, self.pattern_days, first, last, self.stratify)


def analyse(cfg: Config, cube: DataFrame, coverage: DataFrame | None, passages: DataFrame, segments: DataFrame, links: DataFrame, pattern_days: DataFrame, first: str | None = None, last: str | None = None, stratify: bool = False) -> Analysis:
    """Day rule, sums over days, estimates and result of a cube; ``first`` and ``last`` narrow the selection's dates."""
    sel, p, q = cfg.select, cfg.params, cfg.quality
    span = sel.date_range()
    first, last = first or (span and span[0].isoformat()), last or (span and span[1].isoformat())
    tables = [cube] + ([coverage] if coverage is not None else []) + ([pattern_days] if span else [])
    days = written(an.selected_days(*tables, first=first, last=last, weekdays=tuple(sel.weekdays)))
    all_hours = written(an.hour_status(days, coverage, q.min_hour_coverage, p.tick_s if p.tick_from_coverage else None))
    status = written(an.day_status(all_hours, tuple(sel.exclude_dates), q.min_day_coverage))
    hours = written(an.included_hours(all_hours, status))
    mains = written(an.day_mains(pattern_days, status, None if sel.directions is None else tuple(sel.directions)))
    chosen = days.where(~F.col("service_date").cast("string").isin(*sel.exclude_dates)) if sel.exclude_dates else days
    strata = chosen.groupBy(F.weekday("service_date").alias("dow")).agg(F.count(F.lit(1)).alias("n"))
    sums = written(an.totals(hours, mains, segments, cube, passages))
    est = written(an.estimates(sums, segments, p.reference_hours, q.min_passages_per_day, p.reference, strata if stratify else None))
    display = written(an.display_patterns(mains, segments))
    places = written(hs.shown_places(display, segments))
    shown = display.where("place = 1").select("direction_id", "pattern_uid")
    return Analysis(
        cfg, links, segments, cube, coverage, passages, pattern_days, status, hours, mains, strata, sums, est, display, places, an.version_table(mains, segments, display),
        an.weekday_contract(sums, mains, segments, shown), an.reference_agreement(est, places), an.result(est, mains, segments, sel.hours, q.min_days), stratify,
    )


def analyse_prepared(pre: Prepared, length: float | None = None, **kw) -> Analysis:
    p = pre.cfg.params
    segs = written(segments_of(pre.network.links, length or p.segment_m, p.phase_m, p.grid, p.stop_zone))
    cube = written(counted(pre.placed, segs))
    return analyse(pre.cfg, cube, pre.coverage, pre.passages, segs, pre.network.links, pre.network.pattern_days, **kw)


def run(spark: SparkSession, cfg: Config | str, prepared: Prepared | None = None, hotspots: bool = True, log: Callable[[str], None] | None = None) -> Analysis:
    """The whole analysis, of settings or a file of them."""
    cfg = Config.from_toml(cfg) if isinstance(cfg, str) else cfg
    out = analyse_prepared(prepared or prepare(spark, cfg, log))
    if hotspots:
        out.hotspots = out.find_hotspots()
        out.agreement = an.reference_agreement(out.estimates, out.places, out.hotspots)
    return out


def save(out: Analysis, folder: str, title: str | None = None, html: bool = True) -> dict:
    """Tables as Parquet, the document as JSON and page; gives the document."""
    import json

    tables = {"result": out.result, "cube": out.cube, "excluded_days": out.day_status.where("reason is not null"), "versions": out.versions}
    if out.coverage is not None:
        tables["coverage"] = out.coverage
    if out.hotspots is not None:
        tables["hotspots"] = out.hotspots
    sinks.write_tables(tables, folder)
    doc = sinks.document(out)
    if out.hotspots is not None and "geometry" in out.links.columns:
        lines = sinks.geojson(out.hotspots, grids.with_geometry(out.segments, out.links))
        sinks.write_text(json.dumps(sinks.plain(lines), separators=(",", ":")), f"{folder}/hotspots.geojson")
    sinks.write_text(json.dumps(doc, separators=(",", ":"), ensure_ascii=False), f"{folder}/analysis.json")
    if html:
        sinks.write_text(sinks.page(doc, title), f"{folder}/report.html")
    return doc


@dataclass
class Comparison:
    a: Analysis
    b: Analysis
    bins: DataFrame
    changes: DataFrame
    unmatched: DataFrame
    frequency: DataFrame


def compare(a: Analysis, b: Analysis, n_draws: int = 200, seed: int = 0, theta_s: float = 2.0, q: float = 0.1) -> Comparison:
    """Period B against A: matched segments, changes, stretches, frequencies."""
    p = b.cfg.params
    old = a.mains.select("direction_id", "pattern_uid").distinct().join(a.segments, "pattern_uid")
    match = written(cp.aligned(hs.numbered(b.places), old))
    bins_a = a.bins(n_draws, 2 * seed, old, cp.strata_allowed(a.mains))
    bins_b = b.bins(n_draws, 2 * seed + 1, None, cp.strata_allowed(b.mains))
    bins = written(cp.changes(match, bins_a, bins_b, cp.per_hour(a.estimates), cp.per_hour(b.estimates), 0.0, b.cfg.select.hours, q))
    return Comparison(a, b, bins, cp.changed_stretches(bins, a.mains, b.mains, p.tick_s, theta_s, b.cfg.select.hours), cp.unmatched(match, a.places), cp.frequency_change(bins))


def run_compare(spark: SparkSession, cfg: Config, a: tuple[str, str], b: tuple[str, str], n_draws: int | None = None, prepared: Prepared | None = None) -> Comparison:
    """One reading, network and cube for both periods, so that keys agree."""
    days = sorted([*a, *b])
    cfg = replace(cfg, select=replace(cfg.select, dates=f"{days[0]}..{days[-1]}"))
    pre = prepared or prepare(spark, cfg)
    whole = analyse_prepared(pre)
    return compare(whole.subset(*a), whole.subset(*b), n_draws or cfg.params.bootstrap)


def save_compare(out: Comparison, folder: str) -> None:
    sinks.write_tables({"bins": out.bins.drop("draws"), "changes": out.changes, "unmatched": out.unmatched, "frequency": out.frequency}, folder)


def tune(pre: Prepared, lengths: tuple[float, ...] = (10, 15, 20, 30, 40, 50, 75, 100), n_draws: int = 100, n_splits: int = 20, fine_m: float = 5.0, seed: int = 0) -> tuple[DataFrame, float, bool]:
    """(scores of each length, recommended length, whether one passed). Lengths run one after another; each reads the placed rows once."""
    spark = pre.placed.sparkSession
    fine = written(tuning.fine_grid(pre.network.links, fine_m))
    fine_cube = written(tuning.fine_cube(pre.placed, fine))
    rows, devs = None, None
    for length in lengths:
        one = analyse_prepared(pre, length)
        cells = written(one.cells())
        valid = one.mains.join(pre.network.links.select("pattern_uid", "link_key"), "pattern_uid").select("direction_id", "service_date", "link_key").distinct()
        fine_cells = fine_cube.groupBy("service_date", "hour", "fine_key", "link_key").agg(F.sum("obs").alias("obs")).join(valid, ["service_date", "link_key"])
        dev = written(tuning.loo_deviance(cells, fine_cells, one.hours, tuning.overlaps(fine, one.segments), one.segments).withColumn("length", F.lit(float(length))))
        devs = dev if devs is None else devs.unionByName(dev)
        halves = tuning.half_days(one.mains, n_splits, seed)
        lens = one.segments.groupBy("seg_key").agg(F.min("len_m").alias("len_m"))
        found = one.find_hotspots(n_draws)
        j = one.places.select("direction_id", "seg_idx", "j")
        strs = found.join(j.withColumnRenamed("seg_idx", "from_seg").withColumnRenamed("j", "j0"), ["direction_id", "from_seg"]).join(j.withColumnRenamed("seg_idx", "to_seg").withColumnRenamed("j", "j1"), ["direction_id", "to_seg"])
        strs = strs.where("peak_hour is not null").select("direction_id", F.col("rank").alias("stretch"), "j0", "j1", "peak_hour", F.col("excess_per_passage").alias("value"))
        spread = tuning.location_spread(one.bins(n_draws), one.places, strs).agg(F.percentile("loc_spread_m", F.lit(0.5)).alias("loc_spread_m"))
        per_key = cells.where(F.col("hour").between(6, 20)).groupBy("direction_id", "seg_key").agg(F.sum("obs").alias("k")).join(one.places.select("direction_id", "seg_key", "len_m"), ["direction_id", "seg_key"])
        score = tuning.half_reliability(cells, one.hours, halves, lens).agg(F.avg("reliability").alias("reliability"), F.avg("snr").alias("snr"))
        score = score.join(F.broadcast(tuning.excess_reliability(cells, halves, lens, pre.cfg.params.reference_hours).agg(F.avg("reliability_excess").alias("reliability_excess"))))  # one row each
        score = score.join(F.broadcast(spread)).join(F.broadcast(grid_cost(per_key, "direction_id", one.mains.select("service_date").distinct().count()).agg(F.avg("cost").alias("ss_cost"))))
        score = score.withColumn("length", F.lit(float(length))).withColumn("n_segments", F.lit(one.places.count()))
        score = written(score)
        rows = score if rows is None else rows.unionByName(score)
    table = written(rows.join(tuning.cv_columns(devs), "length", "left"))
    best, ok = tuning.recommended(table, pre.cfg.params.segment_m)
    return table.orderBy("length"), best, ok


def sensitivity(pre: Prepared, lengths: tuple[float, ...] = (20, 40), n_draws: int = 50) -> DataFrame:
    """direction_id, variant, rho, max_change: each variant's day profile against the baseline's (phase, gap caps, stop zones, reference, passages, lengths)."""
    base = analyse_prepared(pre)
    cfg = pre.cfg
    ref = written(tuning.profile(base.estimates, base.places))
    variants: dict[str, Callable[[], Analysis]] = {
        "phase": lambda: analyse_prepared(replace(pre, cfg=replace(cfg, params=replace(cfg.params, phase_m=cfg.params.segment_m / 2)))),
        "freeflow": lambda: base.subset(params=replace(cfg.params, reference="freeflow")),
        "stop_zone": lambda: analyse_prepared(replace(pre, cfg=replace(cfg, params=replace(cfg.params, stop_zone=(cfg.params.stop_zone[0] * 1.5, cfg.params.stop_zone[1] * 1.5))))),
        "passages_feed": lambda: analyse_prepared(replace(pre, passages=pre.passages.withColumn("n", F.col("n_feed")))),
    }
    for cap in (cfg.params.gap_cap_s / 2, cfg.params.gap_cap_s * 2):
        variants[f"gap_cap_{cap:g}"] = lambda cap=cap: analyse_prepared(replace(pre, coverage=written(pre.coverage_fn()(cap))))
    for length in lengths:
        variants[f"length_{length:g}"] = lambda length=length: analyse_prepared(pre, length)
    out = None
    for name, make in variants.items():
        v = make()
        one = written(tuning.against_baseline(tuning.profile(v.estimates, v.places), ref).withColumn("variant", F.lit(name)))
        out = one if out is None else out.unionByName(one)
    return out


def inspect(pre: Prepared) -> dict[str, DataFrame]:
    """Coverage by day, placement counts, network versions."""
    out = {"coverage": health.coverage_by_day(pre.coverage), "versions": network.network_versions(pre.network.pattern_days, pre.network.links)}
    if pre.located is not None:
        out["placement"] = placement.placement_report(pre.located, pre.cfg.params.layover_m)
    return out
