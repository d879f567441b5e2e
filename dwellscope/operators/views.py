"""Views of results: units of the line, stretch speeds, calendars, headline numbers, display scales. Columns and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Length of the scale's unit, its lower reference, ends, end of the comparison bar, seconds a report an hour, top speed.
UNIT_M, BASE_S, T_MIN, T_MAX, CMP_S, OPH_S, TOP_KMH = 30.0, 3.0, 3.0, 24.0, 10.0, 2.0, 80.0
# Particles that stay small in names.
PARTICLES = ("aux", "de", "des", "du", "la", "le", "van")
METRICS = ("obs_per_passage", "excess_per_passage", "excess_line_per_passage", "obs_per_h", "obs_per_h_10m", "excess_obs_per_h", "log2_ratio")


def scale_seconds(metric: str, value: Column, len_m: Column, tick_s: float = 20.0) -> Column:
    """Seconds a passage over 30 m that a value of ``metric`` stands for; excesses and ratios count from the scale's base."""
    unit = UNIT_M / len_m
    up = lambda x: F.greatest(x, F.lit(0.0))
    found = {
        "obs_per_passage": value * tick_s * unit,
        "excess_per_passage": BASE_S + up(value * tick_s * unit),
        "excess_line_per_passage": BASE_S + up(value * tick_s * unit),
        "obs_per_h": value * unit * OPH_S,
        "obs_per_h_10m": value * (UNIT_M / 10) * OPH_S,
        "excess_obs_per_h": BASE_S + up(value * unit * OPH_S),
        "log2_ratio": BASE_S * F.pow(F.lit(2.0), up(value)),
    }
    if metric not in found:
        raise ValueError(f"no scale for {metric}")
    return found[metric]


def scale_value(metric: str, seconds: Column) -> Column:
    """The value of ``metric`` for 30 m that the scale shows at ``seconds``."""
    if metric == "obs_per_passage":
        return seconds
    if metric in ("excess_per_passage", "excess_line_per_passage"):
        return seconds - BASE_S
    if metric in ("obs_per_h", "obs_per_h_10m"):
        return seconds / OPH_S / (UNIT_M / 10 if metric == "obs_per_h_10m" else 1)
    if metric == "excess_obs_per_h":
        return (seconds - BASE_S) / OPH_S
    if metric == "log2_ratio":
        return F.log2(seconds / BASE_S)
    raise ValueError(f"no scale for {metric}")


def bar_position(seconds: Column) -> Column:
    """0 to 1 along the scale's bar."""
    return (F.least(F.greatest(seconds, F.lit(T_MIN)), F.lit(T_MAX)) - T_MIN) / (T_MAX - T_MIN)


def change_position(delta: Column) -> Column:
    """0 to 1 along the comparison bar, no change in the middle."""
    return (F.least(F.greatest(delta, F.lit(-CMP_S)), F.lit(CMP_S)) + CMP_S) / (2 * CMP_S)


def scale_kmh(seconds: Column) -> Column:
    return 3.6 * UNIT_M / F.greatest(seconds, F.lit(1e-9))


def speed(opp: Column, len_m: Column, reports: Column, tick_s: float = 20.0) -> Column:
    """km/h, at most 80, null under 3 reports."""
    return F.when(reports >= 3, F.least(F.lit(TOP_KMH), 3.6 * len_m / F.greatest(opp * tick_s, F.lit(1e-9))))


def speed_gap(slow: Column, fast: Column) -> Column:
    return fast - slow


def relative_gap(slow: Column, fast: Column) -> Column:
    return F.try_divide(fast - slow, fast)


def speeds_with_interval(opp: Column, lo: Column, hi: Column, len_m: Column, tick_s: float = 20.0) -> tuple[Column, Column, Column]:
    """Speed and its interval over a length: the ends swap, and the upper end is open where the lower time is under a quarter."""
    at = lambda x: F.least(F.lit(TOP_KMH), 3.6 * len_m / F.greatest(x * tick_s, F.lit(1e-9)))
    return at(opp), at(hi), F.when(lo >= opp / 4, at(lo))


def per_10_m(obs_per_h: Column, len_m: Column) -> Column:
    return obs_per_h * 10 / len_m


def title_name(name: Column) -> Column:
    """Names in capitals as words: particles after the first small, roman numerals of up to four letters kept, parts of hyphens and apostrophes each. Other names stay."""
    small = F.array(*[F.lit(p) for p in PARTICLES])
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    parts = lambda word: F.array_join(F.transform(F.split(word, "-"), lambda h: F.array_join(F.transform(F.split(h, "'"), capital), "'")), "-")

    def one(word: Column, i: Column) -> Column:
        low = F.lower(word)
        return F.when((i > 0) & F.array_contains(small, low), low).when((i > 0) & word.rlike("^[IVX]{1,4}$"), word).otherwise(parts(low))

    return F.when(name != F.upper(name), name).otherwise(F.array_join(F.transform(F.split(name, " "), one), " "))


def colour(value: Column) -> Column:
    """RRGGBB in capitals, null for anything else."""
    digits = F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), "^#?([0-9A-Fa-f]{6})$", 1)
    return F.upper(F.nullif(digits, F.lit("")))


def utc_offset_s(ts: Column, zone: str) -> Column:
    """Seconds of the zone's clock ahead of UTC at an instant (without zone, UTC)."""
    return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts).cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))


def hour_runs(df: DataFrame, group: str, hour: str) -> DataFrame:
    """Runs of consecutive hours: group, first, last."""
    w = W.partitionBy(group).orderBy(hour)
    keyed = df.select(group, hour).distinct().withColumn("k", F.col(hour) - F.row_number().over(w))
    return keyed.groupBy(group, "k").agg(F.min(hour).alias("first"), F.max(hour).alias("last")).drop("k")


def zone_blocks(values: DataFrame) -> DataFrame:
    """Stop segments in a row as one block, other segments alone: direction_id, block, from_m, to_m, zone, opp (sum; null if any is).

    ``values`` has direction_id, seg_idx, x0_m, len_m, zone, opp.
    """
    w = W.partitionBy("direction_id").orderBy("seg_idx")
    new = F.coalesce(((F.col("zone") != "stop") | (F.lag("zone").over(w) != "stop")).cast("int"), F.lit(1))
    b = values.withColumn("new", new).withColumn("block", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.when(F.count("opp") == F.count(F.lit(1)), F.sum("opp"))
    return b.groupBy("direction_id", "block").agg(F.min("x0_m").alias("from_m"), F.max(F.col("x0_m") + F.col("len_m")).alias("to_m"), F.min("zone").alias("zone"), whole.alias("opp"))


def unit_of(segments: DataFrame) -> DataFrame:
    """segments with ``unit``: the link from whose first stop's zone on a segment counts; null for the first stop's own zone.

    A unit runs from leaving one stop's zone to leaving the next one's: a link's running segments and tail, and the head
    (leading stop segments) of the link after. A link without running segments has its head in its first half.
    """
    link = W.partitionBy("direction_id", "link_idx")
    s = segments.withColumn("run0", F.min(F.when(F.col("zone") != "stop", F.col("seg_idx"))).over(link))
    s = s.withColumn("mid", (F.min("x0_m").over(link) + F.max(F.col("x0_m") + F.col("len_m")).over(link)) / 2)
    head = (F.col("zone") == "stop") & F.when(F.col("run0").isNotNull(), F.col("seg_idx") < F.col("run0")).otherwise(F.col("x0_m") + F.col("len_m") / 2 < F.col("mid"))
    unit = F.when(head, F.col("link_idx") - 1).otherwise(F.col("link_idx"))
    return s.withColumn("unit", F.when(unit >= 0, unit)).drop("run0", "mid")


def stop_units(values: DataFrame, running_only: bool = False) -> DataFrame:
    """direction_id, unit, from_m, to_m, len_m, opp of each unit: ratios of its segments added up, null if any is; only between the zones with ``running_only``."""
    u = unit_of(values).where("unit is not null")
    counts = F.col("zone") != "stop" if running_only else F.lit(True)
    n = F.count(F.when(counts, 1))
    whole = F.when((F.count(F.when(counts, F.col("opp"))) == n) & (n > 0), F.sum(F.when(counts, F.col("opp"))))
    return u.groupBy("direction_id", "unit").agg(F.min("x0_m").alias("from_m"), F.max(F.col("x0_m") + F.col("len_m")).alias("to_m"), F.sum(F.when(counts, F.col("len_m"))).alias("len_m"), whole.alias("opp"))


def stretch_total(values: DataFrame, stretches: DataFrame) -> DataFrame:
    """Sums over the segments of each stretch (direction_id, stretch, from_m, to_m), by overlap of over half a metre; null if any is."""
    x = stretches.join(values, "direction_id").where((F.col("x0_m") + F.col("len_m") > F.col("from_m") + 0.5) & (F.col("x0_m") < F.col("to_m") - 0.5))
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)
    extra = [c for c in ("ref", "ref_line") if c in values.columns]
    return x.groupBy("direction_id", "stretch").agg(F.count(F.lit(1)).alias("n_segs"), F.sum("len_m").alias("len_m"), whole("opp"), *[whole(c) for c in extra])


def hotspot_speeds(hotspots: DataFrame, values: DataFrame, tick_s: float = 20.0) -> DataFrame:
    """Speed of each hotspot's reference (evening, or the line's level) and with its excess, with interval; null if a segment has no reference."""
    keyed = hotspots.select("direction_id", F.col("rank").alias("stretch"), "from_m", "to_m", "criterion", "excess_per_passage", "ci_lo", "ci_hi")
    sums = stretch_total(values, keyed.select("direction_id", "stretch", "from_m", "to_m"))
    x = keyed.join(sums, ["direction_id", "stretch"]).withColumn("base", F.when(F.col("criterion") == "peak", F.col("ref")).otherwise(F.col("ref_line")))
    now, lo, hi = speeds_with_interval(F.col("base") + F.col("excess_per_passage"), F.col("base") + F.col("ci_lo"), F.col("base") + F.col("ci_hi"), F.col("len_m"), tick_s)
    free = F.least(F.lit(TOP_KMH), 3.6 * F.col("len_m") / F.greatest(F.col("base") * tick_s, F.lit(1e-9)))
    return x.select("direction_id", F.col("stretch").alias("rank"), "n_segs", "len_m", F.when(F.col("base").isNotNull(), free).alias("kmh_ref"), now.alias("kmh"), lo.alias("kmh_lo"), hi.alias("kmh_hi"))


def day_calendar(hours: DataFrame, status: DataFrame, day_hours: tuple[int, int] = (6, 21)) -> DataFrame:
    """service_date, coverage (over all day hours, missing ones as 0) and status of each date."""
    n = day_hours[1] - day_hours[0]
    cov = hours.where((F.col("hour") >= day_hours[0]) & (F.col("hour") < day_hours[1])).groupBy("service_date").agg((F.sum(F.coalesce("coverage", F.lit(0.0))) / n).alias("coverage"))
    return status.join(cov, "service_date", "left").select("service_date", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reason", F.lit("included")).alias("status"))


def excluded_reasons(status: DataFrame) -> DataFrame:
    """Excluded days for each reason; those of the feed together."""
    pooled = F.when(F.col("reason").isin("low_coverage", "frozen", "no_data"), "feed").otherwise(F.col("reason"))
    return status.where("reason is not null").groupBy(pooled.alias("reason")).agg(F.count(F.lit(1)).alias("n_days"))


def headline(est: DataFrame, hotspots: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Observations and segments kept, hotspots, changes for the better and the worse."""
    out = est.where("col >= 0").agg(F.sum("obs").alias("obs"), F.count_distinct("direction_id", "seg_key").alias("n_segments"))
    if hotspots is not None:
        out = out.join(F.broadcast(hotspots.agg(F.count(F.lit(1)).alias("n_hotspots"))))  # one row
    if changes is not None:
        out = out.join(F.broadcast(changes.agg(F.count(F.when(F.col("sign") > 0, 1)).alias("n_worse"), F.count(F.when(F.col("sign") < 0, 1)).alias("n_better"))))  # one row
    return out


def shown_list(rows: DataFrame, show_zones: bool, value: str, k: int = 8) -> DataFrame:
    """The k rows of each direction with the largest value; those in stop zones only where zones are shown."""
    kept = rows if show_zones else rows.where("zone <> 'stop'")
    w = W.partitionBy("direction_id").orderBy(F.desc(value), "from_seg")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def export_rounded(df: DataFrame, digits: dict[str, int], default: int = 3) -> DataFrame:
    """Doubles rounded for export, not-a-numbers as nulls, dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), digits.get(name, default))
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def ribbon(profiles: DataFrame) -> DataFrame:
    """Least and largest value of the variants' profiles at each place (direction_id, variant, x_m, value)."""
    return profiles.groupBy("direction_id", "x_m").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
