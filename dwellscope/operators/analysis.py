"""Analysis of a cube over selected days: hour and day rules, main patterns, ratio estimates, result, versions.

Sums over days are taken before anything is made dense: positions and passages stay sparse, and the covered hours and
cells of a segment come from its patterns' days, so nothing grows with days x hours x segments but ``day_cells``, which
only the day bootstrap and the daily statistics need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Code and hours [from, to) of the bands; they overlap.
BANDS = {"am": (-1, 7, 10), "pm": (-2, 16, 19), "day": (-3, 6, 21), "evening": (-4, 20, 24), "midday": (-5, 10, 16)}
# Flag bits.
FLAGS = {
    "LOW_COVERAGE": 1, "FROZEN": 2, "LINE_ABSENT": 4, "DEVIATION": 8, "FEW_DAYS": 16, "PARTIAL_VERSIONS": 32, "PASSAGES_ESTIMATED": 64,
    "LOW_DETECTION": 128, "VEHICLE_RATIO": 256, "LAYOVER": 512, "SHORT_WORKING": 1024, "OFF_PATTERN": 2048, "AMBIGUOUS": 4096, "AT_STOP": 8192,
}
#: An hour with one of these is left out.
EXCLUDING = FLAGS["LOW_COVERAGE"] | FLAGS["FROZEN"] | FLAGS["LINE_ABSENT"] | FLAGS["DEVIATION"] | FLAGS["VEHICLE_RATIO"]
# Reasons of an excluded hour, in the order in which a bit explains it.
REASONS = (("FROZEN", "frozen"), ("LINE_ABSENT", "line_absent"), ("DEVIATION", "deviation"), ("VEHICLE_RATIO", "vehicle_ratio"))
# Hours of the day rule and of the line level, smoothing of the log ratio, days of a displayed version.
DAY_HOURS, LINE_HOURS, ALPHA = (6, 21), (6, 23), 0.5
DISPLAY_DAYS, DISPLAY_SHARE = 5, 0.2


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def flag_names(flags: Column) -> Column:
    """Names of the set bits, in the order of the bits."""
    return F.filter(F.array(*[F.when(has_flag(flags, n), F.lit(n)) for n in FLAGS]), lambda x: x.isNotNull())


def selected_days(*tables: DataFrame, first=None, last=None, weekdays: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6)) -> DataFrame:
    """service_date of the days that any of the tables has, within [first, last] and on the weekdays (Monday 0)."""
    days = None
    for t in tables:
        one = t.select("service_date").distinct()
        days = one if days is None else days.unionByName(one)
    days = days.distinct().where(F.weekday("service_date").isin(*weekdays))
    if first is not None:
        days = days.where(F.col("service_date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("service_date") <= F.lit(last).cast("date"))
    return days


def hour_status(days: DataFrame, coverage: DataFrame | None, min_coverage: float = 0.8, tick_s: float | None = None) -> DataFrame:
    """service_date, hour (0..27), coverage (null without a row), flags, excluded, weight of each hour of the days.

    ``weight`` is the real time between polls over ``tick_s``, 1 without it. Without a coverage table all hours are covered.
    """
    grid = days.select("service_date", F.explode(F.sequence(F.lit(0), F.lit(27))).alias("hour"))
    if coverage is None:
        return grid.select("service_date", "hour", F.lit(1.0).alias("coverage"), F.lit(0).alias("flags"), F.lit(False).alias("excluded"), F.lit(1.0).alias("weight"))
    weight = F.lit(1.0)
    if tick_s is not None:
        seconds = F.try_divide(F.coalesce("covered_s", F.lit(0.0)).cast("double"), F.coalesce("n_snapshots", F.lit(0)).cast("double"))
        weight = F.when(seconds > 0, seconds / tick_s).otherwise(1.0)
    share = F.least(F.greatest(F.coalesce(F.col("coverage").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = coverage.select("service_date", F.col("hour").cast("int").alias("hour"), share.alias("coverage"), F.coalesce(F.col("flags").cast("int"), F.lit(0)).alias("flags"), weight.alias("weight"))
    out = grid.join(rows, ["service_date", "hour"], "left").withColumn("flags", F.coalesce("flags", F.lit(0))).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    excluded = F.col("coverage").isNull() | (F.col("coverage") < min_coverage) | (F.col("flags").bitwiseAND(EXCLUDING) != 0)
    return out.select("service_date", "hour", "coverage", "flags", F.coalesce(excluded, F.lit(True)).alias("excluded"), "weight")


def day_status(hours: DataFrame, exclude_dates: tuple[str, ...] = (), min_day: float = 0.75) -> DataFrame:
    """service_date, reason of every day: null where the day counts, else why not.

    Days named by the user are 'excluded'; others if more than 1 - min_day of their hours 6 to 20 are, with the reason of
    most of these hours, the first seen of equally many.
    """
    reason = F.when(F.col("coverage").isNull(), "no_data")
    for bit, name in REASONS:
        reason = reason.when(has_flag(F.col("flags"), bit), name)
    day = hours.where(F.col("hour").between(DAY_HOURS[0], DAY_HOURS[1] - 1)).withColumn("vote", F.when(F.col("excluded"), reason.otherwise("low_coverage")))
    votes = day.groupBy("service_date", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("at"))
    total = F.sum(F.when(F.col("vote").isNotNull(), F.col("n")).otherwise(0))
    best = F.max_by(F.col("vote"), F.when(F.col("vote").isNotNull(), F.struct(F.col("n"), -F.col("at"))))
    out = votes.groupBy("service_date").agg(total.alias("out"), best.alias("best"))
    named = F.col("service_date").cast("string").isin(*exclude_dates) if exclude_dates else F.lit(False)
    over = F.col("out") / (DAY_HOURS[1] - DAY_HOURS[0]) > 1 - min_day + 1e-9
    return out.select("service_date", F.when(named, "excluded").when(over, F.col("best")).alias("reason"))


def included_hours(hours: DataFrame, days: DataFrame) -> DataFrame:
    """The hours that count, of the days that count."""
    return hours.where(~F.col("excluded")).join(days.where("reason is null").select("service_date"), "service_date", "left_semi").drop("excluded")


def day_mains(pattern_days: DataFrame, days: DataFrame, directions: tuple[int, ...] | None = None) -> DataFrame:
    """service_date, direction_id, pattern_uid of the main pattern of each day that counts: most trips, then the smallest uid."""
    kept = pattern_days.where("is_main").join(days.where("reason is null").select("service_date"), "service_date", "left_semi")
    if directions is not None:
        kept = kept.where(F.col("direction_id").isin(*directions))
    w = W.partitionBy("service_date", "direction_id").orderBy(F.desc("n_trips"), "pattern_uid")
    return kept.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("service_date", "direction_id", "pattern_uid")


def _keys(segments: DataFrame) -> DataFrame:
    return segments.select("pattern_uid", "seg_key", "link_key").distinct()


def with_bands(df: DataFrame) -> DataFrame:
    """Rows by ``hour`` as rows by ``col``: the hour, and the code of every band that holds it."""
    codes = [F.when((F.col("hour") >= a) & (F.col("hour") < z), F.lit(code)) for code, a, z in BANDS.values()]
    return df.withColumn("col", F.explode(F.filter(F.array(F.col("hour"), *codes), lambda x: x.isNotNull()))).drop("hour")


def totals(hours: DataFrame, mains: DataFrame, segments: DataFrame, cube: DataFrame, passages: DataFrame, passage_col: str = "n") -> DataFrame:
    """direction_id, seg_key, link_key, dow, col, obs, passages, covered_h, n_cells over the included hours and days.

    ``hours`` are included hours, ``mains`` the days' main patterns. A segment counts on the days whose main pattern holds
    it; positions of all patterns of the key add up. Hours and bands are both columns.
    """
    keys = _keys(segments)
    own = F.broadcast(mains)  # a row for each date and direction
    open_ = hours.select("service_date", "hour", "coverage", "weight")
    # covered hours and cells: of the patterns' days, then shared out to their segments
    by_day = with_bands(open_.join(own, "service_date")).groupBy("direction_id", "pattern_uid", "service_date", "col").agg(F.sum("coverage").alias("c"))
    spread = by_day.groupBy("direction_id", "pattern_uid", F.weekday("service_date").alias("dow"), "col").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m"))
    cov = spread.join(keys, "pattern_uid").groupBy("direction_id", "seg_key", "link_key", "dow", "col").agg(F.sum("c").alias("covered_h"), F.sum("m").alias("n_cells"))

    def summed(facts: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        held = facts.select("service_date", F.col("hour").cast("int").alias("hour"), key, value.alias("v"))
        kept = held.join(F.broadcast(open_), ["service_date", "hour"]).join(keys.select("pattern_uid", key).distinct(), key).join(own, ["service_date", "pattern_uid"])
        amount = F.col("v") * F.col("weight") if name == "obs" else F.col("v")
        hourly = kept.groupBy("direction_id", key, F.weekday("service_date").alias("dow"), "hour").agg(F.sum(amount).cast("double").alias(name))
        return with_bands(hourly).groupBy("direction_id", key, "dow", "col").agg(F.sum(name).alias(name))

    obs = summed(cube, "seg_key", F.col("obs"), "obs")
    pas = summed(passages, "link_key", F.coalesce(F.col(passage_col), F.lit(0)), "passages")
    out = cov.join(obs, ["direction_id", "seg_key", "dow", "col"], "left").join(pas, ["direction_id", "link_key", "dow", "col"], "left")
    return out.fillna({"obs": 0.0, "passages": 0.0}).select("direction_id", "seg_key", "link_key", "dow", "col", "obs", "passages", "covered_h", "n_cells")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def estimates(
    sums: DataFrame,
    segments: DataFrame,
    ref_hours: tuple[int, int] = (20, 24),
    min_passages: float = 0.5,
    reference: str = "evening",
    strata: DataFrame | None = None,
) -> DataFrame:
    """Indicators of each direction, segment and column, from ``totals``.

    obs_per_passage is null under ``min_passages`` a cell. The reference is the ratio of sums over the evening, or with
    ``freeflow`` the 20th percentile over the hours 5 to 23. The line's reference is the median occupancy per metre of
    running segments over the hours 6 to 22, times the length. ``strata`` (dow, n: selected days) makes every ratio the
    mean of the weekdays' ratios, weighted by n over the weekdays that have data.
    """
    info = segments.groupBy("seg_key").agg(F.min("len_m").alias("len_m"), F.min("zone").alias("zone"))
    group = ["direction_id", "seg_key", "link_key"]
    measures = ["obs", "passages", "covered_h", "n_cells"]
    flat = sums.groupBy(*group, "col").agg(*[F.sum(m).alias(m) for m in measures])
    enough = F.col("passages") / F.col("n_cells") >= min_passages
    if strata is None:
        est = flat.withColumn("obs_per_h", _ratio(F.col("obs"), F.col("covered_h"))).withColumn("opp", _ratio(F.col("obs"), F.col("passages")))
    else:
        weighted = sums.join(F.broadcast(strata.select("dow", "n")), "dow")  # at most 7 rows
        mean = lambda num, den, keep: F.try_divide(F.sum(F.when(keep & (den > 0), F.col("n") * num / den)), F.sum(F.when(keep & (den > 0), F.col("n"))))
        rates = weighted.groupBy(*group, "col").agg(mean(F.col("obs"), F.col("covered_h"), F.lit(True)).alias("obs_per_h"), mean(F.col("obs"), F.col("passages"), F.lit(True)).alias("opp"))
        est = flat.join(rates, [*group, "col"])
    est = est.withColumn("opp", F.when(enough, F.col("opp")))
    evening = F.col("col").between(ref_hours[0], ref_hours[1] - 1)
    if reference == "freeflow":
        refs = est.where(F.col("col").between(5, 23)).groupBy(*group).agg(F.percentile("opp", F.lit(0.2)).alias("ref"))
    elif strata is None:
        refs = flat.where(evening).groupBy(*group).agg(F.sum("obs").alias("o"), F.sum("passages").alias("p")).select(*group, _ratio(F.col("o"), F.col("p")).alias("ref"))
    else:
        daily = sums.where(evening).groupBy(*group, "dow").agg(F.sum("obs").alias("o"), F.sum("passages").alias("p")).where("p > 0").join(F.broadcast(strata.select("dow", "n")), "dow")
        refs = daily.groupBy(*group).agg((F.sum(F.col("n") * F.col("o") / F.col("p")) / F.sum("n")).alias("ref"))
    long = flat.where(F.col("col").between(LINE_HOURS[0], LINE_HOURS[1] - 1)).groupBy(*group).agg(F.sum("obs").alias("o"), F.sum("passages").alias("p")).join(info, "seg_key")
    level = long.where("zone = 'running'").groupBy("direction_id").agg(F.percentile(_ratio(F.col("o"), F.col("p")) / F.col("len_m"), F.lit(0.5)).alias("line_level"))
    out = est.join(refs, group, "left").join(info, "seg_key").join(F.broadcast(level), "direction_id", "left")  # a row for each direction
    out = out.withColumn("ref_line", F.col("line_level") * F.col("len_m")).withColumn("excess", F.col("opp") - F.col("ref"))
    surplus = _ratio(F.col("obs") - F.col("ref") * F.col("passages"), F.col("covered_h"))
    if strata is not None:
        each = sums.join(refs, group, "left").join(F.broadcast(strata.select("dow", "n")), "dow").where("covered_h > 0")
        value = (F.col("obs") - F.col("ref") * F.col("passages")) / F.col("covered_h")
        per = each.groupBy(*group, "col").agg((F.sum(F.col("n") * value) / F.sum("n")).alias("surplus"))
        out, surplus = out.join(per, [*group, "col"], "left"), F.col("surplus")
    log2 = F.log2((F.col("opp") + ALPHA) / (F.col("ref") + ALPHA))
    return out.select(
        *group, "col", "len_m", "zone", *measures, "obs_per_h", F.col("opp").alias("obs_per_passage"), F.col("ref").alias("ref_obs_per_passage"),
        surplus.alias("excess_obs_per_h"), F.col("excess").alias("excess_per_passage"), log2.alias("log2_ratio"),
        F.col("ref_line").alias("ref_line_obs_per_passage"), (F.col("opp") - F.col("ref_line")).alias("excess_line_per_passage"),
    )


def result(est: DataFrame, mains: DataFrame, segments: DataFrame, hours: tuple[int, int] = (5, 24), min_days: int = 5) -> DataFrame:
    """A row for each direction, main pattern, segment and column (output hours and bands), with day counts and flags."""
    keys = _keys(segments)
    per_key = mains.groupBy("direction_id", "pattern_uid").agg(F.count(F.lit(1)).alias("d")).join(keys, "pattern_uid").groupBy("direction_id", "seg_key").agg(F.sum("d").alias("n_days"))
    of_all = mains.groupBy("direction_id").agg(F.count_distinct("service_date").alias("all_days"))
    cols = F.concat(F.sequence(F.lit(hours[0]), F.lit(hours[1] - 1)), F.array(*[F.lit(c) for c, _, _ in BANDS.values()]))
    shown = mains.select("direction_id", "pattern_uid").distinct().join(segments.select("pattern_uid", "seg_idx", "seg_key", "x0_m"), "pattern_uid")
    dense = shown.withColumn("col", F.explode(cols)).join(per_key, ["direction_id", "seg_key"]).join(F.broadcast(of_all), "direction_id")  # a row for each direction
    flags = F.when(F.col("n_days") < min_days, FLAGS["FEW_DAYS"]).otherwise(0) + F.when(F.col("n_days") < F.col("all_days"), FLAGS["PARTIAL_VERSIONS"]).otherwise(0)
    return dense.join(est, ["direction_id", "seg_key", "col"]).withColumn("flags", flags).withColumnRenamed("col", "hour").drop("all_days")


def weekday_contract(sums: DataFrame, mains: DataFrame, segments: DataFrame, pattern: DataFrame) -> DataFrame:
    """direction_id, dow, hour, seg_key, obs, covered_h, passages, days, n_cells of the shown ``pattern`` (direction_id, pattern_uid): not divided yet."""
    days = mains.groupBy("direction_id", "pattern_uid", F.weekday("service_date").alias("dow")).agg(F.count(F.lit(1)).alias("d"))
    days = days.join(segments.select("pattern_uid", "link_key").distinct(), "pattern_uid").groupBy("direction_id", "link_key", "dow").agg(F.sum("d").alias("days"))
    shown = pattern.join(segments.select("pattern_uid", "seg_key", "seg_idx"), "pattern_uid").select("direction_id", "seg_key", "seg_idx")
    rows = sums.where("col >= 0").join(shown, ["direction_id", "seg_key"]).join(days, ["direction_id", "link_key", "dow"])
    return rows.select("direction_id", "dow", F.col("col").alias("hour"), "seg_idx", "seg_key", F.round("obs", 1).alias("obs"), F.round("covered_h", 3).alias("covered_h"), F.round("passages", 2).alias("passages"), "days", "n_cells")


def interactive(contract: DataFrame, weekdays: tuple[int, ...], hours: tuple[int, int], min_passages: float = 0.5) -> DataFrame:
    """Chosen weekdays and an hour range: totals added up, then divided; null under ``min_passages`` a cell.

    Totals are rounded to 1e-9, so that they and what they divide do not depend on the order of the rows.
    """
    chosen = contract.where(F.col("dow").isin(*weekdays) & (F.col("hour") >= hours[0]) & (F.col("hour") < hours[1]))
    out = chosen.groupBy("direction_id", "seg_idx", "seg_key").agg(*[F.round(F.sum(c), 9).alias(c) for c in ("obs", "covered_h", "passages")], F.sum("n_cells").alias("n_cells"))
    enough = (F.col("passages") > 0) & (F.col("passages") / F.col("n_cells") >= min_passages)
    return out.withColumn("obs_per_passage", F.when(enough, F.col("obs") / F.col("passages"))).withColumn("obs_per_h", _ratio(F.col("obs"), F.col("covered_h")))


def display_patterns(mains: DataFrame, segments: DataFrame) -> DataFrame:
    """direction_id, pattern_uid, place of the main patterns, the one to show first.

    Patterns with the same links in the same order are one version. Versions on at least 5 days and a fifth of the days
    come first: the longest, with most segments, the most recent, then the pattern of most days. Without any such
    version the most frequent one leads.
    """
    links = segments.groupBy("pattern_uid", "link_idx").agg(F.min("link_key").alias("link_key"))
    seq = links.groupBy("pattern_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_idx", "link_key"))), lambda x: x["link_key"]), "|").alias("seq"))  # tens of links
    size = segments.groupBy("pattern_uid").agg(F.round(F.sum("len_m"), 1).alias("length"), F.count(F.lit(1)).alias("n_segs"))
    days = mains.groupBy("direction_id", "pattern_uid").agg(F.count(F.lit(1)).alias("days"), F.max("service_date").alias("last")).join(seq, "pattern_uid").join(size, "pattern_uid")
    version, direction = W.partitionBy("direction_id", "seq"), W.partitionBy("direction_id")
    days = days.withColumn("v_days", F.sum("days").over(version)).withColumn("v_last", F.max("last").over(version)).withColumn("all_days", F.sum("days").over(direction))
    days = days.withColumn("often", F.col("v_days") >= F.greatest(F.lit(DISPLAY_DAYS), DISPLAY_SHARE * F.col("all_days"))).withColumn("any", F.max("often").over(direction))
    order = direction.orderBy(
        F.when(F.col("any"), (~F.col("often")).cast("int")).otherwise(-F.col("v_days")),
        F.desc("length"),
        F.when(F.col("any"), -F.col("n_segs")).otherwise(0),
        F.desc("v_last"),
        F.desc("days"),
        "pattern_uid",
    )
    return days.select("direction_id", "pattern_uid", "seq", "days", "last", F.row_number().over(order).alias("place"))


def version_table(mains: DataFrame, segments: DataFrame, display: DataFrame) -> DataFrame:
    """One row for each direction and link sequence: its pattern, first and last day, days, links added to and removed from the shown one."""
    links = segments.groupBy("pattern_uid").agg(F.array_sort(F.collect_set("link_key")).alias("links"))
    day = mains.join(display.select("direction_id", "pattern_uid", "seq", "place", "days"), ["direction_id", "pattern_uid"])
    rep = F.min_by("pattern_uid", F.struct(F.when(F.col("place") == 1, 0).otherwise(1), -F.col("days"), "pattern_uid"))
    rows = day.groupBy("direction_id", "seq").agg(rep.alias("pattern_uid"), F.min("service_date").alias("first"), F.max("service_date").alias("last"), F.count(F.lit(1)).alias("n_days"), (F.min("place") == 1).alias("display"))
    shown = display.where("place = 1").join(links, "pattern_uid").select("direction_id", F.col("links").alias("shown"))
    out = rows.join(links, "pattern_uid").join(F.broadcast(shown), "direction_id")  # a row for each direction
    return out.select("direction_id", "pattern_uid", "first", "last", "n_days", "display", F.array_except("links", "shown").alias("links_added"), F.array_except("shown", "links").alias("links_removed"))


def day_cells(hours: DataFrame, mains: DataFrame, segments: DataFrame, cube: DataFrame, passages: DataFrame, passage_col: str = "n") -> DataFrame:
    """direction_id, service_date, hour, seg_key, obs, passages of every included day and hour of every segment valid that day."""
    valid = mains.join(_keys(segments), "pattern_uid").select("direction_id", "service_date", "seg_key", "link_key").distinct()
    base = valid.join(F.broadcast(hours.select("service_date", "hour", "weight")), "service_date")  # 28 rows a day
    obs = cube.groupBy("service_date", F.col("hour").cast("int").alias("hour"), "seg_key").agg(F.sum("obs").alias("o"))
    pas = passages.groupBy("service_date", F.col("hour").cast("int").alias("hour"), "link_key").agg(F.sum(F.coalesce(F.col(passage_col), F.lit(0))).alias("p"))
    out = base.join(obs, ["service_date", "hour", "seg_key"], "left").join(pas, ["service_date", "hour", "link_key"], "left")
    return out.select("direction_id", "service_date", "hour", "seg_key", F.coalesce(F.col("o") * F.col("weight"), F.lit(0.0)).cast("double").alias("obs"), F.coalesce("p", F.lit(0)).cast("double").alias("passages"))


def reference_agreement(est: DataFrame, shown: DataFrame, hotspots: DataFrame | None = None, top: float = 0.1) -> DataFrame:
    """How much both references agree on the shown segments (direction_id, seg_key) of each direction.

    Medians per metre over running segments, rank correlation of the day's excess over each (running segments, and all),
    share of the top running segments by one that are also top by the other, and hotspots by criterion.
    """
    from .core import spearman

    day = est.where(F.col("col") == BANDS["day"][0]).join(shown.select("direction_id", "seg_key").distinct(), ["direction_id", "seg_key"])
    xe, xl = F.col("excess_per_passage"), F.col("excess_line_per_passage")
    running = day.where("zone = 'running'")
    levels = running.groupBy("direction_id").agg(
        F.min(F.col("ref_line_obs_per_passage") / F.col("len_m")).alias("line_level_per_m"),
        F.percentile(F.col("ref_obs_per_passage") / F.col("len_m"), F.lit(0.5)).alias("evening_ref_per_m"),
    )
    rho = spearman(running, "excess_per_passage", "excess_line_per_passage", "direction_id").select("direction_id", F.col("rho").alias("spearman_day"))
    rho_all = spearman(day, "excess_per_passage", "excess_line_per_passage", "direction_id").select("direction_id", F.col("rho").alias("spearman_day_all"))
    both = W.partitionBy("direction_id")
    ok = running.where(xe.isNotNull() & xl.isNotNull())
    ranked = ok.select(
        "direction_id",
        F.greatest(F.lit(1), F.rint(top * F.count(F.lit(1)).over(both)).cast("int")).alias("k"),
        F.row_number().over(both.orderBy(F.desc("excess_per_passage"), "seg_key")).alias("a"),
        F.row_number().over(both.orderBy(F.desc("excess_line_per_passage"), "seg_key")).alias("b"),
        xe.alias("xe"),
        xl.alias("xl"),
    )
    spread = (F.count(F.lit(1)) >= 3) & (F.max("xe") > F.min("xe")) & (F.max("xl") > F.min("xl"))
    hit = F.sum(((F.col("a") <= F.col("k")) & (F.col("b") <= F.col("k"))).cast("int"))
    overlap = ranked.groupBy("direction_id").agg(F.when(spread, hit / F.max("k")).alias("top_overlap"))
    out = levels.join(rho, "direction_id", "left").join(rho_all, "direction_id", "left").join(overlap, "direction_id", "left")
    if hotspots is None:
        return out
    n = lambda c: F.count(F.when(F.col("criterion") == c, 1)).alias(f"n_{c}")
    counts = hotspots.groupBy("direction_id").agg(F.count(F.lit(1)).alias("n_hotspots"), n("peak"), n("persistent"), n("both"))
    out = out.join(counts, "direction_id", "left").fillna(0, ["n_hotspots", "n_peak", "n_persistent", "n_both"])
    return out.withColumn("hotspots_both_share", F.try_divide("n_both", "n_hotspots"))
