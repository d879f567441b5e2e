"""Choosing a segment length and testing how much results depend on choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analysis import BANDS
from .core import assign, spearman


def fine_grid(links: DataFrame, fine_m: float = 5.0) -> DataFrame:
    """Bins of fine_m from each link's start, a last one under a metre joined with the one before: pattern_uid, link_idx, link_key, seg_key, k, lo, hi, seg_idx."""
    n = F.floor(F.col("len_m") / fine_m).cast("int")
    inner = F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(fine_m)), lambda x: (x < F.col("len_m")) & ((x == 0) | (F.col("len_m") - x >= 1.0)))
    df = links.withColumn("edges", F.concat(inner, F.array(F.col("len_m"))))
    df = df.select("pattern_uid", "link_idx", "link_key", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("k", "lo"), F.col("edges").alias("e"))
    w = W.partitionBy("pattern_uid").orderBy("link_idx", "k")
    return df.select("pattern_uid", "link_idx", "link_key", F.concat("link_key", F.lit("/f"), F.col("k").cast("string")).alias("seg_key"), "k", "lo", F.element_at("e", F.col("k") + 2).alias("hi"), (F.row_number().over(w) - 1).alias("seg_idx"))


def overlaps(fine: DataFrame, segments: DataFrame) -> DataFrame:
    """fine_key, seg_key, w (metres) of overlapping bins of both grids on one link. ``segments`` has offset_m, len_m."""
    a = fine.select("pattern_uid", "link_idx", F.col("seg_key").alias("fine_key"), "lo", "hi")
    b = segments.select("pattern_uid", "link_idx", "seg_key", F.col("offset_m").alias("s0"), (F.col("offset_m") + F.col("len_m")).alias("s1"))
    w = F.least("hi", "s1") - F.greatest("lo", "s0")
    return a.join(b, ["pattern_uid", "link_idx"]).withColumn("w", w).where("w > 0").select("pattern_uid", "fine_key", "seg_key", "w")  # a link's bins meet


def loo_deviance(cells: DataFrame, fine_cells: DataFrame, hours: DataFrame, over: DataFrame, segments: DataFrame) -> DataFrame:
    """service_date, deviance: Poisson deviance of each day's fine counts under rates of all other days.

    ``cells`` are day_cells of the segments, ``fine_cells`` (direction_id, service_date, hour, fine_key, obs, link valid that
    day), ``hours`` the included hours with coverage, ``over`` the overlaps.
    """
    cov = hours.select("service_date", "hour", "coverage")
    day = cells.join(F.broadcast(cov), ["service_date", "hour"])  # 28 rows a day
    w = W.partitionBy("direction_id", "seg_key", "hour")
    rest_n, rest_c = F.sum("obs").over(w) - F.col("obs"), F.sum("coverage").over(w) - F.col("coverage")
    length = segments.groupBy("seg_key").agg(F.min("len_m").alias("len_m"))
    rates = day.withColumn("rate", F.when(rest_c > 1e-12, rest_n / rest_c).otherwise(0.0)).join(length, "seg_key").select("direction_id", "service_date", "hour", "seg_key", "coverage", (F.col("rate") / F.col("len_m")).alias("per_m"))
    pairs = over.select("fine_key", "seg_key", "w").distinct()
    mu = rates.join(pairs, "seg_key").groupBy("direction_id", "service_date", "hour", "fine_key").agg(F.greatest(F.sum(F.col("per_m") * F.col("w") * F.col("coverage")), F.lit(1e-6)).alias("mu"))
    y = mu.join(fine_cells, ["direction_id", "service_date", "hour", "fine_key"], "left").withColumn("y", F.coalesce("obs", F.lit(0.0)))
    term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("mu"))).otherwise(0.0) - (F.col("y") - F.col("mu"))
    return y.groupBy("service_date").agg((2 * F.sum(term)).alias("deviance"))


def cv_columns(deviances: DataFrame) -> DataFrame:
    """length, cv_deviance, cv_se, within_1se from (length, service_date, deviance): spread of the paired difference to the best length."""
    mean = deviances.groupBy("length").agg(F.avg("deviance").alias("cv_deviance"))
    best = mean.agg(F.min_by("length", F.struct("cv_deviance", "length")).alias("best"), F.min("cv_deviance").alias("least"))
    ref = deviances.join(F.broadcast(best), F.col("length") == F.col("best"))  # one row
    ref = ref.select("service_date", F.col("deviance").alias("d0"))
    se = deviances.join(ref, "service_date").groupBy("length").agg((F.coalesce(F.stddev_samp(F.col("deviance") - F.col("d0")), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("cv_se"))
    out = mean.join(se, "length").join(F.broadcast(best))
    return out.select("length", "cv_deviance", "cv_se", (F.col("cv_deviance") - F.col("least") <= F.greatest(F.col("cv_se"), F.lit(1e-12))).alias("within_1se"))


def half_days(mains: DataFrame, n_splits: int = 20, seed: int = 0) -> DataFrame:
    """split, service_date, half: the days of each weekday dealt evenly to two halves, by a digest of seed, split and date."""
    days = mains.select("service_date").distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("split").cast("string"), F.col("service_date").cast("string")))
    w = W.partitionBy("split", F.weekday("service_date")).orderBy(key, "service_date")
    first = (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("split").cast("string"), F.weekday("service_date").cast("string"))), 1, 2), 16, 10).cast("int") % 2).cast("int")
    return days.withColumn("half", ((F.row_number().over(w) + first) % 2).cast("int"))


def half_reliability(cells: DataFrame, hours: DataFrame, halves: DataFrame, lengths: DataFrame) -> DataFrame:
    """direction_id, reliability, snr: correlation of positions an hour and metre between halves over segments and hours 6 to 20, at least 0, stepped up; and signal to noise.

    Splits are averaged (snr: their median).
    """
    cov = hours.select("service_date", "hour", "coverage")
    day = cells.where(F.col("hour").between(6, 20)).join(F.broadcast(cov), ["service_date", "hour"]).join(F.broadcast(halves), "service_date")  # rows a date
    rate = day.groupBy("split", "direction_id", "seg_key", "hour", "half").agg(F.try_divide(F.sum("obs"), F.sum("coverage")).alias("r")).join(lengths, "seg_key").withColumn("r", F.col("r") / F.col("len_m"))
    pair = rate.groupBy("split", "direction_id", "seg_key", "hour").agg(F.max(F.when(F.col("half") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("r"))).alias("b")).where("a is not null and b is not null")
    noise = F.var_pop(F.col("a") - F.col("b")) / 4
    each = pair.groupBy("split", "direction_id").agg(F.greatest(F.corr("a", "b"), F.lit(0.0)).alias("c"), noise.alias("noise"), F.var_pop((F.col("a") + F.col("b")) / 2).alias("total"), F.count(F.lit(1)).alias("n")).where("n >= 3 and c is not null")
    each = each.withColumn("rel", 2 * F.col("c") / (1 + F.col("c"))).withColumn("snr", F.when(F.col("noise") > 0, (F.col("total") - F.col("noise")) / F.col("noise")))
    return each.groupBy("direction_id").agg(F.avg("rel").alias("reliability"), F.percentile("snr", F.lit(0.5)).alias("snr"))


def excess_reliability(cells: DataFrame, halves: DataFrame, lengths: DataFrame, ref_hours: tuple[int, int] = (20, 24)) -> DataFrame:
    """direction_id, reliability_excess: the same for the day's excess a passage and metre over the evening."""
    _, a, z = BANDS["day"]
    day = cells.join(F.broadcast(halves), "service_date")  # rows a date
    inside, evening = F.col("hour").between(a, z - 1), F.col("hour").between(ref_hours[0], ref_hours[1] - 1)
    ratio = lambda c: F.try_divide(F.sum(F.when(c, F.col("obs"))), F.sum(F.when(c, F.col("passages"))))
    x = day.groupBy("split", "direction_id", "seg_key", "half").agg((ratio(inside) - ratio(evening)).alias("x")).join(lengths, "seg_key").withColumn("x", F.col("x") / F.col("len_m"))
    pair = x.groupBy("split", "direction_id", "seg_key").agg(F.max(F.when(F.col("half") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("x"))).alias("b")).where("a is not null and b is not null")
    each = pair.groupBy("split", "direction_id").agg(F.greatest(F.corr("a", "b"), F.lit(0.0)).alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 3 and c is not null")
    return each.groupBy("direction_id").agg(F.avg(2 * F.col("c") / (1 + F.col("c"))).alias("reliability_excess"))


def location_spread(bins: DataFrame, places: DataFrame, stretches: DataFrame, top: int = 10) -> DataFrame:
    """direction_id, loc_spread_m: median over the strongest stretches of the spread of the draws' worst place, within two segments around.

    ``stretches`` has direction_id, stretch, j0, j1, peak_hour, value.
    """
    w = W.partitionBy("direction_id").orderBy(F.desc("value"), "j0")
    strongest = stretches.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    inside = strongest.select("direction_id", "stretch", "peak_hour", F.explode(F.sequence(F.greatest(F.col("j0") - 2, F.lit(0)), F.col("j1") + 2)).alias("j"))
    mid = places.select("direction_id", "seg_key", "j", (F.col("x0_m") + F.col("len_m") / 2).alias("mid"))
    x = inside.join(mid, ["direction_id", "j"]).join(bins.select("direction_id", "seg_key", F.col("col").alias("peak_hour"), "draws"), ["direction_id", "seg_key", "peak_hour"])
    each = x.select("direction_id", "stretch", "j", "mid", F.posexplode("draws").alias("draw", "v")).groupBy("direction_id", "stretch", "draw").agg(F.max_by("mid", F.struct(F.coalesce("v", F.lit(float("-inf"))), -F.col("j"))).alias("at"))
    per = each.groupBy("direction_id", "stretch").agg(F.stddev_pop("at").alias("spread"))
    return per.groupBy("direction_id").agg(F.percentile("spread", F.lit(0.5)).alias("loc_spread_m"))


def footprint_overlap(a: DataFrame, b: DataFrame, tol: int = 1) -> DataFrame:
    """direction_id, overlap of the segments that both sets of stretches cover, within tol segments."""
    from .patterns import tolerant_overlap

    cover = lambda s: s.select("direction_id", F.explode(F.sequence("j0", "j1")).alias("j")).distinct()
    return tolerant_overlap(cover(a), cover(b), "direction_id", tol)


def overlapping(hotspots: DataFrame, others: DataFrame, tol_m: float = 30.0, blocks: int = 256) -> DataFrame:
    """Hotspots (direction_id, from_m, to_m) that some other list's stretch overlaps, within tol_m.

    Of the others that begin before a hotspot ends, the farthest end decides, so no pairs are compared: a running maximum
    in ``blocks`` equal parts of each direction's beginnings, which tasks share, after the maxima of the parts before.
    """
    b = others.select(F.col("direction_id").alias("d"), (F.col("from_m") - tol_m).cast("double").alias("f"), (F.col("to_m") + tol_m).cast("double").alias("t")).where("d is not null and f is not null and t is not null")
    b = b.groupBy("d", "f").agg(F.max("t").alias("t"))
    extent = b.groupBy("d").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))  # a row for each direction

    def block(at):
        part = F.floor((at - F.col("lo")) / (F.col("hi") - F.col("lo")) * blocks)
        whole = (F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") < float("inf"))
        return F.when(whole, F.when(at >= F.col("hi"), blocks - 1).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(blocks - 1)))).otherwise(0).cast("int")

    b = b.join(F.broadcast(extent), "d").select("d", "f", "t", block(F.col("f")).alias("block"))
    # the maximum of the parts before stands at the start of each part
    parts = extent.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(b.groupBy("d", "block").agg(F.max("t").alias("t")), ["d", "block"], "left")
    parts = parts.select("d", F.lit(float("-inf")).alias("f"), F.max("t").over(W.partitionBy("d").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("t"), "block").where("t is not null")
    h = hotspots.select(F.struct("*").alias("row"), F.col("direction_id").alias("d"), F.col("from_m").cast("double").alias("from"), F.col("to_m").cast("double").alias("f"))
    h = h.join(F.broadcast(extent), "d").where("f >= lo").select("row", "from", "d", "f", F.lit(None).cast("double").alias("t"), block(F.col("f")).alias("block"))
    none = [F.lit(None).cast(h.schema[n].dataType).alias(n) for n in ("row", "from")]
    both = h.unionByName(b.unionByName(parts).select(*none, "d", "f", "t", "block"))
    reach = F.max("t").over(W.partitionBy("d", "block").orderBy("f"))  # equal places count on both sides
    return both.withColumn("reach", reach).where("row is not null and `from` <= reach").select("row.*")


def total_deviation(base: DataFrame, other: DataFrame) -> DataFrame:
    """Largest relative difference of link totals (pattern_uid, link_key, obs)."""
    j = base.select("pattern_uid", "link_key", F.col("obs").alias("a")).join(other.select("pattern_uid", "link_key", F.col("obs").alias("b")), ["pattern_uid", "link_key"], "full_outer").fillna(0)
    return j.agg(F.coalesce(F.max(F.abs(F.col("b") - F.col("a")) / F.greatest("a", F.lit(1))), F.lit(0.0)).alias("deviation"))


def link_rates(est: DataFrame, shown: DataFrame) -> DataFrame:
    """direction_id, link_key, obs_per_h of the day band over the shown segments of each link."""
    day = est.where(F.col("col") == BANDS["day"][0]).join(shown.select("direction_id", "seg_key").distinct(), ["direction_id", "seg_key"])
    return day.groupBy("direction_id", "link_key").agg(F.sum(F.coalesce("obs_per_h", F.lit(0.0))).alias("obs_per_h"))


def stop_zone(placed: DataFrame, links: DataFrame, max_m: float = 150.0, step: float = 5.0, factor: float = 1.5) -> DataFrame:
    """side (up, down), metres: how far from stops positions stay denser than ``factor`` times the level beyond 100 m.

    Densities of bins of ``step`` are per link long enough for the bin.
    """
    n = int(max_m / step)
    x = placed.where(F.coalesce("count", F.lit(True))).join(links.select("pattern_uid", "link_idx", F.col("len_m").alias("__l")), ["pattern_uid", "link_idx"])
    sides = F.array(F.struct(F.lit("up").alias("side"), (F.col("__l") - F.col("pos_m")).alias("d")), F.struct(F.lit("down").alias("side"), F.col("pos_m").cast("double").alias("d")))
    d = x.select(F.explode(sides).alias("s")).select("s.side", "s.d").where((F.col("d") >= 0) & (F.col("d") <= max_m))
    count = d.groupBy("side", F.least(F.floor(F.col("d") / step), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = placed.sparkSession
    grid = spark.createDataFrame([(s, i) for s in ("up", "down") for i in range(n)], "side string, bin int")
    exposure = links.select("len_m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")).where(F.col("len_m") >= (F.col("bin") + 1) * step).groupBy("bin").agg(F.count(F.lit(1)).alias("e"))
    dens = grid.join(count, ["side", "bin"], "left").join(exposure, "bin", "left").select("side", "bin", (F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("e", F.lit(0)), F.lit(1))).alias("dens"))
    base = dens.groupBy("side").agg(F.coalesce(F.percentile(F.when(F.col("bin") * step >= 100, F.col("dens")), F.lit(0.5)), F.percentile("dens", F.lit(0.5))).alias("base"))
    below = dens.join(base, "side").groupBy("side").agg(F.min(F.when(~(F.col("dens") > factor * F.col("base")), F.col("bin"))).alias("first"))
    return below.select("side", (F.coalesce("first", F.lit(n)) * step).alias("metres"))


def recommended(scores: DataFrame, default: float, min_reliability: float = 0.8, max_spread_m: float = 30.0) -> tuple[float, bool]:
    """(length, whether one passed): the smallest whose excess is reliable and whose hotspots stay in place; else the default."""
    ok = (F.col("reliability_excess") >= min_reliability) & (F.col("loc_spread_m").isNull() | (F.col("loc_spread_m") <= max_spread_m))
    row = scores.where(ok).agg(F.min("length")).first()
    return (float(row[0]), True) if row[0] is not None else (float(default), False)


def score_lengths(spark: SparkSession, lengths: list[float], score: Callable[[float], DataFrame]) -> DataFrame:
    """Scores of each length as one table; ``score`` plans one length."""
    out = None
    for length in lengths:
        one = score(length).withColumn("length", F.lit(float(length)))
        out = one if out is None else out.unionByName(one)
    return out


def against_baseline(variant: DataFrame, baseline: DataFrame) -> DataFrame:
    """For each direction: rank correlation of a variant's profile with the baseline's (direction_id, x_m, value), and the largest relative change."""
    j = baseline.select("direction_id", "x_m", F.col("value").alias("a")).join(variant.select("direction_id", "x_m", F.col("value").alias("b")), ["direction_id", "x_m"])
    rho = spearman(j, "a", "b", "direction_id").select("direction_id", "rho")
    return j.groupBy("direction_id").agg(F.max(F.abs(F.try_divide(F.col("b") - F.col("a"), F.col("a")))).alias("max_change")).join(rho, "direction_id", "left")


def profile(est: DataFrame, places: DataFrame, grid_m: float = 10.0) -> DataFrame:
    """direction_id, x_m, value: the day's positions an hour and metre at places grid_m apart along the shown pattern."""
    day = est.where(F.col("col") == BANDS["day"][0]).select("direction_id", "seg_key", (F.col("obs_per_h") / F.col("len_m")).alias("value"))
    s = places.join(day, ["direction_id", "seg_key"], "left").select("direction_id", "x0_m", (F.col("x0_m") + F.col("len_m")).alias("x1_m"), "value")
    k0 = F.ceil((F.col("x0_m") - grid_m / 2) / grid_m)
    k1 = F.ceil((F.col("x1_m") - grid_m / 2) / grid_m) - 1
    return s.where(k0 <= k1).select("direction_id", F.explode(F.sequence(k0, k1)).alias("k"), "value").select("direction_id", (F.col("k") * grid_m + grid_m / 2).alias("x_m"), "value")


def fine_cube(placed: DataFrame, fine: DataFrame) -> DataFrame:
    """Counted positions by date, hour and fine bin."""
    at = assign(placed.where(F.coalesce("count", F.lit(True))), fine.select("pattern_uid", "link_idx", "hi", "seg_idx")).where("seg_idx is not null")
    return at.groupBy("service_date", "hour", "pattern_uid", "seg_idx").agg(F.count(F.lit(1)).cast("double").alias("obs")).join(fine.select("pattern_uid", "seg_idx", F.col("seg_key").alias("fine_key"), "link_key"), ["pattern_uid", "seg_idx"])
