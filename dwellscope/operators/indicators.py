"""Indicators over the cube, stalls, version runs and dates matched to covered dates; each returns a lazily planned DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def band_totals(cube: DataFrame, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Positions and days of each pattern, segment and band of hours (first, end exclusive); bands may overlap."""
    names = F.filter(F.array(*[F.when(F.col("hour").between(a, b - 1), F.lit(n)) for n, (a, b) in bands.items()]), lambda n: n.isNotNull())
    daily = cube.withColumn("band", F.explode(names)).groupBy("service_date", "pattern_uid", "seg_idx", "band").agg(F.sum("obs").alias("obs"))
    return daily.groupBy("pattern_uid", "seg_idx", "band").agg(F.sum("obs").alias("obs"), F.count(F.lit(1)).alias("n_days"))


def line_level(cells: DataFrame, segments: DataFrame, hours: tuple[int, int] = (6, 23)) -> DataFrame:
    """Reference of each segment: the median over its pattern of positions a passage and metre, times the segment's length."""
    length = segments.select("pattern_uid", "seg_idx", (F.col("hi") - F.col("lo")).alias("len_m"))
    sums = cells.where(F.col("hour").between(hours[0], hours[1] - 1)).groupBy("pattern_uid", "seg_idx").agg(F.sum("obs").alias("o"), F.sum("passages").alias("p"))
    rates = sums.join(length, ["pattern_uid", "seg_idx"]).withColumn("rate", F.try_divide(F.try_divide("o", "p"), "len_m"))
    level = rates.groupBy("pattern_uid").agg(F.percentile("rate", F.lit(0.5)).alias("level"))
    return rates.join(level, "pattern_uid").select("pattern_uid", "seg_idx", (F.col("level") * F.col("len_m")).alias("line_ref"))


def weekday_totals(cube: DataFrame) -> DataFrame:
    """Positions and days of each weekday (Monday 0), hour, pattern and segment; the cube has one row for each date in a cell."""
    return cube.groupBy(F.weekday("service_date").alias("dow"), "hour", "pattern_uid", "seg_idx").agg(F.sum("obs").alias("obs"), F.count(F.lit(1)).alias("n_days"))


def frequency(passages: DataFrame) -> DataFrame:
    """Passages an hour: the median over links of passages a day on which the pattern runs."""
    days = passages.groupBy("pattern_uid").agg(F.count_distinct("service_date").alias("days"))
    links = passages.groupBy("pattern_uid", "hour", "link_idx").agg(F.sum("n").alias("n")).join(days, "pattern_uid")
    return links.groupBy("pattern_uid", "hour").agg(F.percentile(F.col("n") / F.col("days"), F.lit(0.5)).alias("per_h"))


def stalls(snapshots: DataFrame, cap_s: float = 40.0, tick_s: float = 20.0, max_s: float = 300.0) -> DataFrame:
    """Runs of consecutive frozen polls whose spans (to the next poll, capped) sum to more than max_s.

    A run is named by the live poll before it; days carry that poll and the next day's first over, so days are separate tasks.
    """
    polls = snapshots.groupBy("ts").agg(F.bool_and("frozen").alias("frozen")).withColumn("day", F.to_date("ts")).withColumn("us", _micros("ts"))
    live = F.when(~F.col("frozen"), F.col("us"))
    days = polls.groupBy("day").agg(F.min("us").alias("first"), F.max(live).alias("last_live"))
    order = W.orderBy("day")
    days = days.select("day", F.lead("first").over(order).alias("next_first"), F.last("last_live", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    w = W.partitionBy("day").orderBy("us")
    t = polls.join(days, "day").withColumn("after", F.coalesce(F.lead("us").over(w), F.col("next_first")))
    t = t.withColumn("run", F.coalesce(F.last(live, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("carried")))
    t = t.withColumn("span", F.least(F.coalesce((F.col("after") - F.col("us")) / 1e6, F.lit(tick_s)), F.lit(cap_s)))
    runs = t.where("frozen").groupBy("run").agg(F.min("ts").alias("ts0"), F.max("ts").alias("ts1"), F.count(F.lit(1)).alias("n"), F.sum("span").alias("frozen_s"))
    return runs.where(F.col("frozen_s") > max_s).drop("run")


def version_runs(days: DataFrame) -> DataFrame:
    """Stretches of a route's dates (route_id, day, version) with the same version."""
    w = W.partitionBy("route_id").orderBy("day")
    new = F.coalesce((~F.col("version").eqNullSafe(F.lag("version").over(w))).cast("int"), F.lit(1))
    numbered = days.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("route_id", "run").agg(F.first("version").alias("version"), F.min("day").alias("day0"), F.max("day").alias("day1"), F.count(F.lit(1)).alias("n"))


def _calendar(days: DataFrame, covered: DataFrame) -> DataFrame:
    """One row for each date of either table: wanted, and the date itself where covered."""
    both = days.select("day", F.lit(True).alias("wanted"), F.lit(None).cast("date").alias("cov")).unionByName(covered.select("day", F.lit(False).alias("wanted"), F.col("day").alias("cov")))
    return both.groupBy("day").agg(F.max("wanted").alias("wanted"), F.max("cov").alias("cov"))


def nearest_covered(days: DataFrame, covered: DataFrame) -> DataFrame:
    """Nearest covered date of the same kind (weekday, Saturday, Sunday), else nearest of all; the earlier of two equally near.

    Windows over distinct dates (some hundreds a year), no product of both tables.
    """
    def nearest(w) -> Column:
        back = F.last("cov", True).over(w.rowsBetween(W.unboundedPreceding, 0))
        ahead = F.first("cov", True).over(w.rowsBetween(0, W.unboundedFollowing))
        return F.when(back.isNull() | (F.datediff(ahead, "day") < F.datediff("day", back)), ahead).otherwise(back)

    cal = _calendar(days, covered).withColumn("kind", F.greatest(F.weekday("day"), F.lit(4)))
    found = cal.withColumn("same", nearest(W.partitionBy("kind").orderBy("day"))).withColumn("any", nearest(W.orderBy("day")))
    return found.where("wanted").select("day", F.coalesce("same", "any").alias("covered_day"))


def feed_on(days: DataFrame, feeds: DataFrame, max_back: int | None = None) -> DataFrame:
    """The latest feed (``day`` its first valid date) at or before each date, null where none or more than max_back days before."""
    found = _calendar(days, feeds).withColumn("feed", F.last("cov", True).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
    if max_back is not None:
        found = found.withColumn("feed", F.when(F.datediff("day", "feed") <= max_back, F.col("feed")))
    return found.where("wanted").select("day", "feed")


def ranked(df: DataFrame, group: str, value: str, k: int, *order: str) -> DataFrame:
    """The k rows of each group with the largest value, numbered from 1; nulls do not take part."""
    w = W.partitionBy(group).orderBy(F.desc(value), *order)
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def free_flow(cells: DataFrame, q: float = 0.2, hours: tuple[int, int] = (5, 24)) -> DataFrame:
    """Free-flow reference of each segment: the q quantile over hours of positions a passage."""
    opp = F.when(F.col("hour").between(hours[0], hours[1] - 1), F.try_divide("obs", "passages"))
    return cells.groupBy("pattern_uid", "seg_idx").agg(F.percentile(opp, F.lit(q)).alias("free_flow"))


def merged_stretches(stretches: DataFrame, group: str) -> DataFrame:
    """Stretches (j0, j1, both included) of any lists, those that overlap or touch made one."""
    w = W.partitionBy(group).orderBy("j0", "j1")
    reach = F.max("j1").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("j0") > reach + 1).cast("int"), F.lit(1))
    numbered = stretches.select(group, "j0", "j1", new.alias("new")).withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(group, "part").agg(F.min("j0").alias("j0"), F.max("j1").alias("j1")).drop("part")
