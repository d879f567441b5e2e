"""Day bootstrap, intervals, day rule, strata and grid costs; each returns a lazily planned DataFrame or a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bits of coverage flags, in the order in which they explain an excluded hour.
REASONS = ((2, "frozen"), (4, "line_absent"), (8, "deviation"), (256, "vehicle_ratio"))
# Chebyshev coefficients of the published erfc approximation with a relative error of 1.2e-7, constant first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function, in the JVM."""
    t = 1 / (1 + F.abs(x) / 2)
    total = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        total = total * t + c
    upper = t * F.exp(total - x * x)
    return F.when(x >= 0, upper).otherwise(2 - upper)


def one_sided_p(value: Column, theta: float, se: Column) -> Column:
    """Normal p-value of value > theta; without spread 0 or 1."""
    return F.when(se > 0, 0.5 * erfc((value - theta) / se / 2**0.5)).when(value > theta, 0.0).when(value.isNotNull(), 1.0)


def bootstrap_weights(days: DataFrame, n_draws: int, seed: int = 0, stratified: bool = True) -> DataFrame:
    """(draw, day, w) of a rescaled bootstrap of the distinct days of each weekday (of all, if not stratified); days that a draw leaves out have no row.

    In a stratum of n days a draw picks n - 1 with replacement, each worth n / (n - 1); a single day always weighs 1.
    Picks come from a digest of (seed, draw, weekday, number), so they repeat on any partitioning.
    """
    numbered = days.select("day").distinct().withColumn("dow", F.weekday("day") if stratified else F.lit(0))
    numbered = numbered.withColumn("at", F.row_number().over(W.partitionBy("dow").orderBy("day")) - 1)
    strata = numbered.groupBy("dow").agg(F.count(F.lit(1)).alias("n"))
    picks = strata.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n").cast("int") - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "dow", "i"))
    picks = picks.withColumn("at", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n")).cast("int"))
    counted = picks.groupBy("draw", "dow", "at", "n").agg(F.count(F.lit(1)).alias("times"))
    worth = F.when(F.col("n") > 1, F.col("times") * F.col("n") / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return counted.join(numbered, ["dow", "at"]).select("draw", "day", worth.alias("w"))


def bootstrap_intervals(daily: DataFrame, weights: DataFrame, keys: list[str], theta: float, alpha: float = 0.05) -> DataFrame:
    """Ratio of sums of (day, keys, obs, passages) with percentile interval, standard error and p-value over the draws.

    Days are summed to a row for each key first, so the join with the draws grows with keys x days, not with positions.
    """
    sums = daily.groupBy("day", *keys).agg(F.sum("obs").alias("obs"), F.sum("passages").alias("passages"))
    value = sums.groupBy(*keys).agg(F.try_divide(F.sum("obs"), F.sum("passages")).alias("value"))
    drawn = sums.join(weights, "day").groupBy("draw", *keys).agg(F.try_divide(F.sum(F.col("obs") * F.col("w")), F.sum(F.col("passages") * F.col("w"))).alias("x"))
    ends = drawn.groupBy(*keys).agg(F.percentile("x", F.lit(alpha / 2)).alias("lo"), F.percentile("x", F.lit(1 - alpha / 2)).alias("hi"), F.stddev_samp("x").alias("se"))
    return value.join(ends, keys, "left").withColumn("p", one_sided_p(F.col("value"), theta, F.col("se")))


def day_rule(days: DataFrame, coverage: DataFrame, min_coverage: float = 0.5, min_day: float = 0.8, hours: tuple[int, int] = (6, 21), bits: int = 2 | 4 | 8 | 256) -> DataFrame:
    """The excluded days with the reason of most of their excluded hours, the first seen of equally many.

    An hour is excluded without a row, under min_coverage or with one of the bits; a day if more than 1 - min_day of its hours are.
    """
    grid = days.select("day").distinct().withColumn("hour", F.explode(F.sequence(F.lit(hours[0]), F.lit(hours[1] - 1))))
    rows = grid.join(coverage.select("day", "hour", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("flags", F.lit(0)).alias("flags")), ["day", "hour"], "left")
    reason = F.when(F.col("coverage").isNull(), "no_data")
    for bit, name in REASONS:
        reason = reason.when(F.col("flags").bitwiseAND(bit) != 0, name)
    out = F.col("coverage").isNull() | (F.col("coverage") < min_coverage) | (F.col("flags").bitwiseAND(bits) != 0)
    votes = rows.where(out).groupBy("day", reason.otherwise("low_coverage").alias("reason")).agg(F.count(F.lit(1)).alias("votes"), F.min("hour").alias("first"))
    found = votes.groupBy("day").agg(F.max_by("reason", F.struct("votes", -F.col("first"))).alias("reason"), F.sum("votes").alias("n"))
    return found.where(F.col("n") / (hours[1] - hours[0]) > 1 - min_day + 1e-9).select("day", "reason")


def stratified(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over weekdays of ratios of sums of (day, keys, obs, passages), each weighted by its number of days in the table.

    Weekdays without passages of a key do not count for it.
    """
    dow = daily.withColumn("dow", F.weekday("day"))
    share = dow.groupBy("dow").agg(F.count_distinct("day").alias("n"))
    each = dow.groupBy("dow", *keys).agg(F.sum("obs").alias("o"), F.sum("passages").alias("p")).where("p > 0").join(F.broadcast(share), "dow")  # at most 7 rows
    return each.groupBy(*keys).agg((F.sum(F.col("n") * F.col("o") / F.col("p")) / F.sum("n")).alias("opp"))


def persistence(daily: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the days with passages on which positions a passage exceed the key's ``level``."""
    sums = daily.groupBy("day", *keys).agg(F.sum("obs").alias("o"), F.sum("passages").alias("p")).where("p > 0").join(levels, keys)
    return sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.avg((F.col("o") / F.col("p") > F.col("level")).cast("double")).alias("persistence"))


def grid_cost(bins: DataFrame, group: str, n_days: int) -> DataFrame:
    """Histogram cost (2 mean - population variance) / (days x width)^2 of bins (k, len_m), counts scaled to the mean width."""
    width = bins.groupBy(group).agg(F.avg("len_m").alias("width"))
    scaled = bins.join(width, group).withColumn("c", F.col("k") * F.col("width") / F.col("len_m"))
    return scaled.groupBy(group, "width").agg(F.avg("c").alias("m"), F.var_pop("c").alias("v")).select(group, ((2 * F.col("m") - F.col("v")) / F.pow(F.lit(max(n_days, 1)) * F.col("width"), F.lit(2))).alias("cost"))


def compared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both periods with the change of ``opp`` and its log2 ratio (0.5 added to both)."""
    both = a.select(*keys, F.col("opp").alias("a")).join(b.select(*keys, F.col("opp").alias("b")), keys)
    return both.withColumn("delta", F.col("b") - F.col("a")).withColumn("ratio", F.log2((F.col("b") + 0.5) / (F.col("a") + 0.5)))


def split_half(daily: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Reliability of ratios between odd and even days of each group's dates: correlation, at least 0, stepped up to full length."""
    day = daily.select("day").distinct().withColumn("half", (F.row_number().over(W.orderBy("day")) % 2))  # one row a date
    sums = daily.join(F.broadcast(day), "day").groupBy(*keys, "half").agg((F.try_divide(F.sum("obs"), F.sum("passages"))).alias("x"))
    halves = sums.groupBy(*keys).agg(F.max(F.when(F.col("half") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("half") == 1, F.col("x"))).alias("x1")).where("x0 is not null and x1 is not null")
    r = F.greatest(F.corr("x0", "x1"), F.lit(0.0))
    return halves.groupBy(group).agg((2 * r / (1 + r)).alias("reliability"))
