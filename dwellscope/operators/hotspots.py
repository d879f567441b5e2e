"""Hotspots of a direction: bin statistics over bootstrapped days, stretches of candidate bins, their description.

The draws need each segment's day x hour table as a matrix, so they run as one grouped Arrow function a segment
(days x hours numbers each); tests, stretches and ranks are DataFrame operations on bins.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellscope.sources.store import written

from .analysis import BANDS
from .core import benjamini_hochberg
from .statistics import bootstrap_weights, one_sided_p

# Bands of the peak, hours of the persistent criterion, day hours of scores, smallest number of days.
PEAK_BANDS, ALLDAY, SCORE_HOURS, MIN_DAYS = ("am", "pm"), (6, 23), (6, 21), 5
#: Column code of the hours of the persistent criterion together.
ALLDAY_COL = -9
_DDL = "direction_id int, seg_key string, col int, obs double, passages double, opp double, ref double, x double, lo double, hi double, se double, persistence double, draws array<double>, opp_draws array<double>, daily array<double>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def weight_matrix(days: DataFrame, n_draws: int, seed: int = 0, stratified: bool = True) -> tuple[list[dt.date], np.ndarray]:
    """Dates and the (draws x dates) weights of the day bootstrap, for the driver: a number for each draw and date."""
    rows = bootstrap_weights(days, n_draws, seed, stratified).collect()
    dates = sorted(r[0] for r in days.select("day").distinct().collect())
    place = {d: i for i, d in enumerate(dates)}
    out = np.zeros((n_draws, len(dates)))
    for r in rows:
        out[r["draw"], place[r["day"]]] = r["w"]
    return dates, out


def _quantiles(x: np.ndarray, alpha: float) -> tuple[float, float, float]:
    """Ends of the percentile interval and standard error of the values that are numbers."""
    x = x[np.isfinite(x)]
    if not len(x):
        return np.nan, np.nan, np.nan
    lo, hi = np.quantile(x, [alpha / 2, 1 - alpha / 2])
    return float(lo), float(hi), float(x.std(ddof=1)) if len(x) > 1 else np.nan


def _null(x: float) -> float | None:
    return float(x) if np.isfinite(x) else None


def _nulls(x: np.ndarray) -> list[float | None]:
    return [v if f else None for v, f in zip(x.tolist(), np.isfinite(x).tolist(), strict=True)]


def _bins(shared, ref_hours: tuple[int, int], min_passages: float, alpha: float):
    schema = _schema(_DDL)
    epoch = dt.date(1970, 1, 1)

    def run(key, rows):
        direction, seg_key = key[0].as_py(), key[1].as_py()
        dates, weights = shared.value[direction]
        day = np.searchsorted([(d - epoch).days for d in dates], rows.column("service_date").cast(pa.int32()).to_numpy())
        hour = rows.column("hour").to_numpy()
        shape = (len(dates), 28)
        obs, pas, cell = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        obs[day, hour], pas[day, hour], cell[day, hour] = rows.column("obs").to_numpy(), rows.column("passages").to_numpy(), 1
        every = np.ones((1, len(dates)))
        out: dict[str, list] = {f.name: [] for f in schema}

        def ratio(o, p, m=None):
            good = (p > 0) if m is None else (p > 0) & (p >= min_passages * m)
            return np.where(good, o / np.where(p > 0, p, 1), np.nan)

        a, z = ref_hours
        ref, ref_draws = (ratio(w @ obs[:, a:z].sum(1), w @ pas[:, a:z].sum(1)) for w in (every, weights))
        spans = [(h, h, h + 1) for h in sorted(set(hour.tolist()))] + [BANDS[b] for b in PEAK_BANDS] + [(ALLDAY_COL, *ALLDAY)]
        for col, a, z in spans:
            o, p, m = obs[:, a:z].sum(1), pas[:, a:z].sum(1), cell[:, a:z].max(1)
            rule = None if col == ALLDAY_COL else m
            opp, draws = (ratio(w @ o, w @ p, None if rule is None else w @ rule) for w in (every, weights))
            x, x_draws = opp - ref, draws - ref_draws
            lo, hi, se = _quantiles(x_draws, alpha)
            daily = ratio(o, p) - (0.0 if col == ALLDAY_COL else ref[0])
            known = np.isfinite(daily)
            share = (daily[known] > 0).mean() if known.any() else np.nan
            values = (direction, seg_key, col, o.sum(), p.sum(), _null(opp[0]), _null(ref[0]), _null(x[0]), _null(lo), _null(hi), _null(se), _null(share), _nulls(x_draws), _nulls(draws), _nulls(daily))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return pa.table(out, schema=schema)

    return run


def bin_statistics(cells: DataFrame, mains: DataFrame, n_draws: int = 200, ref_hours: tuple[int, int] = (20, 24), min_passages: float = 0.5, level: float = 0.95, seed: int = 0, stratified: bool = True) -> DataFrame:
    """Of each direction, segment and column (hours, peak bands, all day): sums, excess over the evening, interval, spread, share of days above, draws.

    ``cells`` are day_cells, ``mains`` the days' main patterns. Each direction draws from its own days.
    """
    spark = cells.sparkSession
    directions = [r[0] for r in mains.select("direction_id").distinct().collect()]
    weights = {d: weight_matrix(mains.where(F.col("direction_id") == d).select(F.col("service_date").alias("day")), n_draws, seed, stratified) for d in directions}
    shared = spark.sparkContext.broadcast(weights)  # a number for each draw, direction and date
    return cells.select("direction_id", "seg_key", "service_date", "hour", "obs", "passages").groupBy("direction_id", "seg_key").applyInArrow(_bins(shared, ref_hours, min_passages, 1 - level), _DDL)


def peak_candidates(bins: DataFrame, theta: float, hours: tuple[int, int] = (5, 24), q: float = 0.1, min_persistence: float = 0.6) -> DataFrame:
    """Bins of the output hours and peak bands with p, reject and candidate: interval above theta, on enough days, past Benjamini-Hochberg."""
    codes = [BANDS[b][0] for b in PEAK_BANDS]
    shown = bins.where(F.col("col").isin(*codes) | ((F.col("col") >= hours[0]) & (F.col("col") < hours[1])))
    tested = shown.withColumn("p", F.when(F.col("x").isNotNull(), one_sided_p(F.col("x"), theta, F.col("se"))))
    passed = benjamini_hochberg(tested.select("direction_id", "seg_key", "col", "p"), q, "direction_id", "seg_key", "col").drop("p")
    out = tested.join(passed, ["direction_id", "seg_key", "col"])
    return out.withColumn("candidate", F.coalesce((F.col("lo") > theta) & (F.col("persistence") >= min_persistence) & F.col("reject"), F.lit(False)))


def persistent_levels(bins: DataFrame, places: DataFrame) -> DataFrame:
    """direction_id, level, level_draws: median over running segments of the all-day occupancy per metre, and the same in each draw."""
    run = bins.where(F.col("col") == ALLDAY_COL).join(places.where("zone = 'running'").select("direction_id", "seg_key", "len_m"), ["direction_id", "seg_key"])
    whole = run.groupBy("direction_id").agg(F.percentile(F.col("opp") / F.col("len_m"), F.lit(0.5)).alias("level"))
    each = run.select("direction_id", "len_m", F.posexplode("opp_draws").alias("draw", "o")).groupBy("direction_id", "draw").agg(F.percentile(F.col("o") / F.col("len_m"), F.lit(0.5)).alias("m"))
    draws = each.groupBy("direction_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "m"))), lambda v: v["m"]).alias("level_draws"))  # a number for each draw
    return whole.join(draws, "direction_id")


def _less_level(values: str, levels: str) -> Column:
    return F.zip_with(values, levels, lambda o, m: o - m * F.col("len_m"))


def _with_interval(alpha: float, fields: list[str], ddl: str):
    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            ends = [_quantiles(np.array(d, float), alpha) for d in rows["p_draws"]]
            for i, name in enumerate(("lo", "hi", "se")):
                rows[name] = [_null(e[i]) for e in ends]
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in ddl], schema=ddl)

    return run


_PERSISTENT = "direction_id int, seg_key string, j int, len_m double, zone string, obs double, passages double, level double, x double, lo double, hi double, se double, persistence double, hour_share double, evening_share double, p_draws array<double>, daily array<double>"


def persistent_statistics(bins: DataFrame, places: DataFrame, theta: float, ref_hours: tuple[int, int] = (20, 24), q: float = 0.1, level: float = 0.95, min_persistence: float = 0.6, min_hour_share: float = 0.75) -> DataFrame:
    """All-day excess of each shown segment over the direction's usual occupancy, with interval, share of days and hours above, and the persistent candidate rule.

    A running segment is a candidate if the interval's lower end is over theta, on enough days, past Benjamini-Hochberg over
    running segments, in enough hours and in half of the evening hours.
    """
    levels = persistent_levels(bins, places)
    keyed = bins.join(places.select("direction_id", "seg_key", "j", "len_m", "zone"), ["direction_id", "seg_key"]).join(F.broadcast(levels), "direction_id")  # a row for each direction
    usual = F.col("level") * F.col("len_m")
    hourly = keyed.where(F.col("col").between(ALLDAY[0], ALLDAY[1] - 1) & (F.col("passages") > 0)).withColumn("over", (F.col("obs") / F.col("passages") - usual > theta).cast("double"))
    evening = F.col("col").between(ref_hours[0], ref_hours[1] - 1)
    shares = hourly.groupBy("direction_id", "seg_key").agg(F.avg("over").alias("hour_share"), F.avg(F.when(evening, F.col("over"))).alias("evening_share"))
    day = keyed.where(F.col("col") == ALLDAY_COL).join(shares, ["direction_id", "seg_key"], "left")
    known = F.filter(F.transform("daily", lambda v: v - usual), lambda v: v.isNotNull())
    share = F.when(F.size(known) > 0, F.size(F.filter(known, lambda v: v > 0)) / F.size(known))
    rows = day.select(
        "direction_id", "seg_key", "j", "len_m", "zone", "obs", "passages", "level", (F.col("opp") - usual).alias("x"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("se"),
        share.alias("persistence"), "hour_share", "evening_share", _less_level("opp_draws", "level_draws").alias("p_draws"), F.transform("daily", lambda v: v - usual).alias("daily"),
    )
    out = rows.mapInArrow(_with_interval(1 - level, rows.columns, _schema(_PERSISTENT)), _PERSISTENT)
    out = out.withColumn("p", F.when((F.col("zone") == "running") & F.col("x").isNotNull(), one_sided_p(F.col("x"), theta, F.col("se"))))
    passed = benjamini_hochberg(out.select("direction_id", "seg_key", "p"), q, "direction_id", "seg_key").drop("p")
    rule = (F.col("zone") == "running") & (F.col("lo") > theta) & (F.col("persistence") >= min_persistence) & F.col("reject") & (F.col("hour_share") >= min_hour_share) & (F.col("evening_share") >= 0.5)
    return out.join(passed, ["direction_id", "seg_key"]).withColumn("candidate", F.coalesce(rule, F.lit(False)))


def segment_hours(candidates: DataFrame, hours: tuple[int, int] = (5, 24)) -> DataFrame:
    """direction_id, seg_key, hours: hours that are candidates next to another one, and all hours of candidate bands."""
    w = W.partitionBy("direction_id", "seg_key").orderBy("col")
    hourly = candidates.where("col >= 0 and candidate").withColumn("near", (F.lag("col").over(w) == F.col("col") - 1) | (F.lead("col").over(w) == F.col("col") + 1))
    single = hourly.where("near").select("direction_id", "seg_key", F.col("col").alias("hour"))
    of = F.create_map(*[x for b in PEAK_BANDS for x in (F.lit(BANDS[b][0]), F.array(*[F.lit(h) for h in range(max(BANDS[b][1], hours[0]), min(BANDS[b][2], hours[1]))]))])
    band = candidates.where("col < 0 and candidate").select("direction_id", "seg_key", F.explode(F.try_element_at(of, F.col("col"))).alias("hour"))
    return single.unionByName(band).groupBy("direction_id", "seg_key").agg(F.array_sort(F.collect_set("hour")).alias("hours"))


def numbered(places: DataFrame) -> DataFrame:
    """Places with ``zc``, the zone changes up to each place: two places have one zone between them if these agree."""
    w = W.partitionBy("direction_id").orderBy("j")
    return places.withColumn("zc", F.sum((F.coalesce(F.lag("zone").over(w), F.col("zone")) != F.col("zone")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def zoned_stretches(marked: DataFrame, gap: int = 1) -> DataFrame:
    """direction_id, stretch, j0, j1, hours of marked places (direction_id, j, zc, hours) at most ``gap`` places apart without a zone change between."""
    w = W.partitionBy("direction_id").orderBy("j")
    new = F.coalesce((F.col("j") - F.lag("j").over(w) > gap + 1) | (F.lag("zc").over(w) != F.col("zc")), F.lit(True)).cast("int")
    cut = marked.withColumn("new", new).withColumn("stretch", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return cut.groupBy("direction_id", "stretch").agg(F.min("j").alias("j0"), F.max("j").alias("j1"), F.min("zc").alias("zc"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hours")))).alias("hours"))


def joined_stretches(peak: DataFrame, persistent: DataFrame, gap: int = 1) -> DataFrame:
    """Peak and persistent stretches that overlap or touch, within a zone, as one: j0, j1, peak_hours, persistent_hours, is_peak, is_persistent."""
    none = F.array().cast("array<int>")
    rows = peak.select("direction_id", "j0", "j1", "zc", F.col("hours").alias("a"), none.alias("b"))
    rows = rows.unionByName(persistent.select("direction_id", "j0", "j1", "zc", none.alias("a"), F.col("hours").alias("b")))
    w = W.partitionBy("direction_id").orderBy("j0", "j1", F.size("a"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    top, zone = F.max("j1").over(before), F.max("zc").over(before)
    new = F.coalesce((F.col("j0") - top > gap + 1) | ((top < F.col("j0")) & (zone != F.col("zc"))), F.lit(True)).cast("int")
    cut = rows.withColumn("new", new).withColumn("stretch", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    bare = (F.size("a") == 0) & (F.size("b") == 0) & (F.col("new") == 1)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return cut.groupBy("direction_id", "stretch").agg(
        F.min("j0").alias("j0"), F.max("j1").alias("j1"), F.min("zc").alias("zc"), union("a").alias("peak_hours"), union("b").alias("persistent_hours"),
        F.max((F.size("a") > 0) | bare).alias("is_peak"), F.max(F.size("b") > 0).alias("is_persistent"),
    )


def persistent_stretches(persistent: DataFrame, bins: DataFrame, places: DataFrame, theta: float, hours: tuple[int, int] = (5, 24), gap: int = 1) -> DataFrame:
    """Stretches of persistent candidates; their hours are those whose summed excess over the usual level is over theta."""
    zoned = numbered(places)
    none = F.array().cast("array<int>")
    found = zoned_stretches(persistent.where("candidate").select("direction_id", "seg_key").join(zoned.select("direction_id", "seg_key", "j", "zc"), ["direction_id", "seg_key"]).withColumn("hours", none), gap)
    level = persistent.groupBy("direction_id").agg(F.min("level").alias("level"))
    hourly = bins.where(F.col("col").between(max(ALLDAY[0], hours[0]), min(ALLDAY[1], hours[1]) - 1) & (F.col("passages") > 0)).join(places.select("direction_id", "seg_key", "j", "len_m"), ["direction_id", "seg_key"]).join(F.broadcast(level), "direction_id")
    excess = hourly.select("direction_id", "j", "col", (F.col("obs") / F.col("passages") - F.col("level") * F.col("len_m")).alias("x"))
    inside = found.select("direction_id", "stretch", F.explode(F.sequence("j0", "j1")).alias("j")).join(excess, ["direction_id", "j"])
    over = inside.groupBy("direction_id", "stretch", "col").agg(F.sum("x").alias("x")).where(F.col("x") > theta).groupBy("direction_id", "stretch").agg(F.array_sort(F.collect_set("col")).alias("over"))
    return found.join(over, ["direction_id", "stretch"], "left").withColumn("hours", F.coalesce("over", none)).drop("over")


_STRETCH = (
    "direction_id int, stretch int, criterion string, value double, lo double, hi double, persistence double, peak_hour int, excess_obs_per_day double, peak_excess double, allday_excess double, f_num double, peak_ratio double"
)


def _described(hours: tuple[int, int], theta: float, alpha: float, n_days: dict[int, int]):
    schema = _schema(_STRETCH)
    nan = float("nan")

    def matrix(rows, name):
        return np.array([[np.nan if v is None else v for v in r[name]] for r in rows], float)

    def interval(m):
        return _quantiles(np.nansum(m, 0), alpha)[:2]

    def days_above(m):
        whole = np.isfinite(m).all(0)
        return float((m[:, whole].sum(0) > 0).mean()) if whole.any() else nan

    def value(r, name):
        return nan if r[name] is None else r[name]

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["col"], r["j"]))
        head = rows[0]
        n = max(n_days[key[0].as_py()], 1)
        by: dict[int, list[dict]] = {}
        for r in rows:
            by.setdefault(r["col"], []).append(r)
        shown = [c for c in by if hours[0] <= c < hours[1]]
        summed = {c: float(np.nansum([value(r, "x") for r in by[c]])) for c in by}
        peak = (nan, nan, nan, nan, None, nan)
        chosen = [h for h in head["peak_hours"] if h in by]
        if chosen:
            best = max(chosen, key=lambda h: (summed[h], -h))
            surplus = sum(np.nansum([r["obs"] - value(r, "ref") * r["passages"] for r in by[h]]) for h in chosen) / n
            peak = (summed[best], *interval(matrix(by[best], "draws")), days_above(matrix(by[best], "daily")), best, float(surplus))
        whole = (nan,) * 5
        usual = np.array([r["level"] * r["len_m"] for r in by[ALLDAY_COL]])
        level_draws = np.array(head["level_draws"], float)
        lengths = np.array([r["len_m"] for r in by[ALLDAY_COL]])

        def over_level(c):
            return matrix(by[c], "opp_draws") - level_draws[None, :] * lengths[:, None]

        if head["zone"] == "running":
            day = by[ALLDAY_COL]
            surplus = sum(r["obs"] - u * r["passages"] for c in by if ALLDAY[0] <= c < ALLDAY[1] for r, u in zip(by[c], usual, strict=True)) / n
            whole = (float(np.nansum([value(r, "opp") - u for r, u in zip(day, usual, strict=True)])), *interval(over_level(ALLDAY_COL)), days_above(matrix(day, "daily") - usual[:, None]), float(surplus))
        criterion = "both" if head["is_peak"] and head["is_persistent"] else "persistent" if head["is_persistent"] else "peak"
        if criterion == "peak":
            out = peak
        else:
            hourly = {c: float(np.nansum([r["obs"] / r["passages"] - u if r["passages"] > 0 else nan for r, u in zip(by[c], usual, strict=True)])) for c in shown if ALLDAY[0] <= c < ALLDAY[1]}
            worst = max(hourly, key=lambda c: (hourly[c], -c)) if hourly else None
            hour = worst if worst is not None else peak[4]
            if criterion == "persistent":
                out = (*whole[:4], hour, whole[4])
            else:
                out = (hourly[worst], *interval(over_level(worst)), whole[3], hour, float(np.nanmax([peak[5], whole[4]])))
        occupied = [np.nansum([value(r, "opp") for r in by[c]]) / lengths.sum() for c in by if SCORE_HOURS[0] <= c < SCORE_HOURS[1]]
        f_num = float(np.quantile(occupied, 0.2)) if occupied else nan
        peak_hours = {h for b in PEAK_BANDS for h in range(*BANDS[b][1:])}
        inner = [c for c in shown if 6 <= c < 20]
        high, low = [summed[c] for c in inner if c in peak_hours], [summed[c] for c in inner if c not in peak_hours]
        ratio = np.mean(high) / max(np.mean(low), theta / 2) if high and low else nan
        values = (key[0].as_py(), key[1].as_py(), criterion, *map(_null, out[:4]), out[4], _null(out[5]), _null(peak[0]), _null(whole[0]), _null(f_num), _null(ratio))
        return pa.table({f.name: [v] for f, v in zip(schema, values, strict=True)}, schema=schema)

    return run


def hotspot_kind(criterion: Column, score: Column, ratio: Column, f_min: float = 1.5, ratio_min: float = 2.0) -> Column:
    """infrastructure: there all day; congestion: at peaks only; mixed: else."""
    fixed, peaked = F.coalesce(score >= f_min, F.lit(False)), F.coalesce(ratio >= ratio_min, F.lit(False))
    return F.when(criterion == "persistent", "infrastructure").when(criterion == "both", "mixed").when(fixed & ~peaked, "infrastructure").when(peaked & ~fixed, "congestion").otherwise("mixed")


def shown_places(display: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of the shown pattern of each direction, numbered along it (j)."""
    shown = display.where("place = 1").select("direction_id", "pattern_uid").join(segments, "pattern_uid")
    return shown.withColumn("j", (F.row_number().over(W.partitionBy("direction_id").orderBy("seg_idx")) - 1).cast("int"))


def enough_days(mains: DataFrame, min_days: int = 5) -> bool:
    """Whether there are days enough for hotspots."""
    return mains.select("service_date").distinct().count() >= max(min_days, MIN_DAYS)


def hotspots(
    bins: DataFrame, mains: DataFrame, places: DataFrame, links: DataFrame, tick_s: float = 20.0, theta_s: float = 2.0, hours: tuple[int, int] = (5, 24), ref_hours: tuple[int, int] = (20, 24),
    q: float = 0.1, level: float = 0.95, min_persistence: float = 0.6, min_hour_share: float = 0.75, gap: int = 1, min_days: int = 5,
) -> DataFrame:
    """Ranked stretches of each direction. ``bins`` are bin_statistics of the shown places, read several times: write them first.

    Two criteria: peak (excess over the evening) and persistent (over the usual running level, all day); stretches of both
    that touch become one. Without days enough there are none.
    """
    theta = theta_s / tick_s
    if not enough_days(mains, min_days):
        mains, bins = mains.limit(0), bins.limit(0)
    zoned = numbered(places)
    marked = segment_hours(peak_candidates(bins, theta, hours, q, min_persistence), hours).join(zoned.select("direction_id", "seg_key", "j", "zc"), ["direction_id", "seg_key"])
    steady = written(persistent_statistics(bins, places, theta, ref_hours, q, level, min_persistence, min_hour_share).drop("p_draws", "daily"))
    groups = written(joined_stretches(zoned_stretches(marked, gap), persistent_stretches(steady, bins, places, theta, hours, gap), gap))
    n_days = {r[0]: r[1] for r in mains.groupBy("direction_id").count().collect()}  # a number for each direction
    info = places.select("direction_id", "seg_key", "j", "len_m", "zone")
    inside = groups.withColumn("j", F.explode(F.sequence("j0", "j1"))).join(info, ["direction_id", "j"]).join(bins, ["direction_id", "seg_key"]).join(F.broadcast(persistent_levels(bins, places)), "direction_id")
    told = inside.groupBy("direction_id", "stretch").applyInArrow(_described(hours, theta, 1 - level, n_days), _STRETCH)
    # comparable segments: outside all stretches, of the same zone, within 500 m if there are five
    taken = groups.select("direction_id", F.explode(F.sequence("j0", "j1")).alias("j")).distinct()
    ff = bins.where(F.col("col").between(SCORE_HOURS[0], SCORE_HOURS[1] - 1)).join(info, ["direction_id", "seg_key"]).groupBy("direction_id", "j", "zone").agg(F.percentile(F.col("opp") / F.col("len_m"), F.lit(0.2)).alias("ff"))
    mid = places.select("direction_id", "j", (F.col("x0_m") + F.col("len_m") / 2).alias("mid"))
    free = ff.where("ff is not null").join(taken, ["direction_id", "j"], "left_anti").join(mid, ["direction_id", "j"])
    ends = groups.join(places.select("direction_id", F.col("j").alias("j0"), F.col("seg_idx").alias("from_seg"), F.col("x0_m").alias("from_m"), "zone", F.col("link_key").alias("link0"), "pattern_uid"), ["direction_id", "j0"])
    ends = ends.join(places.select("direction_id", F.col("j").alias("j1"), F.col("seg_idx").alias("to_seg"), (F.col("x0_m") + F.col("len_m")).alias("to_m"), F.col("link_key").alias("link1")), ["direction_id", "j1"])
    ends = ends.join(mid.select("direction_id", F.col("j").alias("j0"), F.col("mid").alias("mid0")), ["direction_id", "j0"]).join(mid.select("direction_id", F.col("j").alias("j1"), F.col("mid").alias("mid1")), ["direction_id", "j1"])
    pool = ends.select("direction_id", "stretch", "zone", ((F.col("mid0") + F.col("mid1")) / 2).alias("at")).join(free, ["direction_id", "zone"])
    near = F.abs(F.col("mid") - F.col("at")) <= 500
    base = pool.groupBy("direction_id", "stretch").agg(F.count(F.when(near, 1)).alias("n_near"), F.percentile(F.when(near, F.col("ff")), F.lit(0.5)).alias("b_near"), F.percentile("ff", F.lit(0.5)).alias("b_all"))
    base = base.select("direction_id", "stretch", F.when(F.col("n_near") >= 5, F.col("b_near")).otherwise(F.col("b_all")).alias("base"))
    names = links.groupBy("link_key").agg(F.min_by("from_stop", "pattern_uid").alias("from_stop"), F.min_by("to_stop", "pattern_uid").alias("to_stop"))
    out = ends.join(told, ["direction_id", "stretch"]).join(base, ["direction_id", "stretch"], "left")
    out = out.withColumn("fixed_score", F.when(F.col("base") > 0, F.col("f_num") / F.col("base")))
    out = out.join(names.select(F.col("link_key").alias("link0"), "from_stop"), "link0", "left").join(names.select(F.col("link_key").alias("link1"), "to_stop"), "link1", "left")
    rank = F.row_number().over(W.partitionBy("direction_id").orderBy(F.desc_nulls_last("excess_obs_per_day"), "j0"))
    return out.select(
        "direction_id", "pattern_uid", rank.alias("rank"), "from_seg", "to_seg", "from_m", "to_m", F.coalesce("from_stop", "link0").alias("from_stop"), F.coalesce("to_stop", "link1").alias("to_stop"), "zone", "criterion",
        hotspot_kind(F.col("criterion"), F.col("fixed_score"), F.col("peak_ratio")).alias("kind"),
        F.when(F.col("criterion") == "peak", F.col("peak_hours")).otherwise(F.array_sort(F.array_union("peak_hours", "persistent_hours"))).alias("hours"),
        "peak_hours", "peak_hour", F.col("value").alias("excess_per_passage"), (F.col("value") * tick_s).alias("excess_s_per_passage"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"), "persistence", "excess_obs_per_day",
        "fixed_score", "peak_ratio", F.col("peak_excess").alias("peak_excess_per_passage"), F.col("allday_excess").alias("allday_excess_per_passage"),
    )
