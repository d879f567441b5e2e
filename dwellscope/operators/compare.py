"""Two periods of a line: matched segments, changes with intervals, changed stretches, frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellscope.sources.store import written

from .analysis import BANDS
from .core import benjamini_hochberg
from .hotspots import ALLDAY_COL, PEAK_BANDS, _null, _quantiles, _schema, numbered, segment_hours, zoned_stretches
from .statistics import one_sided_p

#: A period of fewer days has no changed stretches.
MIN_DAYS = 5
#: Lengths of links that are the same way may differ by the larger of these (share, metres).
LENGTH_SHARE, LENGTH_M = 0.05, 20.0

_PAIRS = "direction_id int, link_b string, link_a string"


def _greedy(key, rows):
    """Each new link in order takes the first old link of its length and number of segments that is still free."""
    new = sorted({(r["at_b"], r["link_b"]) for r in rows.to_pylist()})
    taken, out = set(), []
    for _, link in new:
        for r in sorted((r for r in rows.to_pylist() if r["link_b"] == link), key=lambda r: r["at_a"]):
            if r["link_a"] not in taken:
                taken.add(r["link_a"])
                out.append((key[0].as_py(), link, r["link_a"]))
                break
    return pa.table({f.name: [o[i] for o in out] for i, f in enumerate(_schema(_PAIRS))}, schema=_schema(_PAIRS))


def stop_pair(link_key: Column) -> Column:
    return F.split_part(link_key, F.lit("~"), F.lit(1))


def aligned(new: DataFrame, old: DataFrame) -> DataFrame:
    """Shown segments of the new period with the old period's segment: by key, else, for links without any such segment, by
    the same pair of stops, a like length and as many segments, in order along the link.

    ``new`` are shown_places, ``old`` all segments of the old period's main patterns (direction_id, link_idx, link_key,
    seg_key, k, len_m).
    """
    keys = old.groupBy("direction_id", "seg_key").agg(F.min("link_key").alias("old_link"))
    by_key = new.join(keys.select("direction_id", "seg_key", F.col("seg_key").alias("same")), ["direction_id", "seg_key"], "left")
    b = by_key.groupBy("direction_id", "link_key").agg(F.min("j").alias("at_b"), F.count(F.lit(1)).alias("n"), F.sum("len_m").alias("l"), F.count("same").alias("known")).where("known = 0")
    used = new.join(keys.select("direction_id", "seg_key", "old_link"), ["direction_id", "seg_key"]).select("direction_id", F.col("old_link").alias("link_key")).distinct()
    segs = old.groupBy("direction_id", "link_key", "seg_key").agg(F.min("len_m").alias("len_m"), F.min("link_idx").alias("link_idx"))
    a = segs.groupBy("direction_id", "link_key").agg(F.min("link_idx").alias("at_a"), F.count(F.lit(1)).alias("n"), F.sum("len_m").alias("l")).join(used, ["direction_id", "link_key"], "left_anti")
    both = b.select("direction_id", stop_pair(F.col("link_key")).alias("pair"), F.col("link_key").alias("link_b"), "at_b", "n", F.col("l").alias("l_b"))
    both = both.join(a.select("direction_id", stop_pair(F.col("link_key")).alias("pair"), F.col("link_key").alias("link_a"), "at_a", "n", F.col("l").alias("l_a")), ["direction_id", "pair", "n"])
    fits = both.where(F.abs(F.col("l_a") - F.col("l_b")) <= F.greatest(LENGTH_SHARE * F.greatest("l_a", "l_b"), F.lit(LENGTH_M)))
    pairs = fits.select("direction_id", "pair", "link_b", "link_a", "at_b", "at_a").groupBy("direction_id", "pair").applyInArrow(_greedy, _PAIRS)  # the links between two stops
    in_b = W.partitionBy("direction_id", "link_key").orderBy("j")
    in_a = W.partitionBy("direction_id", "link_key").orderBy("k", "seg_key")
    places = by_key.withColumn("nth", F.row_number().over(in_b)).join(pairs.withColumnRenamed("link_b", "link_key"), ["direction_id", "link_key"], "left")
    order = old.groupBy("direction_id", "link_key", "seg_key").agg(F.min("k").alias("k")).withColumn("nth", F.row_number().over(in_a))
    order = order.select("direction_id", F.col("link_key").alias("link_a"), "nth", F.col("seg_key").alias("paired"))
    out = places.join(order, ["direction_id", "link_a", "nth"], "left").withColumn("seg_key_a", F.coalesce("same", "paired"))
    how = F.when(F.col("same").isNotNull(), "seg_key").when(F.col("paired").isNotNull(), "stop_pair")
    return out.withColumn("match", how).drop("same", "paired", "link_a", "nth")


def unmatched(match: DataFrame, old_shown: DataFrame) -> DataFrame:
    """Segments without a partner: of the new period's shown pattern, and of the old one's."""
    b = match.where("seg_key_a is null").select("direction_id", F.lit("b").alias("period"), "seg_key", "link_key")
    known = match.where("seg_key_a is not null").select("direction_id", F.col("seg_key_a").alias("seg_key"))
    return b.unionByName(old_shown.join(known, ["direction_id", "seg_key"], "left_anti").select("direction_id", F.lit("a").alias("period"), "seg_key", "link_key"))


def per_hour(est: DataFrame) -> DataFrame:
    """direction_id, seg_key, col, per_h: passages a cell; of a band, over its hours."""
    hourly = est.where("col >= 0")
    codes = [F.when((F.col("col") >= a) & (F.col("col") < z), F.lit(code)) for code, a, z in BANDS.values()]
    rows = hourly.withColumn("c", F.explode(F.filter(F.array(F.col("col"), *codes), lambda x: x.isNotNull())))
    sums = rows.groupBy("direction_id", "seg_key", F.col("c").alias("col")).agg(F.sum("passages").alias("p"), F.sum("n_cells").alias("n"))
    return sums.select("direction_id", "seg_key", "col", F.when(F.col("n") > 0, F.col("p") / F.col("n")).alias("per_h"))


_CHANGED = "lo double, hi double, se double"


def changes(match: DataFrame, bins_a: DataFrame, bins_b: DataFrame, freq_a: DataFrame, freq_b: DataFrame, theta: float = 0.0, hours: tuple[int, int] = (5, 24), q: float = 0.1, level: float = 0.95) -> DataFrame:
    """Change of each matched segment and column from A to B with the interval of independent draws paired by number, and whether it is sure.

    ``bins_*`` are bin_statistics of the periods, drawn with different seeds.
    """
    codes = [BANDS[b][0] for b in PEAK_BANDS]
    shown = F.col("col").isin(*codes) | ((F.col("col") >= hours[0]) & (F.col("col") < hours[1]))
    names = ["opp", "ref", "x"]
    a = bins_a.where(shown).select("direction_id", F.col("seg_key").alias("seg_key_a"), "col", *[F.col(c).alias(f"{c}_a") for c in names], F.col("opp_draws").alias("draws_a"))
    b = bins_b.where(shown).select("direction_id", "seg_key", "col", *[F.col(c).alias(f"{c}_b") for c in names], F.col("opp_draws").alias("draws_b"))
    fa = freq_a.select("direction_id", F.col("seg_key").alias("seg_key_a"), "col", F.col("per_h").alias("per_h_a"))
    fb = freq_b.select("direction_id", "seg_key", "col", F.col("per_h").alias("per_h_b"))
    both = match.drop("lo", "hi", "se").join(b, ["direction_id", "seg_key"]).join(a, ["direction_id", "seg_key_a", "col"], "left").join(fa, ["direction_id", "seg_key_a", "col"], "left").join(fb, ["direction_id", "seg_key", "col"], "left")
    both = both.withColumn("delta", F.col("opp_b") - F.col("opp_a")).withColumn("draws", F.zip_with("draws_b", "draws_a", lambda y, x: y - x)).drop("draws_a", "draws_b")
    schema = both.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " + _CHANGED

    def ends(batches):
        for batch in batches:
            found = [_quantiles(np.array([np.nan] if d is None else [np.nan if v is None else v for v in d], float), 1 - level) for d in batch.column("draws").to_pylist()]
            cols = [pa.array([_null(f[i]) for f in found], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lo", "hi", "se"])

    out = both.mapInArrow(ends, ddl).withColumn("p", F.when(F.col("delta").isNotNull(), one_sided_p(F.abs("delta"), theta, F.col("se"))))
    passed = benjamini_hochberg(out.select("direction_id", "seg_key", "col", "p"), q, "direction_id", "seg_key", "col").drop("p")
    sure = F.coalesce(F.col("reject") & ((F.col("lo") > theta) | (F.col("hi") < -theta)), F.lit(False))
    out = out.join(passed, ["direction_id", "seg_key", "col"]).withColumn("significant", sure)
    return out.withColumn("sign", F.when(F.col("significant"), F.signum("delta").cast("int")).otherwise(0)).withColumn("freq_change", F.try_divide("per_h_b", "per_h_a") - 1)


def frequency_change(bins: DataFrame) -> DataFrame:
    """Median passages an hour over the matched segments in both periods, for each direction and column, and their relative change."""
    med = bins.groupBy("direction_id", "col").agg(F.percentile("per_h_a", F.lit(0.5)).alias("per_h_a"), F.percentile("per_h_b", F.lit(0.5)).alias("per_h_b"))
    return med.withColumn("freq_change", F.when(F.col("per_h_a") > 0, F.col("per_h_b") / F.col("per_h_a") - 1))


_STRETCH = (
    "direction_id int, sign int, stretch int, peak_hour int, delta double, lo double, hi double, obs_a double, obs_b double, excess_a double, excess_b double, veh_time_s_per_day double, veh_time_s_per_day_all double, per_h_a double, per_h_b double"
)


def _told(tick_s: float, alpha: float):
    schema = _schema(_STRETCH)

    def run(key, table):
        rows = table.to_pylist()
        sign, chosen = key[1].as_py(), rows[0]["hours"]
        by: dict[int, list[dict]] = {}
        for r in rows:
            by.setdefault(r["col"], []).append(r)
        num = lambda c, name: [np.nan if r[name] is None else r[name] for r in by[c]]
        total = lambda c, name: float(np.nansum(num(c, name)))
        hours = [h for h in chosen if h in by]
        peak = max(hours, key=lambda h: (sign * total(h, "delta"), -h))
        draws = np.array([[np.nan if v is None else v for v in r["draws"]] for r in by[peak] if r["draws"] is not None], float)
        lo, hi, _ = _quantiles(np.nansum(draws, 0), alpha) if len(draws) else (np.nan,) * 3
        time = lambda cols: float(sum(np.nansum(np.array(num(c, "delta")) * np.array(num(c, "per_h_b"))) for c in cols)) * tick_s
        seen = [[v for h in hours for v in num(h, n) if np.isfinite(v)] for n in ("per_h_a", "per_h_b")]
        values = (
            key[0].as_py(), sign, key[2].as_py(), peak, total(peak, "delta"), _null(lo), _null(hi), total(peak, "opp_a"), total(peak, "opp_b"), total(peak, "x_a"), total(peak, "x_b"),
            time(hours), time([c for c in by if c >= 0]), *[float(np.mean(s)) if s else None for s in seen],
        )
        return pa.table({f.name: [v] for f, v in zip(schema, values, strict=True)}, schema=schema)

    return run


def changed_stretches(bins: DataFrame, days_a: DataFrame, days_b: DataFrame, tick_s: float = 20.0, theta_s: float = 2.0, hours: tuple[int, int] = (5, 24), level: float = 0.95, gap: int = 1, freq_tol: float = 0.2) -> DataFrame:
    """Stretches of sure changes of one sign whose whole change is beyond theta, ranked by vehicle time a day.

    ``bins`` are changes() over shown places with ``zc`` (numbered); read several times: write them first. ``days_*`` are
    the main patterns of the periods' days; a direction with too few days has no stretch.
    """
    n = lambda d, name: d.groupBy("direction_id").agg(F.count_distinct("service_date").alias(name))
    days = n(days_a, "n_days_a").join(n(days_b, "n_days_b"), "direction_id").where((F.col("n_days_a") >= MIN_DAYS) & (F.col("n_days_b") >= MIN_DAYS))
    found = None
    for sign in (1, -1):
        marked = segment_hours(bins.withColumn("candidate", F.col("sign") == sign), hours).join(bins.select("direction_id", "seg_key", "j", "zc").distinct(), ["direction_id", "seg_key"])
        one = zoned_stretches(marked, gap).withColumn("sign", F.lit(sign))
        found = one if found is None else found.unionByName(one)
    found = written(found)
    inside = found.select("direction_id", "sign", "stretch", "j0", "j1", "hours", F.explode(F.sequence("j0", "j1")).alias("j")).join(bins.drop("sign", "zc", "hours"), ["direction_id", "j"])
    inside = inside.select("direction_id", "sign", "stretch", "hours", "col", "delta", "draws", "opp_a", "opp_b", "x_a", "x_b", "per_h_a", "per_h_b")
    told = inside.groupBy("direction_id", "sign", "stretch").applyInArrow(_told(tick_s, 1 - level), _STRETCH)
    theta = theta_s / tick_s
    kept = told.where(((F.col("sign") > 0) & (F.col("lo") > theta)) | ((F.col("sign") < 0) & (F.col("hi") < -theta)))
    at = bins.select("direction_id", "j", "seg_idx", "x0_m", "len_m", "zone").distinct()
    ends = found.join(at.select("direction_id", F.col("j").alias("j0"), F.col("seg_idx").alias("from_seg"), F.col("x0_m").alias("from_m"), "zone"), ["direction_id", "j0"])
    ends = ends.join(at.select("direction_id", F.col("j").alias("j1"), F.col("seg_idx").alias("to_seg"), (F.col("x0_m") + F.col("len_m")).alias("to_m")), ["direction_id", "j1"])
    out = kept.join(ends.drop("zc", "j0", "j1"), ["direction_id", "sign", "stretch"]).join(F.broadcast(days), "direction_id")  # a row for each direction
    change = F.try_divide("per_h_b", "per_h_a") - 1
    rank = F.row_number().over(W.partitionBy("direction_id").orderBy(F.desc(F.abs("veh_time_s_per_day")), "from_seg"))
    return out.withColumn("freq_change", change).withColumn("frequency_changed", F.coalesce(F.abs("freq_change") > freq_tol, F.lit(False))).withColumn("delta_s", F.col("delta") * tick_s).withColumn("rank", rank).drop("stretch")


def pooled_hours(bins: DataFrame, hours: tuple[int, int]) -> DataFrame:
    """An hour range of both periods: means of passages weighted over the hours that both know."""
    known = bins.where((F.col("col") >= hours[0]) & (F.col("col") < hours[1])).where("opp_a is not null and opp_b is not null and per_h_a > 0 and per_h_b > 0")
    mean = lambda v, w: F.sum(F.col(v) * F.col(w)) / F.sum(w)
    return known.groupBy("direction_id", "seg_key").agg(F.count(F.lit(1)).alias("n_hours"), mean("opp_a", "per_h_a").alias("opp_a"), mean("opp_b", "per_h_b").alias("opp_b")).withColumn("delta", F.col("opp_b") - F.col("opp_a"))


def strata_allowed(mains: DataFrame) -> bool:
    """Weekday strata only where every weekday has two days: a single day would never vary."""
    row = mains.select("service_date").distinct().groupBy(F.weekday("service_date").alias("dow")).count().agg(F.min("count")).first()
    return bool(row[0] and row[0] >= 2)


__all__ = ["ALLDAY_COL", "aligned", "changed_stretches", "changes", "frequency_change", "numbered", "per_hour", "pooled_hours", "strata_allowed", "unmatched"]
