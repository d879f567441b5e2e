"""Operators on canonical tables; each takes DataFrames and returns a lazily planned DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def segment_grid(links: DataFrame, length: float, phase: float = 0.0) -> DataFrame:
    """Equal grid of each link (pattern_uid, link_idx, len_m): n = half-even len/L bins at least 1, shifted by the phase.

    Inner edges strictly inside the link; bins under 1 m join their neighbour
    (only the first and last bin of this grid can be that short).
    """
    n = F.greatest(F.lit(1), F.rint(F.col("len_m") / length).cast("int"))
    df = links.withColumn("step", F.col("len_m") / n).withColumn("n", n)
    df = df.withColumn("shift", F.lit(phase / length) * F.col("step") - F.floor(F.lit(phase / length)) * F.col("step"))
    inner = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.col("shift") + i * F.col("step"))
    inner = F.filter(inner, lambda x: (x >= 1) & (x <= F.col("len_m") - 1))
    df = df.withColumn("edges", F.concat(F.array(F.lit(0.0)), inner, F.array(F.col("len_m"))))
    df = df.select("pattern_uid", "link_idx", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("k", "lo"), "edges")
    seg = W.partitionBy("pattern_uid").orderBy("link_idx", "k")
    return df.select("pattern_uid", "link_idx", "k", "lo", F.element_at("edges", F.col("k") + 2).alias("hi"), (F.row_number().over(seg) - 1).alias("seg_idx"))


def assign(placed: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment of each position: bins are (lo, hi]; at or before 0 the vehicle stands at the end of the link before; beyond the end the last bin.

    A row of an unknown link or without a position has a null segment. The segments of a link become one row of arrays (a
    link has tens of bins), so the join is an equi-join without row explosion.
    """
    arrays = segments.groupBy("pattern_uid", "link_idx").agg(F.array_sort(F.collect_list(F.struct("hi", "seg_idx"))).alias("segs"))
    back = (F.col("pos_m") <= 0) & (F.col("link_idx") > 0)
    moved = placed.withColumn("at_link", F.when(back, F.col("link_idx") - 1).otherwise(F.col("link_idx"))).withColumn("at_pos", F.when(back, F.lit(1e18)).otherwise(F.col("pos_m")))
    segs = arrays.select("pattern_uid", F.col("link_idx").alias("at_link"), "segs")
    below = F.size(F.filter("segs", lambda s: s["hi"] < F.col("at_pos")))
    joined = moved.join(segs, ["pattern_uid", "at_link"], "left")
    place = F.when(F.col("pos_m").isNotNull(), F.element_at("segs", F.least(below, F.size("segs") - 1) + 1)["seg_idx"])
    return joined.withColumn("seg_idx", place).drop("segs", "at_pos")


def cube(placed: DataFrame, segments: DataFrame) -> DataFrame:
    """Counted positions for each service date, hour, pattern and segment."""
    counted = placed.where(F.coalesce("count", F.lit(True)))
    return assign(counted, segments).where("seg_idx is not null").groupBy("service_date", "hour", "pattern_uid", "seg_idx").agg(F.count(F.lit(1)).alias("obs"))


def link_totals(cube_: DataFrame, segments: DataFrame) -> DataFrame:
    return cube_.join(segments.select("pattern_uid", "seg_idx", "link_idx"), ["pattern_uid", "seg_idx"]).groupBy("pattern_uid", "link_idx").agg(F.sum("obs").alias("obs"))


def local_time(df: DataFrame, zone: str, start_s: int = 14400) -> DataFrame:
    """service_date, hour (0..27) and dow (Monday 0) of ``ts`` (UTC, without zone); the service day starts at start_s."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    df = df.withColumn("service_date", F.to_date(local - F.make_dt_interval(secs=F.lit(start_s))))
    seconds = F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(F.col("service_date").cast("timestamp"))
    return df.withColumn("hour", F.floor(seconds / 3600).cast("int")).withColumn("dow", F.weekday("service_date"))


def normalised_id(col: Column, rule: str = "leading_digits") -> Column:
    """Trimmed id; leading_digits keeps the digits after leading zeros, null without any."""
    text = F.trim(col)
    return text if rule == "none" else F.nullif(F.regexp_extract(text, r"^0*(\d+)" if rule == "leading_digits" else rule, 1), F.lit(""))


def runs(df: DataFrame, gap_s: float = 300.0, back_m: float = 100.0) -> DataFrame:
    """run number and running maximum of ``s_m`` along each track: a gap or a step back starts a new run."""
    w = W.partitionBy("track_id").orderBy("ts", "s_m")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lag(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).over(w)
    new = (F.lag("ts").over(w).isNull() | (gap > gap_s) | (F.lag("s_m").over(w) - F.col("s_m") > back_m)).cast("int")
    df = df.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("s_max", F.max("s_m").over(W.partitionBy("track_id", "run").orderBy("ts", "s_m").rowsBetween(W.unboundedPreceding, 0))).drop("new")


def thin(df: DataFrame, tick_s: int = 20) -> DataFrame:
    """The last fix of each track and tick; rows without a track stay, and do not meet in a window."""
    tick = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / tick_s)
    ranked = df.where("track_id is not null").withColumn("rn", F.row_number().over(W.partitionBy("track_id", tick).orderBy(F.desc("ts"), F.desc("s_m"))))
    return ranked.where("rn = 1").drop("rn").unionByName(df.where("track_id is null"))


def feed_lengths(df: DataFrame, min_rows: int = 20, q: float = 0.995, per_m: int | None = None) -> DataFrame:
    """Feed length of each link: the 99.5th percentile of its positions, null under min_rows rows.

    ``per_m`` counts positions rounded to 1/per_m metre first and interpolates on the counts, so that a link's buffer stays
    bounded by its length whatever the number of rows; feeds report whole metres, for which per_m = 1 is exact.
    """
    keys = ["pattern_uid", "link_idx"]
    if per_m is not None:
        df = df.where("pos_m is not null").groupBy(*keys, (F.round(F.col("pos_m") * per_m) / per_m).alias("pos_m")).agg(F.count(F.lit(1)).alias("rows"))
        return df.groupBy(*keys).agg(F.sum("rows").alias("n"), F.percentile("pos_m", F.lit(q), F.col("rows")).alias("q")).select(*keys, "n", F.when((F.col("n") >= min_rows) & (F.col("q") > 0), F.col("q")).alias("flen"))
    return df.groupBy(*keys).agg(F.count("pos_m").alias("n"), F.percentile("pos_m", F.lit(q)).alias("q")).select(*keys, "n", F.when((F.col("n") >= min_rows) & (F.col("q") > 0), F.col("q")).alias("flen"))


def estimate(cube_: DataFrame, passages: DataFrame, segments: DataFrame, ref_hours: tuple[int, int] = (20, 24)) -> DataFrame:
    """Ratio of sums for each pattern, segment and hour, with the evening reference, excess and log2 ratio."""
    obs = cube_.groupBy("pattern_uid", "seg_idx", "hour").agg(F.sum("obs").alias("obs"))
    pas = passages.groupBy("pattern_uid", "link_idx", "hour").agg(F.sum("n").alias("passages"))
    cells = segments.select("pattern_uid", "seg_idx", "link_idx").join(pas, ["pattern_uid", "link_idx"]).join(obs, ["pattern_uid", "seg_idx", "hour"], "left").fillna({"obs": 0})
    ref = F.col("hour").between(ref_hours[0], ref_hours[1] - 1)
    w = W.partitionBy("pattern_uid", "seg_idx")
    refs = F.try_divide(F.sum(F.when(ref, F.col("obs"))).over(w), F.sum(F.when(ref, F.col("passages"))).over(w))
    out = cells.withColumn("ref", refs).withColumn("opp", F.try_divide("obs", "passages"))
    return out.withColumn("excess", F.col("opp") - F.col("ref")).withColumn("ratio", F.log2((F.col("opp") + 0.5) / (F.col("ref") + 0.5)))


def benjamini_hochberg(df: DataFrame, q: float, group: str, *order: str) -> DataFrame:
    """reject: whether the row's ``p`` passes the Benjamini-Hochberg rule within its group; a null p never does."""
    tested = df.where("p is not null").withColumn("rk", F.row_number().over(W.partitionBy(group).orderBy("p", *order)))
    m = tested.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    top = tested.join(m, group).where(F.col("p") <= F.lit(q) * F.col("rk") / F.col("m")).groupBy(group).agg(F.max("rk").alias("top"))
    done = tested.join(top, group, "left").select(group, *order, "p", (F.col("rk") <= F.coalesce("top", F.lit(0))).alias("reject"))
    return done.unionByName(df.where("p is null").select(group, *order, "p", F.lit(False).alias("reject")))


def islands(df: DataFrame, group: str, position: str, gap: int = 1) -> DataFrame:
    """Stretches of positions: a new one where the step is over gap + 1."""
    w = W.partitionBy(group).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap + 1).cast("int"), F.lit(0))
    numbered = df.withColumn("new", new).withColumn("stretch", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(group, "stretch").agg(F.min(position).alias("j0"), F.max(position).alias("j1"), F.count(F.lit(1)).alias("n"))


def haversine_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance on a sphere of 6371008.8 m."""
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return F.lit(2 * 6371008.8) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def spearman(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Rank correlation within each group, ties at their mean rank, rows with a null left out; null under three rows or without spread."""
    def rank(c: str) -> Column:
        return F.rank().over(W.partitionBy(group).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(group, c)) - 1) / 2

    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.select(group, rank(x).alias("rx"), rank(y).alias("ry")).groupBy(group).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("rx", "ry")).alias("rho"), F.count(F.lit(1)).alias("n"))
