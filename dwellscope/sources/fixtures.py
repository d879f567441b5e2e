"""Canonical tables derived from the star-schema tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellscope.operators.core import cube, segment_grid

#: Length in metres of the five links of every pattern.
LINKS = (200.0, 310.0, 340.0, 250.0, 300.0)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(
        F.to_date("o_orderdate").alias("service_date"),
        (F.col("l_orderkey") % 24).cast("int").alias("hour"),
        F.col("o_orderstatus").alias("pattern_uid"),
        ((F.col("l_linenumber") - 1) % 5).cast("int").alias("link_idx"),
        (F.col("l_quantity") * 6.1).alias("pos_m"),
        F.col("l_orderkey").alias("track_id"),
        (F.col("l_linenumber") != 7).alias("count"),
    )


def links(spark: SparkSession) -> DataFrame:
    rows = [(p, i, x) for p in ("F", "O", "P") for i, x in enumerate(LINKS)]
    return spark.createDataFrame(rows, "pattern_uid string, link_idx int, len_m double")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).groupBy("service_date", "hour", "pattern_uid", "link_idx").agg(F.count_distinct("track_id").alias("n"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "ts", F.col("event_type").alias("route_id"), F.col("user_id").alias("track_id"), F.col("value").alias("s_m"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", (F.col("event_id") % 7 < 2).alias("frozen"))


#: Patterns of the small line: direction, links (key, from, to, metres). A1 runs another way between c and d.
LINE = {
    "A0": (0, (("ab", "a", "b", 200.0), ("bc", "b", "c", 310.0), ("c>d~1", "c", "d", 340.0), ("de", "d", "e", 250.0), ("ef", "e", "f", 300.0))),
    "A1": (0, (("ab", "a", "b", 200.0), ("bc", "b", "c", 310.0), ("c>d~2", "c", "d", 344.0), ("de", "d", "e", 250.0), ("ef", "e", "f", 300.0))),
    "B0": (1, (("fe", "f", "e", 300.0), ("ed", "e", "d", 250.0), ("dc", "d", "c", 340.0), ("cb", "c", "b", 310.0), ("ba", "b", "a", 200.0))),
}
#: Days of the small line, and the first on which A1 runs in place of A0.
N_DAYS, CHANGE = 56, 40


def line_links(spark: SparkSession) -> DataFrame:
    rows = []
    for uid, (direction, links_) in LINE.items():
        at = 0.0
        for i, (key, a, b, m) in enumerate(links_):
            rows.append((uid, direction, i, key, a, b, at, m))
            at += m
    return spark.createDataFrame(rows, "pattern_uid string, direction_id int, link_idx int, link_key string, from_stop string, to_stop string, s0_m double, len_m double")


def line_segments(spark: SparkSession, length: float = 30.0) -> DataFrame:
    links_ = line_links(spark)
    grid = segment_grid(links_, length).join(links_.select("pattern_uid", "link_idx", "link_key", "s0_m", F.col("len_m").alias("link_m")), ["pattern_uid", "link_idx"])
    zone = F.when((F.col("lo") == 0) | (F.col("hi") == F.col("link_m")), "stop").otherwise("running")
    return grid.select(
        "pattern_uid", "seg_idx", "link_idx", "link_key", F.concat_ws("/", "link_key", F.col("k").cast("string")).alias("seg_key"), "k", F.col("lo").alias("offset_m"),
        (F.col("s0_m") + F.col("lo")).alias("x0_m"), (F.col("hi") - F.col("lo")).alias("len_m"), zone.alias("zone"), "lo", "hi",
    )


def _date(index) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), index.cast("int"))


def line_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a position on the small line."""
    day, direction = F.col("l_orderkey") % N_DAYS, (F.col("l_suppkey") % 2).cast("int")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        _date(day).alias("service_date"), (4 + F.col("l_partkey") % 24).cast("int").alias("hour"), direction.alias("direction_id"),
        F.when(direction == 1, "B0").when(day < CHANGE, "A0").otherwise("A1").alias("pattern_uid"),
        ((F.col("l_linenumber") - 1) % 5).cast("int").alias("link_idx"), (F.col("l_quantity") * 6.1).alias("pos_m"), F.col("l_orderkey").alias("track_id"),
    )


def line_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed_ = line_placed(spark, sf_dir).withColumn("count", F.lit(True))
    segments = line_segments(spark)
    return cube(placed_, segments).join(segments.select("pattern_uid", "seg_idx", "seg_key"), ["pattern_uid", "seg_idx"])


def line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = line_placed(spark, sf_dir).join(line_links(spark).select("pattern_uid", "link_idx", "link_key"), ["pattern_uid", "link_idx"])
    return keyed.groupBy("service_date", "hour", "link_key").agg(F.count_distinct("track_id").alias("n"))


def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    by = o.groupBy(_date(F.col("o_orderkey") % N_DAYS).alias("service_date"), (4 + F.col("o_custkey") % 24).cast("int").alias("hour"))
    return by.agg((1 - F.max("o_orderkey") % 7 / 10).alias("coverage"), F.when(F.min("o_orderkey") % 11 == 0, 2).otherwise(0).alias("flags"))


def line_pattern_days(spark: SparkSession) -> DataFrame:
    """Every day all three patterns run; A0 is the main one of direction 0 up to the change."""
    days = spark.range(N_DAYS).select(F.col("id").alias("i"), _date(F.col("id")).alias("service_date"))
    pats = F.array(*[F.struct(F.lit(u).alias("pattern_uid"), F.lit(d).alias("direction_id")) for u, (d, _) in LINE.items()])
    main = F.when(F.col("pattern_uid") == "B0", F.lit(True)).when(F.col("i") < CHANGE, F.col("pattern_uid") == "A0").otherwise(F.col("pattern_uid") == "A1")
    return days.select("i", "service_date", F.inline(pats)).select("service_date", "direction_id", "pattern_uid", F.when(main, 10).otherwise(2).alias("n_trips"), main.alias("is_main"))


#: Patterns of a street: direction, kind, trips a day, stops, metres of the links.
STREET = {
    "M": (0, "main", 20, "abcdef", (200.0, 310.0, 340.0, 250.0, 300.0)),
    "R": (1, "main", 20, "fedcba", (300.0, 250.0, 340.0, 310.0, 200.0)),
    "D": (0, "detour", 3, "acgf", (520.0, 400.0, 260.0)),
    "E": (0, "other", 2, "cgf", (400.0, 260.0)),
    "S": (0, "short", 4, "bcd", (310.0, 340.0)),
}


def street(spark: SparkSession) -> dict[str, DataFrame]:
    """patterns, pattern_days, links and stops of the street; h is another platform of the stop f."""
    pats = [(u, d, list(s), [x.upper() for x in s]) for u, (d, _, _, s, _) in STREET.items()]
    roles = F.array(*[F.struct(F.lit(u).alias("pattern_uid"), F.lit(d).alias("direction_id"), F.lit(k).alias("kind"), F.lit(n).alias("n_trips"), F.lit(k == "main").alias("is_main")) for u, (d, k, n, _, _) in STREET.items()])
    rows = [(u, i, f"{s[i]}>{s[i + 1]}", s[i], s[i + 1], float(sum(m[:i])), m[i]) for u, (_, _, _, s, m) in STREET.items() for i in range(len(m))]
    days = spark.range(N_DAYS - 6).select(_date(F.col("id")).alias("service_date"))
    return {
        "patterns": spark.createDataFrame(pats, "pattern_uid string, direction_id int, stop_ids array<string>, stop_names array<string>"),
        "pattern_days": days.select("service_date", F.inline(roles)),
        "links": spark.createDataFrame(rows, "pattern_uid string, link_idx int, link_key string, from_stop string, to_stop string, s0_m double, len_m double"),
        "stops": spark.createDataFrame([(x, x.upper()) for x in "abcdefg"] + [("h", "F")], "stop_id string, stop_name string"),
    }


def street_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a vehicle's report of the last stop passed, metres since and terminus code (z9 is no stop)."""
    pick = lambda c, values: F.try_element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), _date(F.col("l_orderkey") % N_DAYS).alias("service_date"),
        pick(F.col("l_partkey") % 8, ("a", "b", "c", "d", "e", "f", "g", None)).alias("stop_id"),
        pick(F.col("l_suppkey") % 7, ("f", "a", "h", "z9", None, "d", "c")).alias("terminus_id"),
        F.when(F.col("l_suppkey") % 7 == 4, (F.col("l_suppkey") % 2).cast("int")).alias("direction_id"), F.floor(F.col("l_quantity") * 6.1).cast("double").alias("dist_m"),
    )


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as fixes along a pattern: ts, service_date, pattern_uid, track_id, s_m, pos_m, flags, count, row_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.timestamp_seconds(F.lit(1704096000) + F.col("event_id") % 400 * 20).alias("ts"), _date(F.col("user_id") % 5).alias("service_date"), F.when(F.col("user_id") % 2 == 0, "M").otherwise("R").alias("pattern_uid"),
        F.col("user_id").cast("string").alias("track_id"), (F.col("event_id") % 400 * 3.5 + F.floor("value") / 128).alias("s_m"), F.lit(5.0).alias("pos_m"), F.when(F.col("event_id") % 9 == 0, 8192).otherwise(0).alias("flags"), F.lit(True).alias("count"), F.col("event_id").alias("row_id"),
    )
