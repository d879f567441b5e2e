"""Readers of canonical tables; the session's time zone is UTC.

Each function takes DataFrames or paths that any of Spark's readers can open and plans lazily; filters and columns reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dwellscope.operators.core import normalised_id

# Canonical schemas.
OBSERVATION = (
    "ts timestamp, route_id string, vehicle_id string, trip_id string, direction_id tinyint, terminus_id string, stop_id string, "
    "dist_m float, lat double, lon double, bearing float"
)
SNAPSHOT = "ts timestamp, n_rows bigint, frozen boolean"
STOP_EVENT = "service_date date, route_id string, trip_key string, stop_id string, stop_sequence int, arrival timestamp, departure timestamp, observed boolean"
MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def conform(df: DataFrame, ddl: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The schema's columns first, cast (null where a value does not fit) or added as nulls; other columns stay behind them."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = StructType.fromDDL(ddl)
    known = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*known, *[F.col(f"`{c}`") for c in df.columns if c not in schema.names])


def instant(df: DataFrame, name: str, unit: str = "s", zone: str = "UTC") -> Column:
    """UTC timestamp of a column of numbers (of ``unit``), text (numbers, ISO with an offset, ISO in ``zone``), dates or timestamps.

    Of a local time that occurs twice the earlier counts; one that does not occur is null.
    """
    def local(c: Column) -> Column:
        utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), c)
        return F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) == c, utc).cast("timestamp")

    c, kind = F.col(f"`{name}`"), df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return c
    if kind in ("timestamp_ntz", "date"):
        return local(c.cast("timestamp_ntz"))
    number = F.timestamp_micros(F.round(c.try_cast("double") * MICROS[unit]).cast("long"))
    if kind != "string":
        return number
    text = F.trim(c)
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), number).when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp")).otherwise(local(text.try_cast("timestamp_ntz")))


def observations(df: DataFrame, columns: dict[str, str] | None = None, unit: str = "s", zone: str = "UTC", rule: str = "leading_digits", route: str | None = None) -> DataFrame:
    """Any table of fixes as OBSERVATION. ``columns`` maps canonical to own names; a canonical column in the way of a mapped one goes.

    ``route`` filters route_id, or fills it where the table has none.
    """
    names = {own: canonical for canonical, own in (columns or {}).items() if own in df.columns and own != canonical}
    df = df.drop(*[c for c in names.values() if c in df.columns and c not in names]).withColumnsRenamed(names)
    if "ts" not in df.columns:
        raise ValueError("no time column: map ts")
    if "route_id" not in df.columns:
        if route is None:
            raise ValueError("no route_id column: map it or give a route")
        df = df.withColumn("route_id", F.lit(route))
    elif route is not None:
        df = df.where(F.col("route_id").cast("string") == route)
    df = df.withColumn("ts", instant(df, "ts", unit, zone))
    for c in ("stop_id", "terminus_id"):
        if c in df.columns:
            df = df.withColumn(c, normalised_id(F.col(c).cast("string"), rule))
    return conform(df, OBSERVATION, ("ts", "route_id"))


def compact_observations(df: DataFrame, route: str | None = None, unit: str = "s", rule: str = "leading_digits") -> DataFrame:
    """Compact rows (ts, [line], dir, point, dist) as OBSERVATION."""
    if "line" not in df.columns and route is None:
        raise ValueError("no line column: give a route")
    kept = df.select([c for c in ("ts", "line", "dir", "point", "dist") if c in df.columns])
    return observations(kept, {"route_id": "line", "terminus_id": "dir", "stop_id": "point", "dist_m": "dist"}, unit, rule=rule, route=route)


def compact_snapshots(df: DataFrame, unit: str = "s") -> DataFrame:
    """Compact polls (ts, same or frozen, [n_rows]) as SNAPSHOT, of each ts the first row."""
    frozen = F.coalesce(*[F.col(c).cast("boolean") for c in ("frozen", "same") if c in df.columns], F.lit(False))
    n_rows = F.col("n_rows").cast("long") if "n_rows" in df.columns else F.lit(None).cast("long")
    rows = df.select(instant(df, "ts", unit).alias("ts"), n_rows.alias("n_rows"), frozen.alias("frozen"), F.monotonically_increasing_id().alias("__row"))
    return rows.groupBy("ts").agg(F.min_by(F.struct("n_rows", "frozen"), "__row").alias("r")).select("ts", "r.n_rows", "r.frozen")


def punctuality(df: DataFrame, route: str | None = None, rule: str = "leading_digits", only_observed: bool = False) -> DataFrame:
    """Rows of journeys and planned stops (start_date as yyyyMMdd) as STOP_EVENT."""
    if route is not None:
        df = df.where(F.col("route_id").cast("string") == route)
    if only_observed:
        df = df.where("observed")
    journey = F.coalesce(F.col("journey_id").cast("string"), F.lit("")) if "journey_id" in df.columns else F.lit("")
    out = df.select(
        F.to_date(F.try_to_timestamp(F.col("start_date").cast("string"), F.lit("yyyyMMdd"))).alias("service_date"),
        "route_id",
        F.concat_ws(":", journey, F.col("trip_id").cast("string")).alias("trip_key"),
        normalised_id(F.col("stop_id").cast("string"), rule).alias("stop_id"),
        "stop_sequence",
        instant(df, "arrival_time").alias("arrival"),
        instant(df, "departure_time").alias("departure"),
        (F.col("observed") if "observed" in df.columns else F.lit(True)).alias("observed"),
    )
    return conform(out, STOP_EVENT)


def raw_snapshots(spark: SparkSession, paths: list[str], route: str | None = None, rule: str = "leading_digits") -> tuple[DataFrame, DataFrame]:
    """(OBSERVATION, SNAPSHOT) of JSON files named by their time (2025-03-03T07-00-00Z.json, .gz too).

    A file holds a list of positions, or one under data or results. A file equal to the one before is frozen and gives no positions.
    Only times and digests are ordered: within days, each with the last digest of the day before.
    """
    item = "array<struct<lineId:string,directionId:string,pointId:string,distanceFromPoint:double>>"
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    stamp = F.regexp_extract("name", r"(\d{4}-\d\d-\d\dT\d\d-\d\d-\d\dZ)", 1)
    files = files.withColumn("ts", F.to_timestamp(F.regexp_replace(stamp, r"T(\d\d)-(\d\d)-(\d\d)Z", "T$1:$2:$3Z"))).withColumn("sha", F.sha1("value")).withColumn("day", F.to_date("ts"))
    held = F.from_json("value", f"data {item}, results {item}")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.coalesce(held["data"], held["results"]))
    polls = files.select("ts", "day", "sha", F.coalesce(F.size(rows), F.lit(0)).alias("n_rows"))
    carried = polls.groupBy("day").agg(F.max_by("sha", "ts").alias("last")).withColumn("before", F.lag("last").over(W.orderBy("day"))).drop("last")  # one row a day
    polls = polls.join(carried, "day").withColumn("frozen", F.coalesce(F.coalesce(F.lag("sha").over(W.partitionBy("day").orderBy("ts")), F.col("before")) == F.col("sha"), F.lit(False)))
    live = files.join(polls.where("not frozen").select("ts"), "ts").select("ts", F.explode(rows).alias("r"))
    flat = live.select("ts", F.col("r.lineId").alias("line"), F.col("r.directionId").alias("dir"), F.col("r.pointId").alias("point"), F.col("r.distanceFromPoint").alias("dist"))
    return compact_observations(flat, route, rule=rule) if route is not None else compact_observations(flat, rule=rule), conform(polls.select("ts", "n_rows", "frozen"), SNAPSHOT)


def route_feed(spark: SparkSession, folder: str, route: str) -> dict[str, DataFrame]:
    """Tables of a schedule feed (text or Parquet files in a folder) cut down to one route by semi-joins."""
    def read(name: str, text: bool) -> DataFrame:
        return spark.read.csv(f"{folder}/{name}.txt", header=True) if text else spark.read.parquet(f"{folder}/{name}.parquet")

    text = True
    try:
        routes = read("routes", True)
    except Exception as e:  # Spark names a missing path in its error class
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text, routes = False, read("routes", False)
    out = {"routes": routes.where((F.col("route_short_name") == route) | (F.col("route_id") == route))}
    out["trips"] = read("trips", text).join(out["routes"].select("route_id"), "route_id", "left_semi")
    out["stop_times"] = read("stop_times", text).select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), "arrival_time", "departure_time").join(out["trips"].select("trip_id"), "trip_id", "left_semi")
    out["stops"] = read("stops", text).join(out["stop_times"].select("stop_id"), "stop_id", "left_semi")
    return out


def stop_sequences(feed: dict[str, DataFrame]) -> DataFrame:
    """Patterns of a feed: stop_ids (repeats in a row once), trips and the most frequent shape, the smallest of equally many."""
    stops = F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda s: s["stop_id"])
    trips = feed["stop_times"].groupBy("trip_id").agg(stops.alias("all"))  # a trip has tens of stops
    trips = trips.withColumn("stop_ids", F.filter("all", lambda s, i: (i == 0) | (s != F.get("all", i - 1)))).drop("all")
    shape = F.col("shape_id") if "shape_id" in feed["trips"].columns else F.lit(None).cast("string").alias("shape_id")
    joined = trips.join(feed["trips"].select("trip_id", "direction_id", shape), "trip_id")
    counted = joined.groupBy("direction_id", "stop_ids", "shape_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("shape_id", F.struct(-F.when(F.col("shape_id").isNotNull(), F.col("n")).otherwise(0), "shape_id"))
    return counted.groupBy("direction_id", "stop_ids").agg(F.sum("n").alias("n_trips"), best.alias("shape_id"))
