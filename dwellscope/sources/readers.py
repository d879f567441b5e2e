"""Finding and reading input files: tables, flattened and binary vehicle positions, polls, stop events, schedule feeds."""

from __future__ import annotations

import datetime as dt
import glob
import gzip
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellscope.config import Config, seconds_of
from dwellscope.operators.core import local_time, normalised_id

from .store import shared_root
from .tables import OBSERVATION, SNAPSHOT, STOP_EVENT, compact_observations, compact_snapshots, conform, instant, observations, punctuality, raw_snapshots

# Endings of normalised column names for each field, the most specific first.
FIELDS = {
    "ts": ("vehicle.timestamp", "position.timestamp", "timestamp", "ts", "time", "datetime", "fix.time"),
    "lat": ("position.latitude", "latitude", "lat"),
    "lon": ("position.longitude", "longitude", "lon", "lng", "long"),
    "bearing": ("position.bearing", "bearing", "heading"),
    "trip_id": ("trip.trip.id", "trip.id"),
    "route_id": ("trip.route.id", "route.id", "route"),
    "direction_id": ("trip.direction.id", "direction.id", "direction"),
    "vehicle_id": ("vehicle.vehicle.id", "vehicle.id", "vehicle.label", "vehicle"),
}


def expanded(paths: str | list[str]) -> list[str]:
    """Files of glob patterns (** too), folders (all files below that are not hidden) and plain paths; paths with a scheme stay."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        if "://" in p:
            out.append(p)
        elif any(c in p for c in "*?["):
            out += sorted(glob.glob(p, recursive=True))
        elif os.path.isdir(p) and not p.rstrip("/").endswith((".parquet", ".pq")):
            out += sorted(os.path.join(d, f) for d, _, files in os.walk(p) for f in files if not f.startswith("."))
        else:
            out.append(p)
    return out


def format_of(path: str, given: str = "auto") -> str:
    name = path.lower()
    if given != "auto":
        return given
    if name.rstrip("/").endswith((".parquet", ".pq")):
        return "parquet"
    if name.endswith((".json", ".json.gz")):
        return "stib_json"
    return "gtfsrt_pb" if name.endswith((".pb", ".pbf", ".pb.gz")) else "csv"


def _wider(a: str, b: str) -> str:
    """The type that holds values of both."""
    order = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
    if a == b:
        return a
    if a in order and b in order and "boolean" not in (a, b):
        return "double" if {a, b} & {"float", "double"} else order[max(order.index(a), order.index(b))]
    return "string"


def scanned(spark: SparkSession, files: list[str], given: str = "auto") -> DataFrame:
    """Parquet and CSV files as one table, by column names; a column of different types gets the type that holds them."""
    if not files:
        raise FileNotFoundError("no input files")
    parts = []
    for kind in ("parquet", "csv"):
        mine = [f for f in files if format_of(f, given) == kind]
        if kind == "csv":
            parts += [spark.read.options(header=True, inferSchema=True, preferDate=False, timestampFormat="'none'", timestampNTZFormat="'none'").csv(f) for f in mine]
        else:
            parts += [spark.read.parquet(f) for f in mine]
    unknown = [f for f in files if format_of(f, given) not in ("parquet", "csv")]
    if unknown:
        raise ValueError(f"no tables: {', '.join(unknown[:3])}")
    kinds: dict[str, str] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds[name] = _wider(kinds.get(name, kind), kind)
    out = None
    for p in parts:
        own = dict(p.dtypes)
        one = p.select(*[(F.col(f"`{n}`") if own[n] == k else F.col(f"`{n}`").cast(k)).alias(n) if n in own else F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
        out = one if out is None else out.unionByName(one)
    return out


def normalised_name(name: str) -> str:
    """camelCase and punctuation as dots, small letters."""
    return re.sub("[^a-z0-9]+", ".", re.sub("(?<=[a-z0-9])(?=[A-Z])", ".", name).lower()).strip(".")


def detected_columns(names: list[str]) -> dict[str, str]:
    """Column of each field: the first ending that fits a free column, of several the shortest; columns of the header do not count."""
    short = {n: normalised_name(n) for n in names}
    free = [n for n in names if not short[n].startswith("header.")]
    out: dict[str, str] = {}
    for name, endings in FIELDS.items():
        for e in endings:
            fits = [n for n in free if short[n] == e or short[n].endswith("." + e)]
            if fits:
                out[name] = min(fits, key=lambda n: len(short[n]))
                free.remove(out[name])
                break
    return out


def guessed_unit(df: DataFrame, column: str) -> str:
    """s, ms or us from the largest value; iso for text that is no number."""
    c = F.col(f"`{column}`")
    kind = dict(df.dtypes)[column]
    if kind == "string":
        row = df.agg(F.max(c.try_cast("double")).alias("m"), F.min(F.when(c.isNotNull(), c.rlike(r"^\s*\d+(\.\d+)?\s*$"))).alias("numbers")).first()
        if row["numbers"] is False:
            return "iso"
        top = row["m"]
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        top = df.agg(F.max(c)).first()[0]
    else:
        return "s"
    return "s" if top is None or top <= 1e11 else "ms" if top <= 1e14 else "us"


def flat_positions(spark: SparkSession, files: list[str], route: str | None = None, zone: str = "UTC", columns: dict[str, str] | None = None, unit: str | None = None) -> DataFrame:
    """Flattened vehicle positions as OBSERVATION; columns are found by their names, times' unit by their size."""
    df = scanned(spark, files)
    cols = detected_columns(df.columns) | (columns or {})
    if "ts" not in cols:
        raise ValueError("no time column found")
    unit = unit or guessed_unit(df, cols["ts"])
    return observations(df, cols, "s" if unit == "iso" else unit, zone, "none", route)


# ---- binary feeds: the published wire format, by field number


def _wire(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value


def parsed_positions(data: bytes) -> list[dict]:
    """Vehicles with a position of one feed message; time from the header and id from label or entity where the vehicle has none."""
    message = list(_wire(data))
    stamp = next((v for f, _, h in message if f == 1 for k, _, v in _wire(h) if k == 3), None)
    out = []
    for f, _, entity in message:
        if f != 2:
            continue
        parts = {k: v for k, _, v in _wire(entity)}
        if 4 not in parts:
            continue
        vehicle = {k: v for k, _, v in _wire(parts[4])}
        if 2 not in vehicle:
            continue
        trip = {k: v for k, _, v in _wire(vehicle.get(1, b""))}
        place = {k: struct.unpack("<f", v)[0] for k, t, v in _wire(vehicle[2]) if t == 5}
        who = {k: v for k, _, v in _wire(vehicle.get(8, b""))}
        text = lambda v: v.decode() if v is not None else None
        when = vehicle.get(5) or stamp
        out.append({
            "ts": dt.datetime.fromtimestamp(when, dt.timezone.utc) if when else None, "route_id": text(trip.get(5)), "vehicle_id": text(who.get(1) or who.get(2) or parts.get(1)), "trip_id": text(trip.get(1)),
            "direction_id": trip.get(6), "lat": place.get(1), "lon": place.get(2), "bearing": place.get(3),
        })
    return out


def message_bytes(stamp: int, vehicles: list[dict]) -> bytes:
    """A feed message, for tests: vehicles with id, lat, lon and maybe ts, route_id, trip_id, direction_id, bearing, label."""

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def put(no: int, value) -> bytes:
        if isinstance(value, float):
            return number(no << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return number(no << 3) + number(value)
        raw = value.encode() if isinstance(value, str) else value
        return number(no << 3 | 2) + number(len(raw)) + raw

    def each(v: dict, pairs) -> bytes:
        return b"".join(put(no, v[k]) for no, k in pairs if v.get(k) is not None)

    out = put(1, put(1, "2.0") + put(3, stamp))
    for i, v in enumerate(vehicles):
        body = put(1, each(v, ((1, "trip_id"), (5, "route_id"), (6, "direction_id")))) + put(2, each(v, ((1, "lat"), (2, "lon"), (3, "bearing")))) + each(v, ((5, "ts"),)) + put(8, each(v, ((1, "id"), (2, "label"))))
        out += put(2, put(1, f"e{i}") + put(4, body))
    return out


_FIX = pa.schema([("ts", pa.timestamp("us", "UTC")), ("route_id", pa.string()), ("vehicle_id", pa.string()), ("trip_id", pa.string()), ("direction_id", pa.int8()), ("lat", pa.float64()), ("lon", pa.float64()), ("bearing", pa.float32())])


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = parsed_positions(gzip.decompress(data) if path.endswith(".gz") else data)
            yield pa.RecordBatch.from_pylist(rows, schema=_FIX)


def binary_positions(spark: SparkSession, files: list[str], route: str | None = None) -> DataFrame:
    """Feed messages as OBSERVATION; a vehicle that stands in several messages with one time and place counts once."""
    raw = spark.read.format("binaryFile").load(files).select("path", "content")
    rows = raw.mapInArrow(_messages, "ts timestamp, route_id string, vehicle_id string, trip_id string, direction_id tinyint, lat double, lon double, bearing float")
    if route is not None:
        rows = rows.where(F.col("route_id") == route)
    return conform(rows.dropDuplicates(["ts", "vehicle_id", "lat", "lon"]), OBSERVATION, ("ts", "route_id"))


def split_compact(files: list[str]) -> tuple[list[str], list[str]]:
    """(row files, poll files) of a compact feed, told apart by .snaps. in their names."""
    polls = [f for f in files if ".snaps." in os.path.basename(f.rstrip("/"))]
    return [f for f in files if f not in polls], polls


def day_bounds(first: dt.date, last: dt.date, zone: str, start_s: int) -> tuple[dt.datetime, dt.datetime]:
    """UTC instants [from, to) of the service days first to last."""
    at = lambda d: (dt.datetime.combine(d, dt.time(), ZoneInfo(zone)) + dt.timedelta(seconds=start_s)).astimezone(dt.timezone.utc)
    return at(first), at(last + dt.timedelta(days=1))


def within_dates(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows of the service days of the selection; the limits reach the scan."""
    span = cfg.select.date_range()
    if span is None:
        return df
    a, z = day_bounds(*span, cfg.input.timezone, seconds_of(cfg.input.service_day_start))
    return df.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(z)))


def read_observations(spark: SparkSession, cfg: Config) -> DataFrame:
    """OBSERVATION of the settings' files: compact rows, raw polls, binary or flattened positions, or any mapped table."""
    files = [f for f in expanded(cfg.input.paths)]
    if not files:
        raise FileNotFoundError(f"no files match {cfg.input.paths}")
    inp, route = cfg.input, cfg.select.route
    kinds = {format_of(f, inp.format) for f in files}
    rule = inp.linear.id_normaliser
    if kinds == {"stib_json"}:
        df = raw_snapshots(spark, files, route, rule)[0]
    elif kinds == {"gtfsrt_pb"}:
        df = binary_positions(spark, files, route)
    elif inp.kind == "stib" and kinds == {"parquet"} and not inp.columns:
        df = compact_observations(scanned(spark, split_compact(files)[0]), route, rule=rule)
    elif kinds <= {"csv", "parquet"}:
        table = scanned(spark, split_compact(files)[0], inp.format)
        cols = dict(inp.columns) or (detected_columns(table.columns) if inp.kind == "latlon" else {})
        df = observations(table, cols, "s" if inp.ts_unit == "iso" else inp.ts_unit, inp.timezone, rule, route)
    else:
        raise ValueError(f"input files of several formats: {', '.join(sorted(kinds))}")
    return within_dates(df, cfg)


def read_snapshots(spark: SparkSession, cfg: Config) -> DataFrame | None:
    """SNAPSHOT from the settings' table, the polls of raw files, poll files beside the rows, or None."""
    inp = cfg.input
    if inp.snapshots:
        df = scanned(spark, expanded(inp.snapshots))
        if "frozen" not in df.columns:
            df = df.withColumn("frozen", F.col("same").cast("boolean") if "same" in df.columns else F.lit(False))
        return conform(df.withColumn("ts", instant(df, "ts", "s" if inp.ts_unit == "iso" else inp.ts_unit, inp.timezone)), SNAPSHOT).select("ts", "n_rows", "frozen")
    files = expanded(inp.paths)
    if files and {format_of(f, inp.format) for f in files} == {"stib_json"}:
        return raw_snapshots(spark, files, cfg.select.route, inp.linear.id_normaliser)[1]
    polls = split_compact(files)[1]
    return compact_snapshots(scanned(spark, polls)) if polls else None


def stop_events(df: DataFrame, columns: dict[str, str] | None = None, unit: str = "s", zone: str = "UTC", start_s: int = 14400, rule: str = "none", route: str | None = None) -> DataFrame:
    """Any table of stop events as STOP_EVENT. Without service_date that of the trip's first event, without stop_sequence the order of times, without observed all are."""
    names = {own: canonical for canonical, own in (columns or {}).items() if own in df.columns and own != canonical}
    df = df.drop(*[c for c in names.values() if c in df.columns and c not in names]).withColumnsRenamed(names)
    if "trip_key" not in df.columns:
        if "trip_id" not in df.columns:
            raise ValueError("stop events need trip_key or trip_id")
        df = df.withColumn("trip_key", F.col("trip_id").cast("string"))
    known = [c for c in ("arrival", "departure") if c in df.columns]
    if not known:
        raise ValueError("stop events need arrival or departure")
    for c in ("arrival", "departure"):
        df = df.withColumn(c, instant(df, c, unit, zone) if c in known else F.lit(None).cast("timestamp"))
    t = F.coalesce("departure", "arrival")
    if "service_date" not in df.columns:
        first = df.withColumn("ts", F.min(t).over(W.partitionBy("trip_key")).cast("timestamp_ntz"))
        df = local_time(first, zone, start_s).drop("ts", "hour", "dow")
    elif dict(df.dtypes)["service_date"] != "date":
        df = df.withColumn("service_date", F.to_date(F.try_to_timestamp(F.replace(F.col("service_date").cast("string"), F.lit("-"), F.lit("")), F.lit("yyyyMMdd"))))
    if "stop_sequence" not in df.columns:
        df = df.withColumn("__t", t)
        order = F.row_number().over(W.partitionBy("trip_key", F.col("__t").isNull()).orderBy("__t", "stop_id"))
        df = df.withColumn("stop_sequence", F.when(F.col("__t").isNotNull(), order)).drop("__t")
    if "observed" not in df.columns:
        df = df.withColumn("observed", F.lit(True))
    df = df.withColumn("stop_id", normalised_id(F.col("stop_id").cast("string"), rule))
    if "route_id" in df.columns:
        df = df.withColumn("route_id", F.col("route_id").cast("string"))
        df = df if route is None else df.where(F.col("route_id") == route)
    elif route is not None:
        df = df.withColumn("route_id", F.lit(route))
    return conform(df, STOP_EVENT).select(*[c.split()[0] for c in STOP_EVENT.split(", ")])


def read_events(spark: SparkSession, cfg: Config) -> DataFrame | None:
    """Stop events of the settings, of either layout."""
    if not cfg.input.events:
        return None
    df = scanned(spark, expanded(cfg.input.events))
    rule, route = cfg.input.linear.id_normaliser, cfg.select.route
    if {"start_date", "journey_id", "arrival_time"} <= set(df.columns):
        return punctuality(df, route, rule)
    return stop_events(df, None, "s", cfg.input.timezone, seconds_of(cfg.input.service_day_start), rule, route)


# ---- schedule feeds


class FeedReader:
    """Tables of a feed in a folder of text or Parquet files, or a zip of either."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if self.path.endswith(".zip"):
            self.path = self._unpacked(self.path)

    def _unpacked(self, path: str) -> str:
        """Zip members in the shared folder, where all executors see them."""
        root = shared_root(self.spark)
        target = f"{root}/feed-{abs(hash((path, os.path.getmtime(path) if os.path.exists(path) else 0)))}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(target).getFileSystem(self.spark._jsc.hadoopConfiguration())
        data = self.spark.read.format("binaryFile").load(path).first()["content"]
        import io

        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            for name in z.namelist():
                if name.endswith("/"):
                    continue
                out = fs.create(hadoop(f"{target}/{os.path.basename(name)}"), True)
                try:
                    out.write(z.read(name))
                finally:
                    out.close()
        return target

    def scan(self, name: str) -> DataFrame | None:
        for ending in ("txt", "parquet"):
            try:
                if ending == "parquet":
                    return self.spark.read.parquet(f"{self.path}/{name}.parquet")
                return self.spark.read.csv(f"{self.path}/{name}.txt", header=True)
            except Exception as e:  # Spark names a missing path in its error class
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return None


def load_feed(spark: SparkSession, path: str, route: str | None, route_key: str = "route_short_name") -> dict[str, DataFrame]:
    """A feed's tables cut down to one route by semi-joins, with shapes and calendars."""
    reader = FeedReader(spark, path)
    out = {n: reader.scan(n) for n in ("routes", "trips", "stop_times", "stops", "shapes", "calendar", "calendar_dates")}
    if route is not None:
        key = route_key if route_key in out["routes"].columns else "route_id"
        out["routes"] = out["routes"].where(F.col(key).cast("string") == str(route))
    semi = lambda name, other, key: out[name].join(out[other].select(key).distinct(), key, "left_semi")
    out["trips"] = semi("trips", "routes", "route_id")
    wanted = [c for c in ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time") if c in out["stop_times"].columns]
    out["stop_times"] = out["stop_times"].select(*wanted)
    out["stop_times"] = semi("stop_times", "trips", "trip_id")
    out["stops"] = semi("stops", "stop_times", "stop_id")
    if out["shapes"] is not None and "shape_id" in out["trips"].columns:
        out["shapes"] = semi("shapes", "trips", "shape_id")
    for n in ("calendar", "calendar_dates"):
        if out[n] is not None:
            out[n] = semi(n, "trips", "service_id")
    return out


def feed_index(spark: SparkSession, path: str, feeds_dir: str | None = None) -> dict[dt.date, str]:
    """Valid from which date which feed: a table with service_date and path, or sha in a path template."""
    df = scanned(spark, [path])
    template = feeds_dir or os.path.join(os.path.dirname(path), "feeds", "{sha}")
    out = {}
    for r in df.where("service_date is not null").collect():  # a row a date
        row = r.asDict()
        found = row.get("path") or (template.format(sha=row["sha"]) if row.get("sha") else None)
        if found:
            day = row["service_date"]
            out[dt.date.fromisoformat(str(day)[:10])] = str(found)
    return out


class FeedSource:
    """One feed, a feed a date by a path template, or feeds by their first date. Loaded feeds are remembered, the last few."""

    def __init__(self, spark: SparkSession, path: str | None = None, dated: str | None = None, feeds: dict[dt.date, str] | None = None, route_key: str = "route_short_name", max_back: int = 14, keep: int = 8):
        if sum(x is not None for x in (path, dated, feeds)) != 1:
            raise ValueError("give one of path, dated and feeds")
        self.spark, self.path, self.dated, self.feeds, self.route_key, self.max_back, self.keep = spark, path, dated, feeds, route_key, max_back, keep
        self._loaded: dict[tuple, dict[str, DataFrame]] = {}

    @classmethod
    def of(cls, spark: SparkSession, cfg: Config) -> FeedSource:
        g = cfg.gtfs
        if g.index:
            return cls(spark, feeds=feed_index(spark, g.index, g.feeds_dir), route_key=g.route_key)
        return cls(spark, dated=g.dated, route_key=g.route_key) if g.dated else cls(spark, g.path, route_key=g.route_key)

    def path_on(self, day: dt.date) -> str | None:
        """The feed valid on a date: with a template the latest at most max_back days before."""
        if self.path is not None:
            return self.path
        if self.feeds is not None:
            known = [d for d in self.feeds if d <= day]
            return self.feeds[max(known)] if known else None
        for back in range(self.max_back + 1):
            d = day - dt.timedelta(days=back)
            p = self.dated.format(date=d.isoformat(), yyyymmdd=d.strftime("%Y%m%d"))
            if os.path.exists(p):
                return p
        return None

    def by_feed(self, days: list[dt.date]) -> dict[str, list[dt.date]]:
        out: dict[str, list[dt.date]] = {}
        for d in sorted(days):
            if (p := self.path_on(d)) is not None:
                out.setdefault(p, []).append(d)
        return out

    def load(self, path: str, route: str | None) -> dict[str, DataFrame]:
        key = (path, route)
        if key in self._loaded:
            self._loaded[key] = self._loaded.pop(key)
        else:
            self._loaded[key] = load_feed(self.spark, path, route, self.route_key)
            while len(self._loaded) > self.keep:
                self._loaded.pop(next(iter(self._loaded)))
        return self._loaded[key]
