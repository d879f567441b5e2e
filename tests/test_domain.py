"""Exact small cases of health, rules, readers, geometry, network, tracker, views and streams."""

import datetime as dt
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellscope.config import seconds_of
from dwellscope.functions import sql
from dwellscope.operators import analysis as an
from dwellscope.operators import geometry as geo
from dwellscope.operators import health, network, placement, tracker, views
from dwellscope.operators import hotspots as hs
from dwellscope.sources import readers, sinks
from dwellscope.streaming import live

T0 = int(dt.datetime(2025, 3, 3, 6, tzinfo=dt.timezone.utc).timestamp())  # 07:00 in Brussels


def polls(spark, times, frozen=()):
    return spark.createDataFrame([(dt.datetime.fromtimestamp(t, dt.timezone.utc).replace(tzinfo=None), t in frozen) for t in times], "ts timestamp, frozen boolean")


def hours(df):
    return {r["hour"]: r for r in df.collect() if r["n_snapshots"] or r["covered_s"] or r["frozen_s"] or r["flags"] & 2}


def test_coverage_outage_split_and_stall(spark):
    # Facts about the coverage rule.
    hour = T0 + 3600
    times = [t for t in range(T0, T0 + 3 * 3600, 20) if not hour + 600 <= t < hour + 1800]
    got = hours(health.feed_coverage(polls(spark, times)))
    assert got[8]["covered_s"] == pytest.approx(3600 - 1180) and got[8]["flags"] == 1 and got[7]["flags"] == 0
    late = hours(health.feed_coverage(polls(spark, [hour + 3590, hour + 3620])))
    assert late[8]["covered_s"] == pytest.approx(10) and late[9]["covered_s"] == pytest.approx(40)
    edge = hour + 2 * 3600
    span = list(range(edge - 400, edge + 400, 20))
    still = {t for t in span if edge - 200 <= t < edge + 200}
    got = health.feed_coverage(polls(spark, span, still), min_coverage=0.0)
    assert {r["hour"] for r in got.collect() if r["flags"] & 2} == {9, 10}
    short = {t for t in span if edge - 100 <= t < edge + 100}
    assert not any(r["flags"] & 2 for r in health.feed_coverage(polls(spark, span, short), min_coverage=0.0).collect())
    assert health.feed_coverage(polls(spark, [T0])).count() == 24


def test_day_rule_reasons(spark):
    day = [dt.date(2025, 3, d) for d in (3, 4, 5, 6)]
    rows = []
    for d in day:
        for h in range(4, 28):
            low, frozen = d == day[0] and 6 <= h < 14, d == day[1] and 6 <= h < 18
            rows.append((d, h, 0.5 if low else 1.0, 2 if frozen else 0))
    cov = spark.createDataFrame(rows, "service_date date, hour int, coverage double, flags int")
    days = an.selected_days(cov)
    status = an.day_status(an.hour_status(days, cov), ("2025-03-05",))
    assert {r["service_date"]: r["reason"] for r in status.collect()} == dict(zip(day, ["low_coverage", "frozen", "excluded", None], strict=True))
    assert [r[0] for r in spark.range(1).select(an.flag_names(F.lit(513))).collect()] == [["LOW_COVERAGE", "LAYOVER"]]


def test_readers(spark, tmp_path):
    assert readers.normalised_name("vehicle.tripId") == "vehicle.trip.id"
    names = ["header.timestamp", "vehicle.timestamp", "vehicle.position.latitude", "vehicle.position.longitude", "vehicle.vehicle.id", "vehicle.trip.routeId", "vehicle.trip.tripId"]
    found = readers.detected_columns(names)
    assert found["ts"] == "vehicle.timestamp" and found["vehicle_id"] == "vehicle.vehicle.id" and found["route_id"] == "vehicle.trip.routeId" and found["trip_id"] == "vehicle.trip.tripId"
    for top, unit in ((1.7e9, "s"), (1.7e12, "ms"), (1.7e15, "us")):
        assert readers.guessed_unit(spark.createDataFrame([(int(top),)], "t long"), "t") == unit
    assert readers.guessed_unit(spark.createDataFrame([("2025-03-03T07:00:00",)], "t string"), "t") == "iso"
    vehicles = [{"id": "7", "lat": 50.5, "lon": 4.25, "route_id": "S1", "trip_id": "t", "direction_id": 1, "ts": T0, "bearing": 90.0}, {"label": "L", "lat": 50.0, "lon": 4.0, "route_id": "S1"}]
    raw = readers.message_bytes(T0 + 5, vehicles)
    (tmp_path / "a.pb").write_bytes(raw)
    (tmp_path / "b.pb.gz").write_bytes(gzip.compress(raw))
    got = sorted((r["vehicle_id"], r["lat"], r["direction_id"], r["ts"].timestamp() - T0) for r in readers.binary_positions(spark, [str(tmp_path / "a.pb"), str(tmp_path / "b.pb.gz")], "S1").collect())
    assert [g[:3] for g in got] == [("7", 50.5, 1), ("L", 50.0, None)] and got[1][3] - got[0][3] == 5
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("run,stop,arr,dep\nr1,0626,2025-03-04T00:50:00,\nr1,5272F,,2025-03-04T01:05:00\n")
    (tmp_path / "x" / ".hidden").write_text("")
    files = readers.expanded(str(tmp_path / "x"))
    assert len(files) == 1 and [readers.format_of(p) for p in ("a.PQ", "a.json.gz", "a.pbf", "a.txt")] == ["parquet", "stib_json", "gtfsrt_pb", "csv"]
    ev = readers.stop_events(readers.scanned(spark, files), {"trip_key": "run", "stop_id": "stop", "arrival": "arr", "departure": "dep"}, "s", "Europe/Brussels", rule="leading_digits").orderBy("stop_sequence").collect()
    assert [(r["service_date"].day, r["stop_id"], r["stop_sequence"], r["observed"]) for r in ev] == [(3, "626", 1, True), (3, "5272", 2, True)]
    spark.createDataFrame([(1, 2.5)], "a int, b double").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "u.csv").write_text("a,c\n9000000000,z\n")
    both = readers.scanned(spark, [str(tmp_path / "t.parquet"), str(tmp_path / "u.csv")])
    assert dict(both.dtypes) == {"a": "bigint", "b": "double", "c": "string"} and both.count() == 2
    a, z = readers.day_bounds(dt.date(2025, 3, 29), dt.date(2025, 3, 30), "Europe/Brussels", seconds_of("04:00"))
    assert (a.hour, z.hour) == (3, 2)
    assert readers.split_compact(["1.parquet", "1.snaps.parquet"]) == (["1.parquet"], ["1.snaps.parquet"])


def test_feed_source_and_index(spark, tmp_path):
    for day in ("2025-01-01", "2025-01-11"):
        (tmp_path / day).mkdir()
    source = readers.FeedSource(spark, dated=str(tmp_path / "{date}"))
    assert source.path_on(dt.date(2025, 1, 10)).endswith("2025-01-01") and source.path_on(dt.date(2025, 1, 26)) is None
    by = readers.FeedSource(spark, feeds={dt.date(2025, 1, 1): "a", dt.date(2025, 1, 11): "b"})
    assert [by.path_on(dt.date(2025, 1, d)) for d in (1, 10, 11)] == ["a", "a", "b"] and by.path_on(dt.date(2024, 12, 31)) is None
    (tmp_path / "index.csv").write_text("service_date,sha\n2025-01-01,abc\n")
    assert readers.feed_index(spark, str(tmp_path / "index.csv")) == {dt.date(2025, 1, 1): str(tmp_path / "feeds" / "abc")}


def test_geometry():
    shape = np.array([[4.35, 50.85 + k / 1000] for k in range(11)])
    cum = geo.cumulative(shape)
    assert cum[-1] == pytest.approx(1112, abs=1)
    place, off = geo.stops_along([[4.35005, 50.8501], [4.35, 50.853], [4.35, 50.859]], shape)
    assert place == pytest.approx([11.1, 333.6, 1000.8], abs=0.3) and off[0] < 5
    loop = np.concatenate([shape, shape[::-1][1:]])
    there, _ = geo.stops_along([[4.35, 50.852], [4.35, 50.858], [4.35, 50.852]], loop)
    assert there[0] < there[1] < there[2] and there[2] == pytest.approx(cum[-1] + 889.6, abs=2)
    lines, lengths, served = geo.slices([[4.35, 50.85], [4.35, 50.86]], None)
    assert not served and lengths[0] == pytest.approx(cum[-1]) and len(lines[0]) == 2
    assert not geo.slices([[4.36, 50.85], [4.36, 50.86]], shape)[2]  # 700 m off
    assert geo.hausdorff_m(shape, shape + [0.0001, 0]) == pytest.approx(7.02, abs=0.05)
    reg = geo.KeyRegistry()
    key = reg.key_for("a", "b", shape)
    assert reg.key_for("a", "b", shape + [0.0001, 0]) == key and reg.key_for("a", "b", shape + [0.001, 0]) != key and key.startswith("a>b~") and len(reg.rows) == 2
    counts = np.concatenate([np.full(10, 5.0), np.full(6, 60.0), np.full(14, 5.0)])
    cuts = geo.optimal_breaks(counts, [0.0, 300.0])
    assert 100.0 in cuts and 160.0 in cuts and geo.optimal_breaks(counts, [0.0, 15.0, 300.0])[1] == 15.0
    assert geo.cut(shape, 100, 300)[0][1] == pytest.approx(50.85 + 100 / 111194.9, abs=1e-6) and len(geo.distinct([[1, 1], [1, 1], [2, 2]])) == 2
    plane = geo.Plane(shape)
    assert plane.lonlat(plane.xy(shape)) == pytest.approx(shape)


def test_network_tables(spark):
    d = [dt.date(2025, 1, k) for k in range(1, 7)]
    pats = spark.createDataFrame([("M", "r", list("ABCDEF")), ("S", "r", list("CDE")), ("D", "r", list("ACDEF")), ("X", "r", list("XYZ"))], "pattern_uid string, route_id string, stop_ids array<string>")
    rows = [(f"{p}{i}", "all", 0, p) for p, n in (("M", 20), ("S", 4), ("D", 2), ("X", 1)) for i in range(n)]
    trips = spark.createDataFrame(rows, "trip_id string, service_id string, direction_id int, pattern_uid string")
    on = spark.createDataFrame([(x, "all") for x in d], "day date, service_id string")
    days = network.pattern_days(trips, pats, on)
    first = {r["pattern_uid"]: (r["kind"], r["parent_offset"], r["n_trips"], r["is_main"]) for r in days.where(F.col("service_date") == d[0]).collect()}
    # Facts about kinds.
    assert first == {"M": ("main", None, 20, True), "S": ("short", 2, 4, False), "D": ("detour", None, 2, False), "X": ("other", None, 1, False)}
    assert {r["pattern_uid"]: (r["kind"], r["parent_uid"]) for r in network.pattern_kinds(days).collect()} == {"M": ("main", None), "S": ("short", "M"), "D": ("detour", "M"), "X": ("other", None)}
    links = spark.createDataFrame([(p, i, f"{p if p == 'N' and i == 1 else ''}k{i}") for p in "MN" for i in range(3)], "pattern_uid string, link_idx int, link_key string")
    mains = spark.createDataFrame([(x, 0, "N" if i in (2, 3) else "M", True, 5, "main", "r") for i, x in enumerate(d)], "service_date date, direction_id int, pattern_uid string, is_main boolean, n_trips int, kind string, route_id string")
    runs = [(r["version"], r["pattern_uid"], r["n_days"], r["display"], r["links_added"], r["links_removed"]) for r in network.network_versions(mains, links).orderBy("version").collect()]
    assert runs == [(0, "M", 2, True, [], []), (1, "N", 2, False, ["Nk1"], ["k1"]), (2, "M", 2, True, [], [])]
    assert network.display_pattern(mains, links).first()["pattern_uid"] == "M" and network.link_days(mains, links).count() == 18
    wanted = spark.createDataFrame([(dt.date(2025, 1, 8),), (d[0],)], "service_date date")
    assert [tuple(r) for r in network.calendar_proxy(wanted, mains).collect()] == [(dt.date(2025, 1, 8), d[0])]
    feeds = spark.createDataFrame([(d[0], "a"), (d[3], "b")], "valid_from date, path string")
    assert sorted(tuple(r) for r in network.feeds_on(wanted, feeds, 4).collect()) == [(d[0], "a"), (dt.date(2025, 1, 8), "b")]
    cal = spark.createDataFrame([("s", "1", "0", "0", "0", "0", "0", "1", "20250101", "20250131")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string")
    table = network.calendar_table(cal)
    assert table.first()["days"] == [0, 6]
    exc = network.exception_table(spark.createDataFrame([("s", "20250203", "1")], "service_id string, date string, exception_type string"))
    assert tuple(network.service_span(table, exc).first()) == (dt.date(2025, 1, 1), dt.date(2025, 2, 3))


def test_tracker_rules():
    t = tracker.Tracker(1000.0)
    t.poll(0, [(0, 500.0, float("-inf"), True), (1, 100.0, float("-inf"), True)])
    t.poll(20, [(2, 600.0, float("-inf"), True), (3, 150.0, float("-inf"), True)])
    assert [x.rows for x in t.all] == [[0, 2], [1, 3]]
    t.poll(40, [(4, 150.0, float("-inf"), True)])  # the first is not seen
    t.poll(400, [(5, 700.0, float("-inf"), True)])  # too late for it
    assert [x.rows for x in t.all] == [[0, 2], [1, 3, 4], [5]]
    assert tracker.Tracker(100.0).standing([0], [0], [False]) == set()
    still = tracker.Tracker(1000.0)
    for k in range(7):
        still.poll(20.0 * k, [(k, 300.0, float("-inf"), True)])
    assert still.standing([20.0 * k for k in range(7)], [300.0] * 7, [True] * 7) == set(range(7))


def test_track_anonymous_follows_vehicles(spark):
    rows = [(k * 100 + v, "P", dt.date(2025, 3, 3), dt.datetime(2025, 3, 3, 8, 0, 0) + dt.timedelta(seconds=20 * k), v * 400.0 + k * 120.0, 10.0, 0, True) for k in range(12) for v in range(3)]
    placed = spark.createDataFrame(rows, "row_id long, pattern_uid string, service_date date, ts timestamp, s_m double, pos_m double, flags int, count boolean")
    got = tracker.track_anonymous(placed).withColumn("v", F.col("row_id") % 100)
    assert got.groupBy("v").agg(F.count_distinct("track_id").alias("n")).where("n <> 1").count() == 0 and got.select("track_id").distinct().count() == 3
    lines = tracker.line_crossings(got)
    assert lines.where("line = 100").count() == 3  # 1005 m: passed by all


def test_approach_and_links(spark):
    # Facts about the approach rule.
    links = spark.createDataFrame([("P", 0, 300.0), ("P", 1, 200.0), ("P", 2, 30.0)], "pattern_uid string, link_idx int, len_m double")
    rows = [("P", 0, 150.0, 150.0, 0), ("P", 0, 300.0, 300.0, 8192), ("P", 0, 300.0, 300.0, 0), ("P", 1, 100.0, 400.0, 0), ("P", 2, 20.0, 520.0, 0)]
    placed = spark.createDataFrame(rows, "pattern_uid string, link_idx int, pos_m double, s_m double, flags int")
    assert sorted(round(r["pos_m"], 6) for r in placement.approached(placed, links, 36.0).collect()) == [20.0, 82.0, 132.0, 264.0, 300.0]


def test_stretches(spark):
    places = spark.createDataFrame([(0, j, f"s{j}", "stop" if j == 5 else "running") for j in range(10)], "direction_id int, j int, seg_key string, zone string")
    zoned = hs.numbered(places)
    marked = zoned.where("j in (1, 2, 4, 6, 8)").withColumn("hours", F.array(F.col("j")))
    got = [(r["j0"], r["j1"], r["hours"]) for r in hs.zoned_stretches(marked).orderBy("j0").collect()]
    assert got == [(1, 4, [1, 2, 4]), (6, 8, [6, 8])]
    kind = "case when false then 1 end"
    row = spark.range(1).select(*[hs.hotspot_kind(F.lit(c), F.lit(f), F.lit(r)).alias(n) for n, c, f, r in (("a", "peak", 2.0, 1.0), ("b", "peak", 1.0, 3.0), ("c", "persistent", 1.0, 1.0), ("d", "both", 1.0, 1.0))], F.expr(kind)).first()
    assert tuple(row)[:4] == ("infrastructure", "congestion", "infrastructure", "mixed")


def test_views(spark):
    names = ["GARE DU NORD", "SAINTE-MARIE", "LEOPOLD III", "Gare du Nord", "DE L'EAU", "AVENUE DE L'EAU"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(views.title_name(F.col("n")))
    # Facts about names.
    assert [r[0] for r in df.collect()] == ["Gare du Nord", "Sainte-Marie", "Leopold III", "Gare du Nord", "De L'Eau", "Avenue de L'Eau"]
    assert [r[0] for r in spark.createDataFrame([("0a1b2c",), ("red",), (None,)], "c string").select(views.colour(F.col("c"))).collect()] == ["0A1B2C", None, None]
    out = views.export_rounded(spark.createDataFrame([(float("nan"), dt.date(2025, 1, 2), 1.23456)], "a double, b date, c double"), {"c": 1}).first()
    assert tuple(out) == (None, "2025-01-02", 1.2)
    assert sinks.script_json({"a": "</script>&"}) == '{"a":"\\u003c/script\\u003e\\u0026"}' and sinks.page({"line": "@DOC@"}).count("@DOC@") == 3


def test_geojson(spark):
    segs = spark.createDataFrame([("P", i, [[4.0 + i, 50.0], [5.0 + i, 50.0]]) for i in range(4)], "pattern_uid string, seg_idx int, geometry array<array<double>>")
    rows = spark.createDataFrame([("P", 1, 2, 1), ("Q", 0, 1, 2)], "pattern_uid string, from_seg int, to_seg int, rank int")
    got = {f["properties"]["rank"]: f["geometry"] for f in sinks.geojson(rows, segs)["features"]}
    assert got[1]["coordinates"] == [[5.0, 50.0], [6.0, 50.0], [7.0, 50.0]] and got[2] is None


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "service_hour" in names
    row = spark.sql("SELECT service_date(timestamp_ntz'2025-03-18 00:30:00', 'Europe/Brussels') AS d, service_hour(timestamp_ntz'2025-03-18 00:30:00', 'Europe/Brussels') AS h, norm_id(' 0626F') AS i, round(haversine_m(50D, 4D, 50D, 5D)) AS m, has_flag(513, 512) AS f, kmh(1D, 100D, 20D) AS k").first()
    assert (row["d"].day, row["h"], row["i"], row["m"], row["f"], row["k"]) == (17, 25, "626", 71474.0, True, 18.0)


def stream(spark, df, path, plan, mode):
    """All files of a folder through a stream, as rows."""
    df.write.mode("overwrite").parquet(path)
    name = f"out{abs(hash(path))}"
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # fixed for a stream when it starts
    q = plan(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert q.exception() is None
    return spark.table(name)


def test_streams(spark, tmp_path):
    ts = lambda s: dt.datetime(2025, 3, 3, 8) + dt.timedelta(seconds=s)
    polls_ = spark.createDataFrame([("f", ts(0), "a", False), ("f", ts(20), "a", True), ("f", ts(40), "b", False), ("f", ts(200), "b", True), ("f", ts(220), "c", False)], "feed string, ts timestamp, sha string, frozen boolean").coalesce(1)
    got = stream(spark, polls_, str(tmp_path / "a"), lambda s: live.live_frozen(s.select("feed", "ts", "sha")), "append")
    assert [r["frozen"] for r in got.orderBy("ts").collect()] == [False, True, False, True, False]
    got = stream(spark, polls_, str(tmp_path / "b"), live.live_intervals, "append")
    assert [r["covered_s"] for r in got.orderBy("ts").collect()] == [40.0, 40.0]
    fixes = spark.createDataFrame([(ts(s), "v", float(s)) for s in (0, 5, 19, 21, 500)] + [(ts(3), None, 1.0)], "ts timestamp, track_id string, s_m double")
    got = stream(spark, fixes, str(tmp_path / "c"), live.live_thin, "complete")
    assert sorted(r["s_m"] for r in got.collect()) == [19.0, 21.0, 500.0]
    got = stream(spark, fixes.where("track_id is not null"), str(tmp_path / "d"), live.live_runs, "complete")
    assert sorted(r["n"] for r in got.collect()) == [1, 4]
    placed = spark.createDataFrame([(ts(s), "P", 0, float(s), True) for s in (10, 40, 70)], "ts timestamp, pattern_uid string, link_idx int, pos_m double, count boolean")
    segs = spark.createDataFrame([("P", 0, 30.0, 0), ("P", 0, 60.0, 1), ("P", 0, 90.0, 2)], "pattern_uid string, link_idx int, hi double, seg_idx int")
    got = stream(spark, placed, str(tmp_path / "e"), lambda s: live.live_cube(s, segs), "complete")
    assert sorted((r["hour"], r["seg_idx"], r["obs"]) for r in got.collect()) == [(8, 0, 1), (8, 1, 1), (8, 2, 1)]
    rows = [(k * 10 + v, "P", dt.date(2025, 3, 3), ts(20 * k), v * 400.0 + k * 120.0) for k in range(6) for v in range(2)]
    anon = spark.createDataFrame(rows, "row_id long, pattern_uid string, service_date date, ts timestamp, s_m double").coalesce(1)
    got = stream(spark, anon, str(tmp_path / "f"), live.live_tracks, "update").withColumn("v", F.col("row_id") % 10)
    assert got.count() == 12 and got.groupBy("v").agg(F.count_distinct("track_id").alias("n")).where("n <> 1").count() == 0
