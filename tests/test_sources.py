import json
from datetime import datetime

from dwellscope.operators import grids
from dwellscope.sources import tables as tb


def _edges(df):
    rows = df.orderBy("link_idx", "k").collect()
    return [round(r["lo"], 4) for r in rows] + [round(rows[-1]["hi"], 4)]


def test_fixed_grid(spark):
    links = spark.createDataFrame([("P", 0, 100.5)], "pattern_uid string, link_idx int, len_m double")
    assert _edges(grids.fixed_grid(links, 50.0)) == [0, 50, 100.5]
    assert _edges(grids.fixed_grid(links, 30.0, 10.0)) == [0, 10, 40, 70, 100.5]


def test_stops_grid(spark):
    links = spark.createDataFrame([("P", 0, 300.0, 38.0, 36.0), ("P", 1, 70.0, 38.0, 36.0)], "pattern_uid string, link_idx int, len_m double, head double, tail double")
    rows = grids.stops_grid(links, 30.0).orderBy("link_idx", "k").collect()
    assert [round(r["hi"] - r["lo"], 4) for r in rows] == [38.0, *[28.25] * 8, 36.0, 70.0]
    assert [r["zone"] for r in rows] == ["stop", *["running"] * 8, "stop", "stop"]


def test_zones(spark):
    segs = spark.createDataFrame([("P", 30.0 * i, 30.0 * i + 30) for i in range(10)], "pattern_uid string, x0_m double, x1_m double")
    got = grids.tagged(segs, spark.createDataFrame([("P", 0.0), ("P", 300.0)], "pattern_uid string, s_m double"), 30.0, 60.0)
    assert [r["zone"] for r in got.orderBy("x0_m").collect()] == ["stop"] * 2 + ["running"] * 7 + ["stop"]


def test_instants(spark):
    df = spark.createDataFrame([("1740985200",), ("2025-03-03T07:00:00Z",), ("2025-03-03 08:00:00",), ("2025-03-30T02:30:00",), ("junk",), (None,)], "ts string")
    got = [r[0] for r in df.select(tb.instant(df, "ts", zone="Europe/Brussels").cast("string")).collect()]
    assert got == ["2025-03-03 07:00:00"] * 3 + [None] * 3


def test_observations_with_clashing_names(spark):
    df = spark.createDataFrame([(1740985200, "S1", "x", 50.8, 4.3, "0626"), (1740985200, "OTHER", "y", 50.8, 4.3, None)], "t long, route_id string, ts string, lat double, lon double, stop_id string")
    (row,) = tb.observations(df, {"ts": "t"}, route="S1").collect()
    assert (str(row["ts"]), row["stop_id"], row["vehicle_id"]) == ("2025-03-03 07:00:00", "626", None)


def test_raw_snapshots(spark, tmp_path):
    a = [{"lineId": "55", "directionId": "0626", "pointId": "5272F", "distanceFromPoint": 12}, {"lineId": "3", "directionId": "1", "pointId": "2", "distanceFromPoint": 0}]
    for name, data in (("07-00-00", a), ("07-00-20", a), ("07-00-40", {"results": a[:1]})):
        (tmp_path / f"2025-03-03T{name}Z.json").write_text(json.dumps(data))
    obs, snaps = tb.raw_snapshots(spark, [str(tmp_path)], route="55")
    assert [(r["n_rows"], r["frozen"]) for r in snaps.orderBy("ts").collect()] == [(2, False), (2, True), (1, False)]
    assert [(r["ts"], r["terminus_id"], r["stop_id"], r["dist_m"]) for r in obs.orderBy("ts").collect()] == [(datetime(2025, 3, 3, 7), "626", "5272", 12.0), (datetime(2025, 3, 3, 7, 0, 40), "626", "5272", 12.0)]


def test_route_feed(spark, tmp_path):
    for name, text in {
        "routes": "route_id,route_short_name\nR1,55\nR2,3\n",
        "trips": "route_id,trip_id,direction_id,shape_id\nR1,a,0,s2\nR1,b,0,s1\nR2,c,0,s1\n",
        "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\na,A,1,,\na,B,10,,\na,B,11,,\nb,A,1,,\nb,B,2,,\nc,Z,1,,\n",
        "stops": "stop_id,stop_name\nA,a\nB,b\nZ,z\n",
    }.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = tb.route_feed(spark, str(tmp_path), "55")
    assert feed["stops"].count() == 2
    (p,) = tb.stop_sequences(feed).collect()
    assert (p["stop_ids"], p["n_trips"], p["shape_id"]) == (["A", "B"], 2, "s1")
