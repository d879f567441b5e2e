from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from dwellscope.operators import patterns as pt


def test_classified(spark):
    rows = [(list(s), list("ABCDEF")) for s in ("ABCDEF", "CDE", "ACDEF", "XYZ")]
    got = pt.classified(spark.createDataFrame(rows, "stop_ids array<string>, main_ids array<string>")).collect()
    assert {"".join(r["stop_ids"]): (r["kind"], r["parent_offset"]) for r in got} == {"ABCDEF": ("main", None), "CDE": ("short", 2), "ACDEF": ("detour", None), "XYZ": ("other", None)}


def test_main_pattern_of_short_workings(spark):
    rows = [("d", "stub", ["A", "B"], 12), ("d", "full", list("ABCDE"), 10), ("d", "rare", list("ABCDEF"), 1)]
    (got,) = pt.main_patterns(spark.createDataFrame(rows, "day string, pattern_uid string, stop_ids array<string>, n_trips long"), ["day"]).collect()
    assert (got["pattern_uid"], got["score"]) == ("full", 52)


def test_event_passages(spark):
    t, day = datetime(2025, 3, 3, 7, 50), date(2025, 3, 3)
    times = [None, t, None, t + timedelta(minutes=30), None, None]
    rows = [(day, "x", "ABCDEF"[i], i + 1, x, None) for i, x in enumerate(times)]
    ev = spark.createDataFrame(rows, "service_date date, trip_key string, stop_id string, stop_sequence int, arrival timestamp_ntz, departure timestamp_ntz")
    links = spark.createDataFrame([(a, b, a + b) for a, b in zip("ABCDE", "BCDEF")], "a string, b string, link_key string")
    got = {r["link_key"]: (r["service_date"], r["hour"], r["n_events"]) for r in pt.event_passages(ev, links).collect()}
    assert got == {"AB": (day, 7, 1), "BC": (day, 7, 1), "CD": (day, 8, 1), "DE": (day, 8, 1)}
    assert pt.event_passages(ev.limit(0), links).count() == 0


def test_overlap_and_kind(spark):
    a = spark.createDataFrame([("g", 1), ("g", 2), ("g", 9)], "g string, j int")
    b = spark.createDataFrame([("g", 3)], "g string, j int")
    assert [r["overlap"] for r in pt.tolerant_overlap(a, b, "g").collect()] == [0.5]
    kinds = spark.createDataFrame([("persistent", None, None), ("both", 3.0, 1.0), ("peak", 3.0, None), ("peak", None, 5.0), ("peak", 3.0, 5.0)], "c string, f double, r double")
    assert [x[0] for x in kinds.select(pt.hotspot_kind(F.col("c"), F.col("f"), F.col("r"), 2.0, 3.0)).collect()] == ["infrastructure", "mixed", "infrastructure", "congestion", "mixed"]
