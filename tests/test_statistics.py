import math
from datetime import date, datetime, timedelta

from dwellscope.operators import statistics as st
from dwellscope.operators import tracks as tr

MONDAY = date(2025, 3, 3)


def test_erfc(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double")
    for r in df.select("x", st.erfc(df["x"]).alias("y")).collect():
        assert abs(r["y"] - math.erfc(r["x"])) < 3e-7


def test_weights(spark):
    days = spark.createDataFrame([(MONDAY + timedelta(days=7 * i),) for i in range(5)] + [(MONDAY + timedelta(days=1),)], "day date")
    w = st.bootstrap_weights(days.union(days), 40)
    per_draw = {r["draw"]: r["s"] for r in w.groupBy("draw").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect()}
    assert len(per_draw) == 40 and all(abs(s - 6) < 1e-9 for s in per_draw.values())
    assert w.where(w["day"] == MONDAY + timedelta(days=1)).where("w = 1").count() == 40


def test_day_rule(spark):
    days = [MONDAY + timedelta(days=i) for i in range(4)]
    rows = [(days[0], h, 0.3 if h < 14 else 1.0, 0) for h in range(6, 21)]
    rows += [(days[1], h, 1.0, 2 if h < 18 else 0) for h in range(6, 21)]
    rows += [(days[2], h, 1.0, 0) for h in range(6, 21)]
    got = st.day_rule(spark.createDataFrame([(d,) for d in days], "day date"), spark.createDataFrame(rows, "day date, hour int, coverage double, flags int"))
    assert {r["day"]: r["reason"] for r in got.collect()} == {days[0]: "low_coverage", days[1]: "frozen", days[3]: "no_data"}


def test_resample_minute_fixes(spark):
    start = datetime(2025, 3, 3, 8, 0, 7)
    rows = [(start + timedelta(seconds=60 * i), "a", "P", 100.0 * i, 8) for i in range(11)] + [(start, None, "P", 1.0, 8)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, track_id string, pattern_uid string, s_m double, hour int")
    got = tr.resample(df).where("track_id is not null")
    assert 30 <= got.count() <= 33
    assert got.select("ts").distinct().count() == got.count()
    assert tr.resample(df).where("track_id is null").count() == 1
    assert tr.resample(df.limit(0)).count() == 0


def test_crossings_in_proportion(spark):
    t0 = datetime(2025, 3, 3, 8)
    rows = [("a", 1, t0, 10.0), ("a", 1, t0 + timedelta(seconds=100), 110.0), ("a", 1, t0 + timedelta(seconds=200), 110.0)]
    got = tr.crossings(spark.createDataFrame(rows, "track_id string, run int, ts timestamp_ntz, s_max double"), 50.0).orderBy("line").collect()
    assert [(r["line"], round(r["at_us"] / 1e6 - got[0]["at_us"] / 1e6)) for r in got] == [(1, 0), (2, 50)]


def test_line_median_counts_zeros(spark):
    counts = spark.createDataFrame([(MONDAY, 8, 0, 6), (MONDAY, 8, 1, 4), (MONDAY, 8, 3, 9)], "day date, hour int, line int, n int")
    lines = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)], "link_idx int, line int")
    assert [(r["link_idx"], r["n"]) for r in tr.line_passages(counts, lines).collect()] == [(0, 4.0)]
