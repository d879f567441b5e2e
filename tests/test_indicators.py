import random
from datetime import date, datetime, timedelta

from dwellscope.operators import analysis
from dwellscope.operators import indicators as ind
from dwellscope.operators import tuning


def _dates(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "day date")


def test_stall_over_midnight(spark):
    start = datetime(2025, 3, 3, 23, 58)
    polls = [(start + timedelta(seconds=20 * i), 2 <= i < 20 or i in (25, 26)) for i in range(40)]
    df = spark.createDataFrame(polls, "ts timestamp_ntz, frozen boolean")
    (row,) = ind.stalls(df).collect()
    assert (row["ts0"], row["n"], row["frozen_s"]) == (polls[2][0], 18, 360.0)
    assert ind.stalls(df, max_s=400.0).count() == 0


def test_nearest_covered(spark):
    covered = _dates(spark, date(2025, 3, 3), date(2025, 3, 7), date(2025, 3, 8))
    days = _dates(spark, date(2025, 3, 5), date(2025, 3, 9), date(2025, 3, 10), date(2025, 3, 15), date(2025, 3, 1))
    got = {r["day"].day: r["covered_day"].day for r in ind.nearest_covered(days, covered).collect()}
    assert got == {5: 3, 9: 8, 10: 7, 15: 8, 1: 8}
    assert ind.nearest_covered(days, covered.limit(0)).where("covered_day is null").count() == 5


def test_feed_on(spark):
    feeds = _dates(spark, date(2025, 1, 1), date(2025, 1, 11))
    days = _dates(spark, date(2024, 12, 31), date(2025, 1, 10), date(2025, 1, 11), date(2025, 2, 11))
    got = {r["day"]: r["feed"] for r in ind.feed_on(days, feeds, 14).collect()}
    assert list(map(got.get, sorted(got))) == [None, date(2025, 1, 1), date(2025, 1, 11), None]


def test_overlapping_bands(spark):
    cube = spark.createDataFrame([(date(2025, 3, 3), 8, "P", 0, 3), (date(2025, 3, 3), 9, "P", 0, 4), (date(2025, 3, 4), 20, "P", 0, 5)], "service_date date, hour int, pattern_uid string, seg_idx int, obs long")
    got = {r["band"]: (r["obs"], r["n_days"]) for r in ind.band_totals(cube, {"am": (7, 10), "day": (6, 23)}).collect()}
    assert got == {"am": (7, 1), "day": (12, 2)}


def test_overlapping_compares_no_pairs(spark):
    rng = random.Random(4)
    inf, nan = float("inf"), float("nan")
    part = lambda i: (rng.choice([0, 1, 2, None]), i, (a := rng.choice([rng.randrange(1300) * 1.0, rng.random() * 1300])), a + rng.randrange(-60, 60))
    a, b = [part(i) for i in range(400)], [part(i) for i in range(30)]
    a += [a[5], (0, 900, None, 50.0), (0, 901, 50.0, None), (3, 902, 0.0, 9.0), (4, 903, 5.0, 8.0), (5, 904, 100.0, 200.0), (5, 905, 300.0, 400.0)]
    b += [(0, 0, None, 5000.0), (1, 1, -5000.0, None), (None, 2, 0.0, 9000.0), (4, 3, 38.0, 40.0), (4, 4, 38.0, 40.0), (5, 5, -inf, 70.0), (5, 6, nan, nan)]
    schema = "direction_id int, f int, from_m double, to_m double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    on = [left["direction_id"] == right["direction_id"], left["from_m"] <= right["to_m"] + 30.0, left["to_m"] >= right["from_m"] - 30.0]
    want = sorted(map(repr, left.join(right, on, "left_semi").collect()))
    assert 20 < len(want) < 400
    for blocks in (1, 7, 256):
        got = tuning.overlapping(left, right, blocks=blocks)
        assert got.columns == left.columns and sorted(map(repr, got.collect())) == want
    assert tuning.overlapping(left, right.limit(0)).count() == 0
    # no join on the direction alone with rows of both sides: every join's other side has a row for each direction or part
    plan = tuning.overlapping(left, right)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_interactive_in_any_order(spark):
    """Whatever the order of the rows, 1 / 25.6 is 0.0390625, which a sum of 25.600000000000005 would round down."""
    hours = [0.1, 0.2, 0.3, 7.7, 0.7, 9.1, 1.1, 6.4]
    for order in (hours, hours[::-1], sorted(hours), sorted(hours)[::-1], hours[4:] + hours[:4]):
        cells = spark.createDataFrame([(0, 0, "s", 0, 8, 1.0 * (h == 7.7), h, 1.0, 3) for h in order], "direction_id int, seg_idx int, seg_key string, dow int, hour int, obs double, covered_h double, passages double, n_cells long")
        (row,) = analysis.interactive(cells.coalesce(1), (0,), (7, 19)).collect()
        assert (row["covered_h"], row["obs_per_h"], row["obs"], row["n_cells"]) == (25.6, 0.0390625, 1.0, 24)
