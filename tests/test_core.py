import os

import pytest

from dwellscope.operators import core

DATA = "/root/testdata/sf0.001"


def test_places_at_bin_ends(spark):
    links = spark.createDataFrame([("P", 0, 90.0), ("P", 1, 60.0)], "pattern_uid string, link_idx int, len_m double")
    # Facts about bin ends; unknown links and missing positions are our own cases.
    rows = [(0, 30.0), (0, 30.01), (0, 90.0), (0, 120.0), (1, 0.0), (1, -2.0), (0, 0.0), (1, 0.001), (2, 5.0), (0, None)]
    placed = spark.createDataFrame([("P", i, p, n) for n, (i, p) in enumerate(rows)], "pattern_uid string, link_idx int, pos_m double, n int")
    got = core.assign(placed, core.segment_grid(links, 30.0)).orderBy("n").collect()
    assert [r["seg_idx"] for r in got] == [0, 1, 2, 2, 2, 2, 0, 3, None, None]


def test_grid(spark):
    links = spark.createDataFrame([("P", 0, 253.0)], "pattern_uid string, link_idx int, len_m double")
    assert core.segment_grid(links, 30.0).count() == 8
    shifted = core.segment_grid(links, 30.0, 15.0).orderBy("k").collect()
    assert len(shifted) == 9 and shifted[0]["hi"] == pytest.approx(253 / 16)


def test_service_time(spark):
    # Facts about service time.
    cases = {"2025-03-18 00:30:00": (17, 25), "2025-03-18 03:00:00": (18, 4), "2025-03-30 01:30:00": (29, 27), "2025-03-30 02:30:00": (30, 4)}
    df = spark.createDataFrame([(t,) for t in cases], "t string").selectExpr("t", "cast(t as timestamp_ntz) as ts")
    for r in core.local_time(df, "Europe/Brussels").collect():
        assert (r["service_date"].day, r["hour"]) == cases[r["t"]]


def test_registered_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    from dwellscope.plans import registry

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("customer", "orders", "lineitem", "events", "part", "supplier"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, query in registry.QUERIES.items():
        got = query(spark, DATA)
        if name not in registry.ORACLE_SQL:
            assert got.count() >= 0, name
            continue
        cols = sorted(got.columns)
        rel = con.sql(registry.ORACLE_SQL[name])
        assert sorted(rel.columns) == cols, name
        want = con.sql(f"select {', '.join(cols)} from rel").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect()), name
