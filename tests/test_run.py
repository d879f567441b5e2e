"""A made-up line end to end: placement, map matching, passages, run, compare and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from dwellscope import cli
from dwellscope import run as api
from dwellscope.config import Config
from dwellscope.operators.core import local_time
from dwellscope.sources import readers
from dwellscope.sources.simulate import simulated


@pytest.fixture(scope="module")
def line(tmp_path_factory):
    return simulated(str(tmp_path_factory.mktemp("line")), days=6, hours=(6, 16), hotspots=((0, 700, 760, 40, tuple(range(6, 22))),), headway_s=1200.0)


def config(line, **kw):
    return Config.from_dict({
        "input": {"paths": [f"{line.folder}/feed"], "kind": "stib"} | kw, "gtfs": {"path": line.gtfs}, "select": {"route": "S1", "weekdays": [0, 1, 2, 3, 4, 5, 6], "hours": [6, 16]},
        "params": {"reference_hours": [6, 16], "bootstrap": 20}, "quality": {"min_day_coverage": 0.4},
    })


def rows_of(spark, line):
    df = spark.createDataFrame(line.observations).withColumn("ts", F.timestamp_seconds("ts")).withColumn("__ts", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = local_time(df, "Europe/Brussels").withColumn("ts", F.col("__ts")).drop("__ts").withColumn("row_id", F.monotonically_increasing_id())
    return df.withColumn("bearing", F.lit(None).cast("float"))


def network_of(spark, line):
    days = [r[0] for r in rows_of(spark, line).select("service_date").distinct().collect()]
    return api.build_network(spark, readers.FeedSource(spark, line.gtfs), "S1", sorted(days))


def test_linear_placement(spark, line):
    net = network_of(spark, line)
    assert net.pattern_days.where("is_main").select("direction_id", "pattern_uid").distinct().count() == 2
    obs = rows_of(spark, line).drop("vehicle_id", "direction_id").withColumn("vehicle_id", F.lit(None).cast("string")).withColumn("direction_id", F.lit(None).cast("int"))
    placed, located = api.place(obs, net, config(line))
    got = placed.where("count").select("true_dir", "true_s", "direction_id", "s_m").toPandas()
    assert len(got) > 0.9 * len(line.observations)
    assert (got["direction_id"] == got["true_dir"]).mean() >= 0.99
    assert (abs(got["s_m"] - got["true_s"]) <= 30).mean() >= 0.98
    assert placed.where("track_id is null").count() == 0


def test_map_matching(spark, line):
    net = network_of(spark, line)
    cfg = config(line, kind="latlon")
    obs = rows_of(spark, line).withColumn("direction_id", F.lit(None).cast("int"))
    for known in (True, False):
        fixes = obs if known else obs.withColumn("trip_id", F.lit(None).cast("string"))
        placed, _ = api.place(fixes, net, cfg)
        got = placed.where("count").select("true_dir", "true_s", F.col("s_m"), "pattern_uid").join(net.patterns.select("pattern_uid", F.col("direction_id").alias("p_dir")), "pattern_uid").toPandas()
        assert len(got) > 0.85 * len(line.observations)
        assert (got["p_dir"] == got["true_dir"]).mean() >= 0.99
        assert (abs(got["s_m"] - got["true_s"]) <= 30).mean() >= 0.98


LONG = pytest.mark.skipif(not os.environ.get("DWELLSCOPE_LONG"), reason="takes minutes: set DWELLSCOPE_LONG")


@LONG
def test_run_and_compare(spark, line, tmp_path):
    cfg = config(line)
    pre = api.prepare(spark, cfg)
    per_link = pre.passages.groupBy("link_key").agg(F.sum("n").alias("n")).toPandas()
    trips = line.observations.groupby("direction_id")["vehicle_id"].nunique()
    assert abs(per_link["n"].max() / trips.max() - 1) <= 0.03
    out = api.run(spark, cfg, pre)
    found = out.hotspots.where("direction_id = 0").orderBy("rank").first()
    assert found["from_m"] < 760 and found["to_m"] > 700
    doc = api.save(out, str(tmp_path / "out"))
    assert doc["period"]["days"] == 6 and len(doc["dirs"]) == 2 and os.path.exists(tmp_path / "out" / "report.html")
    shapes = json.loads((tmp_path / "out" / "hotspots.geojson").read_text())["features"]
    assert shapes and all(len(f["geometry"]["coordinates"]) >= 2 for f in shapes)
    assert "<" not in json.dumps(doc["hotspots"]) and spark.read.parquet(str(tmp_path / "out" / "result.parquet")).count() > 0
    days = sorted(r[0].isoformat() for r in out.mains.select("service_date").distinct().collect())
    both = api.run_compare(spark, cfg, (days[0], days[2]), (days[3], days[5]), 20, pre)
    bins = both.bins.agg(F.avg(F.col("significant").cast("double"))).first()[0]
    assert bins < 0.2 and both.changes.count() == 0  # nothing changed (and too few days)


@LONG
def test_command_line(spark, line, tmp_path, capsys):
    path = tmp_path / "line.toml"
    path.write_text(f'[input]\npaths = ["{line.folder}/feed"]\nkind = "stib"\n[gtfs]\npath = "{line.gtfs}"\n[select]\nroute = "S1"\nweekdays = [0, 1, 2, 3, 4, 5, 6]\n')
    assert cli.main(["inspect", str(path), "-q"], spark) == 0
    assert "## coverage" in capsys.readouterr().out
    with pytest.raises(ValueError, match="unknown setting"):
        Config.from_dict({"params": {"segment": 3}})
