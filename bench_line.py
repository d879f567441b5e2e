"""Times a line of three million placed rows: cube, analysis and day bootstrap on ready tables. Prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

ROWS, DAYS, LINKS, METRES, DRAWS = 3_000_000, 91, 20, 456.0, 200


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from dwellscope.operators import analysis as an
    from dwellscope.operators import hotspots as hs
    from dwellscope.run import counted, segments_of
    from dwellscope.sources.store import written

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    r = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / (1 << 30)
    placed = written(spark.range(ROWS).select(
        F.date_add(F.lit("2025-01-06").cast("date"), F.floor(r(1) * DAYS).cast("int")).alias("service_date"), (5 + F.floor(r(2) * 19)).cast("int").alias("hour"), F.lit("P").alias("pattern_uid"),
        F.floor(r(3) * LINKS).cast("int").alias("link_idx"), (r(4) * METRES).alias("pos_m"), F.lit(True).alias("count"),
    ))
    links = spark.createDataFrame([("P", i, f"l{i}", i * METRES, METRES) for i in range(LINKS)], "pattern_uid string, link_idx int, link_key string, s0_m double, len_m double")
    segs = written(segments_of(links))
    mains = written(spark.range(DAYS).select(F.date_add(F.lit("2025-01-06").cast("date"), F.col("id").cast("int")).alias("service_date"), F.lit(0).alias("direction_id"), F.lit("P").alias("pattern_uid")))
    passages = written(mains.select("service_date", F.explode(F.sequence(F.lit(5), F.lit(23))).alias("hour")).select("*", F.explode(F.array(*[F.lit(f"l{i}") for i in range(LINKS)])).alias("link_key"), F.lit(8.0).alias("n")))
    took = {}

    def timed(name, make):
        began = time.time()
        out = make()
        took[name] = round(time.time() - began, 2)
        return out

    for again in ("first", "warm"):
        cube = timed(f"cube_{again}", lambda: written(counted(placed, segs)))
        status = an.day_status(an.hour_status(an.selected_days(cube), None))
        hours = written(an.included_hours(an.hour_status(an.selected_days(cube), None), status))
        est = timed(f"analyse_{again}", lambda: written(an.estimates(an.totals(hours, mains, segs, cube, passages), segs)))
        cells = written(an.day_cells(hours, mains, segs, cube, passages))
        bins = timed(f"bootstrap_{again}", lambda: written(hs.bin_statistics(cells, mains, DRAWS)))
    print(json.dumps({"metric": "line", "value": took["cube_warm"], "unit": "sec", "rows": ROWS, "segments": segs.count(), "estimates": est.count(), "bins": bins.count(), "draws": DRAWS, "seconds": took}))
    spark.stop()


if __name__ == "__main__":
    main()
