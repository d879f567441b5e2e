"""Fixes in longitude and latitude placed on the patterns of their day.

Shape edges are cut to cells of the largest lateral distance and spread to the neighbours, so a fix meets edges by an
equi-join; choices are windows over (fix, candidate) rows. Only loops need a pass in order (one grouped Arrow function a
track and pattern).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analysis import FLAGS
from .geometry import EARTH_M, angle, plane_columns
from .placement import link_of

# Fixes on each side for the progress, least progress and its margin, longest step, bearing tolerance, preference of main patterns, standing at a stop.
AROUND, PROGRESS_M, MARGIN_M, STEP_M, BEARING, MAIN_M, AT_STOP_M = 3, 15.0, 15.0, 300.0, 45.0, 2.0, 10.0


def shape_edges(patterns: DataFrame, links: DataFrame, lon0: float, lat0: float, max_m: float) -> DataFrame:
    """Edges of the patterns' lines in metres around (lon0, lat0), with the place of their ends (scaled to the links' length), bearing and cells."""
    length = links.groupBy("pattern_uid").agg(F.max(F.col("s0_m") + F.col("len_m")).alias("length"))
    p = patterns.select("pattern_uid", "direction_id", F.posexplode("geometry").alias("i", "p")).select("pattern_uid", "direction_id", "i", F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"))
    x, y = plane_columns(F.col("lon"), F.col("lat"), lon0, lat0)
    w = W.partitionBy("pattern_uid").orderBy("i")
    e = p.withColumn("x0", x).withColumn("y0", y).withColumn("x1", F.lead("x0").over(w)).withColumn("y1", F.lead("y0").over(w)).withColumn("lon1", F.lead("lon").over(w)).withColumn("lat1", F.lead("lat").over(w))
    e = e.where("x1 is not null and (x0 <> x1 or y0 <> y1)")
    h = F.pow(F.sin(F.radians(F.col("lat1") - F.col("lat")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("lat1")) * F.pow(F.sin(F.radians(F.col("lon1") - F.col("lon")) / 2), 2)
    e = e.withColumn("m", F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))).withColumn("c1", F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("m").over(W.partitionBy("pattern_uid")))
    e = e.join(length, "pattern_uid").withColumn("k", F.col("length") / F.col("all"))
    e = e.select("pattern_uid", "direction_id", "i", "x0", "y0", "x1", "y1", ((F.col("c1") - F.col("m")) * F.col("k")).alias("s0"), (F.col("c1") * F.col("k")).alias("s1"), F.pmod(F.degrees(F.atan2(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(360.0)).alias("tangent"))
    # points along an edge at most a cell apart name the cells around it
    n = F.greatest(F.ceil(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) / max_m), F.lit(1)).cast("int")
    t = F.transform(F.sequence(F.lit(0), n), lambda j: j / n)
    cells = F.array_distinct(F.flatten(F.transform(t, lambda u: F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda a: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda b: F.struct((F.floor((F.col("x0") + u * (F.col("x1") - F.col("x0"))) / max_m) + a).alias("cx"), (F.floor((F.col("y0") + u * (F.col("y1") - F.col("y0"))) / max_m) + b).alias("cy"))))))))
    return e.withColumn("cell", F.explode(cells)).select("*", "cell.cx", "cell.cy").drop("cell")


def passes(fixes: DataFrame, edges: DataFrame, lon0: float, lat0: float, max_m: float) -> DataFrame:
    """fix_id, pattern_uid, direction_id, pass, s, d, tangent: the nearest place of each pass of each pattern within max_m.

    Places of a pattern further than 2 max_m apart along it are different passes.
    """
    x, y = plane_columns(F.col("lon"), F.col("lat"), lon0, lat0)
    pts = fixes.select("fix_id", "version", x.alias("x"), y.alias("y")).withColumn("cx", F.floor(F.col("x") / max_m)).withColumn("cy", F.floor(F.col("y") / max_m))
    vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.least(F.greatest(((F.col("x") - F.col("x0")) * vx + (F.col("y") - F.col("y0")) * vy) / (vx * vx + vy * vy), F.lit(0.0)), F.lit(1.0))
    j = pts.join(edges, ["version", "cx", "cy"]).withColumn("t", t)
    d = F.hypot(F.col("x") - F.col("x0") - F.col("t") * vx, F.col("y") - F.col("y0") - F.col("t") * vy)
    near = j.withColumn("d", d).where(F.col("d") <= max_m).select("fix_id", "pattern_uid", "direction_id", "is_main", "place", (F.col("s0") + F.col("t") * (F.col("s1") - F.col("s0"))).alias("s"), "d", "tangent")
    w = W.partitionBy("fix_id", "pattern_uid").orderBy("s", "d")
    new = F.coalesce((F.col("s") - F.lag("s").over(w) > 2 * max_m).cast("int"), F.lit(0))
    numbered = near.withColumn("new", new).withColumn("pass", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.min_by(F.struct("s", "d", "tangent"), F.struct("d", "s"))
    return numbered.groupBy("fix_id", "pattern_uid", "direction_id", "is_main", "place", "pass").agg(best.alias("b")).select("fix_id", "pattern_uid", "direction_id", "is_main", "place", "pass", "b.*")


def progress(candidates: DataFrame, fixes: DataFrame, around: int = AROUND) -> DataFrame:
    """candidates with ``gain``: metres made along each candidate over the fixes around one in its vehicle's run (gaps under 300 s); null without a vehicle."""
    w = W.partitionBy("vehicle_id").orderBy("t", "fix_id")
    runs = fixes.where("vehicle_id is not null").select("fix_id", "vehicle_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    runs = runs.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) >= 300).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("at", F.row_number().over(W.partitionBy("vehicle_id", "run").orderBy("t", "fix_id"))).drop("new", "t")
    # every fix of a run meets every pattern that its run touches, so that a fix off a pattern breaks the steps beside it
    touched = candidates.join(runs, "fix_id").select("vehicle_id", "run", "pattern_uid").distinct()
    grid = runs.join(touched, ["vehicle_id", "run"]).join(candidates.select("fix_id", "pattern_uid", "s"), ["fix_id", "pattern_uid"], "left")
    line = W.partitionBy("vehicle_id", "run", "pattern_uid").orderBy("at")
    step = F.when(F.col("at") > 1, F.greatest(F.least(F.coalesce(F.col("s") - F.lag("s").over(line), F.lit(0.0)), F.lit(STEP_M)), F.lit(-STEP_M))).otherwise(0.0)
    gain = F.sum("step").over(line.rowsBetween(-around + 1, around))
    out = grid.withColumn("step", step).withColumn("gain", gain)
    return candidates.join(out.select("fix_id", "pattern_uid", "gain"), ["fix_id", "pattern_uid"], "left")


def chosen(candidates: DataFrame, fixes: DataFrame, by_trip: DataFrame | None = None) -> DataFrame:
    """fix_id, pattern_uid, how of every fix: by trip, direction, single, progress, bearing; how alone where none (off, off_direction, ambiguous).

    ``candidates`` are nearest passes with gain; ``by_trip`` (fix_id, pattern_uid) names the trip's pattern.
    """
    x = candidates.join(fixes.select("fix_id", F.col("direction_id").alias("own_dir"), "bearing"), "fix_id")
    x = x.withColumn("allowed", F.col("own_dir").isNull() | (F.col("own_dir") == F.col("direction_id")))
    one = W.partitionBy("fix_id")
    x = x.withColumn("n", F.count(F.when(F.col("allowed"), 1)).over(one))
    ok = x.where("allowed").withColumn("best", F.max("gain").over(one))
    moving = (F.col("gain") >= F.col("best") - MARGIN_M) & (F.col("gain") >= PROGRESS_M)
    ok = ok.withColumn("moving", F.coalesce(moving, F.lit(False))).withColumn("any_moving", F.max("moving").over(one))
    turned = F.coalesce(angle(F.col("tangent"), F.col("bearing").cast("double")) < BEARING, F.lit(False))
    ok = ok.withColumn("turned", turned).withColumn("any_turned", F.max("turned").over(one))
    how = F.when(F.col("n") == 1, "single").when(F.col("any_moving"), "continuity").when(F.col("any_turned"), "bearing").otherwise("ambiguous")
    ok = ok.withColumn("how", how).where(F.when(F.col("how") == "continuity", F.col("moving")).when(F.col("how") == "bearing", F.col("turned")).otherwise(True))
    ok = ok.withColumn("dirs", F.size(F.collect_set("direction_id").over(one))).withColumn("least", F.min("d").over(one))
    prefer = F.when(F.col("is_main") & (F.col("d") <= F.col("least") + MAIN_M), F.struct(F.lit(0).alias("a"), F.col("place").cast("double").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("d").alias("b")))
    pick = ok.groupBy("fix_id", "how").agg(F.min_by("pattern_uid", F.struct(prefer, F.col("place"))).alias("pattern_uid"), F.max("dirs").alias("dirs"))
    pick = pick.select("fix_id", F.when((F.col("how") == "ambiguous") | (F.col("dirs") > 1), "ambiguous").otherwise(F.col("how")).alias("how"), "pattern_uid")
    touched = candidates.select("fix_id").distinct().withColumn("touched", F.lit(True))
    out = fixes.select("fix_id").join(touched, "fix_id", "left").join(pick, "fix_id", "left")
    if by_trip is not None:
        out = out.join(by_trip.select("fix_id", F.col("pattern_uid").alias("trip_uid")).join(candidates.select("fix_id", F.col("pattern_uid").alias("trip_uid")).distinct(), ["fix_id", "trip_uid"]), "fix_id", "left")
    else:
        out = out.withColumn("trip_uid", F.lit(None).cast("string"))
    how = F.when(F.col("trip_uid").isNotNull(), "trip").otherwise(F.coalesce("how", F.when(F.col("touched"), "off_direction").otherwise("off")))
    uid = F.coalesce("trip_uid", F.when(F.col("how") != "ambiguous", F.col("pattern_uid")))
    return out.select("fix_id", uid.alias("pattern_uid"), how.alias("how"))


_LOOP = "fix_id long, s double"


def _follow(key, rows):
    """Of each fix the first pass not more than 50 m behind the one before; after 600 s, or without any, its first pass."""
    table = rows.to_pylist()
    found, before, then = [], None, None
    for r in sorted(table, key=lambda r: (r["t"], r["fix_id"])):
        places = sorted(r["places"])
        ahead = [] if before is None or r["t"] - then > 600 else [p for p in places if p >= before - 50]
        before, then = (ahead or places)[0], r["t"]
        found.append((r["fix_id"], before))
    return pa.table({"fix_id": pa.array([f[0] for f in found], pa.int64()), "s": pa.array([f[1] for f in found], pa.float64())})


def loop_places(matched: DataFrame, all_passes: DataFrame, fixes: DataFrame) -> DataFrame:
    """fix_id, s, d of every matched fix: the nearest pass, but for tracks that touch a pattern several times the pass that follows on."""
    mine = all_passes.join(matched.where("pattern_uid is not null").select("fix_id", "pattern_uid"), ["fix_id", "pattern_uid"])
    per = mine.groupBy("fix_id", "pattern_uid").agg(F.min_by(F.struct("s", "d"), F.struct("d", "s")).alias("near"), F.collect_list("s").alias("places"))
    per = per.join(fixes.select("fix_id", F.coalesce("vehicle_id", "trip_id").alias("track"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")), "fix_id")
    loops = per.where("track is not null").withColumn("several", F.max(F.size("places")).over(W.partitionBy("track", "pattern_uid"))).where("several > 1")
    # with several passes only where they are; a fix with one keeps its nearest place
    followed = loops.select("track", "pattern_uid", "fix_id", "t", "places").groupBy("track", "pattern_uid").applyInArrow(_follow, _LOOP)
    return per.join(followed, "fix_id", "left").select("fix_id", F.coalesce("s", F.col("near.s")).alias("s"), F.col("near.d").alias("d"))


def matched_positions(places: DataFrame, matched: DataFrame, fixes: DataFrame, links: DataFrame, layover_m: float = 10.0, shorts: DataFrame | None = None) -> DataFrame:
    """Placed rows: snapped to a stop less than 10 m behind, link and place, layover at the ends, terminus reached.

    ``shorts`` (fix_id, start_m, end_m) gives the part of the pattern that a short working runs.
    """
    stops = links.groupBy("pattern_uid").agg(F.concat(F.transform(F.array_sort(F.collect_list(F.struct("link_idx", "s0_m"))), lambda x: x["s0_m"]), F.array(F.max(F.col("s0_m") + F.col("len_m")))).alias("stops"), F.transform(F.array_sort(F.collect_list(F.struct("link_idx", "link_key"))), lambda x: x["link_key"]).alias("keys"))  # tens of links
    x = fixes.drop("pattern_uid").join(matched.where("pattern_uid is not null"), "fix_id").join(places, "fix_id").join(F.broadcast(stops), "pattern_uid")
    behind = F.size(F.filter("stops", lambda v: v <= F.col("s"))) - 1
    snap = (behind >= 1) & (behind < F.size("stops") - 1) & (F.col("s") - F.get("stops", F.greatest(behind, F.lit(0))) < AT_STOP_M)
    x = x.withColumn("snap", snap).withColumn("s", F.when(F.col("snap"), F.get("stops", F.greatest(behind, F.lit(0)))).otherwise(F.col("s")))
    x = x.withColumn("at", link_of(F.col("s"), F.col("stops")))
    if shorts is None:
        x = x.withColumn("start_m", F.lit(None).cast("double")).withColumn("end_m", F.lit(None).cast("double"))
    else:
        x = x.join(shorts.select("fix_id", "start_m", "end_m"), "fix_id", "left")
    x = x.withColumn("short", F.col("start_m").isNotNull()).withColumn("start_m", F.coalesce("start_m", F.lit(0.0))).withColumn("end_m", F.coalesce("end_m", F.element_at("stops", -1)))
    known = (F.col("how") == "trip") | F.col("direction_id").isNotNull()
    lay = (F.col("s") - F.col("start_m") < layover_m) | (F.col("s") > F.col("end_m") - F.when(known, 0.5).otherwise(layover_m))
    flags = F.when(F.col("lay"), FLAGS["LAYOVER"]).otherwise(0) + F.when(F.col("short"), FLAGS["SHORT_WORKING"]).otherwise(0) + F.when(F.col("snap"), FLAGS["AT_STOP"]).otherwise(0)
    last_stop = F.element_at(F.filter("stops", lambda v: v < F.col("end_m")), -1)
    x = x.withColumn("lay", lay).withColumn("flags", flags).withColumn("term_s_m", F.when(known & (F.col("s") > last_stop), F.col("end_m")))
    out = x.withColumn("link_idx", F.col("at.link_idx")).withColumn("pos_m", F.col("at.pos_m")).withColumn("link_key", F.get("keys", F.col("at.link_idx"))).withColumn("count", ~F.col("lay"))
    return out.withColumn("track_id", F.coalesce("vehicle_id", "trip_id")).withColumn("from_start", F.col("s") - F.col("start_m")).withColumnRenamed("s", "s_m").withColumnRenamed("d", "match_err_m").drop("stops", "keys", "at", "snap", "lay", "short", "start_m", "end_m")


def start_layover(placed: DataFrame, layover_m: float = 10.0) -> DataFrame:
    """Fixes of a run that jitter around its start before it clearly leaves (3 layover_m) become layover too."""
    w = W.partitionBy("track_id").orderBy("ts", "fix_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    own = placed.where("track_id is not null")
    new = F.coalesce((F.lag("pattern_uid").over(w) != F.col("pattern_uid")) | (gap > 600), F.lit(True)).cast("int")
    d = own.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("track_id", "run")
    d = d.withColumn("left", F.min(F.when(F.col("from_start") >= 3 * layover_m, F.col("ts"))).over(run))
    before = F.col("left").isNull() | (F.col("ts") < F.col("left"))
    d = d.withColumn("stood", F.max(F.when((F.col("from_start") < layover_m) & before, F.col("ts"))).over(run))
    waits = F.coalesce((F.col("from_start") < 3 * layover_m) & (F.col("ts") <= F.col("stood")) & before, F.lit(False))
    d = d.withColumn("count", F.when(waits, F.lit(False)).otherwise(F.col("count"))).withColumn("flags", F.when(waits, F.col("flags").bitwiseOR(FLAGS["LAYOVER"])).otherwise(F.col("flags")))
    return d.drop("new", "run", "left", "stood").unionByName(placed.where("track_id is null"))


def place_latlon(fixes: DataFrame, of_version: DataFrame, patterns: DataFrame, links: DataFrame, max_m: float = 40.0, layover_m: float = 10.0, by_trip: DataFrame | None = None, shorts: DataFrame | None = None) -> DataFrame:
    """Fixes (fix_id, version, ts, lon, lat, vehicle_id, trip_id, direction_id, bearing) placed on the patterns of their version.

    Short workings ride their parent, so they are no candidates themselves. Fixes without a choice go; ``chosen`` tells why.
    """
    middle = patterns.select(F.explode("geometry").alias("p")).agg(F.avg(F.get("p", 0)), F.avg(F.get("p", 1))).first()
    lon0, lat0 = (float(v) if v is not None and math.isfinite(v) else 0.0 for v in middle)
    roles = of_version.where("kind <> 'short' or is_main").select("version", "pattern_uid", "is_main", "place")
    edges = shape_edges(patterns, links, lon0, lat0, max_m).join(roles, "pattern_uid")
    known = fixes.where("lon is not null and lat is not null")
    found = passes(known, edges, lon0, lat0, max_m)
    nearest = found.groupBy("fix_id", "pattern_uid", "direction_id", "is_main", "place").agg(F.min_by(F.struct("s", "d", "tangent"), F.struct("d", "s")).alias("b")).select("fix_id", "pattern_uid", "direction_id", "is_main", "place", "b.*")
    pick = chosen(progress(nearest, known), known, by_trip)
    placed = matched_positions(loop_places(pick, found, known), pick, known, links, layover_m, shorts)
    return start_layover(placed, layover_m).drop("from_start")


def match_report(pick: DataFrame) -> DataFrame:
    """Fixes for each way of choosing, and for each reason of dropping."""
    return pick.groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def bearing_between(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    return F.pmod(F.degrees(F.atan2((lon1 - lon0) * F.cos(F.radians(lat0)), lat1 - lat0)), F.lit(360.0))
