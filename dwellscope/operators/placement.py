"""Placing positions given as "last stop passed and metres since" on the links of a network.

Rules look at distinct (version, stop, terminus, direction) combinations, a small table, and are joined back to the rows.

Tables: ``patterns`` (pattern_uid, direction_id, stop_ids, stop_names), ``pattern_days`` (service_date, direction_id,
pattern_uid, n_trips, is_main, kind), ``links`` (pattern_uid, link_idx, link_key, s0_m, len_m).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analysis import FLAGS
from .core import feed_lengths
from .indicators import nearest_covered
from .tracks import learned_aliases

# A vehicle stands at a stop under 10 m; a short working in the last quarter of its last link stands at its end.
AT_STOP_M, END_SHARE = 10.0, 0.75
PLACED_STATUS = ("ok", "ok_other", "ok_stop_only")


def date_versions(dates: DataFrame, pattern_days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(service_date, network_date, version) of each date, and (version, pattern_uid, direction_id, is_main, kind, n_trips, place).

    Days with the same patterns in the same roles are one version, named by a digest. A date without patterns takes the
    nearest covered one of its kind.
    """
    w = W.partitionBy("service_date").orderBy("direction_id", F.desc("n_trips"), "pattern_uid")
    rows = pattern_days.withColumn("place", F.row_number().over(w))
    role = F.struct("place", "pattern_uid", "direction_id", "is_main", "kind")
    day = rows.groupBy("service_date").agg(F.array_sort(F.collect_list(role)).alias("roles"))  # a day's patterns
    day = day.withColumn("version", F.sha1(F.to_json("roles")))
    covered = nearest_covered(dates.select(F.col("service_date").alias("day")), day.select(F.col("service_date").alias("day")))
    of_date = covered.join(day.select(F.col("service_date").alias("covered_day"), "version"), "covered_day").select(F.col("day").alias("service_date"), F.col("covered_day").alias("network_date"), "version")
    of_version = day.groupBy("version").agg(F.first("roles").alias("roles")).select("version", F.explode("roles").alias("r")).select("version", "r.*")
    return of_date, of_version


def stop_names(patterns: DataFrame) -> DataFrame:
    """stop_id, stop_name of the stops that patterns name; the first name in the order of uids."""
    flat = patterns.select("pattern_uid", F.explode(F.arrays_zip("stop_ids", "stop_names")).alias("s")).select("pattern_uid", "s.stop_ids", "s.stop_names")
    return flat.groupBy(F.col("stop_ids").alias("stop_id")).agg(F.min_by("stop_names", "pattern_uid").alias("stop_name"))


def aliases_of(rows: DataFrame, of_version: DataFrame, patterns: DataFrame, names: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """terminus_id, stop_id of codes that are no stop of the network: given, or the last stop of the pattern that holds most of the code's rows."""
    unknown = rows.where("terminus_id is not null").select("terminus_id", "stop_id").join(names.select(F.col("stop_id").alias("terminus_id")), "terminus_id", "left_anti")
    if given is not None:
        unknown = unknown.join(given.select("terminus_id"), "terminus_id", "left_anti")
    used = of_version.groupBy("pattern_uid").agg(F.max("is_main").alias("is_main"), F.min("place").alias("place"))
    stops = patterns.join(used, "pattern_uid").select("pattern_uid", "is_main", "place", F.size("stop_ids").alias("n"), F.posexplode("stop_ids").alias("i", "stop_id"))
    learned = learned_aliases(unknown, stops.select("pattern_uid", "stop_id", (F.col("i") == F.col("n") - 1).alias("is_last"), "is_main", "place"))
    out = learned.select("terminus_id", F.col("last_stop").alias("stop_id"))
    return out if given is None else given.select("terminus_id", "stop_id").unionByName(out)


def resolved(combos: DataFrame, of_version: DataFrame, patterns: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pattern, link and terminus of each combination (version, stop_id, terminus_id, direction_id) with its status.

    One main pattern that serves the stop and then the terminus (by id or name): ok; several: ambiguous. None: other
    patterns of the day, several only if those run to their end have one direction (the busiest): ok_other. Else the stop
    alone, if one main serves it and the code is that main's first stop: ok_stop_only. Else unknown_terminus or off_pattern.
    """
    name_of = names.select(F.col("stop_id").alias("tid"), F.col("stop_name").alias("tname"))
    keyed = combos.withColumn("cid", F.monotonically_increasing_id())
    keyed = keyed.join(aliases.select("terminus_id", F.col("stop_id").alias("alias")), "terminus_id", "left").withColumn("tid", F.coalesce("alias", "terminus_id")).drop("alias")
    keyed = keyed.join(name_of, "tid", "left")
    pats = of_version.join(patterns.select("pattern_uid", "stop_ids", "stop_names"), "pattern_uid").withColumnRenamed("direction_id", "p_dir")
    m = keyed.where("stop_id is not null").join(pats, "version").withColumn("i", F.array_position("stop_ids", F.col("stop_id")) - 1).withColumn("last", F.size("stop_ids") - 1)
    m = m.where((F.col("i") >= 0) & (F.col("i") < F.col("last")))
    ahead = F.filter(F.sequence(F.col("i") + 1, F.col("last").cast("long")), lambda k: F.coalesce(F.get("stop_ids", k.cast("int")) == F.col("tid"), F.lit(False)) | F.coalesce(F.get("stop_names", k.cast("int")) == F.col("tname"), F.lit(False)))
    same_way = F.col("direction_id").isNull() | (F.col("direction_id") == F.col("p_dir"))
    m = m.withColumn("same_way", same_way).withColumn("term", F.when(F.col("tid").isNull(), F.when(F.col("same_way"), F.col("last"))).otherwise(F.get(ahead, 0)))
    hit = F.col("term").isNotNull()
    whole = F.col("term") == F.col("last")
    best = F.struct("is_main", "place", "pattern_uid", F.col("i").cast("int").alias("link_idx"), F.col("term").cast("int").alias("term"), F.col("last").cast("int").alias("last"), "p_dir", "stop_names", "stop_ids")
    main, other = F.col("is_main"), ~F.col("is_main") & (F.col("kind") != "short")
    sums = m.groupBy("cid").agg(
        F.count(F.when(main & hit, 1)).alias("n_main"), F.min(F.when(main & hit, best)).alias("main"),
        F.count(F.when(other & hit, 1)).alias("n_other"), F.count(F.when(other & hit & whole, 1)).alias("n_full"),
        F.size(F.collect_set(F.when(other & hit & whole, F.col("p_dir")))).alias("full_dirs"), F.size(F.collect_set(F.when(other & hit, F.col("p_dir")))).alias("other_dirs"),
        F.min(F.when(other & hit & whole, best)).alias("full"), F.min(F.when(other & hit, best)).alias("other"),
        F.count(F.when(main & F.col("same_way"), 1)).alias("n_stop"), F.min(F.when(main & F.col("same_way"), best)).alias("alone"),
    )
    x = keyed.join(sums, "cid", "left").fillna(0, ["n_main", "n_other", "n_full", "full_dirs", "other_dirs", "n_stop"])
    one_way = F.when(F.col("n_full") > 0, F.col("full_dirs") == 1).otherwise(F.col("other_dirs") == 1)
    pick_other = (F.col("n_other") == 1) | ((F.col("n_other") > 1) & one_way)
    first = F.get("alone.stop_ids", 0)
    first_name = F.get("alone.stop_names", 0)
    alone = (F.col("n_stop") == 1) & F.col("tid").isNotNull() & (F.coalesce(first == F.col("tid"), F.lit(False)) | F.coalesce(first_name == F.col("tname"), F.lit(False)))
    known = F.col("terminus_id").isNull() | F.col("tname").isNotNull()
    status = (
        F.when(F.col("stop_id").isNull(), "no_position").when(F.col("n_main") == 1, "ok").when(F.col("n_main") > 1, "ambiguous").when(pick_other, "ok_other").when(F.col("n_other") > 1, "ambiguous").when(alone, "ok_stop_only").when(~known, "unknown_terminus").otherwise("off_pattern")
    )
    chosen = F.when(F.col("status") == "ok", F.col("main")).when(F.col("status") == "ok_other", F.when((F.col("n_other") > 1) & (F.col("n_full") > 0), F.col("full")).otherwise(F.col("other"))).when(F.col("status") == "ok_stop_only", F.col("alone"))
    x = x.withColumn("status", status).withColumn("h", chosen)
    last_name, term_name = F.get("h.stop_names", F.col("h.last")), F.get("h.stop_names", F.col("h.term"))
    short = F.coalesce(F.col("h.term") != F.col("h.last"), F.lit(False))
    ends_next = F.coalesce(F.col("h.term") == F.col("h.link_idx") + 1, F.lit(False)) & short & ~F.coalesce(term_name == last_name, F.lit(False))
    return x.select("version", "stop_id", "terminus_id", "direction_id", "status", F.col("h.pattern_uid").alias("pattern_uid"), F.col("h.link_idx").alias("link_idx"), F.col("h.term").alias("term"), short.alias("short"), ends_next.alias("ends_next"), F.col("h.p_dir").alias("p_dir"))


def located(obs: DataFrame, patterns: DataFrame, pattern_days: DataFrame, given: DataFrame | None = None, stops: DataFrame | None = None) -> DataFrame:
    """Observations (service_date, stop_id, terminus_id, direction_id, dist_m, ...) with status, pattern_uid, link_idx and what the terminus means."""
    of_date, of_version = date_versions(obs.select("service_date").distinct(), pattern_days)
    names = stops if stops is not None else stop_names(patterns)
    keys = ["version", "stop_id", "terminus_id", "direction_id"]
    rows = obs.join(F.broadcast(of_date), "service_date")  # a row for each date
    found = resolved(rows.select(*keys).distinct(), of_version, patterns, names, aliases_of(rows, of_version, patterns, names, given))
    named = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(named[f"__{k}"])
    out = rows.join(named, on, "left").drop(*[f"__{k}" for k in keys])
    return out.withColumn("status", F.when(F.col("dist_m").isNull(), "no_position").otherwise(F.col("status")))


def terminus_rows(rows: DataFrame, patterns: DataFrame, of_version: DataFrame, links: DataFrame, names: DataFrame, aliases: DataFrame, layover_m: float = 10.0) -> DataFrame:
    """Rows at (within layover_m) or heading to the first or last stop of a main pattern, put at that end of it: never counted, LAYOVER.

    They let tracks reach and leave a terminus between two polls. ``rows`` have version.
    """
    name = names.select("stop_id", F.col("stop_name").alias("p_name"))
    t_name = names.select(F.col("stop_id").alias("tid"), F.col("stop_name").alias("t_name"))
    seen = rows.join(name, "stop_id", "left").join(aliases.select("terminus_id", F.col("stop_id").alias("alias")), "terminus_id", "left")
    seen = seen.withColumn("tid", F.coalesce("alias", "terminus_id")).join(t_name, "tid", "left").drop("tid", "alias")
    ends = links.groupBy("pattern_uid").agg(F.min("link_idx").alias("l0"), F.max("link_idx").alias("l1"), F.max_by("len_m", "link_idx").alias("len1"), F.max(F.col("s0_m") + F.col("len_m")).alias("s1"), F.min_by("link_key", "link_idx").alias("k0"), F.max_by("link_key", "link_idx").alias("k1"))
    mains = of_version.where("is_main").select("version", "pattern_uid").join(patterns.select("pattern_uid", F.col("direction_id").alias("p_dir"), F.get("stop_names", 0).alias("n0"), F.element_at("stop_names", -1).alias("n1")), "pattern_uid").join(ends, "pattern_uid")
    at = mains.select("version", "pattern_uid", "p_dir", F.explode(F.array(F.struct(F.col("n0").alias("e_name"), F.col("l0").alias("link_idx"), F.col("k0").alias("link_key"), F.lit(0.0).alias("pos_m"), F.lit(0.0).alias("s_m")), F.struct(F.col("n1").alias("e_name"), F.col("l1").alias("link_idx"), F.col("k1").alias("link_key"), F.col("len1").alias("pos_m"), F.col("s1").alias("s_m")))).alias("e"))
    at = at.select("version", "pattern_uid", "p_dir", "e.*").withColumnRenamed("e_name", "p_name")
    keep = seen.drop("pattern_uid", "link_idx", "link_key", "pos_m", "s_m", "p_dir", "term", "short", "ends_next", "status")
    near = keep.join(F.broadcast(at), ["version", "p_name"]).where((F.col("dist_m") < layover_m) | F.coalesce(F.col("t_name") == F.col("p_name"), F.lit(False)))  # two ends for each main
    return near.withColumn("count", F.lit(False)).withColumn("flags", F.lit(FLAGS["LAYOVER"])).withColumn("term_s_m", F.lit(None).cast("double")).withColumn("direction_id", F.col("p_dir")).drop("p_name", "t_name", "p_dir")


def feed_length_table(rows: DataFrame, links: DataFrame, min_rows: int = 20) -> DataFrame:
    """pattern_uid, link_idx, flen: the 99.5th percentile of feed metres, the schedule's length for links with few rows."""
    seen = feed_lengths(rows.select("pattern_uid", "link_idx", F.col("dist_m").cast("double").alias("pos_m")), min_rows, per_m=1)
    return links.select("pattern_uid", "link_idx", "len_m").join(seen, ["pattern_uid", "link_idx"], "left").select("pattern_uid", "link_idx", F.coalesce("flen", "len_m").alias("flen"), F.coalesce("n", F.lit(0)).alias("n"))


def positions(rows: DataFrame, links: DataFrame, flen: DataFrame, layover_m: float = 10.0) -> DataFrame:
    """Placed rows with pos_m, s_m, term_s_m, flags and count, from located rows of a placed status.

    Rows under layover_m from a pattern's first stop go. Feed metres scale to the link's length; a row under 10 m stands at
    the end of the link before. A short working in the last quarter of the link to its own terminus goes.
    """
    x = rows.where(F.col("status").isin(*PLACED_STATUS) & ~((F.col("link_idx") == 0) & (F.col("dist_m") < layover_m)))
    net = links.select("pattern_uid", "link_idx", "link_key", "s0_m", "len_m")
    x = x.join(F.broadcast(flen.select("pattern_uid", "link_idx", "flen")), ["pattern_uid", "link_idx"])  # a row for each link of the network
    share = F.least(F.col("dist_m").cast("double") / F.col("flen"), F.lit(1.0))
    x = x.withColumn("share", share).where(~(F.col("short") & F.col("ends_next") & (F.col("share") >= END_SHARE)))
    at = F.col("dist_m") < AT_STOP_M
    back = at & (F.col("link_idx") > 0)
    x = x.withColumn("at", at).withColumn("back", back).withColumn("link_idx", F.when(back, F.col("link_idx") - 1).otherwise(F.col("link_idx")))
    x = x.join(F.broadcast(net), ["pattern_uid", "link_idx"])
    pos = F.when(F.col("back"), F.col("len_m")).when(F.col("at"), 0.0).otherwise(F.col("share") * F.col("len_m"))
    x = x.withColumn("pos_m", pos).withColumn("s_m", F.col("s0_m") + F.col("pos_m"))
    term = F.when(F.col("short") & (F.col("link_idx") + 1 == F.col("term")), F.col("s0_m") + F.col("len_m"))
    flags = F.when(F.col("short"), FLAGS["SHORT_WORKING"]).otherwise(0) + F.when(F.col("at"), FLAGS["AT_STOP"]).otherwise(0)
    x = x.withColumn("term_s_m", term).withColumn("flags", flags).withColumn("count", F.lit(True)).withColumn("direction_id", F.col("p_dir"))
    return x.drop("share", "at", "back", "len_m", "s0_m", "flen", "short", "ends_next", "term", "p_dir", "status")


def place_linear(obs: DataFrame, patterns: DataFrame, pattern_days: DataFrame, links: DataFrame, layover_m: float = 10.0, min_rows: int = 20, given: DataFrame | None = None, flen: DataFrame | None = None, pseudo: bool = True, stops: DataFrame | None = None) -> DataFrame:
    """Observations placed on the network, with terminus rows. ``flen`` takes feed lengths of another period, None learns them."""
    rows = located(obs, patterns, pattern_days, given, stops)
    if flen is None:
        kept = rows.where(F.col("status").isin(*PLACED_STATUS) & ~((F.col("link_idx") == 0) & (F.col("dist_m") < layover_m)))
        flen = feed_length_table(kept, links, min_rows)
    out = positions(rows, links, flen, layover_m).drop("version", "network_date")
    if not pseudo:
        return out
    _, of_version = date_versions(obs.select("service_date").distinct(), pattern_days)
    names = stops if stops is not None else stop_names(patterns)
    ends = terminus_rows(rows, patterns, of_version, links, names, aliases_of(rows, of_version, patterns, names, given), layover_m)
    return out.unionByName(ends.drop("version", "network_date").select(*out.columns))


def placement_report(rows: DataFrame, layover_m: float = 10.0) -> DataFrame:
    """Rows for each status of located rows; those dropped at a first stop under their own name."""
    drop = F.col("status").isin(*PLACED_STATUS) & (F.col("link_idx") == 0) & (F.col("dist_m") < layover_m)
    return rows.groupBy(F.when(drop, "layover_first_stop").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def approached(placed: DataFrame, links: DataFrame, approach_m: float) -> DataFrame:
    """Positions of a feed that switches to the next stop approach_m before it: shrunk to [0, len - approach_m], but for rows at a stop or terminus and short links."""
    x = placed.join(F.broadcast(links.select("pattern_uid", "link_idx", F.col("len_m").alias("__len"))), ["pattern_uid", "link_idx"], "left")
    keep = (F.col("flags").bitwiseAND(FLAGS["AT_STOP"] | FLAGS["LAYOVER"]) != 0) | F.col("__len").isNull() | (F.col("__len") <= approach_m)
    moved = F.when(keep, F.col("pos_m")).otherwise(F.col("pos_m") * (F.col("__len") - approach_m) / F.col("__len"))
    return x.withColumn("__pos", moved).withColumn("s_m", F.col("s_m") - F.col("pos_m") + F.col("__pos")).withColumn("pos_m", F.col("__pos")).drop("__pos", "__len").select(*placed.columns)


def link_of(s: Column, stops_s: Column) -> Column:
    """(link_idx, pos_m) of a place along a pattern with stops at ``stops_s``; links are (from, to]."""
    inner = F.size(F.filter(stops_s, lambda x: x < s)) - 1
    i = F.least(F.greatest(inner, F.lit(0)), F.size(stops_s) - 2)
    lo, hi = F.get(stops_s, i), F.get(stops_s, i + 1)
    return F.struct(i.alias("link_idx"), F.least(F.greatest(s - lo, F.lit(0.0)), hi - lo).alias("pos_m"))
