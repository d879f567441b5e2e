"""Registered queries of views and tuning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import grids
from dwellscope.operators import tuning as tu
from dwellscope.operators import views as vw
from dwellscope.plans.analysis import _DISPLAY_SQL, ANALYSIS_SQL, EST_SQL, LINE_SQL, World, _shown, rounded, text_dates
from dwellscope.sources import fixtures as fx


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _values(w):
    """Day values of the shown segments."""
    day = w.ready_estimates().where("col = -3").select("direction_id", "seg_key", F.col("obs_per_passage").alias("opp"), F.col("ref_obs_per_passage").alias("ref"), F.col("ref_line_obs_per_passage").alias("ref_line"))
    return w.places().drop("lo", "hi").join(day, ["direction_id", "seg_key"])


def _fine(s):
    return tu.fine_grid(fx.line_links(s))


def _stretches(s, d):
    p = _read(s, d, "part")
    return p.select((F.col("p_partkey") % 2).cast("int").alias("direction_id"), F.col("p_partkey").alias("stretch"), (F.col("p_partkey") * 37 % 1300).cast("double").alias("from_m"), (F.col("p_partkey") * 37 % 1300 + F.col("p_size") * 3).cast("double").alias("to_m"))


def _fine_cells(s, d, w):
    cube = tu.fine_cube(fx.line_placed(s, d).withColumn("count", F.lit(True)), _fine(s))
    valid = w.mains.join(w.links.select("pattern_uid", "link_key"), "pattern_uid").select("direction_id", "service_date", "link_key").distinct()
    return cube.groupBy("service_date", "hour", "fine_key", "link_key").agg(F.sum("obs").alias("obs")).join(valid, ["service_date", "link_key"])


def _deviance(s, d):
    w = World(s, d)
    return tu.loo_deviance(w.cells(), _fine_cells(s, d, w), w.hours, tu.overlaps(_fine(s), w.segments), w.segments)


def _zone(s, d):
    return tu.stop_zone(fx.line_placed(s, d).withColumn("count", F.lit(True)), fx.line_links(s))


def _lengths(w):
    return w.segments.groupBy("seg_key").agg(F.min("len_m").alias("len_m"))


def _rel(s, d):
    w = World(s, d)
    halves = tu.half_days(w.mains, 3)
    a = tu.half_reliability(w.cells(), w.hours, halves, _lengths(w))
    return a.join(tu.excess_reliability(w.cells(), halves, _lengths(w)), "direction_id", "left")


def _names(s, d):
    p = _read(s, d, "part")
    return p.select("p_partkey", vw.title_name(F.upper(F.concat(F.lit("sainte-"), F.col("p_type"), F.lit(" DU l'"), F.col("p_brand"), F.lit(" XIV")))).alias("title"), vw.colour(F.concat(F.lit("#"), F.lpad(F.hex("p_partkey"), 6, "a"))).alias("colour"))


def _scales(s, d):
    v, m = F.col("l_quantity") / 40, F.col("l_linenumber") * 10.0
    cols = [vw.scale_seconds(n, v, m).alias(f"s_{n}") for n in vw.METRICS] + [vw.scale_value(n, v + 4).alias(f"v_{n}") for n in vw.METRICS]
    lo, mid, hi = vw.speeds_with_interval(v, v * 0.2, v * 1.5, m)
    return _read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *cols, vw.bar_position(v * 20).alias("bar"), vw.change_position(v * 20 - 10).alias("change"), vw.scale_kmh(v * 20).alias("kmh"), lo.alias("k0"), mid.alias("k1"), hi.alias("k2"), vw.per_10_m(v, m).alias("per10"))


def _zones(s):
    links = fx.line_links(s)
    own = links.where("link_idx in (0, 2)").where("pattern_uid <> 'A1' or link_idx = 2").select("pattern_uid", "link_idx", "link_key", (F.col("link_idx") * 7.0 + 5).alias("head"), F.col("len_m").alias("tail"))
    return grids.zoned_links(links, own).select("pattern_uid", "link_idx", "head", "tail")


QUERIES = {
    "stop_zone_overrides": lambda s, d: _zones(s),
    "fine_grid": lambda s, d: rounded(_fine(s)),
    "grid_overlaps": lambda s, d: rounded(tu.overlaps(_fine(s), fx.line_segments(s))),
    "loo_deviance": lambda s, d: rounded(text_dates(_deviance(s, d), "service_date"), 4),
    "half_days": lambda s, d: text_dates(tu.half_days(World(s, d).mains, 3), "service_date"),
    "half_reliability": lambda s, d: rounded(_rel(s, d)),
    "stop_zone_profile": _zone,
    "link_rates": lambda s, d: rounded(tu.link_rates((w := World(s, d)).ready_estimates(), _shown(w))),
    "day_profile": lambda s, d: rounded(tu.profile((w := World(s, d)).ready_estimates(), w.places()), 9),
    "overlapping_stretches": lambda s, d: tu.overlapping(_stretches(s, d).where("to_m < 700"), _stretches(s, d).where("from_m >= 700")).select("stretch"),
    "zone_blocks": lambda s, d: rounded(vw.zone_blocks(_values(World(s, d))).drop("block"), 8),
    "stop_units": lambda s, d: rounded(vw.stop_units(_values(World(s, d))), 8),
    "stretch_totals": lambda s, d: rounded(vw.stretch_total(_values(World(s, d)), _stretches(s, d)), 8),
    "day_calendar": lambda s, d: rounded(text_dates(vw.day_calendar((w := World(s, d)).all_hours, w.status), "service_date")),
    "excluded_reasons": lambda s, d: vw.excluded_reasons(World(s, d).status),
    "headline": lambda s, d: vw.headline(World(s, d).ready_estimates()),
    "hour_runs": lambda s, d: vw.hour_runs(_read(s, d, "events").select("user_id", F.hour("ts").alias("hour")), "user_id", "hour"),
    "title_names": _names,
    "display_scales": lambda s, d: rounded(_scales(s, d), 8),
    "utc_offset": lambda s, d: _read(s, d, "events").select("event_id", vw.utc_offset_s(F.col("ts"), "Europe/Brussels").alias("offset_s")),
}
_FINE = """, fe AS (SELECT *, unnest(list_filter(list_transform(range(0, floor(len_m / 5)::INT + 1), lambda i: i * 5.0::DOUBLE), lambda x: x < len_m AND (x = 0 OR len_m - x >= 1))) AS lo FROM lk),
fg AS (SELECT pattern_uid, link_idx, link_key, lo, coalesce(lead(lo) OVER (PARTITION BY pattern_uid, link_idx ORDER BY lo), len_m) AS hi, (row_number() OVER (PARTITION BY pattern_uid, link_idx ORDER BY lo) - 1)::INT AS k, (row_number() OVER (PARTITION BY pattern_uid ORDER BY link_idx, lo) - 1)::INT AS seg_idx FROM fe),
ff AS (SELECT *, link_key || '/f' || k AS fine_key FROM fg), ov AS (SELECT f.pattern_uid, f.fine_key, s.seg_key, least(f.hi, s.hi) - greatest(f.lo, s.lo) AS w FROM ff f JOIN sg s ON s.pattern_uid = f.pattern_uid AND s.link_idx = f.link_idx AND least(f.hi, s.hi) - greatest(f.lo, s.lo) > 0)
"""
_LINE = LINE_SQL.rstrip().rstrip(",") + "\n"
_AN = ANALYSIS_SQL + "z0 AS (SELECT 1)\n"
_VALUES = EST_SQL + "," + _DISPLAY_SQL + """, vv AS (SELECT e.direction_id, s.seg_key, s.seg_idx, s.link_idx, s.x0_m, s.seg_m AS len_m, s.zone, obs_per_passage AS opp, ref_obs_per_passage AS ref, ref_line_obs_per_passage AS ref_line, obs_per_h / s.seg_m AS value
FROM est e JOIN disp p ON p.direction_id = e.direction_id AND place = 1 JOIN sg s ON s.pattern_uid = p.pattern_uid AND s.seg_key = e.seg_key WHERE col = -3)
"""
_PARTS = "(SELECT (p_partkey % 2)::INT AS direction_id, p_partkey AS stretch, (p_partkey * 37 % 1300)::DOUBLE AS from_m, (p_partkey * 37 % 1300 + p_size * 3)::DOUBLE AS to_m FROM part)"
_HALF = """, hf AS (SELECT *, ((row_number() OVER (PARTITION BY split, isodow(day) ORDER BY md5('0:' || split || ':' || day::VARCHAR), day) + ('0x' || substr(md5('0/' || split || '/' || (isodow(day) - 1)), 1, 2))::BIGINT % 2) % 2)::INT AS half FROM (SELECT DISTINCT day FROM mn), range(0, 3) r(split))
"""
ORACLE_SQL = {
    "stop_zone_overrides": _LINE + """, ow AS (SELECT pattern_uid, link_idx, link_key, link_idx * 7.0::DOUBLE + 5 AS head, len_m AS tail FROM lk WHERE link_idx IN (0, 2) AND (pattern_uid <> 'A1' OR link_idx = 2)), ky AS (SELECT link_key, quantile_cont(head, 0.5) AS h, quantile_cont(tail, 0.5) AS t FROM ow GROUP BY ALL)
SELECT l.pattern_uid, l.link_idx, coalesce(o.head, k.h, 60)::DOUBLE AS head, coalesce(o.tail, k.t, 30)::DOUBLE AS tail FROM lk l LEFT JOIN ow o ON o.pattern_uid = l.pattern_uid AND o.link_idx = l.link_idx LEFT JOIN ky k ON k.link_key = l.link_key""",
    "fine_grid": _LINE + _FINE + "SELECT pattern_uid, link_idx, link_key, fine_key AS seg_key, k, lo, hi, seg_idx FROM ff",
    "grid_overlaps": _LINE + _FINE + "SELECT pattern_uid, fine_key, seg_key, round(w, 6) + 0.0::DOUBLE AS w FROM ov",
    "loo_deviance": _AN + _FINE + """, rt AS (SELECT c.*, sum(obs) OVER w - obs AS rn, sum(coverage) OVER w - coverage AS rc FROM cells c WINDOW w AS (PARTITION BY direction_id, seg_key, hour)),
pm AS (SELECT direction_id, day, hour, r.seg_key, coverage, CASE WHEN rc > 1e-12 THEN rn / rc ELSE 0 END / m AS per_m FROM rt r JOIN (SELECT seg_key, min(seg_m) AS m FROM sg GROUP BY ALL) USING (seg_key)),
mu AS (SELECT direction_id, day, hour, fine_key, greatest(sum(per_m * w * coverage), 1e-6) AS mu FROM pm JOIN (SELECT DISTINCT fine_key, seg_key, w FROM ov) USING (seg_key) GROUP BY ALL),
fc AS (SELECT p.day, p.hour, f.fine_key, f.link_key, count(*) AS obs FROM pl p JOIN lk l USING (pattern_uid, link_idx) JOIN ff f ON f.pattern_uid = p.pattern_uid AND f.link_idx = p.link_idx AND least(p.pos_m, l.len_m) > f.lo AND least(p.pos_m, l.len_m) <= f.hi GROUP BY ALL),
vl AS (SELECT DISTINCT m.direction_id, m.day, l.link_key FROM mn m JOIN lk l ON l.pattern_uid = m.pattern_uid), fy AS (SELECT direction_id, day, hour, fine_key, sum(obs) AS obs FROM fc JOIN vl USING (day, link_key) GROUP BY ALL)
SELECT day::VARCHAR AS service_date, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)), 4) + 0.0::DOUBLE AS deviance FROM (SELECT mu.*, coalesce(obs, 0)::DOUBLE AS y FROM mu LEFT JOIN fy USING (direction_id, day, hour, fine_key)) GROUP BY ALL""",
    "half_days": _AN + _HALF + "SELECT split::INT AS split, day::VARCHAR AS service_date, half FROM hf",
    "half_reliability": _AN + _HALF + """, ln_ AS (SELECT seg_key, min(seg_m) AS m FROM sg GROUP BY ALL), ra AS (SELECT split, direction_id, seg_key, hour, sum(obs) FILTER (half = 0) / nullif(sum(coverage) FILTER (half = 0), 0) / any_value(m) AS a, sum(obs) FILTER (half = 1) / nullif(sum(coverage) FILTER (half = 1), 0) / any_value(m) AS b FROM cells JOIN hf USING (day) JOIN ln_ USING (seg_key) WHERE hour BETWEEN 6 AND 20 GROUP BY ALL),
rb AS (SELECT split, direction_id, greatest(corr(a, b), 0) AS c, var_pop(a - b) / 4 AS noise, var_pop((a + b) / 2) AS total FROM ra WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
rc AS (SELECT direction_id, avg(2 * c / (1 + c)) AS reliability, quantile_cont((total - noise) / noise, 0.5) AS snr FROM rb GROUP BY ALL),
xa AS (SELECT split, direction_id, seg_key, half, (sum(obs) FILTER (hour BETWEEN 6 AND 20) / nullif(sum(passages) FILTER (hour BETWEEN 6 AND 20), 0) - sum(obs) FILTER (hour BETWEEN 20 AND 23) / nullif(sum(passages) FILTER (hour BETWEEN 20 AND 23), 0)) / any_value(m) AS x FROM cells JOIN hf USING (day) JOIN ln_ USING (seg_key) GROUP BY ALL),
xb AS (SELECT split, direction_id, seg_key, max(x) FILTER (half = 0) AS a, max(x) FILTER (half = 1) AS b FROM xa GROUP BY ALL), xc AS (SELECT split, direction_id, greatest(corr(a, b), 0) AS c FROM xb WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT rc.direction_id, round(reliability, 6) + 0.0::DOUBLE AS reliability, round(snr, 6) + 0.0::DOUBLE AS snr, round((SELECT avg(2 * c / (1 + c)) FROM xc WHERE xc.direction_id = rc.direction_id), 6) + 0.0::DOUBLE AS reliability_excess FROM rc""",
    "stop_zone_profile": _LINE + """, ds AS (SELECT 'up' AS side, len_m - pos_m AS d FROM pl JOIN lk USING (pattern_uid, link_idx) UNION ALL SELECT 'down', pos_m FROM pl JOIN lk USING (pattern_uid, link_idx)), ct AS (SELECT side, least(floor(d / 5), 29)::INT AS bin, count(*) AS n FROM ds WHERE d BETWEEN 0 AND 150 GROUP BY ALL),
g AS (SELECT side, b::INT AS bin FROM (VALUES ('up'), ('down')) s(side), range(0, 30) r(b)), ex AS (SELECT b AS bin, count(*) AS e FROM lk, range(0, 30) r(b) WHERE len_m >= (b + 1) * 5 GROUP BY ALL), dn AS (SELECT side, bin, coalesce(n, 0) / greatest(coalesce(e, 0), 1) AS dens FROM g LEFT JOIN ct USING (side, bin) LEFT JOIN ex USING (bin)),
bs AS (SELECT side, quantile_cont(dens, 0.5) FILTER (bin * 5 >= 100) AS base FROM dn GROUP BY ALL) SELECT side, coalesce(min(bin) FILTER (NOT dens > 1.5 * base), 30) * 5.0::DOUBLE AS metres FROM dn JOIN bs USING (side) GROUP BY ALL""",
    "link_rates": EST_SQL + "," + _DISPLAY_SQL + "SELECT e.direction_id, e.link_key, round(sum(coalesce(obs_per_h, 0)), 6) + 0.0::DOUBLE AS obs_per_h FROM est e JOIN disp p ON p.direction_id = e.direction_id AND place = 1 JOIN sg s ON s.pattern_uid = p.pattern_uid AND s.seg_key = e.seg_key WHERE col = -3 GROUP BY ALL",
    "day_profile": _VALUES + "SELECT direction_id, x * 10 + 5.0::DOUBLE AS x_m, round(value, 9) + 0.0::DOUBLE AS value FROM vv JOIN range(0, 200) r(x) ON x * 10 + 5 >= x0_m AND x * 10 + 5 < x0_m + len_m",
    "overlapping_stretches": f"SELECT DISTINCT a.stretch FROM {_PARTS} a JOIN {_PARTS} b ON a.direction_id = b.direction_id AND a.from_m <= b.to_m + 30 AND a.to_m >= b.from_m - 30 WHERE a.to_m < 700 AND b.from_m >= 700",
    "zone_blocks": _VALUES + """, b0 AS (SELECT *, CASE WHEN zone = 'stop' AND lag(zone) OVER (PARTITION BY direction_id ORDER BY seg_idx) = 'stop' THEN 0 ELSE 1 END AS nw FROM vv), b1 AS (SELECT *, sum(nw) OVER (PARTITION BY direction_id ORDER BY seg_idx) AS block FROM b0)
SELECT direction_id, round(min(x0_m), 8) + 0.0::DOUBLE AS from_m, round(max(x0_m + len_m), 8) + 0.0::DOUBLE AS to_m, min(zone) AS zone, round(CASE WHEN count(opp) = count(*) THEN sum(opp) END, 8) + 0.0::DOUBLE AS opp FROM b1 GROUP BY direction_id, block""",
    "stop_units": _VALUES + """, u0 AS (SELECT *, min(seg_idx) FILTER (zone <> 'stop') OVER (PARTITION BY direction_id, link_idx) AS r0 FROM vv), u1 AS (SELECT *, CASE WHEN zone = 'stop' AND seg_idx < r0 THEN link_idx - 1 ELSE link_idx END AS unit FROM u0)
SELECT direction_id, unit, round(min(x0_m), 8) + 0.0::DOUBLE AS from_m, round(max(x0_m + len_m), 8) + 0.0::DOUBLE AS to_m, round(sum(len_m), 8) + 0.0::DOUBLE AS len_m, round(CASE WHEN count(opp) = count(*) THEN sum(opp) END, 8) + 0.0::DOUBLE AS opp FROM u1 WHERE unit >= 0 GROUP BY direction_id, unit""",
    "stretch_totals": _VALUES + f"""SELECT s.direction_id, stretch, count(*) AS n_segs, round(sum(len_m), 8) + 0.0::DOUBLE AS len_m, round(CASE WHEN count(opp) = count(*) THEN sum(opp) END, 8) + 0.0::DOUBLE AS opp, round(CASE WHEN count(ref) = count(*) THEN sum(ref) END, 8) + 0.0::DOUBLE AS ref, round(CASE WHEN count(ref_line) = count(*) THEN sum(ref_line) END, 8) + 0.0::DOUBLE AS ref_line
FROM {_PARTS} s JOIN vv ON vv.direction_id = s.direction_id AND x0_m + len_m > from_m + 0.5 AND x0_m < to_m - 0.5 GROUP BY ALL""",
    "day_calendar": _AN + "SELECT d.day::VARCHAR AS service_date, round((SELECT sum(coalesce(coverage, 0)) FROM hs WHERE hs.day = d.day AND hour BETWEEN 6 AND 20) / 15, 6) + 0.0::DOUBLE AS coverage, coalesce(reason, 'included') AS status FROM ds d",
    "excluded_reasons": _AN + "SELECT CASE WHEN reason IN ('low_coverage', 'frozen', 'no_data') THEN 'feed' ELSE reason END AS reason, count(*) AS n_days FROM ds WHERE reason IS NOT NULL GROUP BY ALL",
    "headline": EST_SQL + "SELECT sum(obs) AS obs, count(DISTINCT (direction_id, seg_key)) AS n_segments FROM est WHERE col >= 0",
    "hour_runs": "WITH e AS (SELECT DISTINCT user_id, hour(ts)::INT AS h FROM events), k AS (SELECT *, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM e) SELECT user_id, min(h) AS first, max(h) AS last FROM k GROUP BY user_id, g",
    "utc_offset": "SELECT event_id, (epoch(timezone('Europe/Brussels', timezone('UTC', ts))) - epoch(ts))::BIGINT AS offset_s FROM events",
    "display_scales": """WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity::DOUBLE / 40 AS v, l_linenumber * 10.0::DOUBLE AS m FROM lineitem), y AS (SELECT *, 30 / m AS u FROM x)
SELECT l_orderkey, l_partkey, l_suppkey, """ + ", ".join(
        f"round({e}, 8) + 0.0::DOUBLE AS {n}" for n, e in {
            "s_obs_per_passage": "v * 20 * u", "s_excess_per_passage": "3 + greatest(v * 20 * u, 0)", "s_excess_line_per_passage": "3 + greatest(v * 20 * u, 0)", "s_obs_per_h": "v * u * 2", "s_obs_per_h_10m": "v * 3 * 2", "s_excess_obs_per_h": "3 + greatest(v * u * 2, 0)", "s_log2_ratio": "3 * pow(2, greatest(v, 0))",
            "v_obs_per_passage": "v + 4", "v_excess_per_passage": "v + 1", "v_excess_line_per_passage": "v + 1", "v_obs_per_h": "(v + 4) / 2", "v_obs_per_h_10m": "(v + 4) / 6", "v_excess_obs_per_h": "(v + 1) / 2", "v_log2_ratio": "log2((v + 4) / 3)",
            "bar": "(least(greatest(v * 20, 3), 24) - 3) / 21", "change": "(least(greatest(v * 20 - 10, -10), 10) + 10) / 20", "kmh": "108 / greatest(v * 20, 1e-9)", "k0": "least(80, 3.6 * m / greatest(v * 20, 1e-9))", "k1": "least(80, 3.6 * m / greatest(v * 30, 1e-9))", "k2": "NULL::DOUBLE", "per10": "v * 10 / m",
        }.items()) + " FROM y",
}
