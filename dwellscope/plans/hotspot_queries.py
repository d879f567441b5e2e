"""Registered queries of hotspots, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import hotspots as hs
from dwellscope.plans.analysis import _DISPLAY_SQL, ANALYSIS_SQL, World, rounded
from dwellscope.plans.more import _CHEB, _ERFC, _WEIGHTS

DRAWS, THETA, HOURS = 20, -0.03, (5, 24)
#: Loose limits, so that the small line has candidates.
Q, LEVEL, PERSISTENCE, HOUR_SHARE = 0.9, 0.5, 0.2, 0.2


def _peak(w):
    return hs.peak_candidates(w.bins(), THETA, HOURS, Q, PERSISTENCE)


def _steady(w):
    return hs.persistent_statistics(w.bins(), w.places(), THETA, q=Q, min_persistence=PERSISTENCE, min_hour_share=HOUR_SHARE, level=0.95)


def _marked(w):
    zoned = hs.numbered(w.places()).select("direction_id", "seg_key", "j", "zc")
    return hs.segment_hours(_peak(w), HOURS).join(zoned, ["direction_id", "seg_key"])


def _lists(df, *names):
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if c in names else F.col(c) for c in df.columns])


def _joined(w):
    return hs.joined_stretches(hs.zoned_stretches(_marked(w)), hs.persistent_stretches(_steady(w), w.bins(), w.places(), THETA, HOURS))


def _hotspots(w):
    return hs.hotspots(w.bins(), w.mains, w.places(), w.links, 1.0, THETA, q=Q, min_persistence=PERSISTENCE, min_hour_share=HOUR_SHARE)


QUERIES = {
    "hotspot_bins": lambda s, d: rounded(_peak(World(s, d)).select("direction_id", "seg_key", "col", "obs", "passages", "x", "lo", "hi", "se", "p", "persistence", "reject", "candidate"), 8),
    "persistent_bins": lambda s, d: rounded(_steady(World(s, d)).select("direction_id", "seg_key", "j", "level", "x", "lo", "hi", "se", "p", "persistence", "hour_share", "evening_share", "candidate"), 8),
    "segment_hours": lambda s, d: _lists(_marked(World(s, d)).select("direction_id", "seg_key", "j", "hours"), "hours"),
    "peak_stretches": lambda s, d: _lists(hs.zoned_stretches(_marked(World(s, d))).drop("stretch", "zc"), "hours"),
    "joined_stretches": lambda s, d: _lists(_joined(World(s, d)).drop("stretch", "zc"), "peak_hours", "persistent_hours"),
    "hotspots": lambda s, d: rounded(_lists(_hotspots(World(s, d)), "hours", "peak_hours"), 5),
}

_BINS = (
    ANALYSIS_SQL
    + _DISPLAY_SQL
    + """, plc AS (SELECT p.direction_id, s.seg_key, s.link_key, s.seg_m AS len_m, s.zone, s.x0_m, (row_number() OVER (PARTITION BY p.direction_id ORDER BY s.seg_idx) - 1)::INT AS j FROM disp p JOIN sg s ON s.pattern_uid = p.pattern_uid WHERE p.place = 1),
daily0 AS (SELECT DISTINCT direction_id, day FROM mn), """
    + _WEIGHTS.format(draws=DRAWS).strip().removeprefix(",").replace("FROM daily)", "FROM daily0)").replace("SELECT DISTINCT day,", "SELECT DISTINCT direction_id, day,").replace("PARTITION BY dow", "PARTITION BY direction_id, dow")
    .replace("SELECT DISTINCT dow, n FROM num", "SELECT DISTINCT direction_id, dow, n FROM num").replace("SELECT dow, n, draw", "SELECT direction_id, dow, n, draw").replace("SELECT draw::INT AS draw, day,", "SELECT direction_id, draw::INT AS draw, day,").replace("USING (dow, pos)", "USING (direction_id, dow, pos)").replace("CASE WHEN ct.n > 1", "CASE WHEN num.n > 1").replace("times * ct.n / (ct.n - 1)", "times * num.n / (num.n - 1)")
    + f""",
xb AS (SELECT * FROM (VALUES (-1, 7, 10), (-2, 16, 19), (-9, 6, 23)) b(col, a, z)),
cl AS (SELECT c.direction_id, c.day, c.seg_key, c.hour, c.hour AS col, obs, passages FROM cells c JOIN plc USING (direction_id, seg_key) UNION ALL SELECT c.direction_id, c.day, c.seg_key, c.hour, b.col, obs, passages FROM cells c JOIN plc USING (direction_id, seg_key) JOIN xb b ON c.hour >= b.a AND c.hour < b.z),
pd AS (SELECT direction_id, day, seg_key, col, sum(obs) AS o, sum(passages) AS p, 1 AS m FROM cl GROUP BY ALL),
ev AS (SELECT direction_id, day, seg_key, sum(obs) AS o, sum(passages) AS p FROM cl WHERE col BETWEEN 20 AND 23 GROUP BY ALL),
f0 AS (SELECT direction_id, seg_key, col, sum(o) AS obs, sum(p) AS passages, CASE WHEN sum(p) > 0 AND (max(col) = -9 OR sum(p) >= 0.0973 * sum(m)) THEN sum(o) / sum(p) END AS opp FROM pd GROUP BY ALL),
r0 AS (SELECT direction_id, seg_key, CASE WHEN sum(p) > 0 THEN sum(o) / sum(p) END AS ref FROM ev GROUP BY ALL),
f1 AS (SELECT direction_id, seg_key, col, draw, CASE WHEN sum(p * w) > 0 AND (max(col) = -9 OR sum(p * w) >= 0.0973 * sum(m * w)) THEN sum(o * w) / sum(p * w) END AS opp FROM pd JOIN wts USING (direction_id, day) GROUP BY ALL),
r1 AS (SELECT direction_id, seg_key, draw, CASE WHEN sum(p * w) > 0 THEN sum(o * w) / sum(p * w) END AS ref FROM ev JOIN wts USING (direction_id, day) GROUP BY ALL),
dr AS (SELECT direction_id, seg_key, col, quantile_cont(opp - ref, 0.025) AS lo, quantile_cont(opp - ref, 0.975) AS hi, stddev_samp(opp - ref) AS se FROM f1 LEFT JOIN r1 USING (direction_id, seg_key, draw) GROUP BY ALL),
ps AS (SELECT direction_id, seg_key, col, avg((o / p - CASE WHEN col = -9 THEN 0 ELSE ref END > 0)::INT) FILTER (p > 0 AND (col = -9 OR ref IS NOT NULL)) AS persistence FROM pd LEFT JOIN r0 USING (direction_id, seg_key) GROUP BY ALL),
bn AS (SELECT f0.direction_id, f0.seg_key, f0.col, f0.obs::DOUBLE AS obs, f0.passages::DOUBLE AS passages, f0.opp, ref, f0.opp - ref AS xx, lo, hi, se, persistence FROM f0 LEFT JOIN r0 USING (direction_id, seg_key) LEFT JOIN dr USING (direction_id, seg_key, col) LEFT JOIN ps USING (direction_id, seg_key, col)),
pk0 AS (SELECT *, CASE WHEN se > 0 THEN (xx - {THETA}) / se / sqrt(2) END AS x, 1 / (1 + abs(x) / 2) AS t, t * exp({_CHEB} - x * x) AS u FROM bn WHERE col IN (-1, -2) OR col BETWEEN 5 AND 23),
pk1 AS (SELECT *, CASE WHEN xx IS NULL THEN NULL WHEN se > 0 THEN 0.5 * {_ERFC} WHEN xx > {THETA} THEN 0.0 ELSE 1.0 END::DOUBLE AS pv FROM pk0),
pk2 AS (SELECT direction_id, seg_key, col, pv, row_number() OVER (PARTITION BY direction_id ORDER BY pv, seg_key, col) AS k, count(*) OVER (PARTITION BY direction_id) AS m FROM pk1 WHERE pv IS NOT NULL),
pk3 AS (SELECT direction_id, max(k) FILTER (pv <= {Q} * k / m) AS top FROM pk2 GROUP BY ALL),
pkc AS (SELECT pk1.direction_id, seg_key, col, obs, passages, xx, lo, hi, se, pk1.pv AS p, persistence, coalesce(k <= top, false) AS reject, coalesce(lo > {THETA} AND persistence >= {PERSISTENCE} AND coalesce(k <= top, false), false) AS candidate FROM pk1 LEFT JOIN pk2 USING (direction_id, seg_key, col) LEFT JOIN pk3 ON pk3.direction_id = pk1.direction_id),
"""
)
_STEADY = (
    _BINS
    + f"""lv0 AS (SELECT direction_id, quantile_cont(opp / len_m, 0.5) AS level FROM bn JOIN plc USING (direction_id, seg_key) WHERE col = -9 AND zone = 'running' GROUP BY ALL),
lv1 AS (SELECT direction_id, draw, quantile_cont(opp / len_m, 0.5) AS m FROM f1 JOIN plc USING (direction_id, seg_key) WHERE col = -9 AND zone = 'running' GROUP BY ALL),
sd AS (SELECT direction_id, seg_key, quantile_cont(opp - m * len_m, 0.025) AS lo, quantile_cont(opp - m * len_m, 0.975) AS hi, stddev_samp(opp - m * len_m) AS se FROM f1 JOIN plc USING (direction_id, seg_key) JOIN lv1 USING (direction_id, draw) WHERE col = -9 GROUP BY ALL),
sp_ AS (SELECT direction_id, seg_key, avg((o / p - level * len_m > 0)::INT) FILTER (p > 0) AS persistence FROM pd JOIN plc USING (direction_id, seg_key) JOIN lv0 USING (direction_id) WHERE col = -9 GROUP BY ALL),
sh_ AS (SELECT direction_id, seg_key, avg((obs / passages - level * len_m > {THETA})::INT) AS hour_share, avg((obs / passages - level * len_m > {THETA})::INT) FILTER (col BETWEEN 20 AND 23) AS evening_share FROM bn JOIN plc USING (direction_id, seg_key) JOIN lv0 USING (direction_id) WHERE col BETWEEN 6 AND 22 AND passages > 0 GROUP BY ALL),
s0 AS (SELECT bn.direction_id, bn.seg_key, j, zone, level, opp - level * len_m AS xx, sd.lo, sd.hi, sd.se, sp_.persistence, hour_share, evening_share FROM bn JOIN plc USING (direction_id, seg_key) JOIN lv0 USING (direction_id) LEFT JOIN sd USING (direction_id, seg_key) LEFT JOIN sp_ USING (direction_id, seg_key) LEFT JOIN sh_ USING (direction_id, seg_key) WHERE col = -9),
s1 AS (SELECT *, CASE WHEN se > 0 THEN (xx - {THETA}) / se / sqrt(2) END AS x, 1 / (1 + abs(x) / 2) AS t, t * exp({_CHEB} - x * x) AS u FROM s0),
s2 AS (SELECT *, CASE WHEN zone <> 'running' OR xx IS NULL THEN NULL WHEN se > 0 THEN 0.5 * {_ERFC} WHEN xx > {THETA} THEN 0.0 ELSE 1.0 END::DOUBLE AS pv FROM s1),
s3 AS (SELECT direction_id, seg_key, pv, row_number() OVER (PARTITION BY direction_id ORDER BY pv, seg_key) AS k, count(*) OVER (PARTITION BY direction_id) AS m FROM s2 WHERE pv IS NOT NULL), s4 AS (SELECT direction_id, max(k) FILTER (pv <= {Q} * k / m) AS top FROM s3 GROUP BY ALL),
st_ AS (SELECT s2.direction_id, s2.seg_key, j, zone, level, xx, lo, hi, se, s2.pv AS p, persistence, hour_share, evening_share, coalesce(zone = 'running' AND lo > {THETA} AND persistence >= {PERSISTENCE} AND coalesce(k <= top, false) AND hour_share >= {HOUR_SHARE} AND evening_share >= 0.5, false) AS candidate
  FROM s2 LEFT JOIN s3 USING (direction_id, seg_key) LEFT JOIN s4 ON s4.direction_id = s2.direction_id),
"""
)
_MARK = f"""hc AS (SELECT direction_id, seg_key, col AS h FROM pkc WHERE candidate AND col >= 0),
hh AS (SELECT a.direction_id, a.seg_key, a.h FROM hc a JOIN hc b ON a.direction_id = b.direction_id AND a.seg_key = b.seg_key AND abs(a.h - b.h) = 1 UNION SELECT direction_id, seg_key, x.h::INT FROM pkc JOIN range(0, 28) x(h) ON (col = -1 AND x.h BETWEEN 7 AND 9) OR (col = -2 AND x.h BETWEEN 16 AND 18) WHERE candidate AND col < 0),
zz AS (SELECT *, sum(CASE WHEN zone <> pz THEN 1 ELSE 0 END) OVER (PARTITION BY direction_id ORDER BY j) AS zc FROM (SELECT *, lag(zone, 1, zone) OVER (PARTITION BY direction_id ORDER BY j) AS pz FROM plc)),
mk AS (SELECT z.direction_id, z.seg_key, z.j, z.zc, list_sort(list(DISTINCT h)) AS hours FROM hh JOIN zz z USING (direction_id, seg_key) GROUP BY ALL),
p0 AS (SELECT *, CASE WHEN lag(j) OVER w IS NULL OR j - lag(j) OVER w > 2 OR lag(zc) OVER w <> zc THEN 1 ELSE 0 END AS nw FROM mk WINDOW w AS (PARTITION BY direction_id ORDER BY j)),
p1 AS (SELECT *, sum(nw) OVER (PARTITION BY direction_id ORDER BY j) AS stretch FROM p0),
pst AS (SELECT direction_id, stretch, min(j) AS j0, max(j) AS j1, min(zc) AS zc, list_sort(list_distinct(flatten(list(hours)))) AS hours FROM p1 GROUP BY ALL),
"""
_JOIN = f"""q0 AS (SELECT st_.direction_id, st_.j, z.zc FROM st_ JOIN zz z USING (direction_id, seg_key) WHERE candidate),
q1 AS (SELECT *, CASE WHEN lag(j) OVER w IS NULL OR j - lag(j) OVER w > 2 OR lag(zc) OVER w <> zc THEN 1 ELSE 0 END AS nw FROM q0 WINDOW w AS (PARTITION BY direction_id ORDER BY j)),
q2 AS (SELECT direction_id, min(j) AS j0, max(j) AS j1, min(zc) AS zc FROM (SELECT *, sum(nw) OVER (PARTITION BY direction_id ORDER BY j) AS g FROM q1) GROUP BY direction_id, g),
q3 AS (SELECT q2.direction_id, j0, j1, zc, col, sum(obs / passages - level * len_m) AS x FROM q2 JOIN plc p ON p.direction_id = q2.direction_id AND p.j BETWEEN j0 AND j1 JOIN bn ON bn.direction_id = p.direction_id AND bn.seg_key = p.seg_key JOIN lv0 ON lv0.direction_id = q2.direction_id WHERE col BETWEEN 6 AND 22 AND passages > 0 GROUP BY ALL),
q4 AS (SELECT direction_id, j0, j1, zc, coalesce(list_sort(list(col) FILTER (x > {THETA})), []) AS hours FROM q3 GROUP BY ALL),
u0 AS (SELECT direction_id, j0, j1, zc, hours AS a, []::INT[] AS b FROM pst UNION ALL SELECT direction_id, j0, j1, zc, []::INT[], hours FROM q4),
u1 AS (SELECT *, max(j1) OVER w AS top, max(zc) OVER w AS tz FROM u0 WINDOW w AS (PARTITION BY direction_id ORDER BY j0, j1, len(a) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u2 AS (SELECT *, CASE WHEN top IS NULL OR j0 - top > 2 OR (top < j0 AND tz <> zc) THEN 1 ELSE 0 END AS nw FROM u1), u3 AS (SELECT *, sum(nw) OVER (PARTITION BY direction_id ORDER BY j0, j1, len(a) ROWS UNBOUNDED PRECEDING) AS stretch FROM u2),
jn AS (SELECT direction_id, min(j0) AS j0, max(j1) AS j1, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') AS peak_hours, array_to_string(list_sort(list_distinct(flatten(list(b)))), ',') AS persistent_hours,
  max(len(a) > 0 OR (len(a) = 0 AND len(b) = 0 AND nw = 1)) AS is_peak, max(len(b) > 0) AS is_persistent FROM u3 GROUP BY direction_id, stretch)
"""


def _round(names):
    return ", ".join(f"round({c}, 8) + 0.0::DOUBLE AS {n}" for n, c in names)


ORACLE_SQL = {
    "hotspot_bins": _BINS + "done AS (SELECT 1) SELECT direction_id, seg_key, col, reject, candidate, " + _round((n, "xx" if n == "x" else n) for n in ("obs", "passages", "x", "lo", "hi", "se", "p", "persistence")) + " FROM pkc",
    "persistent_bins": _STEADY + "done AS (SELECT 1) SELECT direction_id, seg_key, j, candidate, " + _round((n, "xx" if n == "x" else n) for n in ("level", "x", "lo", "hi", "se", "p", "persistence", "hour_share", "evening_share")) + " FROM st_",
    "segment_hours": _BINS + _MARK + "done AS (SELECT 1) SELECT direction_id, seg_key, j, array_to_string(hours, ',') AS hours FROM mk",
    "peak_stretches": _BINS + _MARK + "done AS (SELECT 1) SELECT direction_id, j0, j1, array_to_string(hours, ',') AS hours FROM pst",
    "joined_stretches": _STEADY + _MARK + _JOIN + "SELECT * FROM jn",
}
