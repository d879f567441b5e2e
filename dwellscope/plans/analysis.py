"""Registered queries of feed health and the analysis of a cube, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import analysis as an
from dwellscope.operators import health
from dwellscope.operators import hotspots as hs
from dwellscope.sources import fixtures as fx
from dwellscope.sources.store import once


def text_dates(df, *names):
    return df.select(*[F.col(c).cast("string").alias(c) if c in names else F.col(c) for c in df.columns])


def rounded(df, digits=6):
    """Doubles rounded, so that sums in another order agree."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])  # no minus zero


#: Limits that leave days in and days out on the small line.
MIN_COVERAGE, MIN_DAY = 0.5, 0.4


class World:
    """The small line's tables and the first steps of its analysis."""

    def __init__(self, s, d, first=None, last=None):
        # the prepared tables, written once
        self.cube = once(s, ("cube", d), lambda: fx.line_cube(s, d))
        self.passages = once(s, ("passages", d), lambda: fx.line_passages(s, d))
        self.coverage = once(s, ("coverage", d), lambda: fx.line_coverage(s, d))
        self.spark, self.dir = s, d
        self.segments, self.links, self.pattern_days = fx.line_segments(s), fx.line_links(s), fx.line_pattern_days(s)
        self.days = an.selected_days(self.cube, self.coverage, first=first, last=last)
        self.all_hours = an.hour_status(self.days, self.coverage, MIN_COVERAGE)
        self.status = an.day_status(self.all_hours, ("2024-01-10",), MIN_DAY)
        self.hours = once(s, ("hours", d, first, last), lambda: an.included_hours(self.all_hours, self.status))
        self.mains = once(s, ("mains", d, first, last), lambda: an.day_mains(self.pattern_days, self.status))
        self.span = (first, last)

    def totals(self):
        return an.totals(self.hours, self.mains, self.segments, self.cube, self.passages)

    def strata(self):
        return self.days.where("service_date <> '2024-01-10'").groupBy(F.weekday("service_date").alias("dow")).agg(F.count(F.lit(1)).alias("n"))

    def cells(self):
        return an.day_cells(self.hours, self.mains, self.segments, self.cube, self.passages)

    def estimates(self, **kw):
        return an.estimates(self.totals(), self.segments, min_passages=0.1, **kw)

    def ready_estimates(self):
        """The estimates as a written table, for queries on top of them."""
        return once(self.spark, ("estimates", self.dir, *self.span), self.estimates)

    def places(self):
        return hs.shown_places(once(self.spark, ("display", self.dir, *self.span), lambda: an.display_patterns(self.mains, self.segments)), self.segments)

    def bins(self, n_draws=20, seed=0):
        """Bin statistics of the shown places, written once."""
        make = lambda: hs.bin_statistics(self.cells().join(self.places().select("direction_id", "seg_key"), ["direction_id", "seg_key"], "left_semi"), self.mains, n_draws, min_passages=0.0973, seed=seed)
        return once(self.spark, ("bins", self.dir, *self.span, n_draws, seed), make)


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}" for x in r) + ")" for r in rows)


def _link_rows():
    for uid, (direction, links) in fx.LINE.items():
        at = 0.0
        for i, (key, a, b, m) in enumerate(links):
            yield uid, direction, i, key, a, b, at, m
            at += m


#: The small line in SQL.
LINE_SQL = f"""WITH lk AS (SELECT pattern_uid, direction_id, link_idx, link_key, from_stop, to_stop, s0::DOUBLE AS s0_m, m::DOUBLE AS len_m FROM (VALUES {_values(_link_rows())}) v(pattern_uid, direction_id, link_idx, link_key, from_stop, to_stop, s0, m)),
gr AS (SELECT *, greatest(1, round_even(len_m / 30, 0))::INT AS n FROM lk),
sg AS (SELECT pattern_uid, direction_id, link_idx, link_key, k, k * (len_m / n) AS lo, CASE WHEN k = n - 1 THEN len_m ELSE (k + 1) * (len_m / n) END AS hi, s0_m + lo AS x0_m, hi - lo AS seg_m, link_key || '/' || k AS seg_key,
  CASE WHEN k = 0 OR k = n - 1 THEN 'stop' ELSE 'running' END AS zone, (row_number() OVER (PARTITION BY pattern_uid ORDER BY link_idx, k) - 1)::INT AS seg_idx FROM (SELECT *, unnest(range(0, n))::INT AS k FROM gr)),
pl AS (SELECT DATE '2024-01-01' + (l_orderkey % {fx.N_DAYS})::INT AS day, (4 + l_partkey % 24)::INT AS hour, (l_suppkey % 2)::INT AS direction_id, CASE WHEN l_suppkey % 2 = 1 THEN 'B0' WHEN l_orderkey % {fx.N_DAYS} < {fx.CHANGE} THEN 'A0' ELSE 'A1' END AS pattern_uid,
  ((l_linenumber - 1) % 5)::INT AS link_idx, l_quantity * 6.1::DOUBLE AS pos_m, l_orderkey AS track_id FROM lineitem),
cube AS (SELECT p.day, p.hour, s.seg_key, count(*) AS obs FROM pl p JOIN lk l USING (pattern_uid, link_idx) JOIN sg s ON s.pattern_uid = p.pattern_uid AND s.link_idx = p.link_idx AND least(p.pos_m, l.len_m) > s.lo AND least(p.pos_m, l.len_m) <= s.hi GROUP BY ALL),
pas AS (SELECT day, hour, link_key, count(DISTINCT track_id) AS n FROM pl JOIN lk USING (pattern_uid, link_idx) GROUP BY ALL),
cov AS (SELECT DATE '2024-01-01' + (o_orderkey % {fx.N_DAYS})::INT AS day, (4 + o_custkey % 24)::INT AS hour, 1 - max(o_orderkey) % 7 / 10 AS coverage, CASE WHEN min(o_orderkey) % 11 = 0 THEN 2 ELSE 0 END AS flags FROM orders GROUP BY ALL),
pdays AS (SELECT DATE '2024-01-01' + i::INT AS day, i, p.pattern_uid, p.direction_id, CASE WHEN p.pattern_uid = 'B0' THEN true WHEN i < {fx.CHANGE} THEN p.pattern_uid = 'A0' ELSE p.pattern_uid = 'A1' END AS is_main FROM range(0, {fx.N_DAYS}) r(i), (SELECT DISTINCT pattern_uid, direction_id FROM lk) p),
alldays AS (SELECT day FROM pl UNION SELECT day FROM cov),
"""
#: Hours and days that count, main patterns, cells and sums over days.
ANALYSIS_SQL = (
    LINE_SQL
    + f"""hs AS (SELECT d.day, h.hour::INT AS hour, c.coverage, coalesce(c.flags, 0) AS flags, c.coverage IS NULL OR c.coverage < {MIN_COVERAGE} OR c.flags = 2 AS excluded FROM alldays d CROSS JOIN range(0, 28) h(hour) LEFT JOIN cov c ON c.day = d.day AND c.hour = h.hour),
vt AS (SELECT day, CASE WHEN coverage IS NULL THEN 'no_data' WHEN flags = 2 THEN 'frozen' ELSE 'low_coverage' END AS reason, count(*) AS n, min(hour) AS f FROM hs WHERE excluded AND hour BETWEEN 6 AND 20 GROUP BY ALL),
vs AS (SELECT day, sum(n) AS n_out, arg_max(reason, n * 100 - f) AS best FROM vt GROUP BY ALL),
ds AS (SELECT d.day, CASE WHEN d.day = DATE '2024-01-10' THEN 'excluded' WHEN coalesce(n_out, 0) / 15 > {1 - MIN_DAY} + 1e-9 THEN best END AS reason FROM alldays d LEFT JOIN vs USING (day)),
inc AS (SELECT day, hour, coverage FROM hs SEMI JOIN (SELECT day FROM ds WHERE reason IS NULL) USING (day) WHERE NOT excluded),
mn AS (SELECT day, direction_id, pattern_uid FROM pdays SEMI JOIN (SELECT day FROM ds WHERE reason IS NULL) USING (day) WHERE is_main),
cells AS (SELECT m.direction_id, m.day, i.hour, i.coverage, s.seg_key, s.link_key, coalesce(c.obs, 0) AS obs, coalesce(p.n, 0) AS passages FROM mn m JOIN sg s ON s.pattern_uid = m.pattern_uid JOIN inc i ON i.day = m.day
  LEFT JOIN cube c ON c.day = i.day AND c.hour = i.hour AND c.seg_key = s.seg_key LEFT JOIN pas p ON p.day = i.day AND p.hour = i.hour AND p.link_key = s.link_key),
bands AS (SELECT * FROM (VALUES (-1, 7, 10), (-2, 16, 19), (-3, 6, 21), (-4, 20, 24), (-5, 10, 16)) b(col, a, z)),
cc AS (SELECT *, hour AS col FROM cells UNION ALL SELECT c.*, b.col FROM cells c JOIN bands b ON c.hour >= b.a AND c.hour < b.z),
tot AS (SELECT direction_id, seg_key, link_key, (isodow(day) - 1)::INT AS dow, col, sum(obs)::DOUBLE AS obs, sum(passages)::DOUBLE AS passages, sum(coverage) AS covered_h, count(DISTINCT day) AS n_cells FROM cc GROUP BY ALL),
"""
)
_REST = """info AS (SELECT DISTINCT seg_key, seg_m AS len_m, zone FROM sg QUALIFY row_number() OVER (PARTITION BY seg_key ORDER BY seg_m) = 1),
flat AS (SELECT direction_id, seg_key, link_key, col, sum(obs) AS obs, sum(passages) AS passages, sum(covered_h) AS covered_h, sum(n_cells)::BIGINT AS n_cells FROM tot GROUP BY ALL),
lvl AS (SELECT direction_id, quantile_cont(CASE WHEN p > 0 THEN o / p / len_m END, 0.5) AS level FROM (SELECT direction_id, seg_key, sum(obs) AS o, sum(passages) AS p FROM flat WHERE col BETWEEN 6 AND 22 GROUP BY ALL) JOIN info USING (seg_key) WHERE zone = 'running' GROUP BY ALL),
"""
_OUT = """est AS (SELECT f.direction_id, f.seg_key, f.link_key, f.col, len_m, zone, obs, passages, covered_h, n_cells, oph AS obs_per_h, opp AS obs_per_passage, ref AS ref_obs_per_passage, surplus AS excess_obs_per_h, opp - ref AS excess_per_passage,
  log2((opp + 0.5) / (ref + 0.5)) AS log2_ratio, level * len_m AS ref_line_obs_per_passage, opp - level * len_m AS excess_line_per_passage FROM rates f JOIN info USING (seg_key) LEFT JOIN lvl USING (direction_id))
"""
#: Estimates as ratios of sums with the evening reference, with free flow, and by weekday strata.
EST_SQL = (
    ANALYSIS_SQL
    + _REST
    + """refs AS (SELECT direction_id, seg_key, CASE WHEN sum(passages) > 0 THEN sum(obs) / sum(passages) END AS ref FROM flat WHERE col BETWEEN 20 AND 23 GROUP BY ALL),
rates AS (SELECT f.*, CASE WHEN covered_h > 0 THEN obs / covered_h END AS oph, CASE WHEN passages > 0 AND passages / n_cells >= 0.1 THEN obs / passages END AS opp, ref, CASE WHEN covered_h > 0 THEN (obs - ref * passages) / covered_h END AS surplus
  FROM flat f LEFT JOIN refs USING (direction_id, seg_key)),
"""
    + _OUT
)
_FREE_SQL = (
    ANALYSIS_SQL
    + _REST
    + """r0 AS (SELECT *, CASE WHEN covered_h > 0 THEN obs / covered_h END AS oph, CASE WHEN passages > 0 AND passages / n_cells >= 0.1 THEN obs / passages END AS opp FROM flat),
refs AS (SELECT direction_id, seg_key, quantile_cont(opp, 0.2) AS ref FROM r0 WHERE col BETWEEN 5 AND 23 GROUP BY ALL), rates AS (SELECT r0.*, ref, CASE WHEN covered_h > 0 THEN (obs - ref * passages) / covered_h END AS surplus FROM r0 LEFT JOIN refs USING (direction_id, seg_key)),
"""
    + _OUT
)
_STRAT_SQL = (
    ANALYSIS_SQL
    + _REST
    + """st AS (SELECT (isodow(day) - 1)::INT AS dow, count(*) AS n FROM alldays WHERE day <> DATE '2024-01-10' GROUP BY ALL), ws AS (SELECT * FROM tot JOIN st USING (dow)),
refs AS (SELECT direction_id, seg_key, sum(n * o / p) / sum(n) AS ref FROM (SELECT direction_id, seg_key, dow, n, sum(obs) AS o, sum(passages) AS p FROM ws WHERE col BETWEEN 20 AND 23 GROUP BY ALL) WHERE p > 0 GROUP BY ALL),
q AS (SELECT direction_id, seg_key, col, sum(n * obs / covered_h) FILTER (covered_h > 0) / sum(n) FILTER (covered_h > 0) AS oph, sum(n * obs / passages) FILTER (passages > 0) / sum(n) FILTER (passages > 0) AS opp0,
  sum(n * (obs - ref * passages) / covered_h) FILTER (covered_h > 0) / sum(n) FILTER (covered_h > 0) AS surplus FROM ws LEFT JOIN refs USING (direction_id, seg_key) GROUP BY ALL),
rates AS (SELECT f.*, oph, CASE WHEN passages / f.n_cells >= 0.1 THEN opp0 END AS opp, ref, surplus FROM flat f JOIN q USING (direction_id, seg_key, col) LEFT JOIN refs USING (direction_id, seg_key)),
"""
    + _OUT
)
_NUMBERS = ("len_m", "obs", "passages", "covered_h", "obs_per_h", "obs_per_passage", "ref_obs_per_passage", "excess_obs_per_h", "excess_per_passage", "log2_ratio", "ref_line_obs_per_passage", "excess_line_per_passage")
_EST_OUT = "SELECT direction_id, seg_key, link_key, col, zone, n_cells, " + ", ".join(f"round({c}, 9) + 0.0::DOUBLE AS {c}" for c in _NUMBERS) + " FROM est"


def _display(w):
    return an.display_patterns(w.mains, w.segments)


def _contract(w):
    return an.weekday_contract(w.totals(), w.mains, w.segments, _display(w).where("place = 1").select("direction_id", "pattern_uid"))


def _shown(w):
    return _display(w).where("place = 1").select("direction_id", "pattern_uid").join(w.segments, "pattern_uid").select("direction_id", "seg_key")


def _coverage(s, d):
    return health.feed_coverage(fx.snapshots(s, d), "Europe/Brussels", cap_s=3600.0, max_frozen_s=5000.0, min_coverage=0.5)


def _result(s, d):
    w = World(s, d)
    return an.result(w.ready_estimates(), w.mains, w.segments)


QUERIES = {
    "coverage_hours": lambda s, d: rounded(text_dates(_coverage(s, d), "service_date"), 3),
    "coverage_days": lambda s, d: rounded(text_dates(health.coverage_by_day(_coverage(s, d)), "service_date"), 3),
    "hour_status": lambda s, d: rounded(text_dates(World(s, d).all_hours.drop("weight"), "service_date")),
    "day_status": lambda s, d: text_dates(World(s, d).status, "service_date"),
    "day_mains": lambda s, d: text_dates(World(s, d).mains, "service_date"),
    "column_totals": lambda s, d: rounded(World(s, d).totals()),
    "estimates": lambda s, d: rounded(World(s, d).estimates(), 9),
    "estimates_freeflow": lambda s, d: rounded(World(s, d).estimates(reference="freeflow"), 9),
    "estimates_stratified": lambda s, d: rounded((w := World(s, d)).estimates(strata=w.strata()), 9),
    "result": lambda s, d: rounded(_result(s, d).select("direction_id", "pattern_uid", "seg_idx", "hour", "n_days", "flags", "x0_m", "obs", "obs_per_passage", "n_cells")),
    "weekday_contract": lambda s, d: _contract(World(s, d)),
    "interactive": lambda s, d: rounded(an.interactive(_contract(World(s, d)), (0, 2, 4), (7, 19), 0.1)),
    "display_patterns": lambda s, d: text_dates(_display(World(s, d)), "last"),
    "version_table": lambda s, d: text_dates(an.version_table((w := World(s, d)).mains, w.segments, _display(w)), "first", "last").withColumn("links_added", F.array_join("links_added", ",")).withColumn("links_removed", F.array_join("links_removed", ",")),
    "day_cells": lambda s, d: rounded(text_dates(World(s, d).cells(), "service_date")),
    "reference_agreement": lambda s, d: rounded(an.reference_agreement((w := World(s, d)).ready_estimates(), _shown(w))),
    "flag_names": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array_join(an.flag_names((F.col("c_custkey") % 16384).cast("int")), ",").alias("names")),
}

_POLLS = """WITH p AS (SELECT ts, epoch_us(ts) / 1e6 AS t, bool_and(event_id % 7 < 2) AS frozen FROM events GROUP BY ts),
q AS (SELECT *, coalesce(lead(t) OVER (ORDER BY t), t + 20) AS na, coalesce(min(CASE WHEN NOT frozen THEN t END) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), t + 20) AS nl, sum((NOT frozen)::INT) OVER (ORDER BY t) AS run FROM p),
st AS (SELECT min(t) AS a, min(t) + sum(least(na - t, 3600)) AS b FROM q WHERE frozen GROUP BY run HAVING sum(least(na - t, 3600)) > 5000),
sp AS (SELECT 'c' AS kind, t AS a, t + least(nl - t, 3600) AS b FROM q WHERE NOT frozen UNION ALL SELECT 'f', t, t + least(na - t, 3600) FROM q WHERE frozen UNION ALL SELECT 's', a, b FROM st),
o AS (SELECT *, epoch(timezone('Europe/Brussels', timezone('UTC', make_timestamp((a * 1e6)::BIGINT)))) - epoch(make_timestamp((a * 1e6)::BIGINT)) AS z FROM sp WHERE b > a),
h AS (SELECT *, unnest(range(floor((a + z) / 3600)::BIGINT, greatest(floor((a + z) / 3600), ceil((b + z) / 3600) - 1)::BIGINT + 1)) AS h FROM o),
x AS (SELECT kind, greatest(a, h * 3600 - z) AS lo, least(b, (h + 1) * 3600 - z) - greatest(a, h * 3600 - z) AS sec FROM h),
y AS (SELECT kind, sec, lo FROM x UNION ALL SELECT 'n', 0, t FROM q WHERE NOT frozen),
l AS (SELECT kind, sec, timezone('Europe/Brussels', timezone('UTC', make_timestamp((floor(lo) * 1e6)::BIGINT))) AS lt FROM y),
m AS (SELECT kind, sec, (lt - INTERVAL 4 HOUR)::DATE AS day, floor(epoch(lt - (lt - INTERVAL 4 HOUR)::DATE::TIMESTAMP) / 3600)::INT AS hour FROM l),
t AS (SELECT day, hour, sum(sec) FILTER (kind = 'c') AS c, sum(sec) FILTER (kind = 'f') AS f, sum(sec) FILTER (kind = 's') AS s, count(*) FILTER (kind = 'n') AS n FROM m GROUP BY ALL),
e AS (SELECT (timezone('Europe/Brussels', timezone('UTC', ts)) - INTERVAL 4 HOUR)::DATE AS day FROM p), g AS (SELECT unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM e),
r AS (SELECT g.day, k.hour::INT AS hour, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(f, 0) AS f, coalesce(s, 0) AS s FROM g CROSS JOIN range(4, 28) k(hour) LEFT JOIN t ON t.day = g.day AND t.hour = k.hour),
cv AS (SELECT day::VARCHAR AS service_date, hour, n::BIGINT AS n_snapshots, c::DOUBLE AS covered_s, least(c / 3600, 1)::DOUBLE AS coverage, f::DOUBLE AS frozen_s, (CASE WHEN c / 3600 < 0.5 THEN 1 ELSE 0 END + CASE WHEN s > 0 THEN 2 ELSE 0 END)::INT AS flags FROM r)
"""
_FLAG_SQL = ", ".join(f"CASE WHEN c_custkey % 16384 & {b} <> 0 THEN '{n}' END" for n, b in an.FLAGS.items())
_DISPLAY_SQL = """dsp AS (SELECT direction_id, pattern_uid, count(*) AS days, max(day) AS last FROM mn GROUP BY ALL), sq AS (SELECT pattern_uid, string_agg(link_key, '|' ORDER BY link_idx) AS seq FROM lk GROUP BY ALL),
sz AS (SELECT pattern_uid, round(sum(seg_m), 1) AS length, count(*) AS n_segs FROM sg GROUP BY ALL), dv AS (SELECT *, sum(days) OVER (PARTITION BY direction_id, seq) AS vd, max(last) OVER (PARTITION BY direction_id, seq) AS vl, sum(days) OVER (PARTITION BY direction_id) AS ad FROM dsp JOIN sq USING (pattern_uid) JOIN sz USING (pattern_uid)),
do_ AS (SELECT *, vd >= greatest(5, 0.2 * ad) AS often, max((vd >= greatest(5, 0.2 * ad))::INT) OVER (PARTITION BY direction_id) AS anyo FROM dv),
disp AS (SELECT direction_id, pattern_uid, seq, days, last, row_number() OVER (PARTITION BY direction_id ORDER BY CASE WHEN anyo = 1 THEN (NOT often)::INT ELSE -vd END, length DESC, CASE WHEN anyo = 1 THEN -n_segs ELSE 0 END, vl DESC, days DESC, pattern_uid)::INT AS place FROM do_)
"""
_WK_SQL = ANALYSIS_SQL + _DISPLAY_SQL + """, ld AS (SELECT m.direction_id, link_key, (isodow(day) - 1)::INT AS dow, count(*) AS days FROM mn m JOIN lk l ON l.pattern_uid = m.pattern_uid GROUP BY ALL),
wk AS (SELECT t.direction_id, t.dow, t.col AS hour, s.seg_idx, t.seg_key, round(t.obs, 1) AS obs, round(t.covered_h, 3) AS covered_h, round(t.passages, 2) AS passages, ld.days, t.n_cells FROM tot t JOIN disp p ON p.direction_id = t.direction_id AND p.place = 1
JOIN sg s ON s.pattern_uid = p.pattern_uid AND s.seg_key = t.seg_key JOIN ld ON ld.direction_id = t.direction_id AND ld.link_key = t.link_key AND ld.dow = t.dow WHERE t.col >= 0)
"""
ORACLE_SQL = {
    "coverage_hours": _POLLS + "SELECT service_date, hour, n_snapshots, round(covered_s, 3) AS covered_s, round(coverage, 3) AS coverage, round(frozen_s, 3) AS frozen_s, flags FROM cv",
    "coverage_days": _POLLS + "SELECT service_date, round(avg(coverage), 3) AS mean_coverage, count(*) FILTER (flags & 1 <> 0) AS low_hours, count(*) FILTER (flags & 2 <> 0) AS frozen_hours FROM cv WHERE hour BETWEEN 6 AND 20 GROUP BY ALL",
    "hour_status": ANALYSIS_SQL + "done AS (SELECT 1) SELECT day::VARCHAR AS service_date, hour, round(coverage, 6) AS coverage, flags, excluded FROM hs",
    "day_status": ANALYSIS_SQL + "done AS (SELECT 1) SELECT day::VARCHAR AS service_date, reason FROM ds",
    "day_mains": ANALYSIS_SQL + "done AS (SELECT 1) SELECT day::VARCHAR AS service_date, direction_id, pattern_uid FROM mn",
    "column_totals": ANALYSIS_SQL + "done AS (SELECT 1) SELECT direction_id, seg_key, link_key, dow, col, obs, passages, round(covered_h, 6) AS covered_h, n_cells FROM tot",
    "estimates": EST_SQL + _EST_OUT,
    "estimates_freeflow": _FREE_SQL + _EST_OUT,
    "estimates_stratified": _STRAT_SQL + _EST_OUT,
    "result": EST_SQL + """, nd AS (SELECT direction_id, seg_key, count(DISTINCT day) AS n_days FROM (SELECT m.direction_id, m.day, s.seg_key FROM mn m JOIN sg s ON s.pattern_uid = m.pattern_uid) GROUP BY ALL), ad AS (SELECT direction_id, count(DISTINCT day) AS d FROM mn GROUP BY ALL),
sh AS (SELECT DISTINCT direction_id, pattern_uid FROM mn) SELECT sh.direction_id, sh.pattern_uid, s.seg_idx, e.col AS hour, n_days::BIGINT AS n_days, (CASE WHEN n_days < 5 THEN 16 ELSE 0 END + CASE WHEN n_days < ad.d THEN 32 ELSE 0 END)::INT AS flags, round(s.x0_m, 6) AS x0_m, round(obs, 6) AS obs, round(obs_per_passage, 6) AS obs_per_passage, n_cells
FROM sh JOIN sg s ON s.pattern_uid = sh.pattern_uid JOIN est e ON e.direction_id = sh.direction_id AND e.seg_key = s.seg_key JOIN nd ON nd.direction_id = sh.direction_id AND nd.seg_key = s.seg_key JOIN ad ON ad.direction_id = sh.direction_id WHERE e.col < 0 OR e.col BETWEEN 5 AND 23""",
    "weekday_contract": _WK_SQL + "SELECT * FROM wk",
    "interactive": _WK_SQL + """, i AS (SELECT direction_id, seg_idx, seg_key, sum(obs) AS obs, sum(covered_h) AS covered_h, sum(passages) AS passages, sum(n_cells)::BIGINT AS n_cells FROM wk WHERE dow IN (0, 2, 4) AND hour BETWEEN 7 AND 18 GROUP BY ALL)
SELECT direction_id, seg_idx, seg_key, round(obs, 6) AS obs, round(covered_h, 6) AS covered_h, round(passages, 6) AS passages, n_cells, round(CASE WHEN passages > 0 AND passages / n_cells >= 0.1 THEN obs / passages END, 6) AS obs_per_passage, round(CASE WHEN covered_h > 0 THEN obs / covered_h END, 6) AS obs_per_h FROM i""",
    "display_patterns": ANALYSIS_SQL + _DISPLAY_SQL + "SELECT direction_id, pattern_uid, seq, days, last::VARCHAR AS last, place FROM disp",
    "version_table": ANALYSIS_SQL + _DISPLAY_SQL + """, vr AS (SELECT m.direction_id, seq, arg_min(m.pattern_uid, CASE WHEN place = 1 THEN -1000000 ELSE -days END) AS pattern_uid, min(day) AS first, max(day) AS last, count(*) AS n_days, min(place) = 1 AS display FROM mn m JOIN disp p ON p.direction_id = m.direction_id AND p.pattern_uid = m.pattern_uid GROUP BY ALL),
ll AS (SELECT direction_id, pattern_uid AS shown FROM disp WHERE place = 1) SELECT vr.direction_id, pattern_uid, first::VARCHAR AS first, last::VARCHAR AS last, n_days, display,
coalesce((SELECT string_agg(link_key, ',' ORDER BY link_key) FROM lk WHERE lk.pattern_uid = vr.pattern_uid AND link_key NOT IN (SELECT link_key FROM lk b WHERE b.pattern_uid = ll.shown)), '') AS links_added,
coalesce((SELECT string_agg(link_key, ',' ORDER BY link_key) FROM lk WHERE lk.pattern_uid = ll.shown AND link_key NOT IN (SELECT link_key FROM lk b WHERE b.pattern_uid = vr.pattern_uid)), '') AS links_removed FROM vr JOIN ll USING (direction_id)""",
    "day_cells": ANALYSIS_SQL + "done AS (SELECT 1) SELECT direction_id, day::VARCHAR AS service_date, hour, seg_key, obs::DOUBLE AS obs, passages::DOUBLE AS passages FROM cells",
    "reference_agreement": EST_SQL + "," + _DISPLAY_SQL + """, dy AS (SELECT e.*, excess_per_passage AS xe, excess_line_per_passage AS xl FROM est e JOIN disp p ON p.direction_id = e.direction_id AND place = 1 JOIN sg s ON s.pattern_uid = p.pattern_uid AND s.seg_key = e.seg_key WHERE col = -3),
lv AS (SELECT direction_id, min(ref_line_obs_per_passage / len_m) AS line_level_per_m, quantile_cont(ref_obs_per_passage / len_m, 0.5) AS evening_ref_per_m FROM dy WHERE zone = 'running' GROUP BY ALL),
rk AS (SELECT direction_id, zone, seg_key, xe, xl FROM dy WHERE xe IS NOT NULL AND xl IS NOT NULL),
ra AS (SELECT direction_id, rank() OVER (PARTITION BY direction_id ORDER BY xe) + (count(*) OVER (PARTITION BY direction_id, xe) - 1) / 2 AS a, rank() OVER (PARTITION BY direction_id ORDER BY xl) + (count(*) OVER (PARTITION BY direction_id, xl) - 1) / 2 AS b FROM rk),
rr AS (SELECT direction_id, rank() OVER (PARTITION BY direction_id ORDER BY xe) + (count(*) OVER (PARTITION BY direction_id, xe) - 1) / 2 AS a, rank() OVER (PARTITION BY direction_id ORDER BY xl) + (count(*) OVER (PARTITION BY direction_id, xl) - 1) / 2 AS b FROM rk WHERE zone = 'running'),
tp AS (SELECT direction_id, greatest(1, round_even(0.1 * count(*) OVER (PARTITION BY direction_id), 0)) AS k, row_number() OVER (PARTITION BY direction_id ORDER BY xe DESC, seg_key) AS a, row_number() OVER (PARTITION BY direction_id ORDER BY xl DESC, seg_key) AS b FROM rk WHERE zone = 'running')
SELECT lv.direction_id, round(line_level_per_m, 6) AS line_level_per_m, round(evening_ref_per_m, 6) AS evening_ref_per_m, round((SELECT corr(a, b) FROM rr WHERE rr.direction_id = lv.direction_id), 6) AS spearman_day, round((SELECT corr(a, b) FROM ra WHERE ra.direction_id = lv.direction_id), 6) AS spearman_day_all,
round((SELECT count(*) FILTER (a <= k AND b <= k) / max(k) FROM tp WHERE tp.direction_id = lv.direction_id), 6) AS top_overlap FROM lv""",
    "flag_names": f"SELECT c_custkey, array_to_string(list_filter([{_FLAG_SQL}], lambda x: x IS NOT NULL), ',') AS names FROM customer",
}
