"""Registered queries of placement, tracks and passages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import placement as pl
from dwellscope.operators import tracker as tk
from dwellscope.plans.analysis import _values, rounded, text_dates
from dwellscope.sources import fixtures as fx


def _street(s, d):
    net = fx.street(s)
    return net, fx.street_observations(s, d)


def _located(s, d):
    net, obs = _street(s, d)
    return pl.located(obs, net["patterns"], net["pattern_days"], stops=net["stops"])


def _placed(s, d, pseudo=False):
    net, obs = _street(s, d)
    return pl.place_linear(obs, net["patterns"], net["pattern_days"], net["links"], pseudo=pseudo, stops=net["stops"])


_POS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pattern_uid", "link_idx", "link_key", "pos_m", "s_m", "term_s_m", "flags")


def _versions(s, d):
    net, obs = _street(s, d)
    return pl.date_versions(obs.select("service_date").distinct(), net["pattern_days"])[0].select("service_date", "network_date")


def _crossings(s, d):
    return tk.line_crossings(fx.walks(s, d).withColumn("term_s_m", F.when(F.col("row_id") % 5 == 0, F.col("s_m") + 60)))


def _feed(s, d):
    return tk.feed_passages(_crossings(s, d), fx.street(s)["links"])


def _all_passages(s, d):
    net = fx.street(s)
    events = fx.walks(s, d).groupBy("service_date", F.hour("ts").alias("hour"), F.lit("c>d").alias("link_key")).agg(F.count(F.lit(1)).alias("n_events"), F.lit("S").alias("pattern_uid"))
    return tk.all_passages(_feed(s, d), events, net["pattern_days"].where("is_main"), net["links"])


def _link_of(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", pl.link_of((F.col("p_partkey") % 1500).cast("double"), F.array(*[F.lit(x) for x in (0.0, 200.0, 510.0, 850.0, 1100.0, 1400.0)])).alias("x")).select("p_partkey", "x.link_idx", "x.pos_m")


QUERIES = {
    "date_versions": lambda s, d: text_dates(_versions(s, d), "service_date", "network_date"),
    "placement_status": lambda s, d: _located(s, d).groupBy("stop_id", "terminus_id", "direction_id", "status", "pattern_uid", "link_idx").agg(F.count(F.lit(1)).alias("n")),
    "placement_report": lambda s, d: pl.placement_report(_located(s, d)),
    "placement_positions": lambda s, d: rounded(_placed(s, d).select(*_POS)),
    "placement_terminus_rows": lambda s, d: _placed(s, d, True).where("not count").groupBy("pattern_uid", "link_idx", "link_key", "pos_m", "s_m", "flags").agg(F.count(F.lit(1)).alias("n")),
    "approach": lambda s, d: rounded(pl.approached(_placed(s, d), fx.street(s)["links"], 36.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos_m", "s_m")),
    "link_of_place": _link_of,
    "line_crossings": lambda s, d: rounded(text_dates(_crossings(s, d).groupBy("service_date", "pattern_uid", "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("t") - 1704096000).alias("t")), "service_date"), 4),
    "counting_lines": lambda s, d: tk.counting_lines(fx.street(s)["links"]),
    "feed_passages": lambda s, d: text_dates(_feed(s, d), "service_date"),
    "all_passages": lambda s, d: text_dates(_all_passages(s, d), "service_date"),
    "track_anonymous": lambda s, d: text_dates(tk.track_anonymous(fx.walks(s, d).drop("track_id")).groupBy("service_date", "pattern_uid").agg(F.count_distinct("track_id").alias("n_tracks"), F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("count"), 1)).alias("n_waiting")), "service_date"),
}


def _stops():
    for u, (direction, kind, n, stops, m) in fx.STREET.items():
        for i, x in enumerate(stops):
            yield u, direction, kind, n, i, x, x.upper(), len(stops) - 1, float(sum(m[:i])), float(m[i]) if i < len(m) else -1.0


_STREET = f"""WITH ps AS (SELECT * FROM (VALUES {_values(_stops())}) v(u, dir, kind, trips, i, stop, name, last, s0, len_m)), nm AS (SELECT DISTINCT stop, name FROM ps UNION SELECT 'h', 'F'),
ob AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % {fx.N_DAYS} AS day, ['a', 'b', 'c', 'd', 'e', 'f', 'g', NULL][l_partkey % 8 + 1] AS stop_id, ['f', 'a', 'h', 'z9', NULL, 'd', 'c'][l_suppkey % 7 + 1] AS terminus_id,
  CASE WHEN l_suppkey % 7 = 4 THEN (l_suppkey % 2)::INT END AS direction_id, floor(l_quantity * 6.1::DOUBLE) AS dist_m FROM lineitem),
zs AS (SELECT u, sum(n) AS score FROM (SELECT stop_id, count(*) AS n FROM ob WHERE terminus_id = 'z9' GROUP BY ALL) z JOIN ps ON ps.stop = z.stop_id AND ps.i < ps.last GROUP BY ALL),
z9 AS (SELECT u FROM zs JOIN (SELECT DISTINCT u, kind, trips, dir FROM ps) p USING (u) ORDER BY score DESC, kind <> 'main', dir, trips DESC, u LIMIT 1), ali AS (SELECT stop FROM ps JOIN z9 USING (u) WHERE i = last),
co AS (SELECT DISTINCT stop_id, terminus_id, direction_id, CASE WHEN terminus_id = 'z9' THEN (SELECT stop FROM ali) ELSE terminus_id END AS tid FROM ob), cn AS (SELECT co.*, nm.name AS tname FROM co LEFT JOIN nm ON nm.stop = co.tid),
mt AS (SELECT c.*, p.u, p.dir, p.kind, p.trips, p.i, p.last, (c.direction_id IS NULL OR c.direction_id = p.dir) AS way, CASE WHEN c.tid IS NULL THEN CASE WHEN c.direction_id IS NULL OR c.direction_id = p.dir THEN p.last END ELSE (SELECT min(q.i) FROM ps q WHERE q.u = p.u AND q.i > p.i AND (q.stop = c.tid OR q.name = c.tname)) END AS term
  FROM cn c JOIN ps p ON p.stop = c.stop_id AND p.i < p.last),
ag AS (SELECT stop_id, terminus_id, direction_id, count(*) FILTER (kind = 'main' AND term IS NOT NULL) AS nm_, count(*) FILTER (kind IN ('detour', 'other') AND term IS NOT NULL) AS no_, count(*) FILTER (kind IN ('detour', 'other') AND term = last) AS nf,
  count(DISTINCT dir) FILTER (kind IN ('detour', 'other') AND term = last) AS fd, count(DISTINCT dir) FILTER (kind IN ('detour', 'other') AND term IS NOT NULL) AS od, count(*) FILTER (kind = 'main' AND way) AS ns FROM mt GROUP BY ALL),
st AS (SELECT c.*, coalesce(nm_, 0) AS nm_, coalesce(no_, 0) AS no_, coalesce(nf, 0) AS nf, coalesce(fd, 0) AS fd, coalesce(od, 0) AS od, coalesce(ns, 0) AS ns,
  (SELECT m.u FROM mt m WHERE m.kind = 'main' AND m.way AND m.stop_id = c.stop_id AND m.terminus_id IS NOT DISTINCT FROM c.terminus_id AND m.direction_id IS NOT DISTINCT FROM c.direction_id ORDER BY m.dir LIMIT 1) AS alone FROM cn c LEFT JOIN ag ON ag.stop_id IS NOT DISTINCT FROM c.stop_id AND ag.terminus_id IS NOT DISTINCT FROM c.terminus_id AND ag.direction_id IS NOT DISTINCT FROM c.direction_id),
ss AS (SELECT *, CASE WHEN stop_id IS NULL THEN 'no_position' WHEN nm_ = 1 THEN 'ok' WHEN nm_ > 1 THEN 'ambiguous' WHEN no_ = 1 OR (no_ > 1 AND CASE WHEN nf > 0 THEN fd = 1 ELSE od = 1 END) THEN 'ok_other' WHEN no_ > 1 THEN 'ambiguous'
  WHEN ns = 1 AND tid IS NOT NULL AND EXISTS (SELECT 1 FROM ps WHERE ps.u = alone AND i = 0 AND (stop = tid OR name = tname)) THEN 'ok_stop_only' WHEN terminus_id IS NOT NULL AND tname IS NULL THEN 'unknown_terminus' ELSE 'off_pattern' END AS status FROM st),
hx AS (SELECT s.stop_id, s.terminus_id, s.direction_id, s.status, m.u, m.i, m.last, CASE WHEN status = 'ok_stop_only' THEN m.last ELSE m.term END AS term, row_number() OVER (PARTITION BY s.stop_id, s.terminus_id, s.direction_id ORDER BY CASE WHEN s.nf > 0 AND m.term <> m.last AND status = 'ok_other' THEN 1 ELSE 0 END, m.dir, m.trips DESC, m.u) AS rn
  FROM ss s JOIN mt m ON m.stop_id IS NOT DISTINCT FROM s.stop_id AND m.terminus_id IS NOT DISTINCT FROM s.terminus_id AND m.direction_id IS NOT DISTINCT FROM s.direction_id
  WHERE (status = 'ok' AND m.kind = 'main' AND m.term IS NOT NULL) OR (status = 'ok_other' AND m.kind IN ('detour', 'other') AND m.term IS NOT NULL) OR (status = 'ok_stop_only' AND m.kind = 'main' AND m.way)),
rs AS (SELECT s.stop_id, s.terminus_id, s.direction_id, s.status, h.u, h.i, CASE WHEN s.status = 'ok_stop_only' THEN NULL ELSE h.term END AS term, h.last FROM ss s LEFT JOIN hx h ON h.rn = 1 AND h.stop_id IS NOT DISTINCT FROM s.stop_id AND h.terminus_id IS NOT DISTINCT FROM s.terminus_id AND h.direction_id IS NOT DISTINCT FROM s.direction_id),
lo AS (SELECT o.*, r.status, r.u, r.i, r.term, r.last FROM ob o JOIN rs r ON r.stop_id IS NOT DISTINCT FROM o.stop_id AND r.terminus_id IS NOT DISTINCT FROM o.terminus_id AND r.direction_id IS NOT DISTINCT FROM o.direction_id),
kp AS (SELECT * FROM lo WHERE status IN ('ok', 'ok_other', 'ok_stop_only') AND NOT (i = 0 AND dist_m < 10)),
fl AS (SELECT u, i, CASE WHEN count(*) >= 20 AND quantile_cont(dist_m, 0.995) > 0 THEN quantile_cont(dist_m, 0.995) END AS f FROM kp GROUP BY ALL),
p0 AS (SELECT k.*, coalesce(fl.f, p.len_m) AS flen, least(dist_m / coalesce(fl.f, p.len_m), 1) AS sh, coalesce(k.term <> k.last, false) AS short, coalesce(k.term = k.i + 1 AND k.term <> k.last, false) AS nx FROM kp k JOIN ps p ON p.u = k.u AND p.i = k.i LEFT JOIN fl ON fl.u = k.u AND fl.i = k.i),
p1 AS (SELECT *, CASE WHEN dist_m < 10 AND i > 0 THEN i - 1 ELSE i END AS li FROM p0 WHERE NOT (short AND nx AND sh >= 0.75)),
pp AS (SELECT p1.*, q.s0, q.len_m AS lm, q.stop || '>' || r.stop AS link_key, CASE WHEN dist_m < 10 AND p1.i > 0 THEN q.len_m WHEN dist_m < 10 THEN 0 ELSE sh * q.len_m END AS pos, CASE WHEN short AND li + 1 = term THEN q.s0 + q.len_m END AS ts FROM p1 JOIN ps q ON q.u = p1.u AND q.i = p1.li JOIN ps r ON r.u = p1.u AND r.i = p1.li + 1)
"""
_WALK = """WITH e AS (SELECT event_id, 1704096000 + event_id % 400 * 20 AS t, DATE '2024-01-01' + (user_id % 5)::INT AS day, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'R' END AS u, user_id, event_id % 400 * 3.5::DOUBLE + floor(value) / 128 AS s FROM events),
b AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 300 OR lag(s) OVER w - s > 100 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY u, day, user_id ORDER BY t, s)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY u, day, user_id ORDER BY t, s) AS run FROM b), m AS (SELECT *, max(s) OVER (PARTITION BY u, day, user_id, run ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS cm FROM r),
n AS (SELECT *, lag(cm) OVER w AS s0, lag(t) OVER w AS t0, lead(t) OVER w IS NULL AS last, CASE WHEN event_id % 5 = 0 THEN s + 60 END AS term FROM m WINDOW w AS (PARTITION BY u, day, user_id, run ORDER BY t, cm)),
k AS (SELECT day, u, line, t0 + (line * 10 + 5 - s0) / (cm - s0) * (t - t0) AS t FROM (SELECT *, unnest(range(greatest(floor((s0 - 5) / 10)::BIGINT + 1, 0), floor((cm - 5) / 10)::BIGINT + 1)) AS line FROM n WHERE cm > s0)
  UNION ALL SELECT day, u, line, t FROM (SELECT *, unnest(range(greatest(floor((cm - 5) / 10)::BIGINT + 1, 0), floor((term - 5) / 10)::BIGINT + 1)) AS line FROM n WHERE last AND s0 IS NOT NULL AND term > cm))
"""
_LINES = f""", ps AS (SELECT * FROM (VALUES {_values(_stops())}) v(u, dir, kind, trips, i, stop, name, last, s0, len_m)),
l0 AS (SELECT u, i, last, s0 AS lo, s0 + len_m AS hi, x.line, x.line * 10 + 5 AS pt FROM ps JOIN range(0, 200) x(line) ON x.line * 10 + 5 > s0 AND x.line * 10 + 5 < s0 + len_m WHERE i < last),
l1 AS (SELECT *, CASE WHEN i = 0 AND last > 1 THEN pt > (lo + hi) / 2 AND pt < hi - 10 WHEN i = last - 1 AND last > 1 THEN pt > lo + 10 AND pt <= (lo + hi) / 2 ELSE pt > lo + 10 AND pt < hi - 10 END AS good FROM l0),
ln AS (SELECT u AS pattern_uid, i::INT AS link_idx, line FROM (SELECT *, max(good::INT) OVER (PARTITION BY u, i) AS anyg FROM l1) WHERE CASE WHEN anyg = 1 THEN good ELSE true END)
"""
_FEED = _WALK + _LINES + """, ct AS (SELECT day, u, floor((t - epoch(day::TIMESTAMP)) / 3600)::BIGINT AS hour, line, count(*) AS n FROM k GROUP BY ALL), dh AS (SELECT DISTINCT day, u, hour FROM ct),
md AS (SELECT d.day, d.hour, d.u, l.link_idx, quantile_cont(coalesce(c.n, 0)::DOUBLE, 0.5) AS n FROM dh d JOIN ln l ON l.pattern_uid = d.u LEFT JOIN ct c ON c.day = d.day AND c.u = d.u AND c.hour = d.hour AND c.line = l.line GROUP BY ALL),
fp AS (SELECT md.day, hour, md.u, a.stop || '>' || b.stop AS link_key, n FROM md JOIN ps a ON a.u = md.u AND a.i = md.link_idx JOIN ps b ON b.u = md.u AND b.i = md.link_idx + 1 WHERE n > 0)
"""
ORACLE_SQL = {
    "date_versions": f"""WITH o AS (SELECT DISTINCT l_orderkey % {fx.N_DAYS} AS i FROM lineitem), c AS (SELECT i AS j FROM range(0, {fx.N_DAYS - 6}) r(i)), x AS (SELECT DATE '2024-01-01' + i::INT AS a, DATE '2024-01-01' + j::INT AS b FROM o, c)
SELECT a::VARCHAR AS service_date, b::VARCHAR AS network_date FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY greatest(isodow(a), 5) <> greatest(isodow(b), 5), abs(a - b), b) = 1""",
    "placement_status": _STREET + "SELECT stop_id, terminus_id, direction_id, status, u AS pattern_uid, i::INT AS link_idx, count(*) AS n FROM lo GROUP BY ALL",
    "placement_report": _STREET + "SELECT CASE WHEN status IN ('ok', 'ok_other', 'ok_stop_only') AND i = 0 AND dist_m < 10 THEN 'layover_first_stop' ELSE status END AS status, count(*) AS n FROM lo GROUP BY ALL",
    "placement_positions": _STREET + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, u AS pattern_uid, li::INT AS link_idx, link_key, round(pos, 6) + 0.0::DOUBLE AS pos_m, round(s0 + pos, 6) + 0.0::DOUBLE AS s_m, ts::DOUBLE AS term_s_m, (CASE WHEN short THEN 1024 ELSE 0 END + CASE WHEN dist_m < 10 THEN 8192 ELSE 0 END)::INT AS flags FROM pp",
    "placement_terminus_rows": _STREET + """, en AS (SELECT u, 0 AS li, stop || '>' || (SELECT q.stop FROM ps q WHERE q.u = ps.u AND q.i = 1) AS link_key, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS s, name FROM ps WHERE kind = 'main' AND i = 0
UNION ALL SELECT a.u, a.i, a.stop || '>' || b.stop, a.len_m, a.s0 + a.len_m, b.name FROM ps a JOIN ps b ON b.u = a.u AND b.i = a.i + 1 WHERE a.kind = 'main' AND b.i = b.last),
ow AS (SELECT o.*, n1.name AS pn, n2.name AS tn FROM ob o LEFT JOIN nm n1 ON n1.stop = o.stop_id LEFT JOIN nm n2 ON n2.stop = CASE WHEN o.terminus_id = 'z9' THEN (SELECT stop FROM ali) ELSE o.terminus_id END)
SELECT u AS pattern_uid, li::INT AS link_idx, link_key, pos AS pos_m, s AS s_m, 512 AS flags, count(*) AS n FROM ow JOIN en ON en.name = ow.pn WHERE dist_m < 10 OR tn = en.name GROUP BY ALL""",
    "approach": _STREET + ", ap AS (SELECT *, CASE WHEN dist_m < 10 OR lm <= 36 THEN pos ELSE pos * (lm - 36) / lm END AS np FROM pp) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(np, 6) + 0.0::DOUBLE AS pos_m, round(s0 + np, 6) + 0.0::DOUBLE AS s_m FROM ap",
    "link_of_place": """WITH l AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 200.0::DOUBLE), (1, 200, 510), (2, 510, 850), (3, 850, 1100), (4, 1100, 1400)) l(i, lo, hi)), p AS (SELECT p_partkey, (p_partkey % 1500)::DOUBLE AS s FROM part)
SELECT p_partkey, i AS link_idx, least(greatest(s - lo, 0), hi - lo) AS pos_m FROM p JOIN l ON (s > lo AND s <= hi) OR (s <= 0 AND i = 0) OR (s > 1400 AND i = 4)""",
    "line_crossings": _WALK + "SELECT day::VARCHAR AS service_date, u AS pattern_uid, line, count(*) AS n, round(min(t - 1704096000), 4) + 0.0::DOUBLE AS t FROM k GROUP BY ALL",
    "counting_lines": _WALK + _LINES + "SELECT * FROM ln",
    "feed_passages": _FEED + "SELECT day::VARCHAR AS service_date, hour, u AS pattern_uid, link_key, n AS n_feed FROM fp",
    "all_passages": _FEED + f""", fs AS (SELECT day, hour, link_key, sum(n) AS n_feed, arg_max(u, n * 1000 + ascii(u)) AS pf FROM fp GROUP BY ALL), ev AS (SELECT day, (t % 86400 // 3600)::BIGINT AS hour, 'c>d' AS link_key, count(*)::DOUBLE AS n_events, 'S' AS pe FROM e GROUP BY ALL),
mh AS (SELECT DATE '2024-01-01' + x::INT AS day, a.stop || '>' || b.stop AS link_key, min(a.u) AS pm FROM range(0, {fx.N_DAYS - 6}) r(x), ps a JOIN ps b ON b.u = a.u AND b.i = a.i + 1 WHERE a.kind = 'main' GROUP BY ALL)
SELECT day::VARCHAR AS service_date, hour, coalesce(pm, pf, pe) AS pattern_uid, link_key, coalesce(n_feed, 0)::DOUBLE AS n_feed, coalesce(n_events, 0)::DOUBLE AS n_events, greatest(coalesce(n_feed, 0), coalesce(n_events, 0))::DOUBLE AS n FROM fs FULL JOIN ev USING (day, hour, link_key) LEFT JOIN mh USING (day, link_key)""",
}
