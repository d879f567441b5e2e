"""Registered queries of statistics, tracks and network, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import core, grids
from dwellscope.operators import patterns as pt
from dwellscope.operators import statistics as st
from dwellscope.operators import tracks as tr
from dwellscope.sources import fixtures as fx


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _coverage(s, d):
    o = _read(s, d, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("hour", (F.col("o_orderkey") % 24).cast("int"))
    return o.groupBy("day", "hour").agg((1 - F.max(F.col("o_orderkey") % 10) / 20).alias("coverage"), F.max(F.when(F.col("o_custkey") % 5 == 0, 2).otherwise(0)).alias("flags"))


def _daily(s, d):
    """Positions (quantity) and passages (lines) of each month's first days, pattern and link."""
    p = fx.placed(s, d)
    return p.groupBy(F.col("service_date").alias("day"), "pattern_uid", "link_idx").agg(F.sum((F.col("pos_m") > 150).cast("long")).alias("obs"), F.count(F.lit(1)).alias("passages"))


_KEYS = ["pattern_uid", "link_idx"]


def _opp(s, d, condition):
    return _daily(s, d).where(condition).groupBy(*_KEYS).agg((F.sum("obs") / F.sum("passages")).alias("opp"))


def _intervals(s, d):
    daily = _daily(s, d)
    return st.bootstrap_intervals(daily, st.bootstrap_weights(daily, 50), _KEYS, 0.5)


def _resampled(s, d):
    e = _read(s, d, "events").select("ts", F.col("user_id").alias("track_id"), F.col("value").alias("s_m"), F.lit("P").alias("pattern_uid"), F.hour("ts").alias("hour"), "event_id")
    return tr.resample(e, 3600, 43200).select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_unix"), "hour")


def _crossings(s, d):
    runs = core.runs(fx.observations(s, d), 86400, 500)
    return tr.crossings(runs, 50.0)


def _line_counts(s, d):
    li = _read(s, d, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") % 4).cast("int").alias("hour"), (F.col("l_partkey") % 12).cast("int").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _line_passages(s, d):
    lines = s.range(12).select((F.col("id") / 4).cast("int").alias("link_idx"), F.col("id").cast("int").alias("line"))
    return tr.line_passages(_line_counts(s, d), lines)


def _services(s, d):
    sup = _read(s, d, "supplier")
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 20).cast("int"))
    weekdays = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i + F.col("s_suppkey")) % 3 != 0)
    cal = sup.select(F.col("s_suppkey").alias("service_id"), first.alias("start_date"), F.date_add(first, 30).alias("end_date"), weekdays.alias("days"))
    exc = sup.select(F.col("s_suppkey").alias("service_id"), F.date_add(first, 10).alias("date"), (F.col("s_suppkey") % 2 + 1).alias("exception_type"))
    days = s.range(40).select(F.date_add(F.lit("2024-01-05").cast("date"), F.col("id").cast("int")).alias("day"))
    return tr.active_services(days, cal, exc)


def _aliases(s, d):
    rows = _read(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("terminus_id"), (F.col("l_partkey") % 30).alias("stop_id"))
    stops = s.range(30).select((F.col("id") / 6).cast("int").alias("pattern_uid"), F.col("id").alias("stop_id"), (F.col("id") % 6 == 5).alias("is_last"), (F.col("id") < 12).alias("is_main"), (F.col("id") / 6).cast("int").alias("place"))
    return tr.learned_aliases(rows, stops)


def _near(s, d):
    fixes = _read(s, d, "customer").select(F.col("c_custkey").alias("fix_id"), (50 + F.col("c_custkey") % 97 / 1000).alias("lat"), (4 + F.col("c_custkey") % 89 / 1000).alias("lon"))
    points = _read(s, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (50 + F.col("s_suppkey") % 83 / 1000).alias("lat"), (4 + F.col("s_suppkey") % 79 / 1000).alias("lon"))
    return tr.near_points(fixes, points, 400.0)


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


QUERIES = {
    "day_rule": lambda s, d: _text_day(st.day_rule(_coverage(s, d), _coverage(s, d), 0.6, 0.3)),
    "stratified": lambda s, d: _rounded(st.stratified(_daily(s, d), _KEYS), "opp"),
    "weighted_bootstrap_hash": lambda s, d: _rounded(_text_day(st.bootstrap_weights(_daily(s, d), 20)), "w"),
    "percentile_ci": lambda s, d: _rounded(_intervals(s, d).select(*_KEYS, "value", "lo", "hi", "se"), "value", "lo", "hi", "se"),
    "p_values": lambda s, d: _rounded(_read(s, d, "events").select("event_id", st.one_sided_p(F.col("value"), 100.0, F.col("event_id") % 7 * 30.0).alias("p")), "p"),
    "persistence": lambda s, d: _rounded(st.persistence(_daily(s, d), _opp(s, d, "true").withColumnRenamed("opp", "level"), _KEYS), "persistence"),
    "ss_cost": lambda s, d: _rounded(st.grid_cost(_daily(s, d).groupBy(*_KEYS).agg(F.sum("obs").alias("k")).join(fx.links(s), _KEYS), "pattern_uid", 100), "cost"),
    "compare_bins": lambda s, d: _rounded(st.compared(_opp(s, d, "day < '1995-06-01'"), _opp(s, d, "day >= '1995-06-01'"), _KEYS), "a", "b", "delta", "ratio"),
    "split_half": lambda s, d: _rounded(st.split_half(_daily(s, d), _KEYS, "pattern_uid"), "reliability"),
    "resample": _resampled,
    "crossings": lambda s, d: _crossings(s, d).groupBy("track_id", "run", "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.floor(F.col("at_us") / 1e6)).alias("at_s")),
    "link_median_crossings": lambda s, d: _text_day(_line_passages(s, d)),
    "active_services": lambda s, d: _text_day(_services(s, d)),
    "alias_learning": _aliases,
    "spatial_candidates": lambda s, d: _near(s, d).withColumn("m", F.round("m", 3)),
}

_COV = """WITH cov AS (SELECT o_orderdate::DATE AS day, (o_orderkey % 24)::INT AS hour, 1 - max(o_orderkey % 10) / 20 AS coverage, max(CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END) AS flags FROM orders GROUP BY ALL)
"""
_DAILY = """WITH daily AS (SELECT o_orderdate::DATE AS day, o_orderstatus AS pattern_uid, ((l_linenumber - 1) % 5)::INT AS link_idx, sum((l_quantity * 6.1::DOUBLE > 150)::INT) AS obs, count(*) AS passages
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
"""
_WEIGHTS = """, dd AS (SELECT DISTINCT day, isodow(day) - 1 AS dow FROM daily), num AS (SELECT *, row_number() OVER (PARTITION BY dow ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY dow) AS n FROM dd),
str AS (SELECT DISTINCT dow, n FROM num), pk AS (SELECT dow, n, draw, unnest(range(1, greatest(1, n - 1) + 1)) AS i FROM str, range(0, {draws}) r(draw)),
ct AS (SELECT dow, n, draw, ('0x' || substr(md5('0:' || draw || ':' || dow || ':' || i), 1, 8))::BIGINT % n AS pos, count(*) AS times FROM pk GROUP BY ALL),
wts AS (SELECT draw::INT AS draw, day, CASE WHEN ct.n > 1 THEN times * ct.n / (ct.n - 1) ELSE 1.0::DOUBLE END AS w FROM ct JOIN num USING (dow, pos))
"""
_ERFC = "(CASE WHEN x >= 0 THEN u ELSE 2 - u END)"
_CHEB = "+t*(".join(str(c) for c in st.ERFC) + ")" * (len(st.ERFC) - 1)

ORACLE_SQL = {
    "day_rule": _COV + """, g AS (SELECT DISTINCT day, h.hour FROM cov, range(6, 21) h(hour)), r AS (SELECT g.day, g.hour, CASE WHEN coverage IS NULL THEN 'no_data' WHEN flags = 2 THEN 'frozen' WHEN coverage < 0.6 THEN 'low_coverage' END AS reason
FROM g LEFT JOIN cov USING (day, hour)), v AS (SELECT day, reason, count(*) AS n, min(hour) AS f FROM r WHERE reason IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY day) AS total FROM v)
SELECT day::VARCHAR AS day, reason FROM t WHERE total / 15 > 0.7 + 1e-9 QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, f) = 1""",
    "stratified": _DAILY + """, s AS (SELECT isodow(day) AS dow, count(DISTINCT day) AS n FROM daily GROUP BY ALL), e AS (SELECT isodow(day) AS dow, pattern_uid, link_idx, sum(obs) / sum(passages) AS r FROM daily GROUP BY ALL)
SELECT pattern_uid, link_idx, round(sum(n * r) / sum(n), 6) AS opp FROM e JOIN s USING (dow) GROUP BY ALL""",
    "weighted_bootstrap_hash": _DAILY + _WEIGHTS.format(draws=20) + "SELECT draw, day::VARCHAR AS day, round(w, 6) AS w FROM wts",
    "percentile_ci": _DAILY + _WEIGHTS.format(draws=50) + """, x AS (SELECT draw, pattern_uid, link_idx, sum(obs * w) / sum(passages * w) AS x FROM daily JOIN wts USING (day) GROUP BY ALL),
v AS (SELECT pattern_uid, link_idx, sum(obs) / sum(passages) AS value FROM daily GROUP BY ALL)
SELECT pattern_uid, link_idx, round(any_value(value), 6) AS value, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, round(stddev_samp(x), 6) AS se FROM v JOIN x USING (pattern_uid, link_idx) GROUP BY ALL""",
    "p_values": f"""WITH z AS (SELECT event_id, value, event_id % 7 * 30.0::DOUBLE AS se FROM events), y AS (SELECT *, CASE WHEN se > 0 THEN (value - 100) / se / sqrt(2) END AS x, 1 / (1 + abs(x) / 2) AS t FROM z),
q AS (SELECT *, t * exp({_CHEB} - x * x) AS u FROM y) SELECT event_id, round(CASE WHEN se > 0 THEN 0.5 * {_ERFC} WHEN value > 100 THEN 0.0 WHEN value IS NOT NULL THEN 1.0 END, 6)::DOUBLE AS p FROM q""",
    "persistence": _DAILY + """, l AS (SELECT pattern_uid, link_idx, sum(obs) / sum(passages) AS level FROM daily GROUP BY ALL)
SELECT pattern_uid, link_idx, count(*) AS n_days, round(avg((obs / passages > level)::INT), 6) AS persistence FROM daily JOIN l USING (pattern_uid, link_idx) GROUP BY ALL""",
    "ss_cost": _DAILY + """, b AS (SELECT pattern_uid, len_m, sum(obs) AS k FROM daily JOIN (VALUES (0, 200.0::DOUBLE), (1, 310.0), (2, 340.0), (3, 250.0), (4, 300.0)) l(link_idx, len_m) USING (link_idx) GROUP BY pattern_uid, link_idx, len_m),
w AS (SELECT *, avg(len_m) OVER (PARTITION BY pattern_uid) AS width FROM b) SELECT pattern_uid, round((2 * avg(k * width / len_m) - var_pop(k * width / len_m)) / pow(100 * any_value(width), 2), 6) AS cost FROM w GROUP BY ALL""",
    "compare_bins": _DAILY + """, r AS (SELECT pattern_uid, link_idx, sum(obs) FILTER (day < DATE '1995-06-01') / sum(passages) FILTER (day < DATE '1995-06-01') AS a, sum(obs) FILTER (day >= DATE '1995-06-01') / sum(passages) FILTER (day >= DATE '1995-06-01') AS b FROM daily GROUP BY ALL)
SELECT pattern_uid, link_idx, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, round(log2((b + 0.5) / (a + 0.5)), 6) AS ratio FROM r WHERE a IS NOT NULL AND b IS NOT NULL""",
    "split_half": _DAILY + """, h AS (SELECT day, row_number() OVER (ORDER BY day) % 2 AS half FROM (SELECT DISTINCT day FROM daily)), x AS (SELECT pattern_uid, link_idx, sum(obs) FILTER (half = 0) / sum(passages) FILTER (half = 0) AS x0,
sum(obs) FILTER (half = 1) / sum(passages) FILTER (half = 1) AS x1 FROM daily JOIN h USING (day) GROUP BY ALL), r AS (SELECT pattern_uid, greatest(corr(x0, x1), 0) AS r FROM x WHERE x0 IS NOT NULL AND x1 IS NOT NULL GROUP BY ALL) SELECT pattern_uid, round(2 * r / (1 + r), 6) AS reliability FROM r""",
    "resample": """WITH f AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER w AS p, lead(epoch_us(ts)) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
k AS (SELECT event_id, t, CASE WHEN t - p BETWEEN 1 AND 43200000000 THEN p END AS p, CASE WHEN n - t BETWEEN 1 AND 43200000000 THEN n END AS n FROM f),
g AS (SELECT *, unnest(range((t - 43200000000) // 3600000000, (t + 43200000000) // 3600000000 + 1)) * 3600000000 AS g FROM k WHERE p IS NOT NULL OR n IS NOT NULL)
SELECT event_id, g // 1000000 AS at_unix, (hour(make_timestamp(t)) + g // 3600000000 - t // 3600000000)::INT AS hour FROM g
WHERE CASE WHEN g <= t THEN CASE WHEN p IS NULL THEN g < t AND 2 * g >= 3 * t - n ELSE g > p AND 2 * (g - p) >= t - p END ELSE CASE WHEN n IS NULL THEN 2 * g <= 3 * t - p ELSE g <= n AND 2 * (g - t) < n - t END END""",
    "crossings": """WITH a AS (SELECT user_id AS track_id, ts, value AS s, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 86400 OR lag(value) OVER w - value > 500 THEN 1 ELSE 0 END AS b
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)), r AS (SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY ts, s)::BIGINT AS run FROM a),
m AS (SELECT *, epoch_us(ts) AS t, max(s) OVER (PARTITION BY track_id, run ORDER BY ts, s) AS s1 FROM r), n AS (SELECT *, lag(s1) OVER v AS s0, lag(t) OVER v AS t0 FROM m WINDOW v AS (PARTITION BY track_id, run ORDER BY ts, s1)),
k AS (SELECT *, unnest(range(floor(s0 / 50)::BIGINT + 1, floor(s1 / 50)::BIGINT + 1)) AS line FROM n WHERE s1 > s0)
SELECT track_id, run, line, count(*) AS n, min(floor((t0 + (line * 50 - s0) / (s1 - s0) * (t - t0)) / 1e6))::BIGINT AS at_s FROM k GROUP BY ALL""",
    "link_median_crossings": """WITH c AS (SELECT l_shipdate::DATE AS day, (l_orderkey % 4)::INT AS hour, (l_partkey % 12)::INT AS line, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT DISTINCT day, hour FROM c),
d AS (SELECT k.day, k.hour, (x.line // 4)::INT AS link_idx, coalesce(n, 0) AS n FROM k CROSS JOIN range(0, 12) x(line) LEFT JOIN c ON c.day = k.day AND c.hour = k.hour AND c.line = x.line)
SELECT day::VARCHAR AS day, hour, link_idx, quantile_cont(n::DOUBLE, 0.5) AS n FROM d GROUP BY ALL HAVING quantile_cont(n::DOUBLE, 0.5) > 0""",
    "active_services": """WITH s AS (SELECT s_suppkey AS service_id, DATE '2024-01-01' + (s_suppkey % 20)::INT AS a FROM supplier), d AS (SELECT DATE '2024-01-05' + i::INT AS day FROM range(0, 40) r(i))
SELECT day::VARCHAR AS day, service_id FROM d, s WHERE ((day BETWEEN a AND a + 30 AND (isodow(day) - 1 + service_id) % 3 <> 0) OR (day = a + 10 AND service_id % 2 = 0)) AND NOT (day = a + 10 AND service_id % 2 = 1)""",
    "alias_learning": """WITH n AS (SELECT l_suppkey % 50 AS terminus_id, l_partkey % 30 AS stop_id, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT terminus_id, stop_id // 6 AS p, sum(n) AS score FROM n WHERE stop_id % 6 <> 5 GROUP BY ALL)
SELECT terminus_id, p * 6 + 5 AS last_stop FROM s QUALIFY row_number() OVER (PARTITION BY terminus_id ORDER BY score DESC, p >= 2, p) = 1""",
    "spatial_candidates": """WITH f AS (SELECT c_custkey AS fix_id, 50 + c_custkey % 97 / 1000 AS y, 4 + c_custkey % 89 / 1000 AS x FROM customer), p AS (SELECT s_suppkey AS point_id, 50 + s_suppkey % 83 / 1000 AS v, 4 + s_suppkey % 79 / 1000 AS u FROM supplier),
d AS (SELECT fix_id, point_id, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(v - y) / 2), 2) + cos(radians(y)) * cos(radians(v)) * pow(sin(radians(u - x) / 2), 2))) AS m FROM f, p) SELECT fix_id, point_id, round(m, 3) AS m FROM d WHERE m <= 400""",
}


def _stop_links(s):
    return fx.links(s).withColumn("head", F.lit(38.0) + F.col("link_idx")).withColumn("tail", F.lit(36.0))


def _bins(df, *columns):
    return df.select("pattern_uid", "link_idx", "k", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "seg_idx", *columns)


def _zoned(s, d):
    parts = _read(s, d, "part").select("p_partkey", (F.col("p_size") % 3).cast("string").alias("pattern_uid"), (F.col("p_partkey") % 1500).cast("double").alias("x0_m"), (F.col("p_partkey") % 1500 + 30).cast("double").alias("x1_m"))
    stops = s.range(12).select((F.col("id") % 3).cast("string").alias("pattern_uid"), (F.col("id") * 130.0).alias("s_m"))
    return grids.tagged(parts, stops, 30.0, 60.0)


def _sets(s, d, condition):
    return _read(s, d, "events").where(condition).select("user_id", (F.col("event_id") % 300).alias("j"))


def _mains(s, d):
    o = _read(s, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 4).cast("int").alias("v"))
    seqs = s.createDataFrame([(0, ["A", "B", "C", "D", "E"]), (1, ["B", "C", "D"]), (2, ["A", "C", "D", "E"]), (3, ["C", "D"])], "v int, stop_ids array<string>")
    days = o.groupBy("day", "v").agg(F.count(F.lit(1)).alias("n_trips")).join(seqs, "v").withColumn("pattern_uid", F.concat(F.lit("p"), F.col("v").cast("string")))
    return pt.main_patterns(days, ["day"])


def _speeds(s, d):
    x = _daily(s, d).groupBy(*_KEYS).agg((F.sum("obs") / F.sum("passages")).alias("opp"), F.sum("obs").alias("n")).join(fx.links(s), _KEYS)
    return x.select(*_KEYS, pt.speed_kmh(F.col("opp"), F.col("len_m"), F.col("n")).alias("kmh"))


def _combined(s, d):
    p = fx.placed(s, d)
    keys = ["service_date", "pattern_uid", "link_idx"]
    feed = p.where("hour < 14").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_feed"))
    return pt.combined_passages(feed, p.where("hour >= 10").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events")), keys).withColumn("service_date", F.col("service_date").cast("string"))


QUERIES |= {
    "segment_grid_fixed": lambda s, d: _bins(grids.fixed_grid(fx.links(s), 30.0, 15.0)),
    "segment_grid_stops": lambda s, d: _bins(grids.stops_grid(_stop_links(s), 30.0), "zone"),
    "zone_tag": lambda s, d: _zoned(s, d).select("p_partkey", "zone"),
    "tolerant_jaccard": lambda s, d: _rounded(pt.tolerant_overlap(_sets(s, d, "event_type < 'm'"), _sets(s, d, "event_type >= 'm'"), "user_id"), "overlap"),
    "choose_main": lambda s, d: _text_day(_mains(s, d)),
    "speed_scale": lambda s, d: _rounded(_speeds(s, d), "kmh"),
    "passages_combine": _combined,
}

_LINKS = """WITH links AS (SELECT * FROM (VALUES (0, 200.0::DOUBLE), (1, 310.0), (2, 340.0), (3, 250.0), (4, 300.0)) l(link_idx, len_m), (VALUES ('F'), ('O'), ('P')) p(pattern_uid))
"""
ORACLE_SQL |= {
    "segment_grid_fixed": _LINKS + """, e AS (SELECT pattern_uid, link_idx, len_m, unnest(range(0, 13)) AS i FROM links), f AS (SELECT pattern_uid, link_idx, 15.0 + 30 * i AS x FROM e WHERE 15 + 30 * i BETWEEN 1 AND len_m - 1
UNION ALL SELECT pattern_uid, link_idx, 0.0 FROM links UNION ALL SELECT pattern_uid, link_idx, len_m FROM links), b AS (SELECT *, lead(x) OVER (PARTITION BY pattern_uid, link_idx ORDER BY x) AS hi FROM f)
SELECT pattern_uid, link_idx, (row_number() OVER (PARTITION BY pattern_uid, link_idx ORDER BY x) - 1)::INT AS k, x::DOUBLE AS lo, hi::DOUBLE AS hi, (row_number() OVER (PARTITION BY pattern_uid ORDER BY link_idx, x) - 1)::INT AS seg_idx FROM b WHERE hi IS NOT NULL""",
    "segment_grid_stops": _LINKS + """, m AS (SELECT *, 38.0 + link_idx AS h, round_even((len_m - 74 - link_idx) / 30, 0)::INT AS n FROM links), f AS (SELECT pattern_uid, link_idx, len_m, h, h + (len_m - 36 - h) / n * i AS x FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM m)
UNION ALL SELECT pattern_uid, link_idx, len_m, h, 0.0 FROM m UNION ALL SELECT pattern_uid, link_idx, len_m, h, len_m FROM m), b AS (SELECT *, lead(x) OVER (PARTITION BY pattern_uid, link_idx ORDER BY x) AS hi FROM f)
SELECT pattern_uid, link_idx, (row_number() OVER (PARTITION BY pattern_uid, link_idx ORDER BY x) - 1)::INT AS k, round(x, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi,
(row_number() OVER (PARTITION BY pattern_uid ORDER BY link_idx, x) - 1)::INT AS seg_idx, CASE WHEN x = 0 OR hi = len_m THEN 'stop' ELSE 'running' END AS zone FROM b WHERE hi IS NOT NULL""",
    "zone_tag": """SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM range(0, 12) r(i) WHERE i % 3 = p_size % 3 AND p_partkey % 1500 < i * 130 + 60 AND p_partkey % 1500 + 30 > i * 130 - 30) THEN 'stop' ELSE 'running' END AS zone FROM part""",
    "tolerant_jaccard": """WITH a AS (SELECT DISTINCT user_id, event_id % 300 AS j FROM events WHERE event_type < 'm'), b AS (SELECT DISTINCT user_id, event_id % 300 AS j FROM events WHERE event_type >= 'm'),
h AS (SELECT user_id, EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND abs(b.j - a.j) <= 1)::INT AS hit FROM a UNION ALL SELECT user_id, EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND abs(b.j - a.j) <= 1)::INT FROM b)
SELECT user_id, round(avg(hit), 6) AS overlap FROM h GROUP BY user_id""",
    "choose_main": """WITH s AS (SELECT * FROM (VALUES (0, 'ABCDE'), (1, 'BCD'), (2, 'ACDE'), (3, 'CD')) s(v, q)), o AS (SELECT o_orderdate::DATE AS day, o_custkey % 4 AS v, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT *, max(n) OVER (PARTITION BY day) AS top FROM o JOIN s USING (v)),
c AS (SELECT a.day, a.v, a.n, length(a.q) AS len, sum(b.n * (length(b.q) - 1)) AS score FROM d a JOIN d b ON a.day = b.day AND contains(a.q, b.q) WHERE a.n >= 0.25 * a.top GROUP BY ALL)
SELECT day::VARCHAR AS day, 'p' || v AS pattern_uid, score::BIGINT AS score FROM c QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, n DESC, len DESC, v) = 1""",
    "speed_scale": _DAILY + """SELECT pattern_uid, link_idx, round(CASE WHEN sum(obs) >= 3 THEN least(80.0, 3.6 * any_value(len_m) / greatest(sum(obs) / sum(passages) * 20, 1e-9)) END, 6) AS kmh
FROM daily JOIN (VALUES (0, 200.0::DOUBLE), (1, 310.0), (2, 340.0), (3, 250.0), (4, 300.0)) l(link_idx, len_m) USING (link_idx) GROUP BY ALL""",
    "passages_combine": """WITH p AS (SELECT o_orderdate::DATE AS service_date, o_orderstatus AS pattern_uid, ((l_linenumber - 1) % 5)::INT AS link_idx, l_orderkey % 24 AS hour FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT service_date::VARCHAR AS service_date, pattern_uid, link_idx, count(*) FILTER (hour < 14) AS n_feed, count(*) FILTER (hour >= 10) AS n_events, greatest(count(*) FILTER (hour < 14), count(*) FILTER (hour >= 10)) AS n FROM p GROUP BY ALL""",
}
