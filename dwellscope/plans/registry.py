"""Registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import core
from dwellscope.operators import indicators as ind
from dwellscope.plans import analysis, compare_queries, hotspot_queries, line_queries, more, tune_queries
from dwellscope.sources import fixtures as fx

_SEG = """
WITH links AS (SELECT * FROM (VALUES (0, 200.0::DOUBLE), (1, 310.0), (2, 340.0), (3, 250.0), (4, 300.0)) l(link_idx, len_m), (VALUES ('F'), ('O'), ('P')) p(pattern_uid)),
grid AS (SELECT *, greatest(1, round_even(len_m / 30, 0))::INT AS n FROM links),
seg0 AS (SELECT pattern_uid, link_idx, len_m, n, unnest(range(0, n))::INT AS k FROM grid),
segs AS (SELECT pattern_uid, link_idx, k, k * (len_m / n) AS lo, CASE WHEN k = n - 1 THEN len_m ELSE (k + 1) * (len_m / n) END AS hi,
  (row_number() OVER (PARTITION BY pattern_uid ORDER BY link_idx, k) - 1)::INT AS seg_idx FROM seg0),
placed AS (SELECT o_orderdate::DATE AS service_date, (l_orderkey % 24)::INT AS hour, o_orderstatus AS pattern_uid, ((l_linenumber - 1) % 5)::INT AS link_idx,
  l_quantity * 6.1::DOUBLE AS pos_m, l_orderkey AS track_id, l_linenumber <> 7 AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ends AS (SELECT pattern_uid, link_idx, max(hi) AS top FROM segs GROUP BY ALL),
cube AS (SELECT p.service_date, p.hour, p.pattern_uid, s.seg_idx, count(*) AS obs FROM placed p JOIN ends e USING (pattern_uid, link_idx)
  JOIN segs s ON s.pattern_uid = p.pattern_uid AND s.link_idx = p.link_idx AND least(p.pos_m, e.top) > s.lo AND least(p.pos_m, e.top) <= s.hi WHERE p.cnt GROUP BY ALL),
pas AS (SELECT service_date, hour, pattern_uid, link_idx, count(DISTINCT track_id) AS n FROM placed GROUP BY ALL)
"""


def _segs(spark):
    return core.segment_grid(fx.links(spark), 30.0)


def _cube(spark, d):
    return core.cube(fx.placed(spark, d), _segs(spark))


def _estimate(spark, d):
    return core.estimate(_cube(spark, d), fx.passages(spark, d), _segs(spark))


def _local(spark, d):
    return core.local_time(fx.observations(spark, d), "Europe/Brussels")


def _pvalues(spark, d):
    return fx.observations(spark, d).select("route_id", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("s_m") / 5000).alias("p"))


_OBS = "WITH obs AS (SELECT event_id, ts, event_type AS route_id, user_id AS track_id, value AS s_m FROM events)"
_RUNS = (
    _OBS
    + """, a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w > 3000 OR lag(s_m) OVER w - s_m > 50 THEN 1 ELSE 0 END AS brk
FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY ts, s_m)), r AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY ts, s_m ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a)
"""
)

QUERIES = {
    "segment_grid_equal": lambda s, d: _segs(s).select("pattern_uid", "link_idx", "k", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "seg_idx"),
    "cube_count": lambda s, d: _cube(s, d).withColumn("service_date", F.col("service_date").cast("string")),
    "link_totals": lambda s, d: core.link_totals(_cube(s, d), _segs(s)),
    "passages": lambda s, d: fx.passages(s, d).withColumn("service_date", F.col("service_date").cast("string")),
    "estimator_hours": lambda s, d: _estimate(s, d).select("pattern_uid", "seg_idx", "hour", "obs", "passages", F.round("opp", 6).alias("opp")),
    "excess": lambda s, d: _estimate(s, d).select("pattern_uid", "seg_idx", "hour", F.round("ref", 6).alias("ref"), F.round("excess", 6).alias("excess"), F.round("ratio", 6).alias("ratio")),
    "feed_length_p995": lambda s, d: core.feed_lengths(fx.placed(s, d)).select("pattern_uid", "link_idx", "n", F.round("flen", 6).alias("flen")),
    "service_time": lambda s, d: _local(s, d).select("event_id", F.col("service_date").cast("string").alias("service_date"), "hour", "dow"),
    "id_normalise": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", core.normalised_id(F.concat(F.lit(" 00"), F.col("c_custkey").cast("string"), F.col("c_mktsegment"))).alias("id")),
    "snapshots_infer": lambda s, d: fx.observations(s, d).groupBy("ts").agg(F.count(F.lit(1)).alias("n_rows")),
    "run_numbering": lambda s, d: core.runs(fx.observations(s, d), 3000, 50).select("event_id", "run"),
    "running_max": lambda s, d: core.runs(fx.observations(s, d), 3000, 50).select("event_id", "s_max"),
    "thin": lambda s, d: core.thin(fx.observations(s, d), 3600).select("event_id"),
    "bh": lambda s, d: core.benjamini_hochberg(_pvalues(s, d), 0.3, "route_id", "event_id").select("event_id", "reject"),
    "stretches": lambda s, d: core.islands(fx.observations(s, d).select("track_id", (F.col("event_id") / 20).cast("int").alias("j")).distinct(), "track_id", "j", 3),
    "spearman": lambda s, d: core.spearman(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_discount", "l_returnflag").select("l_returnflag", F.round("rho", 6).alias("rho"), "n"),
    "haversine": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", F.round(core.haversine_m(F.lit(50.8), F.lit(4.3), 50.8 + F.col("c_custkey") % 100 / 1000, 4.3 + F.col("c_nationkey") / 1000), 3).alias("m")
    ),
    "unmatched_anti": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey").join(s.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"),
}

_EST = """, o AS (SELECT pattern_uid, seg_idx, hour, sum(obs) AS obs FROM cube GROUP BY ALL), q AS (SELECT pattern_uid, link_idx, hour, sum(n) AS passages FROM pas GROUP BY ALL),
cells AS (SELECT s.pattern_uid, s.seg_idx, q.hour, coalesce(o.obs, 0)::BIGINT AS obs, q.passages::BIGINT AS passages FROM segs s JOIN q USING (pattern_uid, link_idx)
  LEFT JOIN o ON o.pattern_uid = s.pattern_uid AND o.seg_idx = s.seg_idx AND o.hour = q.hour),
refs AS (SELECT pattern_uid, seg_idx, sum(obs) FILTER (hour BETWEEN 20 AND 23) / nullif(sum(passages) FILTER (hour BETWEEN 20 AND 23), 0) AS ref FROM cells GROUP BY ALL)
"""
ORACLE_SQL = {
    "segment_grid_equal": _SEG + "SELECT pattern_uid, link_idx, k, round(lo, 6) AS lo, round(hi, 6) AS hi, seg_idx FROM segs",
    "cube_count": _SEG + "SELECT service_date::VARCHAR AS service_date, hour, pattern_uid, seg_idx, obs FROM cube",
    "link_totals": _SEG + "SELECT pattern_uid, link_idx, sum(obs)::BIGINT AS obs FROM cube JOIN segs USING (pattern_uid, seg_idx) GROUP BY ALL",
    "passages": _SEG + "SELECT service_date::VARCHAR AS service_date, hour, pattern_uid, link_idx, n FROM pas",
    "estimator_hours": _SEG + _EST + "SELECT pattern_uid, seg_idx, hour, obs, passages, round(obs / nullif(passages, 0), 6) AS opp FROM cells",
    "excess": _SEG + _EST + "SELECT pattern_uid, seg_idx, hour, round(ref, 6) AS ref, round(obs / passages - ref, 6) AS excess, round(log2((obs / passages + 0.5) / (ref + 0.5)), 6) AS ratio FROM cells JOIN refs USING (pattern_uid, seg_idx)",
    "feed_length_p995": _SEG + "SELECT pattern_uid, link_idx, count(pos_m) AS n, CASE WHEN count(pos_m) >= 20 THEN round(quantile_cont(pos_m, 0.995), 6) END AS flen FROM placed GROUP BY ALL",
    "service_time": _OBS + """, l AS (SELECT event_id, timezone('Europe/Brussels', timezone('UTC', ts)) AS lt FROM obs), s AS (SELECT *, (lt - INTERVAL 4 HOUR)::DATE AS service_date FROM l)
SELECT event_id, service_date::VARCHAR AS service_date, floor(epoch(lt - service_date::TIMESTAMP) / 3600)::INT AS hour, (isodow(service_date) - 1)::INT AS dow FROM s""",
    "id_normalise": "SELECT c_custkey, c_custkey::VARCHAR AS id FROM customer",
    "snapshots_infer": "SELECT ts, count(*) AS n_rows FROM events GROUP BY ts",
    "run_numbering": _RUNS + "SELECT event_id, run FROM r",
    "running_max": _RUNS + "SELECT event_id, max(s_m) OVER (PARTITION BY track_id, run ORDER BY ts, s_m ROWS UNBOUNDED PRECEDING) AS s_max FROM r",
    "thin": _OBS + " SELECT event_id FROM obs QUALIFY row_number() OVER (PARTITION BY track_id, floor(epoch(ts) / 3600) ORDER BY ts DESC, s_m DESC) = 1",
    "bh": """WITH p AS (SELECT event_type AS g, event_id, CASE WHEN event_id % 11 <> 0 THEN value / 5000 END AS p FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY g) AS m FROM p WHERE p IS NOT NULL),
x AS (SELECT g, max(k) FILTER (p <= 0.3 * k / m) AS top FROM t GROUP BY g) SELECT p.event_id, coalesce(t.k <= x.top, false) AS reject FROM p LEFT JOIN t USING (event_id) LEFT JOIN x ON x.g = p.g""",
    "stretches": """WITH j AS (SELECT DISTINCT user_id AS track_id, (event_id // 20)::INT AS j FROM events), n AS (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY track_id ORDER BY j) > 4 THEN 1 ELSE 0 END AS b FROM j),
s AS (SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT AS stretch FROM n) SELECT track_id, stretch, min(j) AS j0, max(j) AS j1, count(*) AS n FROM s GROUP BY track_id, stretch""",
    "spearman": """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY l_returnflag""",
    "haversine": """SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(c_custkey % 100 / 1000) / 2), 2) + cos(radians(50.8)) * cos(radians(50.8 + c_custkey % 100 / 1000)) * pow(sin(radians(c_nationkey / 1000) / 2), 2))), 3) AS m FROM customer""",
    "unmatched_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
}

BANDS = {"am": (7, 10), "day": (6, 23), "evening": (20, 24)}


def _days(spark, d, table, column):
    """All dates of a table: of shipments (wanted) and of orders (covered, or feeds)."""
    return spark.read.parquet(f"{d}/{table}.parquet").select(F.to_date(column).alias("day")).distinct()


def _versions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.col("o_orderstatus").alias("route_id"), F.to_date("o_orderdate").alias("day")).agg((F.max("o_orderkey") % 3).alias("version"))


def _text(df, *columns):
    return df.select(*[F.col(c).cast("string").alias(c) if c in columns else c for c in df.columns])


QUERIES |= {
    "estimator_bands": lambda s, d: ind.band_totals(_cube(s, d), BANDS),
    "line_level": lambda s, d: ind.line_level(_estimate(s, d), _segs(s)).withColumn("line_ref", F.round("line_ref", 6)),
    "weekday_totals": lambda s, d: ind.weekday_totals(_cube(s, d)),
    "frequency": lambda s, d: ind.frequency(fx.passages(s, d)).withColumn("per_h", F.round("per_h", 6)),
    "stalls": lambda s, d: ind.stalls(fx.snapshots(s, d), 3600.0, 20.0, 300.0).withColumn("frozen_s", F.round("frozen_s", 3)),
    "versions": lambda s, d: _text(ind.version_runs(_versions(s, d)), "day0", "day1"),
    "nearest_daytype": lambda s, d: _text(ind.nearest_covered(_days(s, d, "lineitem", "l_shipdate"), _days(s, d, "orders", "o_orderdate")), "day", "covered_day"),
    "asof_feed": lambda s, d: _text(ind.feed_on(_days(s, d, "lineitem", "l_shipdate"), _days(s, d, "orders", "o_orderdate"), 14), "day", "feed"),
    "hotspot_rank": lambda s, d: ind.ranked(_estimate(s, d).withColumn("excess", F.round("excess", 6)), "pattern_uid", "excess", 20, "seg_idx", "hour").select("pattern_uid", "rank", "seg_idx", "hour", "excess"),
}

_DAYS = """WITH w AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem), c AS (SELECT DISTINCT o_orderdate::DATE AS cov FROM orders)
"""
ORACLE_SQL |= {
    "estimator_bands": _SEG + """SELECT pattern_uid, seg_idx, band, sum(obs)::BIGINT AS obs, count(DISTINCT service_date) AS n_days
FROM cube JOIN (VALUES ('am', 7, 10), ('day', 6, 23), ('evening', 20, 24)) b(band, a, z) ON hour >= a AND hour < z GROUP BY ALL""",
    "line_level": _SEG + _EST + """, r AS (SELECT pattern_uid, seg_idx, any_value(hi - lo) AS len_m, sum(obs) / nullif(sum(passages), 0) / any_value(hi - lo) AS rate FROM cells JOIN segs USING (pattern_uid, seg_idx) WHERE hour BETWEEN 6 AND 22 GROUP BY ALL),
l AS (SELECT pattern_uid, quantile_cont(rate, 0.5) AS level FROM r GROUP BY ALL) SELECT pattern_uid, seg_idx, round(level * len_m, 6) AS line_ref FROM r JOIN l USING (pattern_uid)""",
    "weekday_totals": _SEG + "SELECT (isodow(service_date) - 1)::INT AS dow, hour, pattern_uid, seg_idx, sum(obs)::BIGINT AS obs, count(DISTINCT service_date) AS n_days FROM cube GROUP BY ALL",
    "frequency": _SEG + """, dd AS (SELECT pattern_uid, count(DISTINCT service_date) AS days FROM pas GROUP BY ALL), ll AS (SELECT pattern_uid, hour, link_idx, sum(n) / any_value(days) AS f FROM pas JOIN dd USING (pattern_uid) GROUP BY ALL)
SELECT pattern_uid, hour, round(quantile_cont(f, 0.5), 6) AS per_h FROM ll GROUP BY ALL""",
    "stalls": """WITH p AS (SELECT ts, bool_and(event_id % 7 < 2) AS frozen FROM events GROUP BY ts), q AS (SELECT ts, frozen, least(coalesce((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 20), 3600) AS span,
sum(CASE WHEN frozen THEN 0 ELSE 1 END) OVER w AS run FROM p WINDOW w AS (ORDER BY ts))
SELECT min(ts) AS ts0, max(ts) AS ts1, count(*) AS n, round(sum(span), 3) AS frozen_s FROM q WHERE frozen GROUP BY run HAVING sum(span) > 300""",
    "versions": """WITH v AS (SELECT o_orderstatus AS route_id, o_orderdate::DATE AS day, max(o_orderkey) % 3 AS version FROM orders GROUP BY ALL),
n AS (SELECT *, CASE WHEN version = lag(version) OVER (PARTITION BY route_id ORDER BY day) THEN 0 ELSE 1 END AS b FROM v), r AS (SELECT *, sum(b) OVER (PARTITION BY route_id ORDER BY day)::BIGINT AS run FROM n)
SELECT route_id, run, any_value(version) AS version, min(day)::VARCHAR AS day0, max(day)::VARCHAR AS day1, count(*) AS n FROM r GROUP BY route_id, run""",
    "nearest_daytype": _DAYS + """SELECT day::VARCHAR AS day, cov::VARCHAR AS covered_day FROM w, c
QUALIFY row_number() OVER (PARTITION BY day ORDER BY greatest(isodow(day), 5) <> greatest(isodow(cov), 5), abs(day - cov), cov) = 1""",
    "asof_feed": _DAYS + "SELECT w.day::VARCHAR AS day, CASE WHEN w.day - max(cov) <= 14 THEN max(cov)::VARCHAR END AS feed FROM w LEFT JOIN c ON cov <= w.day GROUP BY w.day",
    "hotspot_rank": _SEG + _EST + """, x AS (SELECT pattern_uid, seg_idx, hour, round(obs / passages - ref, 6) AS excess FROM cells JOIN refs USING (pattern_uid, seg_idx))
SELECT pattern_uid, (row_number() OVER (PARTITION BY pattern_uid ORDER BY excess DESC, seg_idx, hour))::INT AS rank, seg_idx, hour, excess FROM x WHERE excess IS NOT NULL QUALIFY rank <= 20""",
}


def _stretches(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    j0 = (F.col("event_id") * 7919 % 100003).alias("j0")
    return e.select("user_id", j0, (F.col("event_id") * 7919 % 100003 + F.col("event_id") % 400).alias("j1"))


QUERIES |= {
    "ref_freeflow": lambda s, d: ind.free_flow(_estimate(s, d)).withColumn("free_flow", F.round("free_flow", 6)),
    "merge_stretches": lambda s, d: ind.merged_stretches(_stretches(s, d), "user_id"),
}
ORACLE_SQL |= {
    "ref_freeflow": _SEG + _EST + "SELECT pattern_uid, seg_idx, round(quantile_cont(CASE WHEN hour BETWEEN 5 AND 23 THEN obs / nullif(passages, 0) END, 0.2), 6) AS free_flow FROM cells GROUP BY ALL",
    "merge_stretches": """WITH t AS (SELECT user_id, event_id * 7919 % 100003 AS j0, event_id * 7919 % 100003 + event_id % 400 AS j1 FROM events),
n AS (SELECT *, CASE WHEN j0 > max(j1) OVER (PARTITION BY user_id ORDER BY j0, j1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS b FROM t),
p AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY j0, j1 ROWS UNBOUNDED PRECEDING) AS part FROM n) SELECT user_id, min(j0) AS j0, max(j1) AS j1 FROM p GROUP BY user_id, part""",
}

for _part in (more, analysis, hotspot_queries, compare_queries, line_queries, tune_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
