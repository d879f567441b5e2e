"""Registered queries of the comparison of two periods, with SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellscope.operators import compare as cp
from dwellscope.operators import hotspots as hs
from dwellscope.plans.analysis import LINE_SQL, World, rounded
from dwellscope.sources.store import once

SPLIT = ("2024-02-09", "2024-02-10")


def _worlds(s, d):
    return World(s, d, last=SPLIT[0]), World(s, d, first=SPLIT[1])


def _old(w):
    return w.mains.select("direction_id", "pattern_uid").distinct().join(w.segments, "pattern_uid")


def _match(s, d):
    a, b = _worlds(s, d)
    return cp.aligned(hs.numbered(b.places()), _old(a))


def _bins(s, d):
    def make():
        a, b = _worlds(s, d)
        old = _old(a).select("direction_id", "seg_key").distinct()
        of_a = hs.bin_statistics(a.cells().join(old, ["direction_id", "seg_key"], "left_semi"), a.mains, 20, min_passages=0.0973, seed=0)
        return cp.changes(_match(s, d), of_a, b.bins(20, 1), cp.per_hour(a.ready_estimates()), cp.per_hour(b.ready_estimates()), q=0.5)

    return once(s, ("changes", d), make)


def _stretches(s, d):
    a, b = _worlds(s, d)
    out = cp.changed_stretches(_bins(s, d), a.mains, b.mains, theta_s=0.1)
    return out.withColumn("hours", F.array_join(F.transform("hours", lambda x: x.cast("string")), ","))


QUERIES = {
    "aligned_segments": lambda s, d: _match(s, d).select("direction_id", "j", "seg_key", "seg_key_a", "match"),
    "unmatched_segments": lambda s, d: cp.unmatched(_match(s, d), _worlds(s, d)[0].places()),
    "period_changes": lambda s, d: rounded(_bins(s, d).select("direction_id", "seg_key", "col", "opp_a", "opp_b", "delta", "lo", "hi", "p", "significant", "sign", "per_h_a", "per_h_b"), 8),
    "frequency_change": lambda s, d: rounded(cp.frequency_change(_bins(s, d)), 8),
    "pooled_hours": lambda s, d: rounded(cp.pooled_hours(_bins(s, d), (7, 19)), 8),
    "changed_stretches": lambda s, d: rounded(_stretches(s, d), 6),
}

_ALIGN = LINE_SQL + """bp AS (SELECT direction_id, link_key, seg_key, k, (row_number() OVER (PARTITION BY direction_id ORDER BY seg_idx) - 1)::INT AS j FROM sg WHERE pattern_uid IN ('A1', 'B0')), ap AS (SELECT direction_id, link_key, seg_key, k, seg_idx FROM sg WHERE pattern_uid IN ('A0', 'B0')),
al AS (SELECT b.direction_id, j, b.seg_key, b.link_key, coalesce(a.seg_key, CASE WHEN b.link_key = 'c>d~2' THEN 'c>d~1/' || b.k END) AS seg_key_a, CASE WHEN a.seg_key IS NOT NULL THEN 'seg_key' WHEN b.link_key = 'c>d~2' THEN 'stop_pair' END AS match FROM bp b LEFT JOIN ap a ON a.direction_id = b.direction_id AND a.seg_key = b.seg_key)
"""
ORACLE_SQL = {
    "aligned_segments": _ALIGN + "SELECT direction_id, j, seg_key, seg_key_a, match FROM al",
    "unmatched_segments": _ALIGN + "SELECT direction_id, 'b' AS period, seg_key, link_key FROM al WHERE seg_key_a IS NULL UNION ALL SELECT direction_id, 'a', seg_key, link_key FROM ap ANTI JOIN (SELECT direction_id, seg_key_a AS seg_key FROM al) USING (direction_id, seg_key)",
}
