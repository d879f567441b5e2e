"""Writing results: tables, compact feeds, GeoJSON, the JSON document and the page."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def compact_rows(obs: DataFrame) -> DataFrame:
    """OBSERVATION as compact rows: ts in seconds, line, dir, point, dist in whole metres."""
    return obs.select(F.unix_seconds("ts").alias("ts"), F.col("route_id").alias("line"), F.col("terminus_id").alias("dir"), F.col("stop_id").alias("point"), F.round("dist_m").cast("long").alias("dist"))


def compact_polls(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(F.unix_seconds("ts").alias("ts"), F.col("frozen").alias("same"), "n_rows")


def stretch_lines(stretches: DataFrame, segments: DataFrame) -> DataFrame:
    """Stretches with ``coordinates``: the lines of their segments in a row, repeats in a row once; null under two points.

    ``segments`` has pattern_uid, seg_idx, geometry; stretches pattern_uid, from_seg, to_seg.
    """
    keyed = stretches.withColumn("__id", F.monotonically_increasing_id())
    inside = keyed.select("__id", "pattern_uid", F.explode(F.sequence("from_seg", "to_seg")).alias("seg_idx")).join(segments.select("pattern_uid", "seg_idx", "geometry"), ["pattern_uid", "seg_idx"])
    flat = inside.groupBy("__id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "geometry"))), lambda x: x["geometry"])).alias("all"))  # a stretch's segments
    once = F.filter("all", lambda p, i: (i == 0) | (p != F.get("all", i - 1)))
    lines = flat.select("__id", once.alias("c")).select("__id", F.when(F.size("c") >= 2, F.col("c")).alias("coordinates"))
    return keyed.join(lines, "__id", "left").drop("__id")


def geojson(stretches: DataFrame, segments: DataFrame) -> dict:
    """A FeatureCollection with a line for each stretch (tens a direction)."""
    rows = stretch_lines(stretches, segments).collect()
    features = []
    for r in rows:
        props = json.loads(json.dumps({k: v for k, v in r.asDict(True).items() if k != "coordinates"}, default=str))
        features.append({"type": "Feature", "properties": props, "geometry": {"type": "LineString", "coordinates": r["coordinates"]} if r["coordinates"] else None})
    return {"type": "FeatureCollection", "features": features}


def plain(value):
    """Values that JSON knows: not-a-numbers as null, dates as text."""
    if isinstance(value, float) and value != value:
        return None
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def matrices(contract: DataFrame, hours: list[int], n_segs: int) -> dict[str, list]:
    """obs, covered_h, passages, days, n_cells of one direction as [weekday][hour][segment]."""
    zero = lambda: [[[0] * n_segs for _ in hours] for _ in range(7)]
    out = {k: zero() for k in ("obs", "covered_h", "passages", "n_cells")}
    out["days"] = [[0] * n_segs for _ in range(7)]
    at = {h: i for i, h in enumerate(hours)}
    for r in contract.collect():  # weekdays x hours x segments of a line
        if r["hour"] in at:
            for k in ("obs", "covered_h", "passages", "n_cells"):
                out[k][r["dow"]][at[r["hour"]]][r["place"]] = r[k]
            out["days"][r["dow"]][r["place"]] = r["days"]
    return out


def document(run) -> dict:
    """The JSON document of an analysis: period, coverage, versions, directions with undivided weekday totals, hotspots, agreement."""
    hours = list(range(*run.cfg.select.hours))
    status = run.day_status.orderBy("service_date").collect()
    days = [r["service_date"] for r in status if r["reason"] is None]
    per_dow = [sum(d.weekday() == w for d in days) for w in range(7)]
    cov = run.coverage.orderBy("service_date", "hour").collect()
    dates = sorted({r["service_date"] for r in cov})
    share = {(r["service_date"], r["hour"]): round(float(r["coverage"]), 3) for r in cov}
    directions = []
    for r in run.display.where("place = 1").orderBy("direction_id").collect():
        d, uid = r["direction_id"], r["pattern_uid"]
        segs = run.places.where(F.col("direction_id") == d).orderBy("j").collect()
        place = run.places.where(F.col("direction_id") == d).select("seg_key", F.col("j").alias("place"))
        wk = run.contract.where(F.col("direction_id") == d).join(place, "seg_key")
        links = run.links.where(F.col("pattern_uid") == uid).orderBy("link_idx").collect()
        directions.append({
            "dir": d, "pattern_uid": uid, "from": links[0]["from_stop"], "to": links[-1]["to_stop"],
            "links": [{"key": x["link_key"], "from": x["from_stop"], "to": x["to_stop"], "len": round(x["len_m"], 1)} for x in links],
            "seg": {"key": [x["seg_key"] for x in segs], "link": [x["link_idx"] for x in segs], "x0": [round(x["x0_m"], 1) for x in segs], "len": [round(x["len_m"], 2) for x in segs], "zone": [x["zone"] for x in segs]},
            "wk": matrices(wk, hours, len(segs)),
        })
    p = run.cfg.params
    out = {
        "v": 1, "line": run.cfg.select.route,
        "params": {"segment_m": p.segment_m, "phase_m": p.phase_m, "grid": p.grid, "tick_s": p.tick_s, "gap_cap_s": p.gap_cap_s, "stop_zone": list(p.stop_zone), "reference_hours": list(p.reference_hours), "min_passages_per_day": run.cfg.quality.min_passages_per_day},
        "period": {"first": days[0] if days else None, "last": days[-1] if days else None, "days": len(days), "per_dow": per_dow, "excluded": [{"date": r["service_date"], "reason": r["reason"]} for r in status if r["reason"]]},
        "hours": hours, "coverage": {"dates": dates, "c": [[share.get((d, h)) for h in hours] for d in dates]},
        "versions": [r.asDict() for r in run.versions.orderBy("direction_id", "first").collect()], "dirs": directions,
        "hotspots": [r.asDict(True) for r in run.hotspots.orderBy("direction_id", "rank").collect()] if run.hotspots is not None else [],
        "reference_agreement": [r.asDict() for r in run.agreement.orderBy("direction_id").collect()],
    }
    return plain(out)


def script_json(doc: dict) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


_PAGE = """<!doctype html><html lang="@LANG@"><meta charset="utf-8"><title>@TITLE@</title>
<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:right}</style>
<h1>@TITLE@</h1><p id="p"></p><table id="t"></table><script id="doc" type="application/json">@DOC@</script>
<script>const d=JSON.parse(document.getElementById('doc').textContent);document.getElementById('p').textContent=`${d.period.first} – ${d.period.last}: ${d.period.days}`;
const t=document.getElementById('t');const row=(a,e)=>{const r=t.insertRow();a.forEach(x=>{const c=document.createElement(e);c.textContent=x;r.append(c)})};
row(['dir','rank','from','to','kind','s'],'th');(d.hotspots||[]).forEach(h=>row([h.direction_id,h.rank,h.from_stop,h.to_stop,h.kind,(h.excess_s_per_passage||0).toFixed(1)],'td'));</script></html>"""


def page(doc: dict, title: str | None = None, lang: str = "en") -> str:
    """The document as a page; placeholders are filled in one pass, so data never are."""
    import re

    values = {"LANG": html.escape(lang, True), "TITLE": html.escape(title or f"Line {doc.get('line')}"), "DOC": script_json(doc)}
    return re.sub("@(LANG|TITLE|DOC)@", lambda m: values[m[1]], _PAGE)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def markdown_table(df: DataFrame, digits: int = 2) -> str:
    """A small table as markdown."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()])


def figures(doc: dict, folder: str) -> list[str]:
    """A picture of positions by hour and segment for each direction, where matplotlib is installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return []
    out = []
    for d in doc["dirs"]:
        total = [[sum(d["wk"]["obs"][w][h][s] for w in range(7)) for s in range(len(d["seg"]["key"]))] for h in range(len(doc["hours"]))]
        fig, ax = plt.subplots(figsize=(12, 4))
        ax.imshow(total, aspect="auto", origin="lower")
        ax.set_yticks(range(len(doc["hours"])), doc["hours"])
        path = os.path.join(folder, f"matrix_dir{d['dir']}.png")
        fig.savefig(path)
        plt.close(fig)
        out.append(path)
    return out
