"""A made-up line with known truth: schedule feed, polls of an anonymous linear feed or fixes of vehicles, and every position's true place."""

from __future__ import annotations

import csv
import datetime as dt
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd

LON0, LAT0, METRE = 4.35, 50.85, 1 / 111_194.93


@dataclass
class Line:
    folder: str
    gtfs: str
    observations: pd.DataFrame
    polls: pd.DataFrame
    truth: pd.DataFrame
    stops_m: np.ndarray


def _lonlat(s: np.ndarray, side: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A line that heads north, with a slow bend east."""
    return LON0 + (20 * np.sin(s / 400) + side) * METRE / np.cos(np.radians(LAT0)), LAT0 + s * METRE


def _write_feed(folder: str, ids: list[str], at: np.ndarray, first: dt.date, days: int, trips: list[tuple]) -> None:
    os.makedirs(folder, exist_ok=True)

    def put(name: str, head: list[str], rows: list) -> None:
        with open(f"{folder}/{name}.txt", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(head)
            w.writerows(rows)

    last = first + dt.timedelta(days=days - 1)
    put("routes", ["route_id", "route_short_name", "route_type"], [["r1", "S1", 0], ["r2", "OTHER", 3]])
    lon, lat = _lonlat(at)
    put("stops", ["stop_id", "stop_name", "stop_lon", "stop_lat"], [[i, f"STOP {i}", x, y] for i, x, y in zip(ids, lon, lat, strict=True)])
    grid = np.arange(0, at[-1] + 1, 20.0)
    x, y = _lonlat(grid)
    both = [["n", k, a, b] for k, (a, b) in enumerate(zip(x, y, strict=True))] + [["s", k, a, b] for k, (a, b) in enumerate(zip(x[::-1], y[::-1], strict=True))]
    put("shapes", ["shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"], both)
    put("calendar", ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"], [["all", 1, 1, 1, 1, 1, 1, 1, f"{first:%Y%m%d}", f"{last:%Y%m%d}"]])
    put("calendar_dates", ["service_id", "date", "exception_type"], [])
    put("trips", ["route_id", "service_id", "trip_id", "direction_id", "shape_id"], [["r1", "all", t, d, "ns"[d]] for t, d, _, _ in trips])
    times = []
    for t, d, start, part in trips:
        for k, i in enumerate(part):
            clock = int(start + 90 * k)
            times.append([t, ids[i], k, f"{clock // 3600:02d}:{clock % 3600 // 60:02d}:{clock % 60:02d}", f"{clock // 3600:02d}:{clock % 3600 // 60:02d}:{clock % 60:02d}"])
    put("stop_times", ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"], times)


def simulated(folder: str, days: int = 3, first: dt.date = dt.date(2025, 3, 3), seed: int = 0, links: tuple[float, ...] = (400, 520, 350, 600, 450, 380), hours: tuple[int, int] = (6, 22), headway_s: float = 600.0, tick_s: int = 20, hotspots: tuple = (), zone_shift_s: int = 3600, noise_m: float = 0.0) -> Line:
    """Trips both ways at 7 m/s with 20 s at stops; ``hotspots`` (direction, from_m, to_m, seconds, hours) slow them down.

    The feed's clock is UTC, the line's ``zone_shift_s`` ahead. observations has ts, route_id, vehicle_id, trip_id,
    direction_id, terminus_id, stop_id, dist_m, lat, lon and true_s, true_dir.
    """
    rng = np.random.default_rng(seed)
    at = np.concatenate(([0.0], np.cumsum(links)))
    ids = [str(100 + i) for i in range(len(at))]
    n = len(at)
    starts = np.arange(hours[0] * 3600, hours[1] * 3600, headway_s)
    trips = []
    for d in (0, 1):
        for k, start in enumerate(starts):
            order = list(range(n)) if d == 0 else list(range(n))[::-1]
            part = order[: n - 2] if k % 7 == 3 else order
            trips.append((f"t{d}_{k}", d, float(start) + 120 * d, part))
    _write_feed(f"{folder}/gtfs", ids, at, first, days, trips)
    rows, polls = [], []
    for day in range(days):
        midnight = dt.datetime.combine(first + dt.timedelta(days=day), dt.time(), dt.timezone.utc).timestamp() - zone_shift_s
        polls.append(midnight + np.arange(hours[0] * 3600 - 600, hours[1] * 3600 + 3600, tick_s) + rng.integers(0, 3))
        for trip, d, start, part in trips:
            way = np.abs(at[part] - at[part[0]])
            step = 5.0
            edge = np.arange(0, way[-1] + step, step).clip(max=way[-1])
            pace = np.full(len(edge) - 1, step / 7.0) * rng.uniform(0.9, 1.1)
            mid = (edge[1:] + edge[:-1]) / 2
            for hd, a, b, s, hh in hotspots:
                clock = int(start // 3600)
                inside = (mid >= a) & (mid < b)
                if hd == d and clock in hh and inside.any():
                    pace[inside] += s * rng.gamma(4, 0.25) / inside.sum()
            for w in way[1:-1]:
                pace[np.searchsorted(edge, w) - 1] += 20 * rng.uniform(0.7, 1.3)
            t = midnight + start + rng.normal(0, 20) + np.concatenate(([0.0], np.cumsum(pace)))
            seen = polls[-1][(polls[-1] >= t[0]) & (polls[-1] <= t[-1])]
            s = np.interp(seen, t, edge)
            k = np.searchsorted(way, s, side="right") - 1
            k = np.minimum(k, len(part) - 1)
            whole = s if d == 0 else at[-1] - s
            x, y = _lonlat(whole)
            if noise_m:
                x, y = x + rng.normal(0, noise_m, len(x)) * METRE, y + rng.normal(0, noise_m, len(y)) * METRE
            rows.append(pd.DataFrame({
                "ts": seen, "route_id": "S1", "vehicle_id": f"v{day}_{trip}", "trip_id": trip, "direction_id": d, "terminus_id": ids[part[-1]], "stop_id": [ids[part[i]] for i in k], "dist_m": np.round(s - way[k]),
                "lat": y, "lon": x, "true_s": s, "true_dir": d,
            }))
    obs = pd.concat(rows, ignore_index=True)
    snaps = pd.DataFrame({"ts": np.unique(np.concatenate(polls)).astype("int64"), "same": False})
    os.makedirs(f"{folder}/feed", exist_ok=True)
    for day, part in obs.groupby((obs["ts"] + zone_shift_s) // 86400):
        name = dt.datetime.fromtimestamp(int(day) * 86400, dt.timezone.utc).strftime("%Y%m%d")
        own = snaps[(snaps["ts"] + zone_shift_s) // 86400 == day]
        pd.DataFrame({"ts": part["ts"].astype("int64"), "line": "S1", "dir": part["terminus_id"], "point": part["stop_id"], "dist": part["dist_m"].astype("int64")}).to_parquet(f"{folder}/feed/{name}.parquet", index=False)
        own.to_parquet(f"{folder}/feed/{name}.snaps.parquet", index=False)
    flat = obs.rename(columns={"ts": "vehicle.timestamp", "lat": "vehicle.position.latitude", "lon": "vehicle.position.longitude", "vehicle_id": "vehicle.vehicle.id", "route_id": "vehicle.trip.route_id", "trip_id": "vehicle.trip.trip_id"})
    flat[[c for c in flat.columns if "." in c]].assign(**{"vehicle.timestamp": flat["vehicle.timestamp"].astype("int64")}).to_csv(f"{folder}/positions.csv", index=False)
    return Line(folder, f"{folder}/gtfs", obs, snaps, obs[["ts", "vehicle_id", "true_s", "true_dir"]], at)
