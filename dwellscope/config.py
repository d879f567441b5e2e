"""Settings of an analysis; unknown keys are errors."""

from __future__ import annotations

import datetime as dt
import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Linear:
    direction_kind: str = "terminus_stop"
    id_normaliser: str = "leading_digits"
    feed_length: str = "auto"
    terminus_aliases: dict[str, str] = field(default_factory=dict)


@dataclass
class Input:
    paths: list[str] = field(default_factory=list)
    kind: str = "latlon"  # latlon, linear or stib (compact rows)
    format: str = "auto"  # auto, csv, parquet, stib_json, gtfsrt_pb
    timezone: str = "Europe/Brussels"
    service_day_start: str = "04:00"
    ts_unit: str = "s"
    columns: dict[str, str] = field(default_factory=dict)
    linear: Linear = field(default_factory=Linear)
    snapshots: str | None = None
    events: str | None = None


@dataclass
class Gtfs:
    path: str | None = None
    dated: str | None = None
    index: str | None = None
    feeds_dir: str | None = None
    route_key: str = "route_short_name"


@dataclass
class Select:
    route: str | None = None
    dates: str | None = None
    weekdays: list[int] = field(default_factory=lambda: [0, 1, 2, 3, 4])
    exclude_dates: list[str] = field(default_factory=list)
    hours: tuple[int, int] = (5, 24)
    directions: list[int] | None = None

    def date_range(self) -> tuple[dt.date, dt.date] | None:
        if not self.dates:
            return None
        first, last = self.dates.split("..")
        return dt.date.fromisoformat(first), dt.date.fromisoformat(last)


@dataclass
class Params:
    segment_m: float = 30.0
    phase_m: float = 0.0
    grid: str = "equal"
    tick_s: float = 20.0
    tick_from_coverage: bool = False
    per_vehicle: str = "resample"
    gap_cap_s: float = 40.0
    stop_zone: tuple[float, float] = (30.0, 60.0)
    reference_hours: tuple[int, int] = (20, 24)
    reference: str = "evening"
    layover_m: float = 10.0
    max_lateral_m: float = 40.0
    bootstrap: int = 200


@dataclass
class Quality:
    min_hour_coverage: float = 0.8
    min_day_coverage: float = 0.75
    max_frozen_s: float = 300.0
    vehicle_ratio: tuple[float, float] = (0.7, 1.3)
    max_off_pattern: float = 0.2
    min_days: int = 5
    min_passages_per_day: float = 0.5


@dataclass
class Report:
    names: str | dict[str, str] | None = None


def _filled(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    out = kind()
    for key, value in (values or {}).items():
        if key not in known:
            raise ValueError(f"unknown setting {kind.__name__}.{key}")
        held = getattr(out, key)
        if is_dataclass(held) and isinstance(value, dict):
            value = _filled(type(held), value)
        elif isinstance(held, tuple):
            value = tuple(value)
        setattr(out, key, value)
    return out


@dataclass
class Config:
    input: Input = field(default_factory=Input)
    gtfs: Gtfs = field(default_factory=Gtfs)
    select: Select = field(default_factory=Select)
    params: Params = field(default_factory=Params)
    quality: Quality = field(default_factory=Quality)
    report: Report = field(default_factory=Report)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        return _filled(cls, values)

    @classmethod
    def from_toml(cls, path: str) -> Config:
        """Paths in the file are relative to it, but for those with a scheme."""
        with open(path, "rb") as f:
            out = cls.from_dict(tomllib.load(f))
        base = os.path.dirname(os.path.abspath(path))
        whole = lambda p: p if "://" in p or os.path.isabs(p) else os.path.join(base, p)
        out.input.paths = [whole(p) for p in out.input.paths]
        for part, names in ((out.gtfs, ("path", "dated", "index", "feeds_dir")), (out.input, ("snapshots", "events"))):
            for n in names:
                if getattr(part, n):
                    setattr(part, n, whole(getattr(part, n)))
        return out


def seconds_of(clock: str) -> int:
    """HH:MM as seconds."""
    h, m = clock.split(":")
    if not (0 <= int(h) <= 47 and 0 <= int(m) <= 59):
        raise ValueError(f"no time of day: {clock}")
    return int(h) * 3600 + int(m) * 60
