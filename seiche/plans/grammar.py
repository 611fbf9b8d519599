"""The small languages users write: periods, terms, stages, holds and regions."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from seiche.operators.predicates import Selection


def parse_date(text: str) -> dt.date:
    """YYYYMMDD or ISO."""
    text = text.strip()
    return dt.datetime.strptime(text, "%Y%m%d").date() if re.fullmatch(r"\d{8}", text) else dt.date.fromisoformat(text)


def find_event(name: str, events: dict[str, dt.date]) -> dt.date:
    """By exact name, else by the only name that contains it."""
    if name in events:
        return events[name]
    hits = [k for k in events if name.lower() in k.lower()]
    if len(hits) != 1:
        raise ValueError(f"{name!r} matches {len(hits)} events")
    return events[hits[0]]


def resolve_period(spec: str | None = None, *, last: int | None = None, today: dt.date | None = None, events: dict[str, dt.date] | None = None) -> tuple[dt.date, dt.date]:
    """Half-open whole days: "A..B" with dates or events at either end, "after:EVENT", or the last days."""
    today = today or dt.date.today()
    end_of_today = today + dt.timedelta(days=1)

    def edge(text: str) -> dt.date:
        try:
            return parse_date(text)
        except ValueError:
            return find_event(text, events or {})

    if spec is None:
        if last is None:
            raise ValueError("a period or a number of days is needed")
        return end_of_today - dt.timedelta(days=last), end_of_today
    if spec.startswith("after:"):
        return edge(spec[6:]), end_of_today
    start, _, end = spec.partition("..")
    a = edge(start)
    b = edge(end) + dt.timedelta(days=1) if end else end_of_today
    if a >= b:
        raise ValueError(f"{spec!r} is empty")
    return a, b


def window_bounds(start: dt.date, end: dt.date) -> tuple[float, float]:
    """Inclusive dates as fractional years [start, midnight after end)."""
    year = lambda d: d.year + (d - dt.date(d.year, 1, 1)).days / (dt.date(d.year + 1, 1, 1) - dt.date(d.year, 1, 1)).days
    return year(start), year(end + dt.timedelta(days=1))


@dataclass(frozen=True)
class Term:
    """A term of a trajectory: kind (step, exp, log, rate), its epoch, and tau where it has one."""

    kind: str
    epoch: float
    tau: float | None = None


def parse_term(spec: str) -> Term:
    """KIND@EPOCH[,tau=YEARS]."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"
    m = re.fullmatch(rf"\s*(step|exp|log|rate)\s*@\s*({number})\s*(?:,\s*tau\s*=\s*({number}))?\s*", spec.lower())
    if not m:
        raise ValueError(f"no term: {spec!r}")
    kind, epoch, tau = m.groups()
    if (kind in ("exp", "log")) != (tau is not None):
        raise ValueError(f"{kind} {'needs' if tau is None else 'takes no'} tau: {spec!r}")
    if tau is not None and float(tau) <= 0:
        raise ValueError(f"tau is positive: {spec!r}")
    return Term(kind, float(epoch), float(tau) if tau else None)


@dataclass(frozen=True)
class Stage:
    """A stage of a plan: a name, a group of parameters, windows of fractional years (open ends None)."""

    name: str
    group: str
    windows: tuple[tuple[float | None, float | None], ...] = ()


def parse_stage(spec: str) -> Stage:
    """NAME:GROUP[@a:b;c:d]."""
    m = re.fullmatch(r"\s*([\w-]+):([\w+-]+)(?:@(.+))?\s*", spec)
    if not m:
        raise ValueError(f"no stage: {spec!r}")
    windows = []
    for part in (m[3] or "").split(";") if m[3] else []:
        a, _, b = part.partition(":")
        windows.append((float(a) if a.strip() else None, float(b) if b.strip() else None))
        if None not in windows[-1] and windows[-1][0] >= windows[-1][1]:
            raise ValueError(f"empty window: {part!r}")
    return Stage(m[1], m[2], tuple(windows))


@dataclass(frozen=True)
class Hold:
    """A group of parameters taken from a stage, a donor station or the store."""

    stage: str | None
    group: str
    origin: str
    name: str


def parse_hold(spec: str) -> Hold:
    """[STAGE:]GROUP=stage:NAME | donor:NAME | store:NAME."""
    m = re.fullmatch(r"\s*(?:([\w-]+):)?([\w+-]+)=(stage|donor|store):\s*([\w.-]+)\s*", spec)
    if not m:
        raise ValueError(f"no hold: {spec!r}")
    return Hold(m[1], m[2], m[3], m[4])


def parse_region(spec: str, regions: dict[str, Selection] | None = None) -> Selection:
    """A known name, "W/E/S/N", or "LAT,LON,RADIUSkm"."""
    if regions and spec in regions:
        return regions[spec]
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    if m := re.fullmatch("/".join([number] * 4), spec):
        w, e, s, n = map(float, m.groups())
        if w > e or s > n:
            raise ValueError(f"empty box: {spec!r}")
        return Selection(box=(w, e, s, n))
    if m := re.fullmatch(rf"{number},{number},{number}(?:km)?", spec):
        lat, lon, km = map(float, m.groups())
        return Selection(circle=(lon, lat, km))
    raise ValueError(f"no region: {spec!r}")
