"""Filters of series and catalogues. A null or NaN value fails the filter on its own column only."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seiche.functions.geo import in_box, in_polygon, number, within_km


def bounds(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive on both sides; open where None; low above high raises."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"{column}: {low} is above {high}")
    c, out = number(column), F.lit(True)
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & (c <= high)
    return F.coalesce(out, F.lit(False))


def half_open(column: str, start: object = None, end: object = None) -> Column:
    """[start, end), open where None."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= F.lit(start))
    if end is not None:
        out = out & (F.col(column) < F.lit(end))
    return F.coalesce(out, F.lit(False))


def one_of(column: str, values: Iterable[str], known: Iterable[str] | None = None, missing: bool = False) -> Column:
    """Membership; an unknown wanted value raises; ``missing`` keeps nulls."""
    values = list(values)
    if known is not None and (odd := sorted(set(values) - set(known))):
        raise ValueError(f"{column}: unknown {odd}")
    inside = F.coalesce(F.col(column).isin(values), F.lit(False))
    return inside | F.col(column).isNull() if missing else inside


def reviewed(mode: str = "evaluation_mode", status: str = "evaluation_status") -> Column:
    """Manual and not rejected; a null status is kept."""
    return F.coalesce(F.col(mode) == "manual", F.lit(False)) & ~F.col(status).eqNullSafe("rejected")


def not_discarded(status: str = "evaluation_status", kind: str = "event_type", mode: str | None = None) -> Column:
    """Neither rejected nor not existing, and of the mode if one is given."""
    out = ~F.col(status).eqNullSafe("rejected") & ~F.col(kind).eqNullSafe("not existing")
    return out & F.col("evaluation_mode").eqNullSafe(mode) if mode else out


def quality_floor(floor: float, mode: str = "evaluation_mode", quality: str = "quality") -> Column:
    """Drops only automatic rows with a quality under the floor; a missing quality is kept."""
    return ~F.coalesce((F.col(mode) == "automatic") & (number(quality) < floor), F.lit(False))


def noise_screen(sigmas: list[str], most: float, quality: str | None = None, drop_quality: Iterable[int] = ()) -> Column:
    """Every sigma strictly below ``most`` (0 switches that off) and quality none of those to drop."""
    out = F.lit(True)
    for s in sigmas if most else ():
        out = out & F.coalesce(number(s) < most, F.lit(False))
    drop = list(drop_quality)
    return out & ~F.coalesce(F.col(quality).isin(drop), F.lit(False)) if quality and drop else out


def guarded(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], required: Iterable[str] = (), with_type: dict[str, str] | None = None) -> DataFrame:
    """Values outside their range become null, with them the type column paired in ``with_type``.

    Rows whose required column is outside or missing are dropped.
    """
    required = set(required)
    keep, columns = F.lit(True), {}
    for c, (low, high) in ranges.items():
        good = bounds(c, low, high) & number(c).isNotNull()
        if c in required:
            keep = keep & good
        else:
            columns[c] = F.when(good, F.col(c))
            if with_type and c in with_type:
                columns[with_type[c]] = F.when(good | number(c).isNull(), F.col(with_type[c]))
    return df.filter(keep).withColumns(columns)


def glob_match(column: Column, patterns: Iterable[str]) -> Column:
    """Shell patterns (*, ?, [...]) against a whole value, case-sensitive."""
    import fnmatch

    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") + "$")
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Selection:
    """A choice of events: one kind of region, inclusive bounds, and types kept when listed or missing."""

    box: tuple[float, float, float, float] | None = None
    polygon: tuple[tuple[float, float], ...] | None = None
    circle: tuple[float, float, float] | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    event_types: tuple[str, ...] | None = None

    def condition(self, lon: str = "longitude", lat: str = "latitude", kind: str = "event_type") -> Column:
        if sum(x is not None for x in (self.box, self.polygon, self.circle)) > 1:
            raise ValueError("one kind of region only")
        x, y, out = F.col(lon), F.col(lat), F.lit(True)
        if self.box:
            out = out & in_box(x, y, *self.box)
        if self.polygon:
            xs, ys = [p[0] for p in self.polygon], [p[1] for p in self.polygon]
            # The enclosing box is redundant but reaches the scan.
            out = out & in_box(x, y, min(xs), max(xs), min(ys), max(ys)) & in_polygon(x, y, list(self.polygon))
        if self.circle:
            out = out & within_km(x, y, *self.circle)
        for c, (low, high) in self.ranges.items():
            out = out & bounds(c, low, high)
        return out & one_of(kind, self.event_types, missing=True) if self.event_types else out


def selected_stations(stations: DataFrame, areas: DataFrame, *, names: Iterable[str] = (), area: str | None = None, box: tuple[float, float, float, float] | None = None, station: str = "station") -> DataFrame:
    """Named stations and those of an area; a box narrows them, or selects by itself."""
    names = list(names)
    rows = stations
    if names or area:
        wanted = rows.filter(F.col(station).isin(names)) if names else rows.limit(0)
        if area:
            wanted = wanted.unionByName(rows.join(areas.filter(F.col("area") == area).select(station), station, "left_semi"))
        rows = wanted.dropDuplicates([station])
    return rows.filter(in_box(F.col("lon"), F.col("lat"), *box)) if box else rows
