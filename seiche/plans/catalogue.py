"""Plans over several sources: which source serves which time, region pushdown, the readers' registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.operators.predicates import Selection
from seiche.operators.schema import EVENTS, coerced

Reader = Callable[[SparkSession, str | None, str | None], DataFrame]
READERS: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    """Make a source known to ``catalogue_for`` by name; a later one of the same name replaces it."""
    READERS[name] = reader


def seam_windows(sources: list[str], seams: list[str], start: str | None, end: str | None) -> list[tuple[str, str | None, str | None]]:
    """(source, from, to) of each source that serves part of [start, end); half-open at the seams."""
    edges: list[str | None] = [None, *seams, None]
    out = []
    for source, lo, hi in zip(sources, edges, edges[1:]):
        a = max((x for x in (lo, start) if x is not None), default=None)
        b = min((x for x in (hi, end) if x is not None), default=None)
        if a is None or b is None or a < b:
            out.append((source, a, b))
    return out


def within(column: str, start: str | None, end: str | None) -> Column:
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (F.col(column) < F.lit(end).cast("timestamp_ntz"))
    return out


def seam_union(sources: list[tuple[str, DataFrame]], seams: list[str], time: str) -> DataFrame:
    """Union of the sources, each cut at the seams: rows never overlap. Branches outside fold away."""
    names = [n for n, _ in sources]
    frames = dict(sources)
    parts = [frames[n].filter(within(time, a, b)).withColumn("source", F.lit(n)) for n, a, b in seam_windows(names, seams, None, None)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def catalogue_for(spark: SparkSession, selection: Selection, start: str, end: str, *, sources: list[str], seams: list[str], readers: dict[str, Reader] | None = None) -> DataFrame:
    """Events of a selection over a window: each source reads its part, then bounds, region and schema.

    The region's enclosing box goes to the readers' rows first, where it reaches the scan.
    """
    readers = READERS | (readers or {})
    out = None
    for name, a, b in seam_windows(sources, seams, start, end):
        rows = coerced(readers[name](spark, a, b), EVENTS).filter(within("time", a, b))
        rows = rows.filter(selection.condition())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no source serves {start} to {end}")
    return out.orderBy("time", "event_id")


@dataclass
class Catalogue:
    """A frame with the filters that were applied to it; counts are taken only when asked for."""

    df: DataFrame
    history: tuple[tuple[str, DataFrame, DataFrame], ...] = ()

    def where(self, label: str, condition: Column) -> Catalogue:
        kept = self.df.filter(condition)
        return Catalogue(kept, (*self.history, (label, self.df, kept)))

    def provenance(self) -> list[dict[str, object]]:
        """label, n_in, n_out of each filter, in one pass a step."""
        return [{"label": label, "n_in": before.count(), "n_out": after.count()} for label, before, after in self.history]
