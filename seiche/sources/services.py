"""Answers of catalogue services beyond the list: details, fixed windows, whole catalogues of frames, checks between them.

An answer is text in a frame, however it came: from a transport, a folder of recorded answers or a
table. What asks a service is the paged data source of ``web``; here the answers are read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.functions.geo import number
from seiche.operators.joins import compared, resolved_twins
from seiche.operators.predicates import bounds
from seiche.sources.web import quakeml


def many(variant: str, path: str) -> Column:
    """The children at a path of a variant as an array: a single object is an array of one, none an empty one."""
    listed, alone = F.expr(f"try_variant_get({variant}, '{path}', 'array<variant>')"), F.expr(f"try_variant_get({variant}, '{path}', 'variant')")
    return F.coalesce(listed, F.when(F.expr(f"schema_of_variant({variant}) is not null") & alone.isNotNull() & (F.expr(f"schema_of_variant(try_variant_get({variant}, '{path}', 'variant'))") != "VOID"), F.array(alone)), F.array().cast("array<variant>"))


def details(answers: DataFrame, body: str = "body") -> DataFrame:
    """event_id, origin_id, time, latitude, longitude, depth_km, mode of detail answers (QuakeML as JSON).

    Children come as an object or a list of objects; numbers as text or numbers, depths in metres.
    """
    rows = answers.withColumn("v", F.try_parse_json(body))
    rows = rows.withColumn("o", F.explode(many("v", "$.event.origin")))
    d = lambda p: number(F.expr(f"try_variant_get(o, '$.{p}.value', 'string')").try_cast("double"))
    s = lambda v, p: F.expr(f"try_variant_get({v}, '{p}', 'string')")
    time = F.try_to_timestamp(F.regexp_replace(s("o", "$.time.value"), "Z$", "")).cast("timestamp_ntz")
    return rows.select(F.element_at(F.split(s("v", "$.event.publicID"), "/"), -1).alias("event_id"), s("o", "$.publicID").alias("origin_id"), time.alias("time"), d("latitude").alias("latitude"), d("longitude").alias("longitude"), (d("depth") / 1000).alias("depth_km"), s("o", "$.evaluationMode").alias("mode"))


def asked(ids: Iterable[str], ask: Callable[[str], str | None], most: int, missing: str = "raise") -> tuple[list[tuple[str, str]], int]:
    """(the answers to one request an id, how many had none); more ids than ``most`` raise, as does a missing one unless told to skip."""
    ids = list(ids)
    if len(ids) > most:
        raise ValueError(f"{len(ids)} requests, more than {most}")
    found, absent = [], 0
    for i in ids:
        body = ask(i)
        if body is not None:
            found.append((i, body))
        elif missing == "raise":
            raise LookupError(i)
        else:
            absent += 1
    return found, absent


def fixed_windows(start: dt.datetime, end: dt.datetime, chunk: dt.timedelta) -> list[tuple[dt.datetime, dt.datetime]]:
    """Half-open windows of one length from the start, the last one cut at the end."""
    out, at = [], start
    while at < end:
        out.append((at, min(at + chunk, end)))
        at += chunk
    return out


def resolved_events(rows: DataFrame, start: str, end: str, *, event: str = "event", system: str = "system", reviewed: str = "SIL picks", time: str = "time", order: list[Column], auto_value: str, ranges: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """List rows of a padded window as events: twins resolved, then the exact window, then the bounds."""
    out = resolved_twins(rows, event=event, system=system, reviewed_system=reviewed, order=order, auto_value=auto_value)
    out = out.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))
    for c, (low, high) in (ranges or {}).items():
        out = out.filter(bounds(c, low, high))
    return out


def event_count(rows: DataFrame, event: str = "event") -> DataFrame:
    """How many events the rows are of."""
    return rows.agg(F.count_distinct(event).alias("n_events"))


def detail_origins(rows: DataFrame, event: str, systems: tuple[str, ...], system: str = "system") -> DataFrame:
    """All origins of one event, in the order of the systems."""
    place = F.array_position(F.array(*[F.lit(s) for s in systems]), F.col(system))
    return rows.filter(F.col("event") == event).withColumn("place", F.when(place > 0, place).otherwise(len(systems) + 1))


def catalogue_frames(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """events, origins, magnitudes, picks and mechanisms, each row once however many answers it came in."""
    return {name: df.dropDuplicates() for name, df in quakeml(spark, paths).items()}


def preferred_events(frames: dict[str, DataFrame]) -> DataFrame:
    """One row an event: its preferred origin, else its first, and its first magnitude."""
    o = frames["origins"].join(frames["events"].select("event_id", "preferred_origin_id", "event_type"), "event_id")
    rank = F.struct((F.col("origin_id") != F.coalesce("preferred_origin_id", F.lit(""))).alias("other"), "origin_id")
    best = o.groupBy("event_id").agg(F.min_by(F.struct("time", "latitude", "longitude", "depth_km", "evaluation_mode", "event_type"), rank).alias("o"))
    m = frames["magnitudes"].groupBy("event_id").agg(F.min(F.struct("magnitude_id", "magnitude", "magnitude_type")).alias("m"))
    return best.join(m, "event_id", "left").select("event_id", "o.*", "m.magnitude", "m.magnitude_type")


def cross_checked(a: DataFrame, b: DataFrame, *, tolerances: dict[str, float], exact: list[str] = [], key: str = "event_id") -> DataFrame:  # noqa: B006
    """field, n, only_in: how many events of two services differ in each field, and how many are in one only."""
    diff = compared(a, b, key, numbers=tolerances, exact=exact)
    return diff.groupBy("field").agg(F.count("*").alias("n"), F.count_if((F.col("field") == "key") & F.col("b").isNull()).alias("only_a"))


def keyset_page(rows: DataFrame, after: tuple[object, str] | None, limit: int, time: str = "time", key: str = "event_id") -> DataFrame:
    """The next rows in order of (time, id) after the last one seen: a page by keyset, whose cost does not grow with its number."""
    if after is not None:
        t = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.filter((F.col(time) > t) | ((F.col(time) == t) & (F.col(key) > F.lit(after[1]))))
    return rows.orderBy(time, key).limit(limit)
