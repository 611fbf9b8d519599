"""Matching records by nearest time within tolerances of time and distance.

Both tables are cut into slices of time with about equally many left records, repartitioned by
slice and sorted within the partitions; each task then merges its two sorted streams with two
pointers, holding only the right records within the largest tolerance of the left ones in hand.
Slices are never narrower than that tolerance. A right record near a slice's edge goes to both
sides; where a slice holds far more than its share, its left records are salted and its right
records repeated for each salt.

Defined results: records with a null time, coordinate or tolerance are never matched; records
delivered again count once (the first complete delivery); of several right records equally near in
time the one with the smallest id is taken; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def complete_records(events: DataFrame, *, event_id: str = "event_id", time: str = "origin_time", coordinates: str = "coordinates", order: tuple[str, ...] = ("loaded_at", "row_id"), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an event: id, t (microseconds), lon, lat and the columns to keep."""
    lon, lat = F.try_element_at(coordinates, F.lit(1)), F.try_element_at(coordinates, F.lit(2))
    rows = events.select(F.col(event_id).alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), lon.alias("lon"), lat.alias("lat"), *keep, *[F.col(c).alias(f"o_{c}") for c in order])
    rows = rows.filter("id is not null and t is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    first = F.min(F.struct(*[f"o_{c}" for c in order], "t", "lon", "lat", *keep)).alias("r")
    return rows.groupBy("id").agg(first).select("id", "r.t", "r.lon", "r.lat", *[f"r.{c}" for c in keep])


def time_slices(left: DataFrame, slices: int, width: int) -> tuple[list[float], dict[int, int]]:
    """(inner bounds in microseconds, salts by slice) from quantiles of the left times."""
    if slices < 2:
        return [], {}
    cuts = left.approxQuantile("t", [k / slices for k in range(1, slices)], min(0.25 / slices, 0.01))
    bounds: list[float] = []
    salts: dict[int, int] = {}
    for cut in cuts:
        if bounds and cut - bounds[-1] < width:
            salts[len(bounds)] = salts.get(len(bounds), 1) + 1
        else:
            bounds.append(float(cut))
    return bounds, salts


def _slice_of(rows: DataFrame, value: Column, bounds: list[float], out: str) -> DataFrame:
    if not bounds:
        return rows.withColumn(out, F.lit(0))
    rows = rows.withColumn("_v", value.cast("double"))
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_v", outputCol=out, handleInvalid="keep")
    return cut.transform(rows).withColumn(out, F.col(out).cast("int")).drop("_v")


def distance_km(lon_a: np.ndarray, lat_a: np.ndarray, lon_b: np.ndarray, lat_b: np.ndarray) -> np.ndarray:
    """Great-circle distance on a sphere (haversine)."""
    la, lb = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


Side = dict[str, np.ndarray]


def nearest(left: Side, right: Side) -> np.ndarray:
    """For each left record the place of its match in the time-sorted right records, -1 if none.

    Two pointers walk outwards from each left record's time, the nearer one first, until a record
    within the distance is found and no equally near one is left.
    """
    n = len(left["t"])
    found, gap = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    rt = right["t"]
    if not len(rt):
        return found
    up = np.searchsorted(rt, left["t"], "left")
    down = up - 1
    far = np.iinfo(np.int64).max
    live = np.arange(n)
    while len(live):
        t, lo, hi = left["t"][live], down[live], up[live]
        below = np.where(lo >= 0, t - rt[np.maximum(lo, 0)], far)
        above = np.where(hi < len(rt), rt[np.minimum(hi, len(rt) - 1)] - t, far)
        low = below <= above
        d = np.where(low, below, above)
        go = (d <= left["tol_us"][live]) & (d <= gap[live])
        live, d, low, lo, hi = live[go], d[go], low[go], lo[go], hi[go]
        at = np.where(low, lo, hi)
        near = distance_km(left["lon"][live], left["lat"][live], right["lon"][at], right["lat"][at]) <= left["tol_km"][live]
        old = found[live]
        better = near & ((old < 0) | (right["id"][at] < right["id"][np.maximum(old, 0)]))
        found[live[better]] = at[better]
        gap[live[near]] = d[near]
        down[live[low]] -= 1
        up[live[~low]] += 1
    return found


def merged(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Merge sorted batches of both sides; each group (slice, salt) is a stretch of rows."""
    names = ("t", "lon", "lat", "tol_us", "tol_km", "id")
    empty: Side = {k: np.zeros(0, object if k == "id" else float if k in ("lon", "lat", "tol_km") else np.int64) for k in names}
    left, right, group = empty, empty, None

    def match(part: Side) -> pa.RecordBatch | None:
        at = nearest(part, right)
        hit = at >= 0
        if hit.any():
            t, other = part["t"][hit], right["t"][at[hit]]
            return pa.RecordBatch.from_arrays([pa.array(part["id"][hit], pa.string()), pa.array(right["id"][at[hit]], pa.string()), pa.array(other - t)], names=["left_id", "right_id", "dt_us"])
        return None

    for batch in batches:
        keys = batch.column("slice").to_numpy() * 100_000 + batch.column("salt").to_numpy()
        is_left = batch.column("is_left").to_numpy(zero_copy_only=False)
        own = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        stops = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
        start = 0
        for stop in stops:
            if keys[start] != group:
                if (out := match(left)) is not None:
                    yield out
                left, right, group = empty, empty, keys[start]
            for side in (True, False):
                pick = np.flatnonzero(is_left[start:stop] == side) + start
                if len(pick):
                    more = {k: np.concatenate([(left if side else right)[k], own[k][pick]]) for k in names}
                    left, right = (more, right) if side else (left, more)
            now = own["t"][stop - 1]
            ready = int(np.searchsorted(left["t"], now - reach, "left"))
            if ready:
                if (out := match({k: v[:ready] for k, v in left.items()})) is not None:
                    yield out
                left = {k: v[ready:] for k, v in left.items()}
            oldest = left["t"][0] if len(left["t"]) else now
            drop = int(np.searchsorted(right["t"], oldest - reach, "left"))
            right = {k: v[drop:] for k, v in right.items()} if drop else right
            start = stop
    if (out := match(left)) is not None:
        yield out


def matched_by_time(left: DataFrame, right: DataFrame, *, reach_s: float, slices: int | None = None) -> DataFrame:
    """left_id, right_id, dt_us: the nearest right record in time within both tolerances.

    ``left`` has id, t, lon, lat, tol_s, tol_km; ``right`` id, t, lon, lat. ``reach_s`` is the
    largest tolerance of any left record.
    """
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = int(round(reach_s * 1e6))
    left = left.filter("tol_s is not null and tol_km is not null and t is not null")
    bounds, salts = time_slices(left, slices or 4 * tasks, max(2 * reach, 1))
    salt = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in salts.items() for x in (k, v)]), F.col("slice")), F.lit(1)) if salts else F.lit(1)
    a = _slice_of(left, F.col("t"), bounds, "slice").withColumn("salt", F.pmod(F.xxhash64("id"), salt).cast("int"))
    b = _slice_of(_slice_of(right, F.col("t") - reach, bounds, "from"), F.col("t") + reach, bounds, "to")
    b = b.withColumn("slice", F.explode(F.sequence("from", "to"))).withColumn("salt", F.explode(F.sequence(F.lit(0), salt.cast("int") - 1)))
    a = a.select("slice", "salt", "t", F.lit(True).alias("is_left"), "id", "lon", "lat", F.round(F.col("tol_s") * 1e6).cast("long").alias("tol_us"), "tol_km")
    b = b.select("slice", "salt", "t", F.lit(False).alias("is_left"), "id", "lon", "lat", F.lit(0).cast("long").alias("tol_us"), F.lit(0.0).alias("tol_km"))
    rows = a.unionByName(b).repartition(tasks, "slice", "salt").sortWithinPartitions("slice", "salt", "t", "is_left")
    return rows.mapInArrow(lambda batches: merged(batches, reach), "left_id string, right_id string, dt_us long")
