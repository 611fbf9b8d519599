"""Nearest matches against comparing all pairs."""

import datetime as dt

import numpy as np
import pytest

from seiche.llm import nearest_time
from seiche.llm.nearest_time import complete_records, distance_km, matched_by_time, time_slices

SCHEMA = "id string, t long, lon double, lat double, tol_s double, tol_km double"


def rows(seed, n, burst):
    rng = np.random.default_rng(seed)
    t = np.concatenate([rng.integers(0, 3_600_000_000, n - burst), 1_800_000_000 + rng.integers(0, 3_000_000, burst)])
    t[: n // 10] = t[n // 10 : 2 * (n // 10)]
    lon, lat = rng.uniform(-22, -21, n), rng.uniform(64, 64.3, n)
    tol = rng.choice([1.5, 4.0], n)
    return [(f"{seed}-{k:04d}", int(t[k]), float(lon[k]), float(lat[k]), float(tol[k]), float(8 if tol[k] < 2 else 20)) for k in range(n)]


def brute(left, right):
    out = set()
    rt, lon, lat = np.array([r[1] for r in right]), np.array([r[2] for r in right]), np.array([r[3] for r in right])
    for i, t, x, y, tol, km in left:
        gap = np.abs(rt - t)
        ok = np.flatnonzero((gap <= tol * 1e6) & (distance_km(x, y, lon, lat) <= km))
        if len(ok):
            out.add((i, min((gap[k], right[k][0]) for k in ok)[1]))
    return out


@pytest.mark.parametrize("slices,burst", [(None, 0), (16, 150), (1, 50)])
def test_brute_force(spark, slices, burst):
    left, right = rows(1, 400, burst), rows(2, 400, burst)
    got = matched_by_time(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).select("id", "t", "lon", "lat"), reach_s=4.0, slices=slices)
    assert {(r.left_id, r.right_id) for r in got.collect()} == brute(left, right)


def test_hot_slice_is_salted(spark):
    left = rows(3, 300, 280)
    bounds, salts = time_slices(spark.createDataFrame(left, SCHEMA), 16, 8_000_000)
    assert max(salts.values()) > 5 and bounds == sorted(set(bounds))


def test_ties_and_boundaries(spark):
    left = [("a", 10_000_000, 0.0, 0.0, 1.0, 10.0), ("b", None, 0.0, 0.0, 1.0, 10.0), ("c", 20_000_000, 0.0, 0.0, None, 10.0), ("d", 30_000_000, 0.0, 0.0, 1.0, 0.0)]
    right = [("z", 9_000_000, 0.0, 0.0), ("y", 11_000_000, 0.0, 0.0), ("far", 10_000_000, 5.0, 0.0), ("q", 30_000_000, 0.0, 0.0), ("p", 30_000_000, 0.0, 0.0), ("c", 20_000_000, 0.0, 0.0)]
    got = matched_by_time(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, "id string, t long, lon double, lat double"), reach_s=1.0)
    assert {(r.left_id, r.right_id, r.dt_us) for r in got.collect()} == {("a", "y", 1_000_000), ("d", "p", 0)}


def test_deliveries_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    data = [
        (1, "e", t, [1.0, 2.0], t, "clash"), (2, "e", None, [1.0, 2.0], t - dt.timedelta(1), "clash"), (3, "e", t + dt.timedelta(1), [1.0, 2.0], t + dt.timedelta(1), "clash"),
        (4, None, t, [1.0, 2.0], t, "clash"), (5, "g", t, [1.0], t, "clash"), (6, "h", t, [None, 2.0], t, "clash"), (7, "i", t, None, t, "clash"), (8, "j", t, [float("nan"), 1.0], t, "clash"), (9, "k", t, [], t, "clash"),
    ]
    df = spark.createDataFrame(data, "row_id long, event_id string, origin_time timestamp_ntz, coordinates array<double>, loaded_at timestamp_ntz, t string")
    got = complete_records(df).collect()
    assert [(r.id, r.t, r.lon, r.lat) for r in got] == [("e", 1704067200000000, 1.0, 2.0)]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(rows(1, 20, 0), SCHEMA)
    for a, b in ((empty, some), (some, empty), (empty, empty)):
        assert matched_by_time(a, b.select("id", "t", "lon", "lat"), reach_s=4.0).count() == 0


def test_distance():
    assert distance_km(0.0, 0.0, 0.0, 1.0) == pytest.approx(nearest_time.EARTH_KM * np.pi / 180)
