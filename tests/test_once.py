"""Exactly-once deliveries: against a window, with late arrivals, with new files, after a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seiche.streaming.once import message_identity, repeated_deliveries

SCHEMA = "delivery_id long, event_id string, updated_time string, received_at timestamp_ntz, k_event string, first string"
KEY = {"key": ["k_event", "k_instant"], "event_time": "k_instant", "prepare": message_identity}


def rows(n, seed, start=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        e = rng.randrange(n // 4)
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=e, microseconds=rng.randrange(2))
        text = t.isoformat() + "Z" if rng.random() < 0.5 else (t + dt.timedelta(hours=2)).isoformat() + "+02:00"
        name = rng.choice([f"Ev{e}", f" eV{e} ", f"EV{e}"]) if rng.random() < 0.97 else None
        out.append((start + k, name, text if rng.random() < 0.97 else None, t + dt.timedelta(minutes=rng.randrange(5)), "clash", "clash"))
    return out


def brute(data):
    groups = {}
    for d, e, u, r, *_ in data:
        if e is not None and u is not None:
            groups.setdefault((e.strip().lower(), dt.datetime.fromisoformat(u.replace("Z", "+00:00"))), []).append((r, d))
    return {d for g in groups.values() for _, d in sorted(g)[1:]}


def found(spark, path, **kw):
    return {r.delivery_id for r in repeated_deliveries(spark, path, **KEY, **kw).select("delivery_id").collect()}


def test_batches_and_late_arrivals(spark, tmp_path):
    path, data = str(tmp_path / "m.parquet"), []
    for k in range(3):
        part = rows(60, 1 + k % 2, start=100 * k)
        data += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert found(spark, path) == brute(data)
    # With one file a batch and no patience most rows are late and are looked up.
    assert found(spark, path, lateness="0 seconds", files_per_batch=1) == brute(data)


def test_goes_on_with_new_files(spark, tmp_path):
    path, where = str(tmp_path / "m.parquet"), {"folder": str(tmp_path / "f"), "lateness": "1 hour"}
    spark.createDataFrame(rows(40, 5), SCHEMA).coalesce(1).write.parquet(path)
    assert found(spark, path, **where) == brute(rows(40, 5))
    more = rows(40, 6, start=1000)
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert found(spark, path, **where) == brute(rows(40, 5) + more)


def test_empty_and_one_file(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(path)
    assert found(spark, path) == set()
    data = rows(20, 9) + rows(20, 9)[:3]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d")).select(F.input_file_name()).head()[0]
    assert found(spark, one.removeprefix("file://")) == brute(list(dict.fromkeys(data)))
