"""Stamps against Python's calendar and zone database."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from seiche.operators.stamps import instants, observed_zones, offset_history, zone_evidence

SCHEMA = "stamp_id long, field_name string, raw_text string, zone_name string, received_at timestamp_ntz, micros int, row string"
UTC = dt.timezone.utc
US = dt.timedelta(microseconds=1)


def table(spark, rows):
    return spark.createDataFrame([(k, f, t, z, dt.datetime(2026, 1, 1), 7, "clash") for k, (f, t, z) in enumerate(rows)], SCHEMA)


def us(d):
    return (d.replace(tzinfo=d.tzinfo or UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // US


def run(spark, rows):
    return [r.utc_us for r in instants(table(spark, rows)).orderBy("stamp_id").select("utc_us").collect()]


def test_notations(spark):
    d = dt.datetime(2024, 3, 7, 14, 5, 9, 120000)
    cases = [
        ("2024-03-07T14:05:09.12Z", d), ("2024-03-07 14:05:09,12", d), ("20240307T140509.12", d), ("20240307 140509.12 +00", d), ("2024-067T14:05:09.12", d), ("07.03.2024 14:05:09.12", d), ("7 Mar 2024 14:05:09.12", d),
        ("Mar 7, 2024 2:05:09.12 PM", d), ("Thu Mar  7 14:05:09 2024", d.replace(microsecond=0)), ("2024-03-07T16:35:09.12+0230", d), ("2024-03-07 10:35:09.12 -03:30", d), ("7 Mar 2024 15:05:09.12 CET", d), ("Mar 7, 2024 9:05:09.12 AM EST", d),
        ("1709820309", d.replace(microsecond=0)), ("1709820309120", d), ("1709820309120000", d), ("1709820309.1200009", d), ("2024-03-07T14:05:09.120000999Z", d), ("2024-12-31T23:59:60Z", dt.datetime(2025, 1, 1)), ("2024-03-07 12:00:09 AM", None),
    ]
    cases[-1] = ("2024-03-07T12:00:09 AM", dt.datetime(2024, 3, 7, 0, 0, 9))
    assert run(spark, [("time", t, None) for t, _ in cases]) == [us(x) for _, x in cases]


def test_no_instant(spark):
    bad = [None, "", " ", "-", "n/a", "2024-02-30T00:00:00Z", "2024-13-01 00:00:00", "2024-01-01 24:00:00", "2024-01-01 00:60:00", "2023-366T00:00:00", "0000-00-00 00:00:00", "2024-01-01 10:00:00 XYZ", "2024-01-01 13:00:00 PM", "2024-01-01 00:00:61"]
    assert run(spark, [("updated_time", t, None) for t in bad] + [("time", "2024-03-31 02:30:00", "Europe/Berlin"), ("ref_epoch", "00:000:00000", None), ("ref_epoch", "23:366:00000", None), ("t", "x", None), ("t", "2024.5.1", None)]) == [None] * (len(bad) + 5)


def test_zones_epochs_and_years(spark):
    berlin = ZoneInfo("Europe/Berlin")
    rows = [
        ("time", "2024-10-27 02:30:00", "Europe/Berlin", us(dt.datetime(2024, 10, 27, 2, 30, tzinfo=berlin, fold=0))), ("time", "2024-07-01 02:30:00", " Europe/Berlin ", us(dt.datetime(2024, 7, 1, 2, 30, tzinfo=berlin))),
        ("time", "2024-07-01 02:30:00Z", "Europe/Berlin", us(dt.datetime(2024, 7, 1, 2, 30))), ("time", "2024-07-01 02:30:00", "Nowhere/Land", us(dt.datetime(2024, 7, 1, 2, 30))),
        ("ref_epoch", "24:366:86400", None, us(dt.datetime(2025, 1, 1))), ("ref_epoch", "51:001:00001", None, us(dt.datetime(1951, 1, 1, 0, 0, 1))), ("ref_epoch", "2050:001:00000", None, us(dt.datetime(2050, 1, 1))), ("ref_epoch", "50:001:00000", None, us(dt.datetime(2050, 1, 1))),
        ("t", "2024.5000000000", None, us(dt.datetime(2024, 7, 2))), ("t", "2023,5", None, us(dt.datetime(2023, 7, 2, 12))), ("t", "2023", None, us(dt.datetime(2023, 1, 1))),
    ]
    assert run(spark, [r[:3] for r in rows]) == [r[3] for r in rows]


def test_random_local_times(spark):
    rng = random.Random(5)
    rows, want = [], []
    for _ in range(300):
        name = rng.choice(["Europe/Lisbon", "America/Chicago", "Asia/Kathmandu", "Europe/Helsinki"])
        zone = ZoneInfo(name)
        local = dt.datetime(rng.randint(2010, 2026), rng.choice([3, 11, 10, 6]), rng.randint(1, 31 if rng.random() < 0.3 else 28), rng.randint(0, 4), rng.randint(0, 59)) if rng.random() < 0 else dt.datetime(rng.randint(2010, 2026), rng.choice([3, 11, 10, 6]), rng.randint(1, 30), rng.randint(0, 4), rng.randint(0, 59))
        utc = local.replace(tzinfo=zone, fold=0).astimezone(UTC)
        rows.append(("time", local.strftime("%Y-%m-%d %H:%M:%S"), name))
        want.append(us(utc) if utc.astimezone(zone).replace(tzinfo=None) == local else None)
    assert run(spark, rows) == want


def test_zone_is_found_from_ingestion(spark):
    zone, rows = ZoneInfo("Asia/Kathmandu"), []
    for k in range(40):
        t = dt.datetime(2024, 5, 1, tzinfo=UTC) + dt.timedelta(hours=7 * k)
        rows.append((k, "s", t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), None, t.replace(tzinfo=None) + dt.timedelta(seconds=30), 7, "clash"))
    evidence = zone_evidence(spark.createDataFrame(rows, SCHEMA), ["UTC", "America/Chicago", "Asia/Kathmandu"])
    assert [tuple(r) for r in offset_history(evidence).collect()] == [("s", "Asia/Kathmandu")]


def test_estimated_zones_convert(spark):
    rows, want = [], {}
    for k in range(80):
        t = dt.datetime(2024, 2, 1, tzinfo=UTC) + dt.timedelta(hours=48 * k)
        zone = "Asia/Kathmandu" if t < dt.datetime(2024, 4, 1, tzinfo=UTC) else "America/Chicago"
        rows.append((k, "s", t.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), None, t.replace(tzinfo=None) + dt.timedelta(seconds=30), 7, "clash"))
        want[k] = us(t)
    rows += [(100, "s", "2024-02-01 12:00:00", " Asia/Kathmandu ", None, 7, "x"), (101, "s", "2024-02-01 12:00:00", "America/Chicago", None, 7, "x"), (102, "other", "2024-02-01 12:00:00", "No/Zone", dt.datetime(2024, 2, 1, 13), 7, "x")]
    want |= {100: us(dt.datetime(2024, 2, 1, 6, 15)), 101: us(dt.datetime(2024, 2, 1, 18)), 102: us(dt.datetime(2024, 2, 1, 12))}
    stamps = spark.createDataFrame(rows, SCHEMA)
    assert observed_zones(stamps) == ["America/Chicago", "Asia/Kathmandu"]
    history = offset_history(zone_evidence(stamps, ["UTC", *observed_zones(stamps)], period="quarter"))
    got = {r.stamp_id: r.utc_us for r in instants(stamps, zones=history).collect()}
    assert got == want
    fixed = spark.createDataFrame([("s", "Asia/Kathmandu")], "source string, zone string")
    assert {r.stamp_id: r.utc_us for r in instants(stamps, zones=fixed).collect()}[0] == want[0]


def test_empty(spark):
    assert run(spark, []) == []


def test_random_shares_and_epochs(spark):
    from fractions import Fraction

    rng = random.Random(11)
    rows, want = [], []
    for _ in range(300):
        year = rng.choice([1999, 2000, 2016, 2017, 2023, 2024, 2100])
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 18)))
        length = (dt.datetime(year + 1, 1, 1) - dt.datetime(year, 1, 1)).total_seconds()
        exact = Fraction(int(digits), 10 ** len(digits)) * int(length)
        rows.append(("t", f"{year}{rng.choice('.,')}{digits}", None))
        want.append(us(dt.datetime(year, 1, 1) + dt.timedelta(seconds=int(exact + Fraction(1, 2)))))
        day, second = rng.randint(1, 365), rng.randint(0, 86400)
        rows.append(("ref_epoch", f"{year % 100 if year < 2051 else year:02d}:{day:03d}:{second:05d}", None))
        want.append(us(dt.datetime(year, 1, 1) + dt.timedelta(days=day - 1, seconds=second)))
    rows += [("t", "2017.6917808219", None), ("t", "2020,6917808219", None)]
    want += [us(dt.datetime(2017, 9, 10, 12)), us(dt.datetime(2020, 1, 1) + dt.timedelta(seconds=round(0.6917808219 * 366 * 86400)))]
    assert run(spark, rows) == want
