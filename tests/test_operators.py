"""Windows, joins, schema and plans on small frames and against loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seiche import catalogue
from seiche.functions.geo import equirectangular_km  # noqa: F401
from seiche.models.trajectory import detrended, fitted
from seiche.operators import aggregates, joins, predicates, schema, windows
from seiche.plans import grammar
from seiche.plans.catalogue import Catalogue, catalogue_for, seam_windows
from seiche.streaming.series import reviewed_over_automatic, streamed_bucket_medians, upserted

D0 = dt.date(2024, 1, 1)


def hysteresis_loop(start, stay, known):
    inside, out = False, []
    for s, t, k in zip(start, stay, known):
        if s:
            inside = True
        elif k and not t:
            inside = False
        out.append(inside and k)
    return out


def test_hysteresis_and_bridging(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.random() < 0.2, rng.random() < 0.6, rng.random() < 0.8) for g in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, k int, start boolean, stay boolean, known boolean")
    flag = windows.hysteresis(F.col("start"), F.col("stay"), F.col("known"), ["g"], ["k"])
    got = {(r.g, r.k): r.f for r in df.select("g", "k", flag.alias("f")).collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        assert [got[g, k] for k in range(60)] == hysteresis_loop(*zip(*[r[2:] for r in own]))
    gaps = spark.createDataFrame([(0, k, k in (1, 4, 9)) for k in range(12)], "g int, k int, f boolean")
    out = gaps.select("k", windows.bridged(F.col("f"), F.col("k"), ["g"], ["k"], 2).alias("b")).filter("b").collect()
    assert sorted(r.k for r in out) == [1, 2, 3, 4, 9]


def episode_loop(start, stay, max_gap):
    out, i, n = [], 0, len(start)
    while i < n:
        if not start[i]:
            i += 1
            continue
        a = i
        while a > (out[-1][1] + 1 if out else 0) and stay[a - 1]:
            a -= 1
        b = i
        for k in range(i + 1, n):
            if k - b > max_gap + 1:
                break
            if stay[k] or start[k]:
                b = k
        out.append((a, b))
        i = b + 1
    return out


def test_episodes(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(30):
        start, stay = [rng.random() < 0.08 for _ in range(60)], [rng.random() < 0.4 for _ in range(60)]
        rows += [(g, D0 + dt.timedelta(k), start[k], stay[k]) for k in range(60)]

        want[g] = {(D0 + dt.timedelta(a), D0 + dt.timedelta(b)) for a, b in episode_loop(start, stay, 2)}
    df = spark.createDataFrame(rows, "g int, d date, start boolean, stay boolean")
    got = {g: set() for g in want}
    for r in windows.episodes(df, ["g"], "d", "start", "stay", 2).collect():
        got[r.g].add((r.first, r.last))
    assert got == want


def greedy_loop(edges):
    used_a, used_b, out = set(), set(), set()
    for cost, a, b in sorted(edges):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), out.add((a, b))
    return out


def test_greedy_is_sequential(spark):
    rng = random.Random(2)
    edges = list({(rng.randrange(4), a, b) for a in range(40) for b in range(40) if rng.random() < 0.12})
    df = spark.createDataFrame(edges, "c int, a int, b int")
    assert {(r.a, r.b) for r in joins.greedy_pairs(df, "a", "b", [F.col("c")]).collect()} == greedy_loop(edges)
    assert joins.greedy_pairs(df.limit(0), "a", "b", [F.col("c")]).count() == 0


def test_band_and_nearest(spark):
    rng = random.Random(3)
    a = [(k, rng.randrange(0, 400) / 10) for k in range(60)] + [(99, None)]
    b = [(k, rng.randrange(0, 400) / 10) for k in range(60)] + [(98, None)]
    left, right = spark.createDataFrame(a, "i int, t double"), spark.createDataFrame(b, "j int, s double")
    pairs = {(i, j) for i, t in a for j, s in b if t is not None and s is not None and abs(t - s) <= 0.5}
    assert {(r.i, r.j) for r in joins.band_join(left, right, "t", "s", 0.5).collect()} == pairs
    near = {i: min((abs(t - s), s, j) for j, s in b if s is not None and abs(t - s) < 0.5)[1] for i, t in a if t is not None and any(s is not None and abs(t - s) < 0.5 for _, s in b)}
    assert {r.i: r.s for r in joins.nearest_join(left, right, "t", "s", 0.5, "i").collect()} == near


def test_deduplication(spark):
    rows = [(1, 0, float("nan"), 1.0), (1, 1, 2.0, None), (1, 2, 2.0, 3.0), (2, 0, None, 5.0)]
    df = spark.createDataFrame(rows, "k int, pos int, q double, m double")
    assert {(r.k, r.pos) for r in windows.smallest_sigma(df, ["k"], "q", "pos").collect()} == {(1, 1), (2, 0)}
    best = {r.k: (r.pos, r.m) for r in windows.best_quality(df, ["k"], "q", "pos", fill="m").collect()}
    assert best == {1: (2, 3.0), 2: (0, 5.0)}


def test_predicates(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), None), (3, None, "b"), (4, 5.0, "c")], "k int, v double, c string")
    ids = lambda cond: [r.k for r in df.filter(cond).orderBy("k").collect()]
    assert ids(predicates.bounds("v", 1, 5)) == [1, 4] and ids(predicates.one_of("c", ["a"], missing=True)) == [1, 2] and ids(predicates.glob_match(F.col("c"), ["[ab]", "z*"])) == [1, 3]
    with pytest.raises(ValueError):
        predicates.bounds("v", 5, 1)
    with pytest.raises(ValueError):
        predicates.one_of("c", ["q"], known=["a"])
    with pytest.raises(ValueError):
        predicates.Selection(box=(0, 1, 0, 1), circle=(0, 0, 1)).condition()


def test_schema(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "sil-files", "e1", "64", -21.0, float("nan"), "Mlw", "manual", "extra"), ("bad", "other", None, "95", -21.0, 11.0, "??", "manual", "extra")], "time string, source string, event_id string, latitude string, longitude double, magnitude double, magnitude_type string, evaluation_mode string, Time_note string")
    out = schema.coerced(df, schema.EVENTS)
    assert out.columns[: len(schema.EVENTS)] == [s.name for s in schema.EVENTS] and out.columns[-1] == "Time_note" and out.filter("magnitude is null").count() == 1
    found = {(r.column, r.issue): r.n for r in schema.validated(out, schema.EVENTS).collect()}
    assert found == {("time", "missing"): 1, ("event_id", "missing"): 1, ("source", "unknown value"): 1, ("latitude", "out of range"): 1, ("magnitude", "out of range"): 1, ("magnitude_type", "unknown value"): 1}
    assert ("time", "missing column") in {(r.column, r.issue) for r in schema.validated(df.drop("time"), schema.EVENTS).collect()}


def test_plans(spark):
    assert seam_windows(["a", "b"], ["2026-02-01"], "2026-01-01", "2026-03-01") == [("a", "2026-01-01", "2026-02-01"), ("b", "2026-02-01", "2026-03-01")]
    assert seam_windows(["a", "b"], ["2026-02-01"], "2026-02-01", None) == [("b", "2026-02-01", None)]
    reader = lambda name, day: lambda s, a, b: s.createDataFrame([(dt.datetime(2026, m, day), name, f"{name}{m}", 64.0, -21.0) for m in (1, 2, 3)], "time timestamp, source string, event_id string, latitude double, longitude double")
    out = catalogue_for(spark, predicates.Selection(circle=(-21.0, 64.0, 10.0)), "2026-01-01", "2026-12-31", sources=["a", "b"], seams=["2026-02-01"], readers={"a": reader("a", 5), "b": reader("b", 6)})
    assert [r.event_id for r in out.collect()] == ["a1", "b2", "b3"]
    assert Catalogue(spark.range(5)).where("even", F.col("id") % 2 == 0).provenance() == [{"label": "even", "n_in": 5, "n_out": 3}]


def test_grammar():
    assert grammar.resolve_period("20240101..2024-01-03") == (dt.date(2024, 1, 1), dt.date(2024, 1, 4))
    assert grammar.resolve_period("after:onset", today=D0, events={"the onset": dt.date(2023, 12, 1)}) == (dt.date(2023, 12, 1), dt.date(2024, 1, 2))
    assert grammar.resolve_period(last=3, today=D0)[0] == dt.date(2023, 12, 30)
    assert grammar.parse_term("exp@2020.5,tau=0.3") == grammar.Term("exp", 2020.5, 0.3)
    assert grammar.parse_stage("a:rate@:2020;2021:").windows == ((None, 2020.0), (2021.0, None))
    assert grammar.parse_hold("s:rate=donor:REYK") == grammar.Hold("s", "rate", "donor", "REYK")
    assert grammar.parse_region("-22/-20/63/64").box == (-22.0, -20.0, 63.0, 64.0) and grammar.parse_region("64,-21,10km").circle == (-21.0, 64.0, 10.0)
    for bad in (lambda: grammar.parse_term("step@1,tau=2"), lambda: grammar.parse_term("exp@1"), lambda: grammar.parse_region("x"), lambda: grammar.parse_stage("a"), lambda: grammar.resolve_period("2024-01-02..2024-01-01")):
        with pytest.raises(ValueError):
            bad()


def test_trajectory(spark):
    import numpy as np

    rng, rows = np.random.default_rng(0), []
    for t in np.arange(2018, 2022, 0.01):
        rows.append(("A", float(t), float(3 + 7 * (t - 2020) + 2 * np.cos(2 * np.pi * t) + 5 * (t >= 2019.5) + rng.normal(0, 0.1)), 0.1))
    df = spark.createDataFrame([*rows, ("B", 2020.0, 1.0, 0.1)], "s string, t double, y double, sigma double")
    extra = (grammar.parse_term("step@2019.5"),)
    p = fitted(df, ["s"], "t", "y", "sigma", extra=extra)
    r = p.head()
    assert p.count() == 1 and [r.offset, r.rate, r.annual_cos, r.step0] == pytest.approx([3, 7, 2, 5], abs=0.05) and 0 < r.rate_sigma < 0.05
    left = detrended(df, p, ["s"], "t", "y", out="r", extra=extra)
    assert left.filter("s = 'A'").agg(F.stddev("r")).head()[0] < 0.12 and left.filter("s = 'B'").head().r == 1.0


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 5, "c"), (3, 1, "d"), (1, 0, "late")], "k int, v int, x string")
    assert {tuple(r) for r in upserted(old, new, ["k"], ["v"]).collect()} == {(1, 1, "a"), (2, 5, "c"), (3, 1, "d")}
    rows = spark.createDataFrame([(1, "automatic", 9), (1, "manual", 2), (2, "automatic", 1), (2, "automatic", 3)], "k int, mode string, v int")
    assert {tuple(r) for r in reviewed_over_automatic(rows, "k", "mode", ["v"]).collect()} == {(1, "manual", 2), (2, "automatic", 3)}


def test_neighbours(spark):
    rng = random.Random(5)
    p = [(k, rng.uniform(60, 67), rng.uniform(-25, -13)) for k in range(30)]
    s = [(k, rng.uniform(60, 67), rng.uniform(-25, -13)) for k in range(40)]
    points, stations = spark.createDataFrame(p, "p int, lat double, lon double"), spark.createDataFrame([*s, (99, None, 1.0)], "s int, lat double, lon double")
    import math

    km = lambda a, b: math.hypot((b[1] - a[1]) * 111.19, (b[2] - a[2]) * 111.19 * math.cos(math.radians((a[1] + b[1]) / 2)))
    want = {(a[0], k + 1): b for a in p for k, b in enumerate(sorted(range(40), key=lambda j: (km(a, s[j]), j))[:3])}
    got = joins.k_nearest(points, stations, 3, point="p", station="s", start_km=50.0)
    assert {(r.p, r.rank): r.station for r in got.collect()} == want
    few = joins.k_nearest(points, stations.limit(2), 3, point="p", station="s", start_km=50.0)
    assert few.count() == 60


@pytest.mark.parametrize("pairs", [None, 1])
def test_neighbours_of_repeated_places(spark, monkeypatch, pairs):
    """Distances are worked out once a place and a few a round, with the same result, ties to the smaller station."""
    rng = random.Random(6)
    places = [(rng.uniform(60, 61), rng.uniform(-20, -18)) for _ in range(40)] + [(-70.0, 100.0), (0.0, 0.0), (-0.0, 179.0)]
    p = [(k, *rng.choice(places)) for k in range(300)] + [(7, *places[0]), (500, -0.0, 0.0), (501, float("nan"), 0.0)]
    s = [(k, *rng.choice(places[:41])) for k in range(200)] + [(300, 1.0, float("nan"))]
    points, stations = spark.createDataFrame(p, "p int, lat double, lon double"), spark.createDataFrame(s, "s int, lat double, lon double")
    if pairs:
        monkeypatch.setattr(joins, "PAIRS_A_POINT", pairs)
        monkeypatch.setattr(joins, "PAIRS_A_ROUND", pairs)
    seen, banded = [], joins._banded
    monkeypatch.setattr(joins, "_banded", lambda left, right, km: seen.append((left.count(), right.count(), km)) or banded(left, right, km))
    km = lambda a, b: float(np.hypot((b[1] - a[1]) * 111.19, (b[2] - a[2]) * 111.19 * np.cos(np.radians((a[1] + b[1]) / 2))))
    want = []
    for k in sorted({a[0] for a in p if a[1] == a[1]}):
        near = sorted((km(a, b), b[0]) for a in p if a[0] == k for b in s[:-1])[:3]
        want += [(k, n + 1, station, round(d, 6)) for n, (d, station) in enumerate(near)]
    got = joins.k_nearest(points, stations, 3, point="p", station="s", start_km=4000.0, max_km=60000.0)
    assert sorted((r.p, r.rank, r.station, round(r.km, 6)) for r in got.collect()) == want
    assert max(n for n, *_ in seen) <= 43 and max(n for _, n, _ in seen) <= 123
    assert not pairs or (seen[0][2] < 10 and len(seen) > 2 and seen[-1][0] <= 3)


def test_neighbours_within_a_town(spark, monkeypatch):
    """Where most places are metres apart, the first radius is of metres."""
    monkeypatch.setattr(joins, "PAIRS_A_POINT", 10)
    monkeypatch.setattr(joins, "PAIRS_A_ROUND", 1)
    seen, banded = [], joins._banded
    monkeypatch.setattr(joins, "_banded", lambda left, right, km: seen.append(km) or banded(left, right, km))
    s = spark.range(300).select(F.col("id").alias("s"), (64 + F.col("id") * 1e-4).alias("lat"), F.lit(-21.0).alias("lon"))
    got = joins.k_nearest(s.withColumnRenamed("s", "p"), s, 2, point="p", station="s", start_km=4000.0)
    assert {(r.p, r.rank): r.station for r in got.collect() if r.rank == 1} == {(k, 1): k for k in range(300)}
    assert got.count() == 600 and seen[0] < 0.2


def test_counts_keep_null_categories(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a"), (t + dt.timedelta(2), None), (None, "a")], "t timestamp_ntz, c string")
    assert {(r.d.day, r.c): r.n for r in aggregates.daily_counts(df, "t", by="c").collect()} == {(1, "a"): 1, (1, None): 0, (2, "a"): 0, (2, None): 0, (3, "a"): 0, (3, None): 1}
    assert aggregates.daily_counts(df.limit(0), "t").count() == 0


def test_products(spark):
    import numpy as np

    from seiche.functions import geo
    from seiche.models import products

    rng = np.random.default_rng(1)
    s = spark.createDataFrame([(float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for _ in range(60)], "lat double, lon double")
    x, y, z = geo.llh_to_xyz(F.col("lat"), F.col("lon"), F.lit(0.0))
    rows = s.select(F.lit(1).alias("day"), x.alias("x"), y.alias("y"), z.alias("z"))
    r = products.frame_parameters(rows.withColumns({"dx": 0.01 + F.col("x") * 2e-9, "dy": -0.02 + F.col("y") * 2e-9, "dz": 0.03 + F.col("z") * 2e-9})).head()
    assert [r.tx, r.ty, r.tz] == pytest.approx([0.01, -0.02, 0.03], abs=1e-6) and r.scale_ppb == pytest.approx(2.0, abs=1e-6) and abs(r.rx_mas) < 1e-6
    a = np.array([[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 3.0]])
    g = spark.createDataFrame([("k", [float(v) for v in rng.normal(size=3)], (a * (1 + i)).ravel().tolist()) for i in range(4)], "k string, v array<double>, c array<double>")
    g = g.select("k", *[F.col("v")[i].alias(f"v{i}") for i in range(3)], "c")
    out = products.gls_means(g, ["k"], ("v0", "v1", "v2"), "c").head()
    data = g.collect()
    p = sum(np.linalg.inv(np.array(r.c).reshape(3, 3)) for r in data)
    want = np.linalg.solve(p, sum(np.linalg.inv(np.array(r.c).reshape(3, 3)) @ [r.v0, r.v1, r.v2] for r in data))
    assert out.mean == pytest.approx(want) and out.covariance == pytest.approx(np.linalg.inv(p).ravel())
    m = spark.createDataFrame([("A", t, 1.0 + t) for t in range(5)] + [("B", t, 50.0 + t) for t in range(6, 9)] + [("C", 9, 0.0)], "s string, t int, y double")
    joined = products.joined_station(m, ["A", "B", "C"], station="s", t="t", y="y", n=1).collect()
    assert [r.y for r in joined] == [1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 6.0, 7.0, 7.0]


def test_running_totals_and_step_sums(spark):
    rng = random.Random(8)
    rows = [(k, D0 + dt.timedelta(rng.randrange(6)), rng.choice([None, float("nan"), round(rng.uniform(-5, 5), 2)])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, d date, v double")
    total, want = 0.0, {}
    for k, d, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total = round(total + (v if v is not None and v == v else 0.0), 2)
        want[k] = total
    assert {r.k: round(r.running, 2) for r in aggregates.running_totals(df, "v", "d", ["k"]).collect()} == want
    s = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0)], "s string, t double")
    rules = spark.createDataFrame([("a", 2.0, 10.0), ("a", 3.0, 5.0), ("c", 9.0, 1.0)], "s string, b double, x double")
    out = {(r.s, r.t): r.total for r in joins.step_sums(s, rules, "t", "b", "x", ["s"], "total").collect()}
    assert out == {("a", 1.0): 15.0, ("a", 2.0): 5.0, ("a", 3.0): 0.0, ("b", 2.0): 0.0}


def test_comparison_and_twins(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 2.0, None)], "k int, v double, c string")
    b = spark.createDataFrame([(1, 1.2, "x"), (2, 1.0, "z"), (3, 2.0, None), (4, 0.0, "q")], "k int, v double, c string")
    got = {(r.k, r.field) for r in joins.compared(a, b, "k", numbers={"v": 0.1}, exact=["c"]).collect()}
    assert got == {(1, "v"), (2, "v"), (2, "c"), (4, "key")}
    rows = spark.createDataFrame([(1, "auto", 5.0, 0), (1, "picks", 7.0, 1), (1, "picks", 8.0, 2), (2, "auto", 6.0, 3)], "e int, s string, v double, p int")
    out = {r.e: (r.v, r.auto_value, r.n_solutions) for r in joins.resolved_twins(rows, event="e", system="s", reviewed_system="picks", order=[F.col("p")], auto_value="v").collect()}
    assert out == {1: (7.0, 5.0, 2), 2: (6.0, 6.0, 1)}


def test_twins_without_a_depth(spark, tmp_path):
    rows = [(1, "sil00012", "SIL picks", 4.0), (2, "12", "sil aut", float("nan")), (3, "13", None, None), (4, "14", "x", 2.5), (5, "15", "x", float("nan"))]
    spark.createDataFrame(rows, "row_id long, event_id string, originating_system string, depth_km double").write.parquet(str(tmp_path / "skjalftalisa_quakes.parquet"))
    got = {q: {r.event: (r.row_id, str(r.auto_value), r.n_solutions) for r in catalogue.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("j08_twins", "j08_twins_missing")}
    assert got["j08_twins"] == {12: (1, "nan", 2), 13: (3, "None", 1), 14: (4, "2.5", 1), 15: (5, "nan", 1)}
    assert got["j08_twins_missing"] == {12: (1, "None", 2), 13: (3, "None", 1), 14: (4, "2.5", 1), 15: (5, "None", 1)}


def test_upsert_and_baseline_meet_every_key(spark, tmp_path):
    spark.range(1, 31).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.source for r in catalogue.QUERIES["st07_upsert_all"](spark, str(tmp_path)).collect()}
    assert got == {k: "old" if k % 3 == 1 else "new" for k in range(1, 31)}
    rows = [(u, f"2024-01-0{d} 0{h}:00:00", float(u * d * d + h)) for u in (1, 2, 3, 4, 5) for d in (1, 2, 3) for h in (1, 2) if (u, d) != (1, 3)]
    spark.createDataFrame(rows, "user_id int, ts string, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = {(r.user_id, str(r.d)): r.v for r in catalogue.QUERIES["j19_baseline_all"](spark, str(tmp_path)).collect()}
    assert out == {(u, f"2024-01-0{d}"): (u - 1) * (d * d - 1.0) for u in (2, 3, 4, 5) for d in (1, 2)}


def test_late_rows_reach_their_buckets(spark, tmp_path):
    files = [[("2024-03-20 00:01:00", 1.0), ("2024-03-01 00:01:00", 2.0)], [("2024-03-20 00:02:00", 3.0)], [("2024-03-01 00:02:00", 6.0), ("2024-02-01 00:00:00", 5.0)]]
    for rows in files:
        spark.createDataFrame(rows, "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = {str(r.bucket): (r.value, r.n) for r in streamed_bucket_medians(spark, str(tmp_path / "events"), "ts", "10 minutes", "v", files_per_batch=1).collect()}
    assert got == {"2024-03-20 00:00:00": (2.0, 2), "2024-03-01 00:00:00": (4.0, 2), "2024-02-01 00:00:00": (5.0, 1)}


def test_empty_frames(spark):
    e = spark.createDataFrame([], "k int, t double, v double, s double, d date, ts timestamp_ntz, lat double, lon double")
    assert aggregates.bucket_medians(e, "ts", "1 hour", ["v"]).count() == 0
    assert aggregates.line_rate(e, ["k"], "t", "v", "s").count() == 0
    assert aggregates.trimmed_mean(e, ["k"], "v", ["t"]).count() == 0
    assert windows.mad_kept(e, ["k"], "v", 3).count() == 0 and windows.largest_gap(e, ["k"], "ts", "t").count() == 0
    assert joins.unique_key_join(e.select(F.col("k").alias("a")), e.select(F.col("k").alias("b")), "a", "b").count() == 0
    assert joins.k_nearest(e.select("k", "lat", "lon"), e.select(F.col("k").alias("s"), "lat", "lon"), 2, point="k", station="s").count() == 0
