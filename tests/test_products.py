"""Station products, networks, quantiles and linkage on planted values, nulls and empty tables."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from seiche.models import network, records
from seiche.operators import aggregates, joins, screens, windows
from seiche.plans import documents, grammar

SERIES = "rec_id long, station string, session_code string, component string, t double, y double, sigma double, k1 string"


def series(spark, rows):
    return spark.createDataFrame([(n, *r, "clash") for n, r in enumerate(rows)], SERIES)


def planted():
    rng = random.Random(5)
    rows = [("A", "s", c, 2020 + k / 100, 3.0 * k / 100 + rng.gauss(0, 0.1), 0.1) for c in "NEU" for k in range(60)]
    rows += [("B", "s", c, 2020 + k / 100, 1.0, 0.1) for c in "NEU" for k in range(0, 60, 20)]
    rows += [("C", "s", "N", 2020.1, None, 0.1), ("C", "s", "N", None, 1.0, 0.1), ("C", "s", "N", 2020.2, 1.0, None), (None, "s", "N", 2020.1, float("nan"), 0.1)]
    return rows


def test_velocities_and_refusals(spark):
    df = series(spark, planted())
    out = {(r.station, r.component): r for r in records.velocities(df, (2020.0, 2020.6), keys=["station", "session_code"]).collect()}
    assert out["A", "N"].rate == pytest.approx(3.0, abs=0.4) and out["A", "N"].refused is None and out["A", "N"].sigma > 0
    assert out["B", "N"].rate is None and "few epochs 3" in out["B", "N"].refused and out["C", None].refused == "no epochs"
    steps = spark.createDataFrame([("A", "s", 2020.3)], "station string, session_code string, step double")
    refused = records.velocities(df, (2020.0, 2020.6), keys=["station", "session_code"], steps=steps).filter("station = 'A'").head().refused
    allowed = records.velocities(df, (2020.0, 2020.6), keys=["station", "session_code"], steps=steps, allow_steps=True).filter("station = 'A'").head()
    assert refused == "steps_in_window" and allowed.refused is None and allowed.flags == ["truncated", "steps_in_window"]
    known = spark.createDataFrame([("B", "s")], "station string, session_code string")
    assert records.velocities(df, (2020.0, 2020.6), keys=["station", "session_code"], recorded=known).filter("station = 'A'").head().refused == "no_record"
    short = records.velocities(df, (2020.0, 2020.6), keys=["station", "session_code"], least=100, least_snr=3.0).filter("station = 'A'").head()
    assert short.tier == "short" and short.flags == ["truncated", "short"]
    assert records.velocities(df.limit(0), (2020.0, 2020.6), keys=["station", "session_code"]).count() == 0


def test_displacements_coordinates_views(spark):
    df = series(spark, planted())
    for method, want in (("ends", 3.0 * 0.5), ("points", 3.0 * 0.59), ("rate", 3.0 * 0.6)):
        got = {(r.station, r.component): r for r in records.displacements(df, (2020.0, 2020.6), keys=["station", "session_code"], method=method, ends_days=36.5).collect()}
        assert got["A", "E"].displacement == pytest.approx(want, abs=0.4) and got["A", "E"].refused is None
    step = records.displacements(df, (2020.0, 2020.6), keys=["station", "session_code"], method="step", onset=2020.2, end=2020.4, step_days=36.5).filter("station = 'A' and component = 'N'").head()
    assert step.displacement == pytest.approx(0.9, abs=0.4)
    at = {(r.station, r.component): r for r in records.coordinates(df, 2020.3, keys=["station", "session_code"]).collect()}
    assert at["A", "U"].value == pytest.approx(0.9, abs=0.2) and at["A", "U"].flags == [] and at["C", "N"].refused == "no solutions to anchor on"
    assert any(f.startswith("extrapolated") for f in records.coordinates(df, 2021.3, keys=["station", "session_code"]).filter("station = 'A'").head().flags)
    out = records.view(df, keys=["station", "session_code"], outliers=df.filter("rec_id = 3").select("rec_id"))
    bad = out.filter("not kept").select("station", "component", F.round("t", 2)).collect()
    assert {tuple(r) for r in bad} == {("A", c, 2020.03) for c in "NEU"} and out.count() == df.count()
    assert records.exported(out, (2020.0, 2020.1)).filter("not kept").count() == 0
    assert records.rate_scales(df, 0.2, keys=["station", "component"]).filter("station = 'A' and k is not null").count() == 3


@pytest.mark.parametrize("in_one_buffer", [1_000_000, 10])
def test_quantiles_and_trimmed_means(spark, in_one_buffer, monkeypatch):
    monkeypatch.setattr(aggregates, "VALUES_IN_ONE_BUFFER", in_one_buffer)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 100), rng.gauss(0, 1e-3), 0.0, 5.0, -5.0, None, float("nan"), float("inf")])) for _ in range(4000)] + [("empty", None)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([v] if v is not None and np.isfinite(v) else [])
    got = {r.k: r for r in aggregates.group_quantiles(df, ["k"], "v", [0.1, 0.5, 0.95], ["a", "b", "c"]).collect()}
    for k, v in groups.items():
        assert got[k].n == len(v)
        assert (got[k].a, got[k].b, got[k].c) == ((None, None, None) if not v else tuple(pytest.approx(x) for x in np.quantile(v, [0.1, 0.5, 0.95])))
    finite = df.filter("v is null or abs(v) < 1e300 or isnan(v)")
    means = {r.k: r.trimmed_mean for r in aggregates.trimmed_mean(finite, ["k"], "v").collect()}
    for k in ("a", "b", None):
        v = sorted(groups[k])
        assert means[k] == pytest.approx(np.mean(v[len(v) // 3 : len(v) - len(v) // 3]))
    assert means["one"] is None and "empty" not in means
    kept = windows.mad_kept(finite.filter("k = 'a'"), ["k"], "v", 3.0)
    m = median(groups["a"])
    spread = 1.4826 * median(abs(x - m) for x in groups["a"])
    assert kept.count() == sum(abs(x - m) <= 3 * spread for x in groups["a"])
    assert aggregates.group_quantiles(df.limit(0), [], "v", [0.5], ["m"]).head().n == 0


def test_linkage_does_not_depend_on_where_it_is_done(spark):
    rng = random.Random(9)
    edges = [(a, b, round(rng.random(), 2)) for a in range(40) for b in range(40) if rng.random() < 0.2]
    chain = [(100 + k // 2 + k % 2, 200 + k // 2, 2 + k / 1000) for k in range(120)]  # each edge shares an end with the next
    df = spark.createDataFrame(edges + chain, "a long, b long, c double")
    want, ua, ub = set(), set(), set()
    for a, b, _ in sorted(edges + chain, key=lambda e: (e[2], e[0], e[1])):
        if a not in ua and b not in ub:
            want.add((a, b)), ua.add(a), ub.add(b)
    for n in (10_000, 30):
        assert {(r.a, r.b) for r in joins.greedy_pairs(df, "a", "b", [F.col("c")], in_one_task=n).collect()} == want


def test_neighbours_through_cells(spark):
    rng = random.Random(1)
    points = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(300)]
    df = spark.createDataFrame([*points, (900, None, 1.0)], "station long, lat double, lon double")
    km = lambda p, q: np.hypot((q[1] - p[1]) * 111.19, (q[2] - p[2]) * 111.19 * np.cos(np.radians((p[1] + q[1]) / 2)))
    for most in (300.0, 2500.0):
        want = {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and km(p, q) <= most}
        assert {(r.a, r.b) for r in joins.pairs_within(df, station="station", max_km=most).collect()} == want


def test_frames_and_networks(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(30, 3)) * 6e6
    p = network.partials(xyz, ["xtran", "zrot", "scale"]) @ np.array([0.02, 5.0, 3.0])
    d = p.reshape(-1, 3)
    d[7] += 0.4
    rows = [(1, f"s{k:02d}", *map(float, xyz[k]), *(map(float, d[k]) if k != 9 else (None, None, None)), 0.001) for k in range(30)] + [(2, "s00", *map(float, xyz[0]), 0.0, 0.0, 0.0, 0.001)]
    out = network.stabilised(spark.createDataFrame(rows, "day int, site string, x double, y double, z double, dx double, dy double, dz double, sigma double"), parameters=["xtran", "zrot", "scale"]).collect()
    one = {r.site: r for r in out if r.day == 1}
    assert abs(one["s03"].dx) < 1e-9 and one["s07"].dx == pytest.approx(0.4) and not one["s07"].used and one["s03"].n_used == 28
    assert [r.refused for r in out if r.day == 2] == ["1 reference sites"]
    c = network.psd_covariance(np.array([[1.0, 2.0, 3.0]]), np.array([[0.99, 0.99, -0.99]]))[0]
    assert np.linalg.eigvalsh(c).min() > -1e-9 and np.sqrt(np.diag(c)) == pytest.approx([1, 2, 3])
    holds = [grammar.parse_hold("post:rate=stage:pre")]
    with pytest.raises(ValueError):
        network.resolved_plan([grammar.parse_stage("post:rate"), grammar.parse_stage("pre:rate")], holds, donor=lambda n: None, store=lambda n: None, station="X")
    with pytest.raises(ValueError):
        network.resolved_plan([grammar.parse_stage("post:rate")], [grammar.parse_hold("rate=donor:DDDD")], donor=lambda n: None, store=lambda n: None, station="X")


def test_documents(tmp_path):
    path = str(tmp_path / "sub" / "d.json")
    documents.write_text(path, documents.stable_json({"b": 1, "a": [1.5]}))
    assert (tmp_path / "sub" / "d.json").read_text() == '{\n "a": [\n  1.5\n ],\n "b": 1\n}\n' and len(list((tmp_path / "sub").iterdir())) == 1
    one = documents.merged_entry({"x": 1}, ["a", "b"], "S", 2)
    assert one == {"x": 1, "a": {"b": {"S": 2}}} and documents.merged_entry(one, ["a", "b"], "S", None) == {"x": 1}
    with pytest.raises(ValueError):
        documents.merged_entry({"a": 1}, ["a", "b"], "S", 2)
    with pytest.raises(ValueError):
        documents.quake_regions({"r": {"bbox": [0, 1, 0, 1], "radius": [0, 0, 1]}})


def test_screens_of_empty_series(spark):
    df = series(spark, planted()).limit(0)
    assert screens.screened(df, ["station"], "t", "y", "sigma", most=1.0).count() == 0
    assert screens.data_ends(df, ["station"], "t", 2020.5).count() == 0 and screens.nearest_epoch(df, ["station"], "t", 2020.5).count() == 0
    steps = df.select("station").withColumn("step", F.lit(0.0))
    assert screens.cut_at_steps(df, ["station"], "t", steps, 2020.0, 1.0).count() == 0


def test_shared_decay_gathers_no_series(spark, monkeypatch):
    """One row a series is joined to the rows without a broadcast, which the driver would have to hold."""
    from seiche import session

    plans, write = [], session.written
    monkeypatch.setattr(session, "written", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, purpose))
    x = [k / 40 for k in range(40)]
    value = lambda s, t: 1 + 0.5 * t + (s + 1) * (1 - np.exp(-t / 0.3)) + 1e-3 * ((7 * s + round(40 * t)) % 5) + (50.0 if (s, t) == (1, 0.5) else 0.0)
    rows = [(str(s), 2020 + t, float(value(s, t)), 1.0) for s in range(3) for t in x] + [("short", 2020.5, 1.0, 1.0)]
    df = session.written(spark.createDataFrame(rows, "station string, t double, y double, sigma double"), "decay-input")
    tau, kept = records.shared_decay(df, keys=["station"], onset=2020.0, until=2021.0, taus=[0.1, 0.3, 0.8])
    assert tau == 0.3 and {(r.station, round(r.t, 3)) for r in kept.collect()} == {(s, round(t, 3)) for s, t, *_ in rows} - {("1", 2020.5), ("short", 2020.5)}
    out = records.transients(kept, keys=["station"], onset=2020.0, tau=tau, at=[2020.5])
    assert out.count() == 3
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
