"""Implausible values against loops over each series."""

import numpy as np
import pandas as pd

from seiche.operators import spikes
from seiche.operators.spikes import implausible, tail_cutoffs

SCHEMA = "rec_id long, station string, session_code string, component string, t double, y double, sigma double, stretch string, own string"


def table(spark, frame):
    cols = ["rec_id", "station", "session_code", "component", "t", "y", "sigma"]
    rows = [tuple(None if pd.isna(v) else v for v in r) + ("clash", "clash") for r in frame[cols].astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def series(seed, n=300, scale=2.0, name="AAAA"):
    rng = np.random.default_rng(seed)
    t = 2020 + np.arange(n) / 365.25
    y = scale * (3 * np.sin(2 * np.pi * t) + 5 * (t - 2020)) + rng.normal(0, scale, n)
    return pd.DataFrame({"station": name, "session_code": "s", "component": "N", "t": t, "y": y, "sigma": np.abs(rng.normal(3, 0.3, n))})


def found(df):
    out = [tuple(r) for r in implausible(df).collect()]
    assert len(out) == len({r for r, _ in out})
    return dict(out)


def planted():
    frame = pd.concat([series(1), series(2, scale=0.1, name="BBBB"), series(3, scale=30, name="CCCC")], ignore_index=True)
    want = {}
    for base, scale in ((0, 2.0), (300, 0.1), (600, 30.0)):
        for k, width in ((40, 1), (90, 2), (140, 3)):
            frame.loc[base + k : base + k + width - 1, "y"] += (-1) ** k * 14 * scale
            want |= {base + k + j: "spike" for j in range(width)}
        frame.loc[base + 200 :, "y"] += 40 * scale  # a lasting offset
        frame.loc[base + 250 : base + 256, "y"] = frame.y[base + 250]
        want |= {base + 250 + j: "stuck" for j in range(7)}
        frame.loc[base + 20, "sigma"] = 60.0
        want[base + 20] = "spike"
        for j, (c, v) in enumerate([("sigma", 0.0), ("sigma", -1.0), ("sigma", np.inf), ("y", np.inf), ("y", -2e6)]):
            frame.loc[base + 60 + j, c] = v
            want[base + 60 + j] = "impossible"
        frame.loc[base + 10, "y"] = np.nan
        frame.loc[base + 11, "sigma"] = np.nan
    frame["rec_id"] = np.arange(len(frame))
    again = frame.loc[[40, 250, 60]].assign(rec_id=[2000, 2001, 2002])
    want |= {2000: "spike", 2001: "stuck", 2002: "impossible"}
    return pd.concat([frame, again], ignore_index=True).sample(frac=1, random_state=2), want


def test_planted(spark):
    frame, want = planted()
    assert found(table(spark, frame)) == want


def test_long_series_is_split(spark, monkeypatch):
    frame, want = planted()
    monkeypatch.setattr(spikes, "STRETCH", 120)
    got = found(table(spark, frame))
    # A stretch judges by its own scatter: the planted cases stay.
    assert want.items() <= got.items() and len(got) <= len(want) + 3


def uneven():
    """A series with a noisy and a quiet part, gaps beside the edges of stretches, and a stuck run and repeated rows across one."""
    rng = np.random.default_rng(7)
    frame = pd.concat([series(5, 700, name="LONG"), series(6, 90)], ignore_index=True)
    frame["rec_id"] = np.arange(len(frame))
    frame.loc[0:119, "y"] += rng.normal(0, 40, 120)
    frame.loc[0:119, "sigma"] = 30.0
    frame.loc[110, "sigma"] = 4.0
    frame.loc[360:479, "y"] = frame.y[360] + rng.normal(0, 0.01, 120)
    frame.loc[400, "y"] += 0.5  # far only by the quiet part's own scatter
    frame.loc[237:242, "y"] = frame.y[237]
    for k in (122, 238, 484):
        frame.loc[k:699, "t"] += 5.0
    frame.loc[[121, 483], "y"] += 90.0
    frame.loc[[200, 481], "y"] = np.nan
    return pd.concat([frame, frame.loc[[119, 120, 239, 240, 481]].assign(rec_id=range(3000, 3005))], ignore_index=True).sample(frac=1, random_state=3)


def test_split_or_not_is_the_same(spark, monkeypatch):
    flat = series(8, 400, name="FLAT").assign(rec_id=range(5000, 5400), y=3.0)
    flat.loc[::9, "y"] += np.arange(45)
    for frame in (planted()[0], uneven(), flat):
        whole = found(table(spark, frame))
        for stretch in (120, 7):
            monkeypatch.setattr(spikes, "STRETCH", stretch)
            assert found(table(spark, frame)) == whole
        monkeypatch.undo()
    assert set(found(table(spark, uneven())).values()) == {"stuck", "spike"}


def test_statistics_of_split_series(spark, monkeypatch):
    seen = []
    made = spikes._series_statistics
    monkeypatch.setattr(spikes, "_series_statistics", lambda *a, **k: seen.append(made(*a, **k)) or seen[-1])
    monkeypatch.setattr(spikes, "STRETCH", 120)
    frame = uneven()
    implausible(table(spark, frame))
    one = frame[(frame.station == "LONG")].sort_values(["t", "rec_id"])
    first = one.dropna(subset=["y"]).drop_duplicates("t")
    y = first.y.to_numpy()
    scatter = np.median(np.abs(np.diff(y))) * spikes.SCATTER_OF_STEP
    z = np.abs(y - spikes._levels(y, np.zeros(len(y), int), spikes.NEIGHBOURS)[2]) / scatter
    cutoff = tail_cutoffs(z, np.zeros(len(z), int), 1, risk=1e-6, bounds=spikes.BOUNDS)[0]
    (got,) = seen[0].collect()
    np.testing.assert_allclose([got.usual, got.scatter, got.cutoff], [one.drop_duplicates("t").sigma.median(), scatter, cutoff], rtol=1e-9)


def test_small_stretches_of_rows(spark):
    frame, want = planted()
    assert {r.rec_id: r.issue for r in implausible(table(spark, frame), rows_at_once=50).collect()} == want


def test_edges(spark):
    assert found(table(spark, series(1).head(0).assign(rec_id=[]))) == {}
    flat = series(1).assign(y=3.0, rec_id=np.arange(300))
    flat.loc[5:9, "station"] = None
    flat.loc[20, "t"] = np.nan
    flat.loc[20, "sigma"] = -1.0
    got = found(table(spark, flat))
    assert got[20] == "impossible" and set(got.values()) == {"impossible", "stuck"} and not {5, 6, 7, 8, 9} & set(got)


def test_cutoffs_follow_the_tail():
    rng = np.random.default_rng(0)
    z = np.concatenate([np.abs(rng.normal(size=4000)), np.abs(rng.standard_t(3, 4000)), np.abs(rng.normal(size=20))])
    g = np.repeat([0, 1, 2], [4000, 4000, 20])
    cut = tail_cutoffs(z, g, 3, risk=1e-6, bounds=(3.0, 30.0))
    assert 3.5 < cut[0] < 6.5 < cut[1] and cut[2] == 30.0
