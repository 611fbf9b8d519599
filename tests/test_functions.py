"""Column functions against known values and their own inverses."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seiche.functions import geo, mechanism, moment, text, timeaxis


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).head()


L = F.lit


def test_distances(spark):
    r = one(spark, geo.geodesic_km(L(0.0), L(0.0), L(0.0), L(1.0)), geo.geodesic_km(L(0.0), L(0.0), L(1.0), L(0.0)), geo.geodesic_km(L(64.0), L(-21.0), L(64.0), L(-21.0)), geo.geodesic_km(L(64.0), L(-21.0), L(None).cast("double"), L(1.0)), geo.haversine_km(L(0.0), L(0.0), L(0.0), L(180.0)))
    assert r[0] == pytest.approx(111.3194908, abs=1e-6) and r[1] == pytest.approx(110.5743886, abs=1e-6) and r[2] == 0 and r[3] is None
    assert r[4] == pytest.approx(math.pi * 6371)


def test_polygon_edges(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    points = {(1.0, 1.0): True, (0.0, 0.0): True, (2.0, 1.0): True, (1.0, 2.0): True, (2.1, 1.0): False, (-1.0, 2.0): False, (float("nan"), 1.0): False, (None, 1.0): False}
    df = spark.createDataFrame(list(points), "x double, y double")
    assert [r[0] for r in df.select(geo.in_polygon(F.col("x"), F.col("y"), square)).collect()] == list(points.values())
    with pytest.raises(ValueError):
        geo.in_polygon(L(0.0), L(0.0), square[:2])


def test_ellipsoid_and_frames(spark):
    x, y, z = geo.llh_to_xyz(L(64.1), L(-21.9), L(120.0))
    r = one(spark, *geo.xyz_to_llh(x, y, z), *geo.xyz_to_neu(L(1.0), L(0.0), L(0.0), L(0.0), L(0.0)), *geo.plate_velocity_neu(L(6378137.0), L(0.0), L(0.0), (0.0, 0.0, 1e-8)))
    assert r[0:3] == pytest.approx((64.1, -21.9, 120.0), abs=1e-6) and r[3:6] == pytest.approx((0, 0, 1)) and r[6:9] == pytest.approx((0, 0.06378137, 0), abs=1e-9)


def test_moment_inverses(spark):
    for m in (-1.0, 1.99, 2.5, 3.7, 5.0, 5.8):
        r = one(spark, moment.mlw_from_moment(moment.moment_from_mlw(L(m))), moment.mw_from_moment(moment.moment_from_mw(L(m))), moment.magnitude_exact(moment.ground_velocity(L(m), L(25.0)) * 1e6, L(25.0)))
        assert list(r) == pytest.approx([m] * 3, abs=1e-9)
    r = one(spark, moment.near_field_bias(L(10.0), L(5.0)), moment.mw_from_moment(L(-1.0)), moment.magnitude_far(L(1.0), L(0.0)), moment.near_field_limit(L(3.5), [(3.0, 1.0), (4.0, 5.0), (9.0, 9.0)]), moment.near_field_limit(L(None).cast("double"), [(3.0, 1.0), (4.0, 5.0)]))
    assert r[0] == pytest.approx(0.2255, abs=2e-4) and r[1] is None and r[2] is None and r[3] == 5.0 and r[4] == 1.0


def test_planes(spark):
    for s, d, r in ((30.0, 60.0, 45.0), (200.0, 30.0, -90.0), (350.0, 85.0, 170.0), (10.0, 45.0, 90.0)):
        other = mechanism.auxiliary_plane(L(s), L(d), L(r))
        back = mechanism.auxiliary_plane(other["strike"], other["dip"], other["rake"])
        out = one(spark, back["strike"], back["dip"], back["rake"], mechanism.same_plane((L(s), L(d), L(r)), (other["strike"], other["dip"], other["rake"])))
        assert out[1] == pytest.approx(d, abs=1e-6) and out[3] == pytest.approx(0, abs=1e-4)
        assert math.cos(math.radians(out[0] - s)) == pytest.approx(1) and math.cos(math.radians(out[2] - r)) == pytest.approx(1)


def test_axes_and_classes(spark):
    for plane, want in (((0.0, 45.0, -90.0), "normal"), ((0.0, 45.0, 90.0), "reverse"), ((0.0, 90.0, 0.0), "strike-slip")):
        a = mechanism.axes(*map(L, plane))
        r = one(spark, mechanism.faulting_class(a["p"][1], a["b"][1], a["t"][1]), a["p"][1], a["t"][1])
        assert r[0] == want
    r = one(spark, mechanism.faulting_label(L(" Strike slip  faulting dominates ")), mechanism.faulting_label(L("x")), mechanism.from_dip_to_180(L(10.0), L(120.0), L(30.0))["dip"], mechanism.from_dip_to_180(L(10.0), L(181.0), L(30.0)), mechanism.wrapped(L(-180.0)))
    assert r[0] == "strike-slip" and r[1] is None and r[2] == 60 and r[3] is None and r[4] == 180


def test_time_axes(spark):
    d = dt.datetime(2024, 2, 29, 12)
    y = 2024 + (59.5) / 366
    r = one(spark, timeaxis.fractional_year(L(d)), timeaxis.instant_of(L(y)), timeaxis.day_of(L(y)), timeaxis.noon_year(L(d.date())), timeaxis.nearest_hour(L(5400)), timeaxis.nearest_hour(L(1800)), timeaxis.sinex_epoch(L("24:060:43200")), timeaxis.date_of_week_and_day(L(2303), L(60)), timeaxis.parsed_date(L("20240229")), timeaxis.tau_years(timeaxis.half_life_days(L(2.0))))
    assert r[0] == pytest.approx(y) and r[1] == d and r[2] == d.date() and r[3] == pytest.approx(y) and r[4] == 7200 and r[5] == 0 and r[6] == d and r[7] == d.date() and r[8] == d.date() and r[9] == pytest.approx(2)


def test_identifiers(spark):
    r = one(spark, text.event_type(L("QU")), text.event_type(L("zz")), text.event_type(L(" ")), text.canonical_number(L(" 001352381 ")), text.canonical_number(L("IMO12")), text.path_day(L("/2026/nov/12/21:50:00/53:43:797")), text.path_key(L("x/2026/Nov/12/21:50:00/53:43:797")), text.baseline_ends(L("abcd-EFGH"))[1], text.reason_names(L(5)), text.wrap_correction(L(-25.0)))
    assert tuple(r) == ("earthquake", "other", None, "1352381", None, dt.date(2026, 11, 12), "2026/nov/12/21:50:00/53:43:797", "EFGH", "outlier,icing", -20.0)
