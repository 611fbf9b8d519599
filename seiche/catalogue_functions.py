"""Queries of the scalar functions, filters and grammars, with the SQL that gives the same rows.

The SQL spells the published formula out by itself, so that an error shared by a function and its
inverse shows. Angles are compared by sine and cosine, which do not jump.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from seiche.catalogue import query
from seiche.functions import geo, mechanism, moment, text, timeaxis
from seiche.operators import predicates, schema
from seiche.plans import grammar
from seiche.queries import read

D = F.col


def _double(c: str) -> Column:
    return D(c).cast("double")


# Fault planes: made of the customers' numbers.

_PLANE = "SELECT c_custkey k, radians((c_custkey * 37) % 360) s, radians(1 + c_custkey % 89) d, radians((c_custkey * 53) % 359 - 179) r FROM customer"
_VECTORS = f"""SELECT *, cos(r) * cos(s) + sin(r) * cos(d) * sin(s) ux, cos(r) * sin(s) - sin(r) * cos(d) * cos(s) uy, -sin(r) * sin(d) uz,
-sin(d) * sin(s) nx, sin(d) * cos(s) ny, -cos(d) nz FROM ({_PLANE})"""
_AUX = f"""SELECT k, s, d, r, f * ux ux, f * uy uy, f * uz uz, f * nx nx, f * ny ny, f * nz nz FROM (SELECT *, CASE WHEN uz > 0 THEN -1 ELSE 1 END f FROM ({_VECTORS}))"""
_PLUNGES = f"""SELECT k, degrees(asin(least(1, abs(nz - uz) / sqrt(2)))) p, degrees(asin(least(1, abs(nx * uy - ny * ux)))) b, degrees(asin(least(1, abs(nz + uz) / sqrt(2)))) t,
nx - ux px, ny - uy py, nz - uz pz FROM ({_VECTORS})"""


def _planes(spark, d):
    c = read(spark, d, "customer")
    return c.select(D("c_custkey").alias("k"), (D("c_custkey") * 37 % 360).cast("double").alias("s"), (1 + D("c_custkey") % 89).cast("double").alias("d"), (D("c_custkey") * 53 % 359 - 179).cast("double").alias("r"))


@query(f"""SELECT k, round(cos(s2), 6) + 0 AS cos_strike, round(sin(s2), 6) + 0 AS sin_strike, round(degrees(acos(-uz)), 4) AS dip,
round(cos(r2), 5) + 0 AS cos_rake, round(sin(r2), 5) + 0 AS sin_rake FROM (SELECT *, atan2(-nz / sin(acos(-uz)), nx * cos(s2) + ny * sin(s2)) r2 FROM (SELECT *, atan2(-ux, uy) s2 FROM ({_AUX}))) WHERE uz > -0.9999""")
def f14_auxiliary(spark, d):
    """The auxiliary plane by the slip and normal vectors (vertical ones apart, whose rake is undefined)."""
    p = _planes(spark, d).withColumn("a", mechanism.auxiliary_plane(D("s"), D("d"), D("r")))
    cut = F.abs(F.sin(F.radians("r")) * F.sin(F.radians("d"))) < 0.9999
    turn = lambda f, c, n: (F.round(f(F.radians(D(f"a.{c}"))), n) + 0).alias(f"{f.__name__}_{c}")
    return p.filter(cut).select("k", turn(F.cos, "strike", 6), turn(F.sin, "strike", 6), F.round("a.dip", 4).alias("dip"), turn(F.cos, "rake", 5), turn(F.sin, "rake", 5))


@query(f"""SELECT a.k AS k, round(degrees(least(greatest(acos(greatest(-1, least(1, n))), acos(greatest(-1, least(1, u)))), greatest(acos(greatest(-1, least(1, -n))), acos(greatest(-1, least(1, -u)))))), 4) AS angle
FROM (SELECT a.k, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz n, a.ux * b.ux + a.uy * b.uy + a.uz * b.uz u FROM ({_VECTORS}) a JOIN ({_VECTORS}) b ON b.k = a.k + 1) a""")
def f15_plane_mismatch(spark, d):
    """The angle between the planes of consecutive numbers."""
    p = _planes(spark, d)
    q = p.select((D("k") - 1).alias("k"), D("s").alias("s2"), D("d").alias("d2"), D("r").alias("r2"))
    return p.join(q, "k").select("k", F.round(mechanism.plane_angle((D("s"), D("d"), D("r")), (D("s2"), D("d2"), D("r2"))), 4).alias("angle"))


@query("""SELECT c_custkey AS k, ((c_custkey * 137) % 1000 - 500) % 360 + CASE WHEN ((c_custkey * 137) % 1000 - 500) % 360 < 0 THEN 360.0 ELSE 0.0 END AS strike,
CASE WHEN w > 180 THEN w - 360.0 ELSE w + 0.0 END AS rake FROM (SELECT c_custkey, (((c_custkey * 91) % 1500 - 700) % 360 + 360.0) % 360 w FROM customer)""")
def f16_normalised_plane(spark, d):
    p = read(spark, d, "customer").select(D("c_custkey").alias("k"), mechanism.normalised_plane((D("c_custkey") * 137 % 1000 - 500).cast("double"), F.lit(45.0), (D("c_custkey") * 91 % 1500 - 700).cast("double")).alias("p"))
    return p.select("k", "p.strike", (D("p.rake") + 0.0).alias("rake"))


@query("""WITH v AS (SELECT c_custkey k, (c_custkey * 37) % 360 s, c_custkey % 200 d, (c_custkey * 53) % 359 - 179 r FROM customer),
w AS (SELECT k, CASE WHEN d >= 90 THEN s ELSE s + 180 END s, CASE WHEN d >= 90 THEN 180 - d ELSE d END dip, CASE WHEN d >= 90 THEN 180 - r ELSE r + 180 END r FROM v WHERE d <= 180)
SELECT k, CAST(s % 360 AS DOUBLE) AS strike, CAST(dip AS DOUBLE) AS dip, CAST(CASE WHEN r > 180 THEN r - 360 WHEN r <= -180 THEN r + 360 ELSE r END AS DOUBLE) AS rake FROM w""")
def f17_dip_to_180(spark, d):
    """Planes of a convention with dips to 180 degrees; none beyond."""
    k = D("c_custkey")
    p = read(spark, d, "customer").select(k.alias("k"), mechanism.from_dip_to_180((k * 37 % 360).cast("double"), (k % 200).cast("double"), (k * 53 % 359 - 179).cast("double")).alias("p"))
    return p.filter("p is not null").select("k", "p.*")


@query(f"""SELECT k, round(CASE WHEN k % 3 = 0 THEN 0 ELSE degrees(acos(greatest(-1, least(1, sin(d) * sin(d + radians(20)) + cos(d) * cos(d + radians(20)))))) END, 3) AS angle,
k % 3 <> 0 AS inconsistent FROM ({_PLANE}) WHERE d < radians(60) AND abs(sin(r) * sin(d)) < 0.99""")
def f18_same_plane(spark, d):
    """A plane against the auxiliary of another (F18, F22): of its own, or of the plane with a dip twenty degrees steeper and the rake along the strike."""
    p = _planes(spark, d).filter("d < 60").filter(F.abs(F.sin(F.radians("r")) * F.sin(F.radians("d"))) < 0.99)
    a = (D("s"), D("d"), F.when(D("k") % 3 == 0, D("r")).otherwise(0.0))
    own = p.withColumn("other", mechanism.auxiliary_plane(a[0], F.when(D("k") % 3 == 0, D("d")).otherwise(D("d") + 20), a[2]))
    b = (D("other.strike"), D("other.dip"), D("other.rake"))
    return own.select("k", (F.round(mechanism.same_plane(a, b), 3) + 0).alias("angle"), mechanism.inconsistent(a, b, 10.0).alias("inconsistent"))


@query(f"""SELECT k, round(p, 4) AS p_plunge, round(b, 4) AS b_plunge, round(t, 4) AS t_plunge, CASE WHEN p > 89.99 OR p < 0.01 THEN NULL ELSE round(cos(atan2(CASE WHEN pz < 0 THEN -py ELSE py END, CASE WHEN pz < 0 THEN -px ELSE px END)), 4) + 0 END AS cos_p FROM ({_PLUNGES})""")
def f19_axes(spark, d):
    """Plunges of the axes of a double couple and the azimuth of P."""
    a = mechanism.axes(D("s"), D("d"), D("r"))
    p = _planes(spark, d).select("k", *[a[x][1].alias(x) for x in "pbt"], a["p"][0].alias("az"))
    return p.select("k", *[F.round(x, 4).alias(f"{x}_plunge") for x in "pbt"], F.when((D("p") <= 89.99) & (D("p") >= 0.01), F.round(F.cos(F.radians("az")), 4) + 0).alias("cos_p"))


_CLEAR = "abs(p - 60) > 1e-6 AND abs(b - 60) > 1e-6 AND abs(t - 50) > 1e-6"


@query(f"""SELECT k, CASE WHEN b > 60 THEN 'strike-slip' WHEN p > 60 THEN 'normal' WHEN t > 50 THEN 'reverse' ELSE 'odd' END AS class FROM ({_PLUNGES}) WHERE {_CLEAR}""")
def f20_faulting_class(spark, d):
    a = mechanism.axes(D("s"), D("d"), D("r"))
    p = _planes(spark, d).select("k", *[a[x][1].alias(x) for x in "pbt"]).filter(_CLEAR)
    return p.select("k", mechanism.faulting_class(D("p"), D("b"), D("t")).alias("class"))


@query(f"""SELECT k, CASE WHEN p >= 52 AND t <= 35 THEN 'normal' WHEN p >= 40 AND p < 52 AND t <= 20 THEN 'normal-oblique' WHEN p < 40 AND b >= 45 AND t <= 20 THEN 'strike-slip'
WHEN p <= 20 AND b >= 45 AND t < 40 THEN 'strike-slip' WHEN p <= 20 AND t >= 40 AND t < 52 THEN 'reverse-oblique' WHEN p <= 35 AND t >= 52 THEN 'reverse' ELSE 'odd' END AS class
FROM (SELECT k, round(p, 5) p, round(b, 5) b, round(t, 5) t FROM ({_PLUNGES}))""")
def f20_stress_regime(spark, d):
    """The classes by the world stress map's rule."""
    a = mechanism.axes(D("s"), D("d"), D("r"))
    p = _planes(spark, d).select("k", *[F.round(a[x][1], 5).alias(x) for x in "pbt"])
    return p.select("k", mechanism.faulting_class(D("p"), D("b"), D("t"), "wsm").alias("class"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'strike-slip' WHEN 1 THEN 'normal' WHEN 2 THEN 'reverse' WHEN 3 THEN 'strike-slip' WHEN 4 THEN NULL ELSE 'dip-slip' END AS label FROM part""")
def f25_faulting_label(spark, d):
    """Labels in free text."""
    words = F.array(*[F.lit(w) for w in (" Strike slip  faulting dominates ", "Normal faulting dominates", "reverse dominates", "strike-slip", "no solution", "Dip-slip faulting dominates")])
    return read(spark, d, "part").select("p_partkey", mechanism.faulting_label(F.get(words, (D("p_partkey") % 6).cast("int"))).alias("label"))


# Ground velocity.


@query("""SELECT l_orderkey, l_linenumber, round((1.69 / 1.05) * (log10(r + 0.00299 * pow(10, 0.621 * m)) - log10(r)), 6) AS bias,
CASE WHEN r = 1 THEN NULL ELSE round((log10(r + 0.00299 * pow(10, 0.621 * m)) - log10(r)) / log10(r), 6) END AS change FROM (SELECT *, l_quantity r, l_tax * 50 m FROM lineitem)""")
def f10_near_field(spark, d):
    """The bias of the far-field magnitude and the change of the distance term."""
    l = read(spark, d, "lineitem").withColumns({"r": D("l_quantity"), "m": D("l_tax") * 50})  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.round(moment.near_field_bias(D("r"), D("m")), 6).alias("bias"), F.round(moment.distance_term_change(D("r"), D("m")), 6).alias("change"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN m IS NULL OR m < 2 THEN 5.0 WHEN m < 3 THEN 12.0 ELSE 30.0 END AS km FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_tax * 50 END m FROM lineitem)""")
def f12_near_field_limit(spark, d):
    l = read(spark, d, "lineitem").withColumn("m", F.when(D("l_linenumber") != 3, D("l_tax") * 50))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", moment.near_field_limit(D("m"), [(2.0, 5.0), (3.0, 12.0), (4.5, 30.0)]).alias("km"))


@query("SELECT l_orderkey, l_linenumber, round(2.0::DOUBLE / 3 * log10(l_extendedprice * 1e9) - 6.03, 6) AS mw, round((1.69 * log10(l_quantity) + log10(l_extendedprice * 1e-6) + 4.96) / 1.05, 6) AS m_pgv FROM lineitem")
def f62_older_forms(spark, d):
    """The moment magnitude with its older constant, the far-field magnitude of a row."""
    l = read(spark, d, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.round(moment.mw_from_moment(D("l_extendedprice") * 1e9, moment.MW_CONSTANT_OLD), 6).alias("mw"), F.round(moment.magnitude_far(D("l_extendedprice"), D("l_quantity")), 6).alias("m_pgv"))


@query("""WITH q AS (SELECT row_id, CASE WHEN NOT isnan(seismic_moment) THEN seismic_moment END m0, CASE WHEN m_mlw BETWEEN -3 AND 10 THEN m_mlw END m,
CASE row_id % 3 WHEN 0 THEN 'Mlw' WHEN 1 THEN 'ML' ELSE 'ML_SIL' END kind FROM skjalftalisa_quakes)
SELECT row_id, round(log10(CASE WHEN m0 IS NOT NULL THEN m0 WHEN kind = 'Mlw' THEN pow(10, CASE WHEN m > 5.4 THEN 14.3650793650793651 + (m - 5.4) / 0.5 WHEN m > 4.6 THEN 10 + 2 + 1 / 0.9 + 1.6 / 0.8 + (m - 4.6) / 0.7 WHEN m > 3 THEN 10 + 2 + 1 / 0.9 + (m - 3) / 0.8 WHEN m > 2 THEN 10 + 2 + (m - 2) / 0.9 ELSE 10 + m END) END), 5) AS log_m0,
m0 IS NULL AND m IS NOT NULL AND kind = 'Mlw' AS derived FROM q WHERE m IS NULL OR m <= 5.4""")
def f05_derived_moment(spark, d):
    """Missing moments filled from Mlw only, with a flag."""
    kind = F.when(D("row_id") % 3 == 0, "Mlw").when(D("row_id") % 3 == 1, "ML").otherwise("ML_SIL")
    q = read(spark, d, "skjalftalisa_quakes").select("row_id", geo.number("seismic_moment").alias("moment_nm"), F.when(D("m_mlw").between(-3, 10), D("m_mlw")).alias("magnitude"), kind.alias("magnitude_type"))
    out = moment.with_derived_moment(q.filter("magnitude is null or magnitude <= 5.4"), ["Mlw"])
    return out.select("row_id", F.round(F.log10("moment_nm"), 5).alias("log_m0"), D("moment_derived").alias("derived"))


# Geometry.

_SPH = "(2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(lat - 64) / 2), 2) + cos(radians(lat)) * cos(radians(64)) * pow(sin(radians(lon + 21) / 2), 2)))))"


@query(f"""SELECT c_custkey AS k, round(km / {_SPH}, 1) AS ratio FROM (SELECT c_custkey, ((c_custkey * 37) % 1800) / 10.0::DOUBLE - 90 lat, ((c_custkey * 73) % 3600) / 10.0::DOUBLE - 180 lon, {_SPH} km FROM (SELECT c_custkey, ((c_custkey * 37) % 1800) / 10.0::DOUBLE - 90 lat, ((c_custkey * 73) % 3600) / 10.0::DOUBLE - 180 lon FROM customer)) WHERE km BETWEEN 1 AND 18000""")
def f28_geodesic(spark, d):
    """The ellipsoidal distance is that on a sphere within a few tenths of a per cent: the ratio is 1.0."""
    lat, lon = D("c_custkey") * 37 % 1800 / F.lit(10.0) - 90, D("c_custkey") * 73 % 3600 / F.lit(10.0) - 180
    c = read(spark, d, "customer").select(D("c_custkey").alias("k"), lat.alias("lat"), lon.alias("lon"))
    ball = geo.haversine_km(D("lat"), D("lon"), F.lit(64.0), F.lit(-21.0))
    return c.filter(ball.between(1, 18000)).select("k", F.round(geo.geodesic_km(D("lat"), D("lon"), F.lit(64.0), F.lit(-21.0)) / ball, 1).alias("ratio"))


@query("""SELECT s_suppkey AS k, round(abs(2 * 6335439.327 * radians(0.5) - 111.19 * 1000) / 111190, 2) AS off FROM supplier""")
def p03_distance(spark, d):
    """One degree along a meridian at the equator: the meridian's radius of curvature times the angle."""
    s = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), (D("s_suppkey") * 3.0).alias("lon"))
    km = geo.geodesic_km(F.lit(-0.5), D("lon"), F.lit(0.5), D("lon"))
    return s.select("k", F.round(F.abs(km * 1000 - 111190) / 111190, 2).alias("off"))


@query("""SELECT k FROM (SELECT c_custkey k, 64 + (c_custkey % 100) / 100.0::DOUBLE lat FROM customer) WHERE (lat - 64.5) * (lat - 64.5) * 111.45 * 111.45 BETWEEN 100 AND 900 AND abs((lat - 64.5) * 111.45 - 10) > 0.3 AND abs((lat - 64.5) * 111.45 + 10) > 0.3 AND abs((lat - 64.5) * 111.45 - 30) > 0.3 AND abs((lat - 64.5) * 111.45 + 30) > 0.3""")
def p04_ring(spark, d):
    """A ring of 10 to 30 km, points on its edges left out, by points along a meridian."""
    c = read(spark, d, "customer").select(D("c_custkey").alias("k"), (64 + D("c_custkey") % 100 / F.lit(100.0)).alias("lat"), F.lit(-21.0).alias("lon"))
    off = (D("lat") - 64.5) * 111.45
    clear = (F.abs(F.abs(off) - 10) > 0.3) & (F.abs(F.abs(off) - 30) > 0.3)
    return c.filter(geo.within_km(D("lon"), D("lat"), -21.0, 64.5, 30.0, 10.0)).filter(clear).select("k")


@query("""SELECT k FROM (SELECT c_custkey k, (c_custkey * 7) % 3600 / 10.0::DOUBLE - 180 lon FROM customer) WHERE least(abs(lon - 179), 360 - abs(lon - 179)) * 111.32 <= 300""")
def p04_date_line(spark, d):
    """A circle over the date line, by points along the equator."""
    c = read(spark, d, "customer").select(D("c_custkey").alias("k"), (D("c_custkey") * 7 % 3600 / F.lit(10.0) - 180).alias("lon"), F.lit(0.0).alias("lat"))
    return c.filter(geo.within_km(D("lon"), D("lat"), 179.0, 0.0, 300.0)).select("k")


@query("""SELECT s_suppkey AS k, s_suppkey % 40 + 1 AS km, round(lat - (km * 1.01 / 111.19), 9) AS south, round(lat + (km * 1.01 / 111.19), 9) AS north,
round((km * 1.01 / 111.19) / cos(radians(least(89.999, abs(lat) + (km * 1.01 / 111.19)))), 9) AS half FROM (SELECT s_suppkey, 60 + s_suppkey % 10 lat, s_suppkey % 40 + 1 km FROM supplier)""")
def p06_box(spark, d):
    """The box that is sent to a service for a circle."""
    rows = []
    for r in read(spark, d, "supplier").select("s_suppkey").collect():  # a small table of regions; the box is a plan-time value
        k, lat = r[0], 60 + r[0] % 10
        w, e, s, n = geo.box_around(0.0, lat, k % 40 + 1)
        rows.append((k, k % 40 + 1, round(s, 9), round(n, 9), round((e - w) / 2, 9)))
    return spark.createDataFrame(rows, "k long, km long, south double, north double, half double")


@query("""SELECT s_suppkey AS k, 'POLYGON((' || s_suppkey || '.0 1.0, 2.0 3.0, 4.0 0.5, ' || s_suppkey || '.0 1.0))' AS wkt FROM supplier""")
def f30_wkt(spark, d):
    rows = [(r[0], geo.polygon_wkt([(float(r[0]), 1.0), (2.0, 3.0), (4.0, 0.5)])) for r in read(spark, d, "supplier").select("s_suppkey").collect()]  # a ring is a plan-time value
    return spark.createDataFrame(rows, "k long, wkt string")


_A, _F = 6378137.0, "(1 / 298.257222101::DOUBLE)"
_E2 = f"({_F} * (2 - {_F}))"
_N = f"({_A} / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)))"


@query(f"""SELECT k, round(({_N} + h) * cos(radians(lat)) * cos(radians(lon)), 4) + 0 AS x, round(({_N} + h) * cos(radians(lat)) * sin(radians(lon)), 4) + 0 AS y, round(({_N} * (1 - {_E2}) + h) * sin(radians(lat)), 4) + 0 AS z
FROM (SELECT s_suppkey k, s_acctbal h, ((s_suppkey * 37) % 1800) / 10.0::DOUBLE - 90 lat, ((s_suppkey * 73) % 3600) / 10.0::DOUBLE - 180 lon FROM supplier)""")
def f47_to_cartesian(spark, d):
    s = read(spark, d, "supplier").withColumns({"lat": D("s_suppkey") * 37 % 1800 / F.lit(10.0) - 90, "lon": D("s_suppkey") * 73 % 3600 / F.lit(10.0) - 180})
    return s.select(D("s_suppkey").alias("k"), *[(F.round(v, 4) + 0.0).alias(n) for n, v in zip("xyz", geo.llh_to_xyz(D("lat"), D("lon"), D("s_acctbal")))])


@query("""SELECT k, round(-sin(lat) * cos(lon) * a - sin(lat) * sin(lon) * b + cos(lat) * c, 6) + 0 AS n, round(-sin(lon) * a + cos(lon) * b, 6) + 0 AS e, round(cos(lat) * cos(lon) * a + cos(lat) * sin(lon) * b + sin(lat) * c, 6) + 0 AS u
FROM (SELECT s_suppkey k, radians(((s_suppkey * 37) % 1800) / 10.0 - 90) lat, radians(((s_suppkey * 73) % 3600) / 10.0 - 180) lon, s_suppkey / 10.0::DOUBLE a, 5 - s_suppkey / 20.0::DOUBLE b, s_suppkey % 7 c FROM supplier)""")
def f48_local_frame(spark, d):
    k = D("s_suppkey")
    neu = geo.xyz_to_neu(k / F.lit(10.0), 5 - k / F.lit(20.0), (k % 7).cast("double"), k * 37 % 1800 / F.lit(10.0) - 90, k * 73 % 3600 / F.lit(10.0) - 180)
    return read(spark, d, "supplier").select(k.alias("k"), *[(F.round(v, 6) + 0.0).alias(n) for n, v in zip("neu", neu)])


@query("""SELECT s_suppkey AS k, 0.0::DOUBLE AS n, round(6378137.0 * 1e-8 * cos(0) , 9) AS e, 0.0::DOUBLE AS u FROM supplier""")
def f44_plate_rate(spark, d):
    """A plate that turns about the pole moves points of the equator east."""
    lon = D("s_suppkey") * 3.0
    x, y, z = geo.llh_to_xyz(F.lit(0.0), lon, F.lit(0.0))
    neu = geo.plate_velocity_neu(x, y, z, (0.0, 0.0, 1e-8))
    return read(spark, d, "supplier").select(D("s_suppkey").alias("k"), *[(F.round(v, 9) + 0.0).alias(n) for n, v in zip("neu", neu)])


# Time axes and identifiers.


@query("""SELECT rec_id, CAST(make_date(CAST(floor(t) AS INT), 1, 1) + CAST(floor((t - floor(t)) * (CASE WHEN floor(t) % 4 = 0 THEN 366 ELSE 365 END) + 1e-9) AS INT) AS DATE) AS day FROM series_epochs""")
def f36_day_of(spark, d):
    return read(spark, d, "series_epochs").select("rec_id", timeaxis.day_of(D("t")).alias("day"))


@query("""SELECT rec_id, CAST(make_timestamp(CAST(floor(t) AS INT), 1, 1, 0, 0, 0.0) + to_seconds(CAST(round_even((t - floor(t)) * (CASE WHEN floor(t) % 4 = 0 THEN 366 ELSE 365 END) * 86400, 0) AS BIGINT)) AS TIMESTAMP) AS at FROM series_epochs""")
def f37_instant_of(spark, d):
    return read(spark, d, "series_epochs").select("rec_id", timeaxis.instant_of(D("t")).alias("at"))


@query(r"""SELECT stamp_id, CASE WHEN regexp_matches(raw_text, '^\d{2}:\d{3}:\d{5}$') AND substr(raw_text, 4, 3) <> '000' THEN
CAST(make_timestamp(CASE WHEN CAST(raw_text[1:2] AS INT) <= 50 THEN 2000 ELSE 1900 END + CAST(raw_text[1:2] AS INT), 1, 1, 0, 0, 0.0) + to_days(CAST(substr(raw_text, 4, 3) AS INT) - 1) + to_seconds(CAST(substr(raw_text, 8, 5) AS INT)) AS TIMESTAMP) END AS at
FROM raw_stamps WHERE field_name = 'ref_epoch' AND regexp_matches(raw_text, '^\d{2}:\d{3}:\d{5}$')""")
def f38_sinex_epoch(spark, d):
    return read(spark, d, "raw_stamps").filter(r"field_name = 'ref_epoch' and raw_text rlike '^[0-9]{2}:[0-9]{3}:[0-9]{5}$'").select("stamp_id", timeaxis.sinex_epoch(D("raw_text")).alias("at"))


@query("""WITH v AS (SELECT p_partkey k, 1500 + p_partkey % 800 w, 1 + (p_partkey * 7) % 366 doy FROM part), s AS (SELECT *, DATE '1980-01-06' + CAST(w * 7 AS INT) start FROM v)
SELECT k, (SELECT min(CAST(start AS DATE) + CAST(x AS INT)) FROM range(-1, 8) r(x) WHERE dayofyear(CAST(start AS DATE) + CAST(x AS INT)) = doy) AS day FROM s""")
def f39_week_and_day(spark, d):
    """The day of a GPS week with a day of the year, none where they do not meet."""
    k = D("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), timeaxis.date_of_week_and_day(1500 + k % 800, 1 + k * 7 % 366).alias("day"))


@query("SELECT event_id, CAST(round_even(epoch_us(ts) / 1e6 / 3600, 0) * 3600 AS BIGINT) AS hour FROM events")
def f40_nearest_hour(spark, d):
    return read(spark, d, "events").select("event_id", timeaxis.nearest_hour(F.unix_micros(D("ts").cast("timestamp")) / 1e6).alias("hour"))


@query("SELECT s_suppkey AS k, round(s_suppkey * 365.25 * ln(2), 6) AS days, round(s_suppkey / (365.25 * ln(2)), 9) AS tau FROM supplier")
def f53_half_life(spark, d):
    """Half-life in days of a relaxation time in years, and back."""
    k = _double("s_suppkey")
    return read(spark, d, "supplier").select(D("s_suppkey").alias("k"), F.round(timeaxis.half_life_days(k), 6).alias("days"), F.round(timeaxis.tau_years(k), 9).alias("tau"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def f56_parsed_date(spark, d):
    """Dates written either way, read again."""
    o = read(spark, d, "orders")
    written = F.when(D("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", timeaxis.parsed_date(written).alias("day"))


@query(r"""SELECT line_id, nullif(regexp_extract(lower(w), '(\d{4}/[a-z]{3}/\d{2}/\d{2}:\d{2}:\d{2}/\d{2}:\d{2}:\d{3})$', 1), '') AS key,
TRY_CAST(strptime(nullif(regexp_extract(lower(w), '/?(\d{4}/[a-z]{3}/\d{2})/', 1), ''), '%Y/%b/%d') AS DATE) AS day FROM (SELECT line_id, string_split_regex(trim(raw_line), '\s+')[11] w FROM fps_lines WHERE layout = 'fps' AND raw_line NOT LIKE '#%' AND trim(raw_line) <> '') WHERE regexp_matches(lower(w), '/?\d{4}/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/\d{2}/')""")
def f31_path_keys(spark, d):
    """Keys and days of the event paths in the raw lines."""
    lines = read(spark, d, "fps_lines").filter("layout = 'fps' and raw_line not like '#%' and trim(raw_line) <> ''")
    w = F.try_element_at(F.split(F.trim("raw_line"), r"\s+"), F.lit(11))
    rows = lines.select("line_id", w.alias("w")).filter(F.lower("w").rlike(r"/?\d{4}/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/\d{2}/"))
    return rows.select("line_id", text.path_key(D("w")).alias("key"), text.path_day(D("w")).alias("day"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 < 2 THEN 'AB' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') END AS rover, CASE WHEN p_partkey % 4 < 2 THEN 'CD' || lpad(CAST(p_partkey % 97 AS VARCHAR), 2, '0') END AS reference FROM part""")
def f51_baseline_ends(spark, d):
    k = D("p_partkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    code = F.when(k % 4 == 0, F.concat(F.lit("ab"), two(100), F.lit("-CD"), two(97))).when(k % 4 == 1, F.concat(F.lit(" AB"), two(100), F.lit("-cd"), two(97), F.lit(" "))).when(k % 4 == 2, F.lit("ABC-DEFG"))
    a, b = text.baseline_ends(code)
    return read(spark, d, "part").select(k.alias("k"), a.alias("rover"), b.alias("reference"))


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS hash FROM nation""")
def f60_content_hash(spark, d):
    return read(spark, d, "nation").select("n_nationkey", text.content_hash(D("n_nationkey"), D("n_name")).alias("hash"))


@query("""SELECT s_suppkey AS k, CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE round(CASE p WHEN 68 THEN 0.994457883209753 WHEN 90 THEN 1.644853626951473 WHEN 95 THEN 1.959963984540054 WHEN 99 THEN 2.575829303548901 END, 6) END AS divisor FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 68 WHEN 1 THEN 90 WHEN 2 THEN 95 WHEN 3 THEN 99 END p FROM supplier)""")
def f29_sigma_divisor(spark, d):
    """Confidence levels in per cent as multiples of sigma; 1 where there is none."""
    k = D("s_suppkey") % 5
    p = F.when(k == 0, 68.0).when(k == 1, 90.0).when(k == 2, 95.0).when(k == 3, 99.0)
    return read(spark, d, "supplier").select(D("s_suppkey").alias("k"), F.round(text.sigma_divisor(p), 6).alias("divisor"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN event_id ELSE round_even((event_id / 7.0::DOUBLE) * 1e9, 0) END AS BIGINT) AS ns FROM events WHERE event_id % 5 <> 0""")
def f61_time_ns(spark, d):
    """Whole numbers are nanoseconds, others seconds; missing ones are no time."""
    e = read(spark, d, "events")
    whole = F.when(D("event_id") % 3 == 0, D("event_id"))
    seconds = F.when(D("event_id") % 3 != 0, F.when(D("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(D("event_id") / F.lit(7.0)))
    out = e.select("event_id", timeaxis.time_ns(F.when(D("event_id") % 5 != 0, whole), seconds).alias("ns"))
    return out.filter("ns is not null")


@query("""SELECT rec_id, CAST(date_diff('day', DATE '0001-01-01', make_date(CAST(floor(t) AS INT), 1, 1)) + 1 AS DOUBLE) + round((t - floor(t)) * (CASE WHEN floor(t) % 4 = 0 THEN 366 ELSE 365 END), 6) AS ordinal FROM series_epochs""")
def f41_ordinal(spark, d):
    """Fractional years as day numbers from year 1."""
    y = F.floor("t")
    day, part = F.floor(timeaxis.ordinal(D("t"))), (D("t") - y) * timeaxis.year_length(y)
    return read(spark, d, "series_epochs").select("rec_id", (day - F.floor(part) + F.round(part, 6)).alias("ordinal"))


# Filters, schema, grammars.


@query("""SELECT row_id FROM skjalftalisa_quakes WHERE coalesce(quality, 0) <> 3 AND coalesce(lower(trim(event_code)), '') <> 'ne'""")
def p07_mode_filter(spark, d):
    q = read(spark, d, "skjalftalisa_quakes").withColumns({"status": F.when(D("quality") == 3, "rejected").otherwise("reviewed"), "kind": text.event_type(D("event_code"))})
    return q.filter(predicates.not_discarded("status", "kind")).select("row_id")


_GUARD = """SELECT row_id, CASE WHEN depth_km BETWEEN -5 AND 800 THEN depth_km END AS depth_km, CASE WHEN m_ml BETWEEN -3 AND 10 THEN m_ml END AS magnitude, {kind} AS magnitude_type
FROM skjalftalisa_quakes WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)"""


def _guarded(spark, d, with_type):
    q = read(spark, d, "skjalftalisa_quakes").select("row_id", "latitude", "longitude", "depth_km", D("m_ml").alias("magnitude"), F.lit("ML").alias("magnitude_type"))
    out = predicates.guarded(q, {"latitude": (-90, 90), "longitude": (-180, 180), "depth_km": (-5, 800), "magnitude": (-3, 10)}, ["latitude", "longitude"], with_type)
    return out.select("row_id", "depth_km", "magnitude", "magnitude_type")


@query(_GUARD.format(kind="'ML'"))
def p10_guard_keeps_type(spark, d):
    """The guard of one service leaves the type of a magnitude it takes away."""
    return _guarded(spark, d, None)


@query(_GUARD.format(kind="CASE WHEN m_ml BETWEEN -3 AND 10 OR m_ml IS NULL OR isnan(m_ml) THEN 'ML' END"))
def p11_guard_drops_type(spark, d):
    """That of another takes the type, too."""
    return _guarded(spark, d, {"magnitude": "magnitude_type"})


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09 12:00:00'""")
def p13_time_window(spark, d):
    from seiche.plans.catalogue import within

    return read(spark, d, "events").filter(within("ts", "2024-01-03", "2024-01-09 12:00:00")).select("event_id")


@query("""SELECT CAST(row_id AS VARCHAR) AS event_id, CAST(depth_km AS DOUBLE) AS depth_km, CASE WHEN NOT isnan(magnitude) THEN magnitude END AS magnitude, CAST(NULL AS BIGINT) AS n_phases FROM sil_events""")
def p25_coerced(spark, d):
    """A frame with some columns, numbers as text and an extra one, brought to the catalogue's schema."""
    rows = read(spark, d, "sil_events").select(D("row_id").alias("event_id"), D("depth_km").cast("string").alias("depth_km"), "magnitude", F.lit("x").alias("Depth_extra"))
    return schema.coerced(rows, schema.EVENTS).select("event_id", "depth_km", "magnitude", "n_phases")


@query("""WITH m AS (SELECT row_id, CASE WHEN strike IS NOT NULL AND NOT isnan(strike) THEN strike END s, CASE WHEN dip IS NOT NULL AND NOT isnan(dip) THEN dip END d, CASE WHEN slip IS NOT NULL AND NOT isnan(slip) THEN slip END r FROM skjalftalisa_quakes)
SELECT * FROM (SELECT 'dip1' AS "column", 'missing' AS issue, count(*) FILTER (d IS NULL) AS n FROM m UNION ALL SELECT 'dip1', 'out of range', count(*) FILTER (d NOT BETWEEN 0 AND 90) FROM m
UNION ALL SELECT 'strike1', 'missing', count(*) FILTER (s IS NULL) FROM m UNION ALL SELECT 'strike1', 'out of range', count(*) FILTER (s NOT BETWEEN 0 AND 360) FROM m
UNION ALL SELECT 'rake1', 'missing', count(*) FILTER (r IS NULL) FROM m UNION ALL SELECT 'rake1', 'out of range', count(*) FILTER (r NOT BETWEEN -180 AND 180) FROM m) WHERE n > 0""")
def p28_mechanisms_validated(spark, d):
    """Issues of fault planes by column."""
    q = read(spark, d, "skjalftalisa_quakes").select(D("strike").alias("strike1"), D("dip").alias("dip1"), D("slip").alias("rake1"))
    specs = [s for s in schema.MECHANISMS if s.name in ("strike1", "dip1", "rake1")]
    return schema.validated(schema.coerced(q, specs), specs).select("column", "issue", "n")


@query("""SELECT n_nationkey AS station FROM nation WHERE n_regionkey = 2 OR n_nationkey IN (1, 4)""")
def p18_stations(spark, d):
    """Named stations and those of an area."""
    n = read(spark, d, "nation").select(D("n_nationkey").cast("string").alias("station"))
    areas = read(spark, d, "nation").select(D("n_regionkey").cast("string").alias("area"), D("n_nationkey").cast("string").alias("station"))
    return predicates.selected_stations(n, areas, names=["1", "4"], area="2").select(D("station").cast("int").alias("station"))


@query("""SELECT * FROM (VALUES ('2024-01-05..2024-01-12', DATE '2024-01-05', DATE '2024-01-13'), ('20240105..', DATE '2024-01-05', DATE '2026-03-02'), ('after:main', DATE '2024-01-20', DATE '2026-03-02'), ('aftershock..20240301', DATE '2024-02-01', DATE '2024-03-02'), ('last 10', DATE '2026-02-20', DATE '2026-03-02')) t(spec, "from", until)""")
def f55_periods(spark, d):
    """The periods users write."""
    events, today = {"main": dt.date(2024, 1, 20), "big aftershock": dt.date(2024, 2, 1)}, dt.date(2026, 3, 1)
    rows = [(s, *grammar.resolve_period(s, today=today, events=events)) for s in ("2024-01-05..2024-01-12", "20240105..", "after:main", "aftershock..20240301")]
    rows.append(("last 10", *grammar.resolve_period(last=10, today=today)))
    return spark.createDataFrame(rows, "spec string, from date, until date")


@query("""SELECT * FROM (VALUES ('step@2020.5', 'step', 2020.5, NULL), (' EXP @ 2.02e3 , TAU = 1e-1', 'exp', 2020.0, 0.1), ('log@2018.25,tau=2', 'log', 2018.25, 2.0), ('exp@2020', 'refused', NULL, NULL), ('step@2020,tau=1', 'refused', NULL, NULL), ('log@2020,tau=0', 'refused', NULL, NULL), ('bend@2020', 'refused', NULL, NULL)) t(spec, kind, epoch, tau)""")
def x07_terms(spark, d):
    def parsed(s):
        try:
            t = grammar.parse_term(s)
        except ValueError:
            return s, "refused", None, None
        return s, t.kind, t.epoch, t.tau

    specs = ("step@2020.5", " EXP @ 2.02e3 , TAU = 1e-1", "log@2018.25,tau=2", "exp@2020", "step@2020,tau=1", "log@2020,tau=0", "bend@2020")
    return spark.createDataFrame([parsed(s) for s in specs], "spec string, kind string, epoch double, tau double")


@query("""SELECT * FROM (VALUES ('pre:rate', 'pre', 'rate', ''), ('post:annual@2019:2020.5;2021:', 'post', 'annual', '2019.0-2020.5 2021.0-'), ('x:rate@2020:2019', 'refused', NULL, NULL), ('rate', 'refused', NULL, NULL)) t(spec, name, "group", windows)""")
def x09_stages(spark, d):
    def parsed(s):
        try:
            g = grammar.parse_stage(s)
        except ValueError:
            return s, "refused", None, None
        show = lambda v: "" if v is None else str(v)
        return s, g.name, g.group, " ".join(f"{show(a)}-{show(b)}" for a, b in g.windows)

    return spark.createDataFrame([parsed(s) for s in ("pre:rate", "post:annual@2019:2020.5;2021:", "x:rate@2020:2019", "rate")], "spec string, name string, group string, windows string")


@query("""SELECT * FROM (VALUES ('post:rate=stage:pre', 'post', 'rate', 'stage', 'pre'), ('annual=donor:ABCD', NULL, 'annual', 'donor', 'ABCD'), ('rate=store:self', NULL, 'rate', 'store', 'self'), ('rate=donor:', 'refused', NULL, NULL, NULL), ('rate=ABCD', 'refused', NULL, NULL, NULL), ('=stage:x', 'refused', NULL, NULL, NULL)) t(spec, stage, "group", origin, name)""")
def x10_holds(spark, d):
    def parsed(s):
        try:
            h = grammar.parse_hold(s)
        except ValueError:
            return s, "refused", None, None, None
        return s, h.stage, h.group, h.origin, h.name

    specs = ("post:rate=stage:pre", "annual=donor:ABCD", "rate=store:self", "rate=donor:", "rate=ABCD", "=stage:x")
    return spark.createDataFrame([parsed(s) for s in specs], "spec string, stage string, group string, origin string, name string")


@query("""SELECT row_id FROM seiscomp_events WHERE coordinates[1] BETWEEN -22.5 AND -20 AND coordinates[2] BETWEEN 63.5 AND 64.5 AND NOT isnan(coordinates[1]) AND NOT isnan(coordinates[2])""")
def x11_regions(spark, d):
    """A region as users write it, as a filter."""
    e = read(spark, d, "seiscomp_events").select("row_id", F.try_element_at("coordinates", F.lit(1)).alias("longitude"), F.try_element_at("coordinates", F.lit(2)).alias("latitude"))
    return e.filter(grammar.parse_region("-22.5/-20/63.5/64.5").condition()).select("row_id")


@query("""SELECT * FROM (VALUES ('a', NULL, '1996-01-01'), ('b', '1996-01-01', '1998-01-01'), ('c', '1998-01-01', '1999-06-01')) t(source, "from", until)""")
def u02_seam_windows(spark, d):
    from seiche.plans.catalogue import seam_windows

    return spark.createDataFrame(seam_windows(["a", "b", "c", "d"], ["1996-01-01", "1998-01-01", "2000-01-01"], None, "1999-06-01"), "source string, from string, until string")
