"""Geometry as column expressions: distances, boxes, polygons, ellipsoid conversions, rotations.

NaN and null coordinates give null distances and are inside nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80.
SEMI_MAJOR_M = 6_378_137.0
FLATTENING = 1 / 298.257222101
KM_PER_DEGREE = 111.19


def number(c: Column | str) -> Column:
    """The value with NaN as null: Spark sorts NaN above every number, so a bound would let it pass."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def equirectangular_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance with the longitude scaled at the middle latitude; no wrap at the date line (see ``lon_difference``)."""
    dy = (lat_b - lat_a) * KM_PER_DEGREE
    dx = (lon_b - lon_a) * KM_PER_DEGREE * F.cos(F.radians((lat_a + lat_b) / 2))
    return F.hypot(dx, dy)


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = 6371.0) -> Column:
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geodesic_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, rounds: int = 12) -> Column:
    """Distance on the GRS80 ellipsoid by Vincenty's inverse formula, folded a fixed number of times.

    It does not converge for nearly antipodal points; coincident points give 0.
    """
    f, a = FLATTENING, SEMI_MAJOR_M
    b = a * (1 - f)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat_a))), F.atan((1 - f) * F.tan(F.radians(lat_b)))
    given = F.struct(F.radians(lon_b - lon_a).alias("l"), F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"))

    def angles(g: Column, lam: Column) -> Column:
        x, y = g["cu2"] * F.sin(lam), g["cu1"] * g["su2"] - g["su1"] * g["cu2"] * F.cos(lam)
        return F.struct(F.hypot(x, y).alias("ss"), (g["su1"] * g["su2"] + g["cu1"] * g["cu2"] * F.cos(lam)).alias("cs"), F.sin(lam).alias("sl"))

    def parts(g: Column, t: Column) -> Column:
        sa = F.when(t["ss"] > 0, g["cu1"] * g["cu2"] * t["sl"] / t["ss"]).otherwise(0.0)
        ca = 1 - sa * sa
        return F.struct(t["ss"].alias("ss"), t["cs"].alias("cs"), F.atan2(t["ss"], t["cs"]).alias("s"), sa.alias("sa"), ca.alias("ca"), F.when(ca > 0, t["cs"] - 2 * g["su1"] * g["su2"] / ca).otherwise(0.0).alias("cm"))

    def let(value: Column, body) -> Column:
        """``body`` over one evaluation of ``value``."""
        return F.transform(F.array(value), body)[0]

    def step(g: Column, lam: Column) -> Column:
        def out(p: Column) -> Column:
            c = f / 16 * p["ca"] * (4 + f * (4 - 3 * p["ca"]))
            return g["l"] + (1 - c) * f * p["sa"] * (p["s"] + c * p["ss"] * (p["cm"] + c * p["cs"] * (2 * p["cm"] * p["cm"] - 1)))

        return let(angles(g, lam), lambda t: let(parts(g, t), out))

    def length(g: Column, lam: Column) -> Column:
        def out(p: Column) -> Column:
            u = p["ca"] * ((a * a - b * b) / (b * b))
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            c2 = p["cm"] * p["cm"]
            ds = small * p["ss"] * (p["cm"] + small / 4 * (p["cs"] * (2 * c2 - 1) - small / 6 * p["cm"] * (4 * p["ss"] * p["ss"] - 3) * (4 * c2 - 3)))
            return b * big * (p["s"] - ds) / 1000

        return let(angles(g, lam), lambda t: let(parts(g, t), out))

    folded = lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), g["l"], lambda lam, _: step(g, lam), lambda lam: length(g, lam))
    usable = lat_a.isNotNull() & lon_a.isNotNull() & lat_b.isNotNull() & lon_b.isNotNull()
    return F.when(usable, let(given, folded))


def lon_difference(lon_a: Column, lon_b: Column) -> Column:
    """The shorter way from a to b, in [-180, 180)."""
    return F.pmod(lon_b - lon_a + 180, F.lit(360.0)) - 180


def in_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Inclusive on all sides; null and NaN are outside."""
    return F.coalesce(number(lon).between(west, east) & number(lat).between(south, north), F.lit(False))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]], edge: float = 1e-9) -> Column:
    """Even-odd rule with half-open crossings; points within ``edge`` of an edge are inside.

    A closing vertex equal to the first is dropped; fewer than three vertices raise.
    """
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if len(ring) < 3:
        raise ValueError("a polygon has at least three vertices")
    crossed, on_edge = F.lit(False), F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if y0 != y1:
            at = (y - y0) * ((x1 - x0) / (y1 - y0)) + x0
            crossed = crossed != (((y < y0) != (y < y1)) & (x < at))
        length = (x1 - x0) ** 2 + (y1 - y0) ** 2
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length)) if length else F.lit(0.0)
        on_edge = on_edge | (F.hypot(x - (x0 + along * (x1 - x0)), y - (y0 + along * (y1 - y0))) <= edge)
    return F.coalesce(number(x).isNotNull() & number(y).isNotNull() & (crossed | on_edge), F.lit(False))


def box_around(lon: float, lat: float, km: float, margin: float = 0.01) -> tuple[float, float, float, float]:
    """West, east, south, north of a box that holds the circle, to push down before the exact test."""
    import math

    half = km * (1 + margin) / KM_PER_DEGREE
    widest = min(89.999, abs(lat) + half)
    wide = half / math.cos(math.radians(widest))
    return lon - wide, lon + wide, lat - half, lat + half


def within_km(lon: Column, lat: Column, at_lon: float, at_lat: float, km: float, least_km: float = 0.0) -> Column:
    """Inclusive ring around a point: a box that reaches the scan, then the ellipsoidal distance.

    A circle over the date line has a box on either side of it, one over a pole all longitudes.
    """
    d = geodesic_km(number(lat), number(lon), F.lit(at_lat), F.lit(at_lon))
    west, east, south, north = box_around(at_lon, at_lat, km)
    if south < -90 or north > 90 or east - west >= 360:
        boxes = in_box(lon, lat, -360.0, 360.0, south, north)
    else:
        boxes = in_box(lon, lat, west, east, south, north)
        if west < -180:
            boxes = boxes | in_box(lon, lat, west + 360, 360.0, south, north)
        if east > 180:
            boxes = boxes | in_box(lon, lat, -360.0, east - 360, south, north)
    return boxes & (d <= km) & (d >= least_km)


def llh_to_xyz(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    e2 = FLATTENING * (2 - FLATTENING)
    n = SEMI_MAJOR_M / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    flat = (n + h) * F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), (n * (1 - e2) + h) * F.sin(F.radians(lat))


def xyz_to_llh(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres by Bowring's closed form (well under a millimetre near the surface)."""
    a, b = SEMI_MAJOR_M, SEMI_MAJOR_M * (1 - FLATTENING)
    e2, second = FLATTENING * (2 - FLATTENING), (a * a - b * b) / (b * b)
    p = F.hypot(x, y)
    theta = F.atan2(z * a, p * b)
    lat = F.atan2(z + second * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p * F.cos(lat) + z * F.sin(lat) - a * a / n


def xyz_to_neu(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A difference of positions in the local frame (north, east, up) at a latitude and longitude."""
    sp, cp, sl, cl = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return -sp * cl * dx - sp * sl * dy + cp * dz, -sl * dx + cl * dy, cp * cl * dx + cp * sl * dy + sp * dz


def plate_velocity_neu(x: Column, y: Column, z: Column, pole_xyz_rad: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Velocity (m a year) of a position on a plate with the given rotation vector (radians a year)."""
    wx, wy, wz = pole_xyz_rad
    lat, lon, _ = xyz_to_llh(x, y, z)
    return xyz_to_neu(z * wy - y * wz, x * wz - z * wx, y * wx - x * wy, lat, lon)


def horizontal_error_km(dlat: Column, dlon: Column, lat: Column) -> Column:
    """The larger of the two coordinate errors in km; a missing one is skipped."""
    return F.greatest(number(dlat) * KM_PER_DEGREE, number(dlon) * KM_PER_DEGREE * F.cos(F.radians(lat)))


def polygon_wkt(ring: list[tuple[float, float]]) -> str:
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    if len(closed) < 4:
        raise ValueError("a polygon has at least three vertices")
    return "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in closed) + "))"


def baseline_neu(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], at: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Position a less position b in the local frame (north, east, up) of a third one."""
    lat, lon, _ = xyz_to_llh(*at)
    return xyz_to_neu(*(x - y for x, y in zip(a, b)), lat, lon)


def signed_root_correlation(root: Column, sigma_a: Column, sigma_b: Column) -> Column:
    """The correlation from a covariance given as its signed root, within ±1; null without both sigmas."""
    rho = F.signum(root) * root * root / F.nullif(sigma_a * sigma_b, F.lit(0.0))
    return F.when(rho.isNotNull() & ~F.isnan(rho), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))
