"""Fault planes as column expressions: strike, dip and rake in degrees (Aki and Richards)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(degrees: Column) -> Column:
    """An angle in (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - degrees, F.lit(360.0))


def normalised_plane(strike: Column, dip: Column, rake: Column) -> Column:
    """Strike in [0, 360), rake in (-180, 180]."""
    return F.struct((F.pmod(strike, F.lit(360.0)) + 0.0).alias("strike"), dip.alias("dip"), wrapped(rake).alias("rake"))


def from_dip_to_180(strike: Column, dip: Column, rake: Column) -> Column:
    """A plane whose dip may reach 180 degrees in the usual convention; null outside [0, 180]."""
    steep = dip >= 90
    s = F.when(steep, strike).otherwise(strike + 180)
    d = F.when(steep, 180 - dip).otherwise(dip)
    r = F.when(steep, 180 - rake).otherwise(rake + 180)
    return F.when(dip.between(0, 180), normalised_plane(s, d, r))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``, however often it is used."""
    return F.transform(F.array(value), body)[0]


def slip_and_normal(strike: Column, dip: Column, rake: Column) -> tuple[list[Column], list[Column]]:
    """(slip, normal) as north, east, down."""
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    slip = [F.cos(r) * F.cos(s) + F.sin(r) * F.cos(d) * F.sin(s), F.cos(r) * F.sin(s) - F.sin(r) * F.cos(d) * F.cos(s), -F.sin(r) * F.sin(d)]
    normal = [-F.sin(d) * F.sin(s), F.sin(d) * F.cos(s), -F.cos(d)]
    return slip, normal


def _vectors(strike: Column, dip: Column, rake: Column, prefix: str = "") -> list[Column]:
    """The slip and normal as the fields u0 … n2 of a struct."""
    u, n = slip_and_normal(strike, dip, rake)
    return [c.alias(f"{prefix}{name}{k}") for name, v in (("u", u), ("n", n)) for k, c in enumerate(v)]


def auxiliary_plane(strike: Column, dip: Column, rake: Column) -> Column:
    """The other nodal plane: its normal is the slip of the first, its slip the normal."""

    def other(v: Column) -> Column:
        up = F.when(v["u2"] > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        u, n = [v[f"u{k}"] * up for k in range(3)], [v[f"n{k}"] * up for k in range(3)]
        d = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -u[2])))
        s = F.atan2(-u[0], u[1])
        r = F.atan2(-n[2] / F.greatest(F.sin(d), F.lit(1e-12)), n[0] * F.cos(s) + n[1] * F.sin(s))
        return normalised_plane(F.degrees(s), F.degrees(d), F.degrees(r))

    given = F.struct(strike.alias("s"), dip.alias("d"), rake.alias("r"))
    return let(given, lambda p: let(F.struct(*_vectors(p["s"], p["d"], p["r"])), other))


def plane_angle(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The larger of the angles between the normals and between the slips of two planes, in degrees."""
    given = F.struct(*[c.alias(f"{p}{k}") for p, plane in (("a", a), ("b", b)) for k, c in enumerate(plane)])
    both = lambda g: F.struct(*_vectors(g["a0"], g["a1"], g["a2"], "a"), *_vectors(g["b0"], g["b1"], g["b2"], "b"))
    dot = lambda v, name: sum((v[f"a{name}{k}"] * v[f"b{name}{k}"] for k in (1, 2)), v[f"a{name}0"] * v[f"b{name}0"])
    angle = lambda c: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
    smaller = lambda q: F.least(F.greatest(angle(q["n"]), angle(q["u"])), F.greatest(angle(-q["n"]), angle(-q["u"])))
    return let(given, lambda g: let(both(g), lambda v: let(F.struct(dot(v, "n").alias("n"), dot(v, "u").alias("u")), smaller)))


def same_plane(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Angle between plane a and the auxiliary of plane b."""
    return let(auxiliary_plane(*b), lambda o: plane_angle(a, (o["strike"], o["dip"], o["rake"])))


def inconsistent(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], tolerance_deg: float) -> Column:
    """Whether two planes are no pair of nodal planes; null without a second plane."""
    return F.when(b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull(), same_plane(a, b) > tolerance_deg)


def axes(strike: Column, dip: Column, rake: Column) -> dict[str, tuple[Column, Column]]:
    """(azimuth, plunge) of the P, B and T axes on the lower hemisphere."""
    u, n = slip_and_normal(strike, dip, rake)
    cross = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    vectors = {"p": [n[k] - u[k] for k in range(3)], "b": cross, "t": [n[k] + u[k] for k in range(3)]}

    def direction(v: list[Column]) -> tuple[Column, Column]:
        down = F.when(v[2] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        x, y, z = (c * down for c in v)
        azimuth, plunge = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.atan2(z, F.hypot(x, y)))
        # A horizontal axis has two ends: the one in [0, 180) names it. A vertical one points nowhere.
        half = F.when((plunge < 1e-7) & (azimuth >= 180 - 1e-9), F.greatest(azimuth - 180, F.lit(0.0))).otherwise(azimuth)
        return F.when((plunge > 90 - 1e-6) | (half >= 360 - 1e-9), F.lit(0.0)).otherwise(half), plunge

    return {k: direction(v) for k, v in vectors.items()}


# Plunges of the P, B and T axes from (inclusive), to (exclusive) and up to (inclusive) of the regimes of the world stress map.
REGIMES = (
    ("normal", {"p": (52, None, None), "t": (None, None, 35)}),
    ("normal-oblique", {"p": (40, 52, None), "t": (None, None, 20)}),
    ("strike-slip", {"p": (None, 40, None), "b": (45, None, None), "t": (None, None, 20)}),
    ("strike-slip", {"p": (None, None, 20), "b": (45, None, None), "t": (None, 40, None)}),
    ("reverse-oblique", {"p": (None, None, 20), "t": (40, 52, None)}),
    ("reverse", {"p": (None, None, 35), "t": (52, None, None)}),
)


def faulting_class(p: Column, b: Column, t: Column, rule: str = "frohlich") -> Column:
    """The class by the plunges of the axes, null without all three.

    ``frohlich``: B above 60 degrees is strike-slip, P above 60 normal, T above 50 reverse, else
    odd. ``wsm``: the first of the REGIMES whose bounds hold, else odd.
    """
    known = p.isNotNull() & b.isNotNull() & t.isNotNull()
    if rule == "frohlich":
        return F.when(b > 60, "strike-slip").when(p > 60, "normal").when(t > 50, "reverse").when(known, "odd")
    if rule != "wsm":
        raise ValueError(f"no rule {rule!r}")
    axis, out = {"p": p, "b": b, "t": t}, None
    for name, bounds in REGIMES:
        holds = F.lit(True)
        for k, (least, below, most) in bounds.items():
            for value, test in ((least, axis[k].__ge__), (below, axis[k].__lt__), (most, axis[k].__le__)):
                holds = holds & test(F.lit(value)) if value is not None else holds
        out = F.when(known & holds, name) if out is None else out.when(known & holds, name)
    return out.when(known, "odd")


def faulting_label(text: Column) -> Column:
    """The class named in free text such as "normal faulting dominates"; null if none is."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"( faulting)? dominates$", "")
    return F.when(plain.isin("normal", "reverse", "strike-slip", "dip-slip", "odd"), plain).when(plain.isin("strike slip", "strikeslip"), "strike-slip").when(plain.isin("thrust", "inverse"), "reverse")
