"""Seismic moment, magnitudes and ground velocity as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The constant of the moment magnitude and of its older form.
MW_CONSTANT, MW_CONSTANT_OLD = 6.0333, 6.03
# Knots, slopes and intercept of the piecewise relation of Mlw and log10 of the moment.
MLW_KNOTS = (2.0, 3.0, 4.6, 5.4)
MLW_SLOPES = (1.0, 1 / 0.9, 1 / 0.8, 1 / 0.7, 1 / 0.5)
MLW_INTERCEPT = 10.0


@dataclass(frozen=True)
class GroundVelocity:
    """log10(pgv) = a log10(r + c 10^(g M)) + b M + d, in m/s and km."""

    # Published coefficients.
    a: float = -1.69
    c: float = 0.00299
    g: float = 0.621
    b: float = 1.05
    d: float = -4.96


@dataclass(frozen=True)
class Relation:
    """log10(moment) = intercept + slope M for one magnitude type, from ``least`` on."""

    name: str
    magnitude_type: str
    intercept: float
    slope: float
    least: float | None = None


# Relations of magnitudes that no moment is measured for.
RELATIONS = (Relation("seiscomp_ml_sil_m0", "ML_SIL", 10.41, 1.045), Relation("seiscomp_mpgv_w_m0", "Mpgv_w", 8.95, 1.347, 3.0))


def mw_from_moment(m0: Column, constant: float = MW_CONSTANT) -> Column:
    return F.when((m0 > 0) & ~F.isnan(m0), F.lit(2.0 / 3.0) * F.log10(m0) - constant)


def moment_from_mw(mw: Column, constant: float = MW_CONSTANT) -> Column:
    return F.pow(F.lit(10.0), (mw + constant) * 1.5)


def log_moment_from_mlw(mlw: Column) -> Column:
    """On the segment of the line that holds the magnitude, from its start and slope."""
    out = F.lit(None).cast("double")
    for low, value, slope in _segments():
        at = slope * mlw + (value - slope * low)
        out = F.when(mlw > low, at).otherwise(out) if low > float("-inf") else F.lit(MLW_SLOPES[0]) * mlw + MLW_INTERCEPT
    return out


def _segments() -> list[tuple[float, float, float]]:
    """(lower magnitude, log10 of the moment there, slope) of each segment; the first is open below."""
    out, value = [(float("-inf"), float("nan"), MLW_SLOPES[0])], MLW_SLOPES[0] * MLW_KNOTS[0] + MLW_INTERCEPT
    for k, knot in enumerate(MLW_KNOTS):
        out.append((knot, value, MLW_SLOPES[k + 1]))
        if k + 1 < len(MLW_KNOTS):
            value += MLW_SLOPES[k + 1] * (MLW_KNOTS[k + 1] - knot)
    return out


def moment_from_mlw(mlw: Column) -> Column:
    return F.when(~F.isnan(mlw), F.pow(F.lit(10.0), log_moment_from_mlw(mlw)))


def mlw_from_moment(m0: Column) -> Column:
    """The inverse: on each segment of the line the magnitude that gives the moment."""
    log_m = F.log10(m0)
    out = (log_m - MLW_INTERCEPT) / MLW_SLOPES[0]
    for low, value, slope in _segments()[1:]:
        out = F.when(log_m > value, (log_m - value) / slope + low).otherwise(out)
    return F.when((m0 > 0) & ~F.isnan(m0), out)


def moment_estimate(measured: Column, mlw: Column, magnitude: Column, magnitude_type: Column, relations: tuple[Relation, ...] = RELATIONS) -> tuple[Column, Column]:
    """(moment, relation): the measured moment, else that of Mlw, else of the type's linear relation."""
    value, label = F.when(measured.isNotNull(), measured), F.when(measured.isNotNull(), F.lit("measured"))
    value, label = value.when(mlw.isNotNull(), moment_from_mlw(mlw)), label.when(mlw.isNotNull(), F.lit("mlw"))
    for r in relations:
        fits = (magnitude_type == r.magnitude_type) & magnitude.isNotNull()
        if r.least is not None:
            fits = fits & (magnitude >= r.least)
        value, label = value.when(fits, F.pow(F.lit(10.0), r.intercept + r.slope * magnitude)), label.when(fits, F.lit(r.name))
    return value, label


def ground_velocity(m: Column, r_km: Column, model: GroundVelocity = GroundVelocity()) -> Column:
    """Peak ground velocity in m/s; null for a negative distance."""
    near = r_km + model.c * F.pow(F.lit(10.0), model.g * m)
    return F.when(r_km >= 0, F.pow(F.lit(10.0), model.a * F.log10(near) + model.b * m + model.d))


def magnitude_far(pgv_um: Column, r_km: Column, model: GroundVelocity = GroundVelocity()) -> Column:
    """The magnitude from velocity in µm/s, the near-field term left out."""
    return F.when((pgv_um > 0) & (r_km > 0), (-model.a * F.log10(r_km) + F.log10(pgv_um * 1e-6) - model.d) / model.b)


def magnitude_exact(pgv_um: Column, r_km: Column, model: GroundVelocity = GroundVelocity(), low: float = -3.0, high: float = 10.0, halvings: int = 64) -> Column:
    """The magnitude whose velocity at the distance is the given one, by bisection; null outside [low, high]."""

    def short(m: Column) -> Column:
        return model.a * F.log10(r_km + model.c * F.pow(F.lit(10.0), model.g * m)) + model.b * m + model.d - F.log10(pgv_um * 1e-6)

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = short(mid) < 0
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((pgv_um > 0) & (r_km > 0) & (short(F.lit(low)) <= 0) & (short(F.lit(high)) >= 0), root)


def near_field_bias(r_km: Column, m: Column, model: GroundVelocity = GroundVelocity()) -> Column:
    """How far the far-field magnitude falls short."""
    near = r_km + model.c * F.pow(F.lit(10.0), model.g * m)
    return F.when(r_km > 0, (-model.a / model.b) * (F.log10(near) - F.log10(r_km)))


def distance_term_change(r_km: Column, m: Column, model: GroundVelocity = GroundVelocity()) -> Column:
    """Relative change of the distance term by the near-field term."""
    near = r_km + model.c * F.pow(F.lit(10.0), model.g * m)
    return F.when(r_km > 0, F.try_divide(F.log10(near) - F.log10(r_km), F.log10(r_km)))


def near_field_limit(m: Column, table: list[tuple[float, float]]) -> Column:
    """Kilometres of the first row (upper magnitude, km) above m; the first for null, the last above all."""
    out = F.when(m.isNull() | F.isnan(m), F.lit(table[0][1]))
    for upper, km in table:
        out = out.when(m < upper, F.lit(km))
    return out.otherwise(F.lit(table[-1][1]))


def with_derived_moment(df: DataFrame, magnitude_types: list[str], moment: str = "moment_nm", magnitude: str = "magnitude", kind: str = "magnitude_type") -> DataFrame:
    """Missing moments from the magnitudes of the given types by the relation of Mlw, and ``moment_derived``.

    Moments that are there stay. Types whose relation is another raise.
    """
    if odd := sorted(set(magnitude_types) & {"ML_SIL", "M"}):
        raise ValueError(f"no moment follows from {odd}")
    fill = F.col(moment).isNull() & F.col(kind).isin(magnitude_types) & F.col(magnitude).isNotNull()
    fill = F.coalesce(fill, F.lit(False))
    return df.withColumns({moment: F.when(fill, moment_from_mlw(F.col(magnitude))).otherwise(F.col(moment)), "moment_derived": fill})
