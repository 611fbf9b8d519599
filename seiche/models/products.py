"""Station products: conversions of rates and displacements, joined stations, a-priori positions, removed steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions.geo import number


def to_displacement(records: DataFrame, years: Column, value: str = "rate", sigma: str = "rate_sigma") -> DataFrame:
    """A rate over a period as a displacement with its sigma."""
    return records.withColumns({"displacement": F.col(value) * years, "displacement_sigma": F.col(sigma) * years})


def to_velocity(records: DataFrame, years: Column, value: str = "displacement", sigma: str = "sigma") -> DataFrame:
    """A displacement over a period as a rate with its sigma; null for a period of no length."""
    return records.withColumns({"rate": F.try_divide(F.col(value), years), "rate_sigma": F.try_divide(F.col(sigma), years)})


def steps_removed(series: DataFrame, steps: DataFrame, keys: list[str], t: str, y: str, out: str) -> DataFrame:
    """Adds ``out``: y less the amplitudes of the key's steps (epoch, amplitude) at or before its epoch.

    A key has a few steps: they are one small array, summed within the row.
    """
    few = steps.groupBy(*keys).agg(F.collect_list(F.struct("epoch", "amplitude")).alias("_steps"))
    total = F.aggregate(F.filter("_steps", lambda s: s["epoch"] <= F.col(t)), F.lit(0.0), lambda a, s: a + s["amplitude"])
    return series.join(few, keys, "left").withColumn(out, F.col(y) - F.coalesce(total, F.lit(0.0))).drop("_steps")


def anchored_offset(y: str, model: Column, sigma: str) -> Column:
    """Σw(y − model)/Σw with w = 1/σ², as an aggregate."""
    w = F.when((number(sigma) > 0) & number(y).isNotNull(), F.pow(F.col(sigma), -2))
    return F.sum(w * (F.col(y) - model)) / F.sum(w)


def window_shift(a: DataFrame, b: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """keys, shift (median of b − a over equal epochs) and n."""
    both = a.select(*keys, t, F.col(y).alias("_a")).join(b.select(*keys, t, F.col(y).alias("_b")), [*keys, t])
    d = number(F.col("_b") - F.col("_a"))
    return both.groupBy(*keys).agg(F.median(d).alias("shift"), F.count(d).alias("n"))


def joined_station(series: DataFrame, members: list[str], *, station: str, t: str, y: str, n: int) -> DataFrame:
    """Marks of a moved station as one series in the given order.

    A later mark is moved by the mean of the last n values of the one before less the mean of its
    own first n; the moves add up.
    """
    rows = series.filter(F.col(station).isin(members) & number(y).isNotNull())
    w = W.partitionBy(station)
    rows = rows.withColumns({"_f": F.row_number().over(w.orderBy(t)), "_l": F.row_number().over(w.orderBy(F.col(t).desc()))})
    place = F.array_position(F.array(*[F.lit(m) for m in members]), F.col(station))
    ends = rows.groupBy(station).agg(F.avg(F.when(F.col("_f") <= n, F.col(y))).alias("_first"), F.avg(F.when(F.col("_l") <= n, F.col(y))).alias("_last")).withColumn("_place", place)
    order = W.orderBy("_place")  # one row a member
    moves = ends.withColumn("_move", F.lag("_last").over(order) - F.col("_first"))
    moves = moves.select(station, F.coalesce(F.sum("_move").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)).alias("_move"), "_place")
    return rows.join(moves, station).withColumn(y, F.col(y) + F.col("_move")).orderBy("_place", t).drop("_f", "_l", "_move", "_place")


def apriori_at(x0: Column, v: Column, epoch: Column, t: Column) -> Column:
    """Position at t from one at an epoch and a velocity, in Julian years."""
    return x0 + v * (t - epoch)


def transient_value(kind: str, amplitude: Column, start: Column, tau_days: Column, t: Column) -> Column:
    """Amplitude × (1 − e^(−d/τ)) or ln(1 + d/τ) after the start, d in days; 0 before."""
    d = F.greatest((t - start) * 365.25, F.lit(0.0))
    return amplitude * ((1 - F.exp(-d / tau_days)) if kind == "EXP" else F.log1p(d / tau_days))


def day_mean_position(rows: DataFrame, keys: list[str], day: str, components: tuple[str, ...]) -> DataFrame:
    """Mean of each component per day over the rows that have all of them."""
    ok = rows
    for c in components:
        ok = ok.filter(number(c).isNotNull())
    return ok.groupBy(*keys, day).agg(*[F.avg(c).alias(c) for c in components], F.count("*").alias("n"))


def gls_means(rows: DataFrame, keys: list[str], values: tuple[str, str, str], covariance: str) -> DataFrame:
    """Generalised mean of 3-vectors with 3×3 covariances (nine numbers a row): mean and covariance.

    Σ C⁻¹ and Σ C⁻¹ x are summed by Spark; the inverses come from the adjugate as column math, so
    that no group is gathered.
    """
    c = [F.col(covariance)[k] for k in range(9)]
    cof = [c[4] * c[8] - c[5] * c[7], c[2] * c[7] - c[1] * c[8], c[1] * c[5] - c[2] * c[4], c[5] * c[6] - c[3] * c[8], c[0] * c[8] - c[2] * c[6], c[2] * c[3] - c[0] * c[5], c[3] * c[7] - c[4] * c[6], c[1] * c[6] - c[0] * c[7], c[0] * c[4] - c[1] * c[3]]
    rows = rows.withColumn("_det", c[0] * cof[0] + c[1] * cof[3] + c[2] * cof[6]).filter("_det > 0")
    inv = [x / F.col("_det") for x in cof]
    x = [F.col(v) for v in values]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(i) for i in inv]).alias("p"), F.array(*[F.sum(inv[3 * r] * x[0] + inv[3 * r + 1] * x[1] + inv[3 * r + 2] * x[2]) for r in range(3)]).alias("b"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)

    def run(batches):
        for pdf in batches:
            cov = [np.linalg.inv(np.asarray(p).reshape(3, 3)) for p in pdf.p]
            yield pd.DataFrame({k: pdf[k] for k in keys} | {"n": pdf.n, "mean": [(m @ np.asarray(b)).tolist() for m, b in zip(cov, pdf.b)], "covariance": [m.ravel().tolist() for m in cov]})

    return sums.mapInPandas(run, f"{key_schema}, n long, mean array<double>, covariance array<double>")


def frame_parameters(rows: DataFrame) -> DataFrame:
    """Helmert translation, rotation and scale of each day from its stations' residuals.

    ``rows``: day, x, y, z (metres), dx, dy, dz. The normal equations are sums per day, so a day
    may have any number of stations; seven parameters a day are solved.
    """
    radius = 6_371_000.0
    x, y, z = (F.col(k) / radius for k in "xyz")
    design = {"dx": [1, 0, 0, F.lit(0.0), z, -y, x], "dy": [0, 1, 0, -z, F.lit(0.0), x, y], "dz": [0, 0, 1, y, -x, F.lit(0.0), z]}
    design = {k: [F.lit(float(v)) if isinstance(v, int) else v for v in row] for k, row in design.items()}
    products = [sum((design[c][i] * design[c][j] for c in design), F.lit(0.0)) for i in range(7) for j in range(i, 7)]
    right = [sum((design[c][i] * F.col(c) for c in design), F.lit(0.0)) for i in range(7)]
    sums = rows.groupBy("day").agg(F.count("*").alias("n"), F.array(*[F.sum(p) for p in products]).alias("m"), F.array(*[F.sum(r) for r in right]).alias("b"))

    def run(batches):
        for pdf in batches:
            out = []
            for m, b in zip(pdf.m, pdf.b):
                a = np.zeros((7, 7))
                a[np.triu_indices(7)] = m
                a = a + np.triu(a, 1).T
                out.append(np.linalg.lstsq(a, np.asarray(b), rcond=1e-10)[0])
            p = np.array(out).reshape(-1, 7)
            mas = math.degrees(1 / radius) * 3.6e6
            yield pd.DataFrame({"day": pdf.day, "n": pdf.n} | {f"t{c}": p[:, k] for k, c in enumerate("xyz")} | {f"r{c}_mas": p[:, 3 + k] * mas for k, c in enumerate("xyz")} | {"scale_ppb": p[:, 6] / radius * 1e9})

    return sums.mapInPandas(run, f"day {rows.schema['day'].dataType.simpleString()}, n long, tx double, ty double, tz double, rx_mas double, ry_mas double, rz_mas double, scale_ppb double")
