"""Trajectory models of series: line, seasons, steps and decays, by weighted least squares.

A model that is linear in its parameters needs only the sums of products of its columns. They are
made by Spark's aggregates, combined in the map tasks, so that a series of any length comes to one
small matrix; only these are solved with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seiche.functions.geo import number
from seiche.plans.grammar import Term


def terms(t: Column, *, seasons: tuple[float, ...] = (1.0, 0.5), origin: float = 2020.0, extra: tuple[Term, ...] = ()) -> dict[str, Column]:
    """The columns of the model by parameter name."""
    out = {"offset": F.lit(1.0), "rate": t - origin}
    for period in seasons:
        label = {1.0: "annual", 0.5: "semiannual"}.get(period, f"p{period:g}")
        out[f"{label}_cos"], out[f"{label}_sin"] = F.cos(t * (2 * math.pi / period)), F.sin(t * (2 * math.pi / period))
    for k, term in enumerate(extra):
        after = F.greatest(t - term.epoch, F.lit(0.0))
        value = {"step": (t >= term.epoch).cast("double"), "rate": after, "exp": 1 - F.exp(-after / (term.tau or 1.0)), "log": F.log1p(after / (term.tau or 1.0))}[term.kind]
        out[f"{term.kind}{k}"] = value
    return out


def normal_sums(df: DataFrame, keys: list[str], columns: dict[str, Column], y: str, sigma: str | None) -> DataFrame:
    """keys, n and ``m``: the upper triangle of the weighted products of the columns and y, row by row."""
    usable = number(y).isNotNull() & (F.abs(y) != float("inf"))
    w = F.lit(1.0)
    if sigma:
        usable = usable & (number(sigma) > 0) & (F.col(sigma) != float("inf"))
        w = F.pow(F.col(sigma), -2)
    rows = df.filter(usable).select(*keys, w.alias("_w"), *[c.alias(f"_x{k}") for k, c in enumerate([*columns.values(), F.col(y)])])
    size = len(columns) + 1
    products = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(size) for j in range(i, size)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*products).alias("m"))


def solve(flat: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(parameters, sigmas scaled by χ²/ν, χ²) of a flat upper triangle with y last."""
    m = np.zeros((size + 1, size + 1))
    m[np.triu_indices(size + 1)] = flat
    m = m + np.triu(m, 1).T
    scale = np.sqrt(np.maximum(np.diag(m)[:size], 1e-300))
    a, b = m[:size, :size] / np.outer(scale, scale), m[:size, size] / scale
    inverse = np.linalg.pinv(a, hermitian=True)
    p = inverse @ b
    chi2 = max(float(m[size, size] - b @ p), 0.0)
    return p / scale, np.sqrt(np.maximum(np.diag(inverse), 0) * chi2 / max(n - size, 1)) / scale, chi2


def fitted(df: DataFrame, keys: list[str], t: str, y: str, sigma: str | None = None, *, least: int = 20, **model: object) -> DataFrame:
    """keys, n, rms weighted by sigma, and <name>, <name>_sigma for each parameter.

    Series with fewer than ``least`` usable epochs are left out.
    """
    columns = terms(F.col(t), **model)
    names, size = list(columns), len(columns)
    sums = normal_sums(df, keys, columns, y, sigma).filter(F.col("n") >= least)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys], "n long", "chi2 double", *[f"{c} double, {c}_sigma double" for c in names]])

    def run(batches):
        for pdf in batches:
            out = {k: pdf[k] for k in keys} | {"n": pdf["n"]}
            solved = [solve(np.asarray(m), size, n) for m, n in zip(pdf["m"], pdf["n"])]
            out["chi2"] = [s[2] for s in solved]
            for k, c in enumerate(names):
                out[c], out[f"{c}_sigma"] = [s[0][k] for s in solved], [s[1][k] for s in solved]
            yield pd.DataFrame(out)

    return sums.mapInPandas(run, schema)


def detrended(df: DataFrame, parameters: DataFrame, keys: list[str], t: str, y: str, *, out: str, without: tuple[str, ...] = ("offset",), **model: object) -> DataFrame:
    """Adds ``out``: y less the model's terms but those ``without``; y itself where a series has no parameters."""
    columns = {k: c for k, c in terms(F.col(t), **model).items() if k not in without}
    p = parameters.select(*keys, *[F.col(k).alias(f"_p_{k}") for k in columns])
    total = sum((c * F.col(f"_p_{k}") for k, c in columns.items()), F.lit(0.0))
    return df.join(p, keys, "left").withColumn(out, F.coalesce(F.col(y) - total, F.col(y))).drop(*[f"_p_{k}" for k in columns])


def shared_decay(df: DataFrame, keys: list[str], t: str, y: str, sigma: str, *, onset: float, taus: list[float]) -> DataFrame:
    """tau, chi2, n_series, best: the misfit of all series after ``onset`` for each relaxation time.

    Every tau is tried on every series in one scan and one aggregation; the smallest total misfit is the
    shared one.
    """
    from pyspark.sql import Window as W

    from seiche.models.records import _solved

    x = F.col(t) - onset
    rows = df.filter(F.col(t) >= onset).withColumn("_tau", F.explode(F.array(*[F.lit(float(v)) for v in taus])))
    columns = {"offset": F.lit(1.0), "rate": x, "amplitude": 1 - F.exp(-x / F.col("_tau"))}
    misfit = _solved(normal_sums(rows, [*keys, "_tau"], columns, y, sigma), [*keys, "_tau"], 20)
    total = misfit.groupBy(F.col("_tau").alias("tau")).agg(F.sum("chi2").alias("chi2"), F.count("*").alias("n_series"))
    # One row a tau.
    return total.withColumn("best", F.row_number().over(W.orderBy("chi2", "tau")) == 1).select("tau", "chi2", "n_series", "best")


def fitted_function(df: DataFrame, keys: list[str], x: str, y: str, f, start: tuple[float, ...], rounds: int = 100) -> DataFrame:
    """keys, p0, p1, ..., n of a user's model f(x, *p) fitted to each group by damped least squares.

    A model that is not linear needs the rows of a group together: groups are to be of a size that one
    task can hold, like a station's series. Linear ones are fitted by ``fitted``, which has no such bound.
    """
    schema = ", ".join([*[f"`{g.name}` {g.dataType.simpleString()}" for g in df.schema if g.name in keys], *[f"p{k} double" for k in range(len(start))], "n long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        ok = np.isfinite(a) & np.isfinite(b)
        a, b, p, damp = a[ok], b[ok], np.array(start, float), 1e-3
        cost = lambda q: float(np.sum((b - f(a, *q)) ** 2))
        now = cost(p)
        for _ in range(rounds):
            step = 1e-6 * np.maximum(np.abs(p), 1e-3)
            j = np.stack([(f(a, *(p + s)) - f(a, *(p - s))) / (2 * step[k]) for k, s in enumerate(np.diag(step))], 1)
            m, g = j.T @ j, j.T @ (b - f(a, *p))
            try:
                move = np.linalg.solve(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), g)
            except np.linalg.LinAlgError:
                break
            new = cost(p + move)
            if new <= now:
                p, damp, done = p + move, damp / 3, now - new <= 1e-14 * max(now, 1e-300)
                now = new
                if done:
                    break
            else:
                damp *= 4
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {f"p{k}": [v] for k, v in enumerate(p)} | {"n": [int(ok.sum())]})

    return df.groupBy(*keys).applyInPandas(run, schema)
