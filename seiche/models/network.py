"""Networks of stations: noise of baselines, regional seasons, reference frames, stored parameters and their plans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seiche.functions.geo import number
from seiche.operators.joins import kernel_mean, pairs_within
from seiche.plans.grammar import Hold, Stage


def pair_correlations(residuals: DataFrame, pairs: DataFrame, *, station: str = "station", day: str = "day", component: str = "component", value: str = "r", least: int = 2) -> DataFrame:
    """a, b, component, rho, n: the correlation of two stations' residuals over their common days; null with too few."""
    one = lambda s, v: residuals.filter(number(value).isNotNull()).select(F.col(station).alias(s), day, component, F.col(value).alias(v))
    both = pairs.select("a", "b").join(one("a", "x"), "a").join(one("b", "y"), ["b", day, component])
    out = both.groupBy("a", "b", component).agg(F.corr("x", "y").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def noise_law(residuals: DataFrame, stations: DataFrame, *, station: str = "station", day: str = "day", component: str = "component", value: str = "r", sigma: str = "sigma", max_km: float = 50.0, least_pairs: int = 5) -> tuple[DataFrame, DataFrame]:
    """(station, component, k), (component, rho0, length_km, n_pairs): the noise of stations and how pairs share it.

    k is the root mean square of the standardised residuals. The law rho(d) = rho0 e^(−d/length) is a line
    through the logarithms of the pairs' positive correlations; with fewer pairs there is none.
    """
    good = residuals.filter(number(value).isNotNull() & (number(sigma) > 0))
    own = good.groupBy(station, component).agg(F.sqrt(F.avg(F.pow(F.col(value) / F.col(sigma), 2))).alias("k"))
    near = pairs_within(stations, station=station, max_km=max_km)
    rho = pair_correlations(good, near, station=station, day=day, component=component, value=value).join(near, ["a", "b"]).filter("rho > 0")
    log = F.log("rho")
    law = rho.groupBy(component).agg(F.count("*").alias("n_pairs"), F.regr_slope(log, F.col("km")).alias("_s"), F.regr_intercept(log, F.col("km")).alias("_i")).filter(F.col("n_pairs") >= least_pairs)
    return own, law.select(component, F.least(F.exp("_i"), F.lit(1.0)).alias("rho0"), F.when(F.col("_s") < 0, -1 / F.col("_s")).alias("length_km"), "n_pairs")


def pair_inputs(pairs: DataFrame, own: DataFrame, law: DataFrame, correlations: DataFrame | None = None, *, station: str = "station", component: str = "component") -> DataFrame:
    """a, b, component, k_a, k_b, rho, rho_from: what a baseline's sigma needs; a pair's own correlation wins over the law."""
    k = lambda s: own.select(F.col(station).alias(s), component, F.col("k").alias(f"k_{s}"))
    rows = pairs.join(k("a"), "a").join(k("b"), ["b", component]).join(law, component, "left")
    by_law = F.col("rho0") * F.exp(-F.col("km") / F.col("length_km"))
    if correlations is not None:
        rows = rows.join(correlations.select("a", "b", component, F.col("rho").alias("_own")), ["a", "b", component], "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("double"))
    return rows.select("a", "b", component, "k_a", "k_b", F.coalesce("_own", by_law, F.lit(0.0)).alias("rho"), F.when(F.col("_own").isNotNull(), "own").when(by_law.isNotNull(), "law").otherwise("none").alias("rho_from"))


def baseline_series(a: DataFrame, b: DataFrame, *, key: str = "t", value: str = "y", sigma: str = "sigma", rho: float = 0.0, rezero: bool = True) -> DataFrame:
    """key, y, sigma of a less b where both have the key; sigma with their correlation, not below zero; from zero at its first value."""
    both = a.select(key, F.col(value).alias("_x"), F.col(sigma).alias("_sx")).join(b.select(key, F.col(value).alias("_y"), F.col(sigma).alias("_sy")), key)
    s = F.sqrt(F.greatest(F.pow("_sx", F.lit(2)) + F.pow("_sy", F.lit(2)) - 2 * rho * F.col("_sx") * F.col("_sy"), F.lit(0.0)))
    out = both.select(key, number(F.col("_x") - F.col("_y")).alias(value), s.alias(sigma))
    if not rezero:
        return out
    # One row: the first value that is there.
    first = out.filter(F.col(value).isNotNull()).agg(F.min(F.struct(key, value)).alias("f")).head()["f"]
    return out.withColumn(value, F.col(value) - (first[value] if first else 0.0))


# Regional seasons.


def donors(records: DataFrame, stations: DataFrame, *, station: str = "station", estimated: str = "own_seasonal") -> DataFrame:
    """Records of stations that have a place and a season estimated from their own data."""
    return records.filter(F.coalesce(F.col(estimated), F.lit(False))).join(stations, station)


def regional_seasonals(targets: DataFrame, given: DataFrame, *, station: str = "station", parameters: tuple[str, ...], length_km: float, radius_km: float, least: int = 2) -> DataFrame:
    """station, a column a parameter, n_donors: means of the donors near, weighted by distance; with too few none."""
    out = None
    for p in parameters:
        one = kernel_mean(targets, given, station=station, value=p, length_km=length_km, radius_km=radius_km).filter(F.col("n") >= least)
        one = one.select(station, p, F.col("n").alias("n_donors")) if out is None else one.select(station, p)
        out = one if out is None else out.join(one, station)
    return out


def left_out_errors(given: DataFrame, *, station: str = "station", parameters: tuple[str, ...], length_km: float, radius_km: float) -> DataFrame:
    """parameter, median_error, n: each donor's parameters against what the others near it give."""
    guess = regional_seasonals(given, given, station=station, parameters=parameters, length_km=length_km, radius_km=radius_km)
    both = given.select(station, *[F.col(p).alias(f"_{p}") for p in parameters]).join(guess, station)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.abs(F.col(p) - F.col(f"_{p}")).alias("e")) for p in parameters])).alias("x")).select("x.*")
    return long.groupBy("parameter").agg(F.median("e").alias("median_error"), F.count("e").alias("n"))


# Reference frames.


def partials(xyz: np.ndarray, parameters: list[str]) -> np.ndarray:
    """The change of stacked x, y, z (metres) by translations (m), rotations (mas) and scale (ppb)."""
    n, mas = len(xyz), np.radians(1 / 3.6e6)
    x, y, z = np.asarray(xyz, float).T
    zero = np.zeros(n)
    columns = {
        "xtran": (1 + zero, zero, zero), "ytran": (zero, 1 + zero, zero), "ztran": (zero, zero, 1 + zero),
        "xrot": (zero, -z * mas, y * mas), "yrot": (z * mas, zero, -x * mas), "zrot": (-y * mas, x * mas, zero), "scale": (x * 1e-9, y * 1e-9, z * 1e-9),
    }
    return np.stack([np.stack(columns[p], 1).ravel() for p in parameters], 1)


def stabilised(rows: DataFrame, *, parameters: list[str], iterations: int = 4, n_sigma: float = 3.0, least: int = 4, day: str = "day") -> DataFrame:
    """Each day's solution brought into the frame of its reference sites.

    ``rows``: day, site, x, y, z, dx, dy, dz (observed less reference, null for a site that is no
    reference), sigma. The parameters are fitted to the reference sites, weighted; sites whose residual
    exceeds ``n_sigma`` times the fit's scatter are taken out and the fit repeated. A group is one day's
    solution: one row a site. Returns day, site, dx, dy, dz after the parameters are taken off,
    used (whether it held the frame), n_used, and refused with too few sites.
    """
    schema = f"day {rows.schema[day].dataType.simpleString()}, site string, dx double, dy double, dz double, used boolean, n_used int, refused string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site").reset_index(drop=True)
        d, s = pdf[["dx", "dy", "dz"]].to_numpy(float), pdf["sigma"].to_numpy(float)
        use = np.isfinite(d).all(1) & (s > 0)
        a = partials(pdf[["x", "y", "z"]].to_numpy(float), parameters).reshape(len(pdf), 3, -1)
        refused, p = None, np.zeros(len(parameters))
        for _ in range(iterations):
            if use.sum() < least:
                refused = f"{int(use.sum())} reference sites"
                break
            m, b, w = a[use].reshape(-1, len(parameters)), d[use].ravel(), np.repeat(1 / s[use], 3)
            p = np.linalg.lstsq(m * w[:, None], b * w, rcond=None)[0]
            left = np.abs(d - a @ p).max(1)
            scatter = np.sqrt(np.mean((d[use] - a[use] @ p) ** 2))
            bad = use & (left > max(n_sigma * scatter, 1e-12))
            if not bad.any():
                break
            use &= ~bad
        after = d - a @ p if refused is None else np.full_like(d, np.nan)
        return pd.DataFrame({"day": pdf[day], "site": pdf["site"], **{c: after[:, k] for k, c in enumerate(("dx", "dy", "dz"))}, "used": use if refused is None else False, "n_used": int(use.sum()), "refused": refused})

    return rows.groupBy(day).applyInPandas(run, schema)


def one_per_site(rows: DataFrame, *, day: str = "day", site: str = "site", trace: str = "trace", position: str = "position") -> DataFrame:
    """Of a day's solutions of one site the one whose covariance has the smaller trace."""
    from seiche.operators.windows import first_per_key

    return first_per_key(rows, [day, site], [F.coalesce(number(trace), F.lit(float("inf"))), F.col(position)])


def not_shrunk(new: DataFrame, old: DataFrame, *, day: str = "day", n: str = "n_sites", least: float = 0.8) -> DataFrame:
    """Of each day the new make, unless it has fewer than ``least`` of the sites of the one before it, which then stays."""
    joined = new.select(day, F.struct(*new.columns).alias("new")).join(old.select(day, F.struct(*old.columns).alias("old")), day, "full_outer")
    keep = F.col("old").isNotNull() & (F.col("new").isNull() | (F.col(f"new.{n}") < least * F.col(f"old.{n}")))
    return joined.select(day, F.when(keep, F.col(f"old.{n}")).otherwise(F.col(f"new.{n}")).alias(n), F.when(keep, "kept").otherwise("new").alias("make"))


# Stored parameters.


def estimates(series: DataFrame, *, keys: list[str], t: str = "t", least: int = 50, least_span: float = 1.0, most_gap: float = 1.0, outliers: DataFrame | None = None, number_of: str = "rec_id", **model: object) -> DataFrame:
    """keys, status (estimated, skipped), reason, and the fitted parameters: gates first, outliers left out of the fit."""
    from pyspark.sql import Window as W

    from seiche.models.records import reasons, usable
    from seiche.models.trajectory import fitted

    rows = series.filter(usable())
    rows = rows.join(outliers.select(number_of).distinct(), number_of, "left_anti") if outliers is not None else rows
    gaps = rows.withColumn("_g", F.col(t) - F.lag(t).over(W.partitionBy(*keys).orderBy(t)))
    gate = gaps.groupBy(*keys).agg(F.count("*").alias("n_epochs"), (F.max(t) - F.min(t)).alias("span"), F.max("_g").alias("gap"))
    gate = series.select(*keys).distinct().join(gate, keys, "left")
    why = reasons((F.coalesce("n_epochs", F.lit(0)) < least, "epochs"), (F.coalesce("span", F.lit(0.0)) < least_span, "span"), (F.col("gap") > most_gap, "gap"))
    gate = gate.select(*keys, "n_epochs", "span", why.alias("reason"))
    fit = fitted(rows.join(gate.filter("reason is null").select(*keys), keys, "left_semi"), keys, t, "y", "sigma", least=least, **model)
    return gate.join(fit.drop("n"), keys, "left").withColumn("status", F.when(F.col("reason").isNull(), "estimated").otherwise("skipped"))


def prior_fallback(estimated: DataFrame, prior: DataFrame, anchors: DataFrame, *, keys: list[str], parameters: tuple[str, ...], offset: str = "offset") -> DataFrame:
    """Skipped stations with a record in the frame before get its parameters, its offset anew from their data (keys, offset)."""
    old = prior.select(*keys, *[F.col(p).alias(f"_p_{p}") for p in parameters])
    rows = estimated.join(old, keys, "left").join(anchors.select(*keys, F.col(offset).alias("_anchor")), keys, "left")
    take = (F.col("status") == "skipped") & F.col(f"_p_{parameters[0]}").isNotNull()
    new = {p: F.when(take, F.coalesce("_anchor", f"_p_{p}") if p == offset else F.col(f"_p_{p}")).otherwise(F.col(p)) for p in parameters}
    return rows.withColumns(new | {"status": F.when(take, "prior").otherwise(F.col("status"))}).drop("_anchor", *[f"_p_{p}" for p in parameters])


def compared_parameters(record: DataFrame, prior: DataFrame, *, keys: list[str], name: str = "name", value: str = "value", sigma: str = "sigma") -> DataFrame:
    """keys, name, change, in_sigmas of parameters by name; those of one side only have no change."""
    a, b = record.select(*keys, name, F.col(value).alias("_a"), F.col(sigma).alias("_s")), prior.select(*keys, name, F.col(value).alias("_b"), F.col(sigma).alias("_q"))
    change = F.col("_a") - F.col("_b")
    return a.join(b, [*keys, name], "full_outer").select(*keys, name, change.alias("change"), (F.abs(change) / F.nullif(F.hypot("_s", "_q"), F.lit(0.0))).alias("in_sigmas"))


def secular_rates(parameters: DataFrame, *, keys: list[str], name: str = "name", value: str = "value", sigma: str = "sigma", rate: str = "rate") -> DataFrame:
    """keys, rate, rate_sigma by the parameter's name; a record without it has none."""
    at = lambda c: F.max(F.when(F.col(name) == rate, F.col(c)))
    return parameters.groupBy(*keys).agg(at(value).alias("rate"), at(sigma).alias("rate_sigma"))


def digest(record: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()[:16]


def resolved_plan(plan: Iterable[Stage], holds: Iterable[Hold], *, donor: Callable[[str], Mapping[str, float] | None], store: Callable[[str], Mapping[str, float] | None], station: str) -> list[dict]:
    """The stages in order, each with what is held in it: at an earlier stage, at a donor's values or at saved ones.

    A hold without a stage belongs to the last one. A stage held must come earlier; a donor or saved
    background must be there; what was borrowed is recorded with its digest.
    """
    stages = [{"name": s.name, "group": s.group, "windows": list(s.windows), "held": []} for s in plan]
    place = {s["name"]: k for k, s in enumerate(stages)}
    for h in holds:
        target = h.stage or stages[-1]["name"]
        if target not in place:
            raise ValueError(f"no stage {target!r}")
        entry: dict[str, object] = {"group": h.group, "from": h.origin, "name": h.name}
        if h.origin == "stage":
            if place.get(h.name, len(stages)) >= place[target]:
                raise ValueError(f"{target}: {h.name!r} is no earlier stage")
        else:
            name = station if h.name == "self" else h.name
            values = (donor if h.origin == "donor" else store)(name)
            if values is None:
                raise ValueError(f"{h.origin} {name!r} has no record")
            entry |= {"name": name, "values": dict(values), "digest": digest(values)}
        stages[place[target]]["held"].append(entry)
    return stages


def donor_drift(previous: Iterable[Mapping], current: Iterable[Mapping]) -> list[str]:
    """Donors whose record is not the one that was borrowed, and donors that came or went."""
    borrowed = lambda plan: {(s["name"], h["group"], h["name"]): h["digest"] for s in plan for h in s["held"] if "digest" in h}
    old, new = borrowed(previous), borrowed(current)
    out = [f"{s}: {g} of {n} changed" for (s, g, n), d in sorted(new.items()) if (s, g, n) in old and old[s, g, n] != d]
    out += [f"{s}: {g} of {n} is new" for s, g, n in sorted(set(new) - set(old))]
    return out + [f"{s}: {g} of {n} is gone" for s, g, n in sorted(set(old) - set(new))]


def psd_covariance(sigma: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """3×3 covariances of sigmas (n, 3) and correlations (n, 3: 12, 13, 23): negative eigenvalues cut, the diagonal of ones restored."""
    n = len(sigma)
    c = np.broadcast_to(np.eye(3), (n, 3, 3)).copy()
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        c[:, i, j] = c[:, j, i] = np.nan_to_num(rho[:, k])
    values, vectors = np.linalg.eigh(c)
    c = (vectors * np.clip(values, 0, None)[:, None, :]) @ np.swapaxes(vectors, 1, 2)
    scale = np.sqrt(np.einsum("nii->ni", c))
    c = c / (scale[:, :, None] * scale[:, None, :])
    return c * sigma[:, :, None] * sigma[:, None, :]
