"""Station products as records: velocities, displacements, coordinates, series and their views, all stations at once.

A series is a frame of keys (station and the like), component, t (fractional years), y and sigma,
and a record is a row a key and component, or a row a key, with ``refused``, why there is none, and
``flags``. Everything is an aggregate over the keys, combined in the map tasks; nothing loops over
stations, and a station that gives no record does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions.geo import number
from seiche.operators.screens import cut_at_steps, data_ends, nearest_epoch

DAYS = 365.25


def usable(y: str = "y", sigma: str = "sigma", most: float | None = None) -> Column:
    """A finite value with a positive finite sigma, not above ``most``."""
    out = number(y).isNotNull() & (F.abs(y) != float("inf")) & (number(sigma) > 0) & (F.col(sigma) != float("inf"))
    return F.coalesce(out & (F.col(sigma) <= most) if most is not None else out, F.lit(False))


def reasons(*tests: tuple[Column, Column | str]) -> Column:
    """The texts of the tests that hold, joined; null where none does."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), w if isinstance(w, Column) else F.lit(w)) for t, w in tests]))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def _sums(rows: DataFrame, keys: list[str], t: str, middle: Column, y: str = "y", sigma: str = "sigma") -> DataFrame:
    """n, the span and the weighted sums of x^k, x^k y and y² about a middle, as one aggregate."""
    x, w = F.col(t) - middle, F.pow(F.col(sigma), -2)
    rows = rows.withColumns({"_x": x, "_w": w})
    powers = [F.sum(F.col("_w") * F.pow("_x", F.lit(k))).alias(f"s{k}") for k in range(5)]
    mixed = [F.sum(F.col("_w") * F.pow("_x", F.lit(k)) * F.col(y)).alias(f"r{k}") for k in range(3)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), *powers, *mixed, F.sum(F.col("_w") * F.col(y) * F.col(y)).alias("yy"))


def _line(c: dict[str, Column]) -> dict[str, Column]:
    """rate, offset, χ² and formal sigma (scaled by χ²/ν) of the weighted line from the sums."""
    det = c["s0"] * c["s2"] - c["s1"] * c["s1"]
    rate = (c["s0"] * c["r1"] - c["s1"] * c["r0"]) / F.nullif(det, F.lit(0.0))
    offset = (c["r0"] - rate * c["s1"]) / c["s0"]
    chi2 = F.greatest(c["yy"] - rate * c["r1"] - offset * c["r0"], F.lit(0.0))
    return {"rate": rate, "offset": offset, "chi2": chi2, "formal": F.sqrt(chi2 / F.greatest(c["n"] - 2, F.lit(1)) * c["s0"] / F.nullif(det, F.lit(0.0)))}


def _parabola_chi2(c: dict[str, Column]) -> Column:
    """χ² of the weighted parabola by Cramer's rule."""
    det3 = lambda a, b, e, d, f, g, h, i, j: a * (f * j - g * i) - b * (d * j - g * h) + e * (d * i - f * h)
    s, r = [c[f"s{k}"] for k in range(5)], [c[f"r{k}"] for k in range(3)]
    det = F.nullif(det3(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4]), F.lit(0.0))
    p0 = det3(r[0], s[1], s[2], r[1], s[2], s[3], r[2], s[3], s[4]) / det
    p1 = det3(s[0], r[0], s[2], s[1], r[1], s[3], s[2], r[2], s[4]) / det
    p2 = det3(s[0], s[1], r[0], s[1], s[2], r[1], s[2], s[3], r[2]) / det
    return F.greatest(c["yy"] - p0 * r[0] - p1 * r[1] - p2 * r[2], F.lit(0.0))


def velocities(
    series: DataFrame, window: tuple[float, float], *, keys: list[str], component: str = "component", t: str = "t", steps: DataFrame | None = None, recorded: DataFrame | None = None, scales: DataFrame | None = None,
    most_sigma: float | None = None, least: int = 5, cover: float = 0.8, allow_steps: bool = False, no_record: str = "refuse", default_k: float = 1.0, least_snr: float | None = None, nonlinear_f: float = 30.0, nonlinear_days: float = 61.0, nonlinear_least: int = 7,
) -> DataFrame:
    """One row a key and component: rate, sigma, sigma_formal, k, k_from, n, span, largest_gap, snr, tier, flags, refused.

    Gates are those of the key: its component with fewest epochs counts. ``steps`` (keys, step) inside
    the window refuse it unless they are allowed; ``recorded`` are the keys that have a stored model:
    others are refused, or fall back to the plate. Data that stop before the window's end are
    covered up to their own end and flagged. A key that fails only the gates for a few epochs may
    stand as ``short`` where its rate exceeds ``least_snr`` sigmas. ``scales`` (keys and component, k)
    widens the sigma. Where a parabola fits much better (F) in a short window the rate is flagged.
    """
    t0, t1 = window
    part = [*keys, component]
    everything = series.select(*keys).distinct()
    ends = data_ends(series.filter(usable(most=most_sigma)), keys, t, t1)
    rows = series.filter(usable(most=most_sigma) & (F.col(t) >= t0) & (F.col(t) < t1))
    gaps = rows.withColumn("_g", F.col(t) - F.lag(t).over(W.partitionBy(*part).orderBy(t))).groupBy(*part).agg(F.max("_g").alias("largest_gap"))
    sums = _sums(rows, part, t, F.lit((t0 + t1) / 2))
    cols = {c: F.col(c) for c in sums.columns}
    fits = sums.select(*part, "n", "first", "last", *[v.alias(k) for k, v in _line(cols).items()], _parabola_chi2(cols).alias("chi2_2"))
    gate = fits.groupBy(*keys).agg(F.min("n").alias("n_gate"), F.min("first").alias("_first"), F.max("last").alias("_last"))
    inside = steps.filter((F.col("step") > t0) & (F.col("step") < t1)).groupBy(*keys).agg(F.count("*").alias("n_steps")) if steps is not None else everything.limit(0).withColumn("n_steps", F.lit(0))
    known = recorded.select(*keys).distinct().withColumn("_known", F.lit(True)) if recorded is not None else everything.withColumn("_known", F.lit(True))
    one = everything.join(gate, keys, "left").join(ends, keys, "left").join(inside, keys, "left").join(known, keys, "left")
    half_day = 0.5 / DAYS
    length = F.coalesce(F.col("data_end") + half_day, F.lit(t1)) - t0
    covered = (F.col("_last") - F.col("_first")) / length
    few, thin = F.coalesce(F.col("n_gate"), F.lit(0)) < least, F.coalesce(covered, F.lit(0.0)) < cover
    stepped = F.coalesce("n_steps", F.lit(0)) > 0
    missing = F.col("_known").isNull()
    hard = reasons((missing & F.lit(no_record == "refuse"), "no_record"), (F.col("n_gate").isNull(), "no epochs"), (stepped & F.lit(not allow_steps), "steps_in_window"))
    soft = reasons((few & F.col("n_gate").isNotNull(), F.concat(F.lit("few epochs "), F.coalesce("n_gate", F.lit(0)).cast("string"))), (thin & F.col("n_gate").isNotNull(), "cover"))
    flags = F.array_compact(F.array(F.when(missing & F.lit(no_record == "plate"), "fallback:plate"), F.when(F.col("data_end").isNotNull(), "truncated"), F.when(stepped & F.lit(allow_steps), "steps_in_window")))
    one = one.select(*keys, hard.alias("_hard"), soft.alias("_soft"), flags.alias("_flags"), length.alias("_length"), "data_end")
    out = one.join(fits, keys, "left").join(gaps, part, "left")
    out = out.join(scales.select(*part, F.col("k").alias("_k")), part, "left") if scales is not None else out.withColumn("_k", F.lit(None).cast("double"))
    k = F.coalesce("_k", F.lit(default_k))
    snr = F.abs("rate") / F.nullif(F.col("formal") * k, F.lit(0.0))
    strong = snr >= least_snr if least_snr is not None else F.lit(False)
    short = F.col("_hard").isNull() & F.col("_soft").isNotNull() & F.coalesce(strong, F.lit(False))
    refused = F.when(F.col("_hard").isNotNull(), F.concat_ws("; ", "_hard", "_soft")).when(F.col("_soft").isNotNull() & ~short, F.col("_soft"))
    bent = (F.col("_length") * DAYS <= nonlinear_days + 0.5) & (F.col("n") >= nonlinear_least) & ((F.col("chi2") - F.col("chi2_2")) * (F.col("n") - 3) >= nonlinear_f * F.col("chi2_2"))
    ok = refused.isNull()
    value = lambda c: F.when(ok, c)
    all_flags = F.array_compact(F.array_append(F.array_append("_flags", F.when(short, "short")), F.when(F.coalesce(bent, F.lit(False)) & ok, "nonlinear")))
    return out.select(
        *part, value(F.col("rate")).alias("rate"), value(F.col("formal") * k).alias("sigma"), value(F.col("formal")).alias("sigma_formal"), k.alias("k"), F.when(F.col("_k").isNotNull(), "empirical_k").otherwise("default_k").alias("k_from"),
        F.coalesce("n", F.lit(0)).alias("n"), "first", "last", "largest_gap", value(snr).alias("snr"), F.when(ok, F.when(short, "short").otherwise("standard")).alias("tier"), "data_end", all_flags.alias("flags"), refused.alias("refused"),
    )


def acceptance(records: DataFrame, keys: list[str]) -> DataFrame:
    """n_stations, n_accepted: keys of which a record is not refused count as accepted."""
    one = records.groupBy(*keys).agg(F.bool_or(F.col("refused").isNull()).alias("ok"))
    return one.agg(F.count("*").alias("n_stations"), F.count_if("ok").alias("n_accepted"))


def rate_scales(series: DataFrame, years: float, *, keys: list[str], t: str = "t", least: int = 5, least_windows: int = 4) -> DataFrame:
    """keys, k, n_windows: how much more the rates of windows of a length scatter than their formal sigmas say.

    Windows overlap by half; a row lies in two of them. Each gives a weighted line; k is the scaled
    median absolute deviation of the rates over the median formal sigma. Keys with too few windows
    have none.
    """
    half = years / 2
    place = F.floor(F.col(t) / half)
    rows = series.filter(usable()).withColumn("_win", F.explode(F.array(place - 1, place)))
    rows = rows.withColumn("_mid", (F.col("_win") + 1) * half)
    sums = _sums(rows, [*keys, "_win"], t, F.col("_mid"))
    cols = {c: F.col(c) for c in sums.columns}
    fits = sums.select(*keys, "n", (F.col("last") - F.col("first")).alias("span"), *[v.alias(k) for k, v in _line(cols).items()])
    fits = fits.filter((F.col("n") >= least) & (F.col("span") >= 0.6 * years) & (F.col("formal") > 0))
    centre = fits.groupBy(*keys).agg(F.median("rate").alias("_m"), F.median("formal").alias("_f"), F.count("*").alias("n_windows")).filter(F.col("n_windows") >= least_windows)
    spread = fits.join(centre, keys).groupBy(*keys).agg(F.median(F.abs(F.col("rate") - F.col("_m"))).alias("_d"), F.first("_f").alias("_f"), F.first("n_windows").alias("n_windows"))
    return spread.select(*keys, (1.4826 * F.col("_d") / F.col("_f")).alias("k"), "n_windows")


def k_table(series: DataFrame, days: list[int], *, keys: list[str], component: str = "component", t: str = "t") -> DataFrame:
    """days, component, k (the median over stations), n_stations for each length of window."""
    out = None
    for n in days:
        one = rate_scales(series, n / DAYS, keys=[*keys, component], t=t).groupBy(component).agg(F.median("k").alias("k"), F.count("*").alias("n_stations")).withColumn("days", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def displacements(series: DataFrame, period: tuple[float, float], *, keys: list[str], component: str = "component", t: str = "t", method: str = "ends", ends_days: float = 10.0, onset: float | None = None, end: float | None = None, step_days: float = 30.0, least: int = 1) -> DataFrame:
    """One row a key and component: displacement, sigma, span (years), n_start, n_end, refused.

    ``ends``: weighted levels of the period's first and last days; ``points``: its first and last
    epoch; ``step``: levels of the days before ``onset`` and after ``end`` within the period; ``rate``:
    the velocity times the length. The span is that between the mean times of the two levels, or the
    period's.
    """
    p0, p1 = period
    part = [*keys, component]
    if method == "rate":
        v = velocities(series, period, keys=keys, component=component, t=t)
        long = F.lit(p1 - p0)
        return v.select(*part, (F.col("rate") * long).alias("displacement"), (F.col("sigma") * long).alias("sigma"), F.when(F.col("refused").isNull(), long).alias("span"), F.col("n").alias("n_start"), F.col("n").alias("n_end"), "refused")
    rows = series.filter(usable() & (F.col(t) >= p0) & (F.col(t) < p1))
    everything = series.select(*part).distinct()
    if method == "points":
        at = lambda f: f(F.struct(t, "y", "sigma"))
        out = everything.join(rows.groupBy(*part).agg(at(F.min).alias("a"), at(F.max).alias("b"), F.count("*").alias("n")), part, "left")
        bad = reasons((F.col("n").isNull(), "no epochs"), (F.col("n") == 1, "one epoch"))
        ok = bad.isNull()
        return out.select(*part, F.when(ok, F.col("b.y") - F.col("a.y")).alias("displacement"), F.when(ok, F.hypot("a.sigma", "b.sigma")).alias("sigma"), F.when(ok, F.col(f"b.{t}") - F.col(f"a.{t}")).alias("span"), F.when(ok, 1).otherwise(0).cast("long").alias("n_start"), F.when(ok, 1).otherwise(0).cast("long").alias("n_end"), bad.alias("refused"))
    if method == "ends":
        width = ends_days / DAYS
        before, after = F.col(t) < p0 + width, F.col(t) >= p1 - width
    else:
        width = step_days / DAYS
        before, after = (F.col(t) < onset) & (F.col(t) >= onset - width), (F.col(t) >= end) & (F.col(t) < end + width)
    w = F.pow(F.col("sigma"), -2)
    level = lambda at, c: F.sum(F.when(at, w * F.col(c))) / F.sum(F.when(at, w))
    sums = rows.groupBy(*part).agg(
        level(before, "y").alias("a"), level(after, "y").alias("b"), level(before, t).alias("ta"), level(after, t).alias("tb"), (1 / F.sum(F.when(before, w))).alias("va"), (1 / F.sum(F.when(after, w))).alias("vb"), F.count_if(before).alias("n_start"), F.count_if(after).alias("n_end")
    )
    out = everything.join(sums, part, "left").na.fill(0, ["n_start", "n_end"])
    bad = reasons((F.lit(method == "ends") & F.lit(p1 - p0 < 2 * ends_days / DAYS), "ends overlap"), (F.col("n_start") < least, "no epochs at the start"), (F.col("n_end") < least, "no epochs at the end"))
    ok = bad.isNull()
    return out.select(*part, F.when(ok, F.col("b") - F.col("a")).alias("displacement"), F.when(ok, F.sqrt(F.col("va") + F.col("vb"))).alias("sigma"), F.when(ok, F.col("tb") - F.col("ta")).alias("span"), "n_start", "n_end", bad.alias("refused"))


def displacement_spans(records: DataFrame, keys: list[str], period: tuple[float, float]) -> DataFrame:
    """keys, span: the mean of the components' spans, the period's length where there is none."""
    return records.groupBy(*keys).agg(F.coalesce(F.avg("span"), F.lit(period[1] - period[0])).alias("span"))


def coordinates(series: DataFrame, epoch: float, *, keys: list[str], component: str = "component", t: str = "t", window_days: float = 10.0, steps: DataFrame | None = None, rates: DataFrame | None = None, method: str = "observed") -> DataFrame:
    """One row a key and component: value, sigma, t_obs, n, flags, refused: the level at an epoch.

    ``observed``: the weighted mean of the window's rows on the epoch's side of every step, its
    sigma scaled by the root of χ²/ν where that exceeds one. Without any, or by ``model``: the mean of
    the window about the nearest row, moved by the key's rate (0 without one) and flagged as
    extrapolated by so many days, and where a step lies between.
    """
    part, half = [*keys, component], window_days / 2 / DAYS
    rows = series.filter(usable())
    steps = steps if steps is not None else rows.select(*keys).limit(0).withColumn("step", F.lit(0.0))
    own = cut_at_steps(rows, keys, t, steps, epoch, half)
    w = F.pow(F.col("sigma"), -2)

    def mean(df: DataFrame) -> DataFrame:
        sums = df.groupBy(*part).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("y") * F.col("y")).alias("wyy"), (F.sum(w * F.col(t)) / F.sum(w)).alias("t_obs"))
        chi2 = F.greatest(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
        return sums.select(*part, "n", "t_obs", (F.col("wy") / F.col("w")).alias("value"), (F.sqrt(1 / F.col("w")) * F.sqrt(F.greatest(chi2, F.lit(1.0)))).alias("sigma"))

    everything = series.select(*part).distinct()
    seen = mean(own).withColumn("flags", F.array().cast("array<string>"))
    if method == "model":
        seen = seen.limit(0)
    anchor = nearest_epoch(rows, part, t, epoch).select(*part, F.col(t).alias("_at"))
    near = rows.join(anchor, part).filter(F.abs(F.col(t) - F.col("_at")) <= half)
    base = mean(near).join(seen.select(*part), part, "left_anti")
    base = base.join(rates.select(*part, F.col("rate").alias("_v")), part, "left") if rates is not None else base.withColumn("_v", F.lit(None).cast("double"))
    lo, hi = F.least(F.col("t_obs"), F.lit(epoch)), F.greatest(F.col("t_obs"), F.lit(epoch))
    between = base.select(*part, "t_obs").join(steps, keys).filter((F.col("step") > lo) & (F.col("step") < hi)).select(*part).distinct().withColumn("_between", F.lit(True))
    gap = F.abs(F.col("t_obs") - epoch) * DAYS
    flags = F.array_compact(F.array(F.when(F.col("_v").isNull(), "model:none"), F.lit("sigma:observed_only"), F.when(F.col("_between"), "steps_between"), F.when(F.lit(method == "observed") | (gap > max(window_days, 0.5)), F.concat(F.lit("extrapolated:"), F.round(gap, 0).cast("long").cast("string"), F.lit("d")))))
    base = base.join(between, part, "left").select(*part, "n", "t_obs", (F.col("value") + F.coalesce("_v", F.lit(0.0)) * (epoch - F.col("t_obs"))).alias("value"), "sigma", flags.alias("flags"))
    return everything.join(seen.unionByName(base), part, "left").withColumn("refused", F.when(F.col("n").isNull(), "no solutions to anchor on"))


#: The bits of an exported epoch's reasons, in the order of ``functions.text.REASONS``.
OUTLIER, DECLARED, ICING, SNOW, NETWORK = 1, 2, 4, 8, 16


def view(series: DataFrame, *, keys: list[str], number_of: str = "rec_id", component: str = "component", t: str = "t", outliers: DataFrame | None = None, declared: DataFrame | None = None, bad_days: DataFrame | None = None, model: DataFrame | None = None, terms: tuple[str, ...] = ("rate",), provisional_days: float = 0.0) -> DataFrame:
    """The series with further columns, none taken away: reasons (bits), kept, provisional, y_clean, y_detrended.

    ``outliers`` (number), ``declared`` (keys, yearf of whole epochs), ``bad_days`` (day key, of the
    network) each set their bit; y_clean is null where any component of the epoch is flagged;
    y_detrended is y less the ``model``'s terms (keys, component and a column a term) where there is
    one. Flags of the last ``provisional_days`` of a series are provisional.
    """
    from seiche.functions.timeaxis import day_key, epoch_key
    from seiche.models.trajectory import terms as model_terms

    rows = series.withColumn("_e", epoch_key(F.col(t)))
    bit = F.lit(0)
    if outliers is not None:
        rows = rows.join(outliers.select(number_of).distinct().withColumn("_o", F.lit(OUTLIER)), number_of, "left")
        bit = bit.bitwiseOR(F.coalesce("_o", F.lit(0)))
    if declared is not None:
        rows = rows.join(declared.select(*keys, epoch_key(F.col("yearf")).alias("_e"), F.lit(DECLARED).alias("_d")).distinct(), [*keys, "_e"], "left")
        bit = bit.bitwiseOR(F.coalesce("_d", F.lit(0)))
    if bad_days is not None:
        rows = rows.withColumn("_day", day_key(F.col(t))).join(bad_days.select(F.col("day_key").alias("_day"), F.lit(NETWORK).alias("_n")).distinct(), "_day", "left").drop("_day")
        bit = bit.bitwiseOR(F.coalesce("_n", F.lit(0)))
    rows = rows.withColumn("reasons", bit)
    flagged = rows.filter("reasons <> 0").select(*keys, "_e").distinct().withColumn("_bad", F.lit(True))
    last = rows.groupBy(*keys).agg(F.max(t).alias("_last"))
    rows = rows.join(flagged, [*keys, "_e"], "left").join(last, keys, "left")
    out = {"kept": F.col("_bad").isNull(), "y_clean": F.when(F.col("_bad").isNull(), F.col("y")), "provisional": (F.col("reasons") != 0) & (F.col(t) > F.col("_last") - provisional_days / DAYS)}
    if model is not None:
        rows = rows.join(model.select(*keys, component, *[F.col(c).alias(f"_m_{c}") for c in terms]), [*keys, component], "left")
        columns = model_terms(F.col(t))
        out["y_detrended"] = F.col("y") - sum((F.coalesce(f"_m_{c}", F.lit(0.0)) * columns[c] for c in terms), F.lit(0.0))
    extra = [c for c in rows.withColumns(out).columns if not c.startswith("_")]
    return rows.withColumns(out).select(*extra)


def exported(viewed: DataFrame, period: tuple[float, float] | None, *, t: str = "t", dropped: bool = False) -> DataFrame:
    """The rows of a viewed series in a period, the kept ones or all, with the names of their reasons."""
    from seiche.functions.text import reason_names

    rows = viewed.filter((F.col(t) >= period[0]) & (F.col(t) < period[1])) if period else viewed
    rows = rows if dropped else rows.filter("kept")
    return rows.withColumn("reason_names", reason_names(F.col("reasons")))


def shared_decay(series: DataFrame, *, keys: list[str], onset: float, until: float, taus: list[float], t: str = "t", rounds: int = 3, times: float = 5.0, least: int = 8) -> tuple[float, DataFrame]:
    """(the relaxation time with the least total misfit, the rows it was taken from).

    All times are tried in one aggregation; rows whose residual exceeds ``times`` scaled median
    absolute deviations of their series are left out and the search repeated, until none is.
    """
    from seiche.models.trajectory import normal_sums
    from seiche.session import written

    rows = series.filter(usable() & (F.col(t) >= onset) & (F.col(t) < until))
    best = taus[0]
    x = F.col(t) - onset
    columns = {"offset": F.lit(1.0), "rate": x, "amplitude": 1 - F.exp(-x / F.col("_tau"))}
    by_key = lambda df, one: df.join(one.hint("merge"), keys)  # noqa: E731  # a row a series, of which there may be any number: not gathered for a broadcast
    for _ in range(rounds):
        tried = rows.withColumn("_tau", F.explode(F.array(*[F.lit(float(tau)) for tau in taus])))
        fits = written(_solved(normal_sums(tried, [*keys, "_tau"], columns, "y", "sigma"), [*keys, "_tau"], least), "decay-fits")
        # One row a time.
        total = fits.groupBy("_tau").agg(F.sum("chi2").alias("chi2")).collect()
        if not total:
            break
        best = min(total, key=lambda r: (r["chi2"], r["_tau"]))["_tau"]
        model = F.col("offset") + F.col("linear") * x + F.col("amplitude") * (1 - F.exp(-x / F.lit(best)))
        fit = fits.filter(F.col("_tau") == best).select(*keys, "offset", "linear", "amplitude")
        resid = written(by_key(rows, fit).select(*rows.columns, ((F.col("y") - model) / F.col("sigma")).alias("_r")), "decay-residuals")
        resid = by_key(resid, resid.groupBy(*keys).agg(F.median("_r").alias("_m")))
        off = F.abs(F.col("_r") - F.col("_m"))
        spread = resid.groupBy(*keys).agg((1.4826 * F.median(off)).alias("_d"))
        kept = written(by_key(resid.withColumn("_off", off), spread).withColumn("_kept", F.col("_off") <= times * F.col("_d")).select(*rows.columns, "_kept"), "decay-kept")
        if kept.filter("not coalesce(_kept, false)").isEmpty():
            break
        rows = kept.filter("_kept").drop("_kept")
    return best, rows


def _solved(sums: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, n, chi2, offset, linear, amplitude and their sigmas from normal sums of three columns."""
    import numpy as np
    import pandas as pd

    from seiche.models.trajectory import solve

    names = ("offset", "linear", "amplitude")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys], "n long", "chi2 double", *[f"{c} double, {c}_sigma double" for c in names]])

    def run(batches):
        for pdf in batches:
            done = [solve(np.asarray(m), 3, n) for m, n in zip(pdf["m"], pdf["n"])]
            out = {k: pdf[k] for k in keys} | {"n": pdf["n"], "chi2": [s[2] for s in done]}
            for k, c in enumerate(names):
                out[c], out[f"{c}_sigma"] = [s[0][k] for s in done], [s[1][k] for s in done]
            yield pd.DataFrame(out)

    return sums.filter(F.col("n") >= least).mapInPandas(run, schema)


def transients(series: DataFrame, *, keys: list[str], onset: float, tau: float, at: list[float], t: str = "t", least: int = 8) -> DataFrame:
    """Records of series that relax after an onset at a fixed time: offset, linear, amplitude with sigmas, n, chi2.

    With dates ``at`` a row each: at, rate (linear + amplitude/τ e^(−(at−onset)/τ)) and whether it is
    beyond the data by more than a day.
    """
    from seiche.models.trajectory import normal_sums

    x = F.col(t) - onset
    rows = series.filter(usable() & (F.col(t) >= onset))
    fit = _solved(normal_sums(rows, keys, {"offset": F.lit(1.0), "rate": x, "amplitude": 1 - F.exp(-x / F.lit(tau))}, "y", "sigma"), keys, least)
    if not at:
        return fit
    last = rows.groupBy(*keys).agg(F.max(t).alias("_last"))
    dated = fit.join(last.hint("merge"), keys).withColumn("at", F.explode(F.array(*[F.lit(float(a)) for a in at])))
    rate = F.col("linear") + F.col("amplitude") / tau * F.exp(-(F.col("at") - onset) / F.lit(tau))
    return dated.withColumns({"rate": rate, "extrapolated": F.col("at") > F.col("_last") + 1 / DAYS}).drop("_last")
