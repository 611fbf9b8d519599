"""Aggregates of series and catalogues: zero-filled counts, medians, weighted means, trimmed means, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, time: str, by: str | None = None) -> DataFrame:
    """Events per UTC day over the whole span of days, zero where there are none.

    With ``by``, one row a day and category; a null category is a category. Only the counts, one
    row a day and category, meet the spine of days.
    """
    keys = ["d"] + ([by] if by else [])
    rows = events.withColumn("d", F.col(time).cast("date")).filter("d is not null")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null")
    spine = span.select(F.explode(F.sequence("a", "b")).alias("d"))
    if by:
        spine = spine.select("d", F.lit(1).alias("_k")).join(counts.select(F.col(by).alias("_by"), F.lit(1).alias("_k")).distinct(), "_k").drop("_k")
        joined = spine.join(counts.withColumnRenamed("d", "_d"), (F.col("d") == F.col("_d")) & F.col("_by").eqNullSafe(F.col(by)), "left")
        return joined.select("d", F.col("_by").alias(by), F.coalesce("n", F.lit(0)).alias("n"))
    return spine.join(counts, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n"))


def missing(value: Column | str) -> Column:
    """The value with NaN as null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c), c)


def cumulative(value: str, order: list[str], partition: list[str] | None = None, places: int = 2) -> Column:
    """Running sum in order, missing as zero; exact decimals, so that it does not depend on the plan."""
    w = (W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.sum(F.coalesce(missing(value), F.lit(0.0)).cast(f"decimal(28,{places})")).over(w).cast("double")


def running_totals(df: DataFrame, value: str, day: str, order: list[str], places: int = 2) -> DataFrame:
    """Adds ``running``, the sum over all rows up to each in order, day by day.

    The days' totals are summed first (one row a day in one task), then within each day: no task
    sees more than a day's rows.
    """
    amount = F.coalesce(missing(value), F.lit(0.0)).cast(f"decimal(28,{places})")
    days = df.groupBy(day).agg(F.sum(amount).alias("_t"))
    before = days.select(F.col(day).alias("_d"), (F.sum("_t").over(W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_before"))
    rows = df.join(before, F.col(day) == F.col("_d")).drop("_d")
    w = W.partitionBy(day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running", (F.col("_before") + F.sum(amount).over(w)).cast("double")).drop("_before")


def bucket_medians(df: DataFrame, time: str, width: str, values: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Median of each value and the row count per tumbling window; empty windows are left out."""
    medians = [F.median(missing(v)).alias(v) for v in values]
    rows = df.filter(F.col(time).isNotNull()).groupBy(*keys, F.window(time, width)).agg(*medians, F.count("*").alias("n"))
    return rows.select(*keys, F.col("window.start").alias("bucket"), *values, "n")


def _bin(value: str) -> Column:
    """A whole number that orders as the value does: Java's log1p is semi-monotonic by its specification."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 256).cast("long")


def _keyed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """_k (the keys as one struct, which joins with its nulls) and the finite values _v, with their bin _b."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    rows = df.select((F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")).alias("_k"), F.when(finite, F.col(value)).cast("double").alias("_v"))
    return rows.filter(F.col("_v").isNotNull()).withColumn("_b", _bin("_v"))


#: Values of one group that one buffer or one sort may hold; larger groups go through bins, with the same result.
VALUES_IN_ONE_BUFFER = 1_000_000


def _largest(df: DataFrame, keys: list[str], value: Column) -> int:
    """The most values any group has: one row a group, then one."""
    return df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).head()[0] or 0


def group_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float], names: list[str]) -> DataFrame:
    """keys, n and exact linear quantiles of the finite values; null where a group has none.

    Where a group has more than ``VALUES_IN_ONE_BUFFER``, values are counted in bins first (combined in the
    map tasks), and only the bins that hold the wanted ranks are looked into, equal values as one row: a
    group with a third of all rows is in no buffer.
    """
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    if _largest(df, keys, finite) <= VALUES_IN_ONE_BUFFER:
        return df.groupBy(*keys).agg(F.count(finite).alias("n"), *[F.percentile(finite, F.lit(float(q))).alias(name) for name, q in zip(names, quantiles)])
    rows = _keyed(df, keys, value)
    w = W.partitionBy("_k")
    bins = rows.groupBy("_k", "_b").agg(F.count("*").alias("n")).withColumns({"all": F.sum("n").over(w), "below": F.sum("n").over(w.orderBy("_b")) - F.col("n")})
    spots = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("all") - 1)).alias("at")) for k, q in enumerate(quantiles)])
    wanted = bins.withColumn("s", F.explode(spots)).withColumn("r", F.explode(F.array(F.floor("s.at"), F.ceil("s.at")))).select("_k", "_b", "below", "n", "s", F.col("r").cast("long").alias("r")).distinct()
    wanted = wanted.filter((F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("n"))).drop("n")
    held = rows.join(wanted.select("_k", "_b").distinct(), ["_k", "_b"]).groupBy("_k", "_b", "_v").agg(F.count("*").alias("m"))
    held = held.withColumn("upto", F.sum("m").over(W.partitionBy("_k", "_b").orderBy("_v")))
    at = wanted.join(held, ["_k", "_b"]).filter((F.col("r") - F.col("below") >= F.col("upto") - F.col("m")) & (F.col("r") - F.col("below") < F.col("upto")))
    at = at.groupBy("_k", F.col("s.k").alias("k"), F.col("s.at").alias("at")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    wide = at.groupBy("_k").agg(*[F.max(F.when(F.col("k") == k, value_at)).alias(name) for k, name in enumerate(names)])
    groups = df.groupBy(*keys).agg(F.count(finite).alias("n"))
    groups = groups.withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    return groups.join(wide, "_k", "left").drop("_k")


def quantile_summary(df: DataFrame, value: str, quantiles: list[float], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """n and exact linear quantiles of the finite values; null when there are none."""
    return group_quantiles(df, keys, value, quantiles, [f"q{round(q * 100):02d}" for q in quantiles])


def weighted_mean(value: str, sigma: str, power: int = 2) -> tuple[Column, Column]:
    """(mean weighted by 1/sigma^power, its sigma) as aggregates; rows without either are skipped."""
    usable = missing(value).isNotNull() & (missing(sigma) > 0)
    w = F.when(usable, F.pow(F.col(sigma), -power))
    total = F.sum(w)
    return F.sum(w * F.col(value)) / total, F.sqrt(1 / F.sum(F.when(usable, F.pow(F.col(sigma), -2))))


def end_displacement(df: DataFrame, keys: list[str], t: str, value: str, sigma: str, days: float) -> DataFrame:
    """Weighted level of the first and last ``days`` of each key (half-open) and their difference.

    refused is set where the ends overlap or one is empty.
    """
    span = df.filter(missing(value).isNotNull()).groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    rows = df.join(span, keys)
    early, late = F.col(t) < F.col("_a") + days, F.col(t) > F.col("_b") - days
    w = F.when((missing(sigma) > 0) & missing(value).isNotNull(), F.pow(F.col(sigma), -2))
    level = lambda at: F.sum(F.when(at, w * F.col(value))) / F.sum(F.when(at, w))
    err = lambda at: F.sqrt(1 / F.sum(F.when(at, w)))
    out = rows.groupBy(*keys).agg(level(early).alias("start"), level(late).alias("end"), err(early).alias("_sa"), err(late).alias("_sb"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return out.select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("displacement"), F.hypot("_sa", "_sb").alias("sigma"), ((F.col("_b") - F.col("_a") < 2 * days) | F.col("start").isNull() | F.col("end").isNull()).alias("refused"))


def step_displacement(df: DataFrame, keys: list[str], t: str, value: str, sigma: str, onset: float, end: float, window: float) -> DataFrame:
    """Difference of the weighted levels in [end, end + window) and [onset - window, onset)."""
    before, after = (F.col(t) >= onset - window) & (F.col(t) < onset), (F.col(t) >= end) & (F.col(t) < end + window)
    w = F.when((missing(sigma) > 0) & missing(value).isNotNull(), F.pow(F.col(sigma), -2))
    level = lambda at: F.sum(F.when(at, w * F.col(value))) / F.sum(F.when(at, w))
    var = lambda at: 1 / F.sum(F.when(at, w))
    return df.groupBy(*keys).agg((level(after) - level(before)).alias("step"), F.sqrt(var(after) + var(before)).alias("sigma"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"))


def line_rate(df: DataFrame, keys: list[str], t: str, value: str, sigma: str | None = None, least: int = 5) -> DataFrame:
    """Weighted straight line by closed form: rate, offset at the mean epoch, sigma scaled by χ²/ν, n.

    The sums are taken about each key's mean epoch, found first, so that large epochs lose nothing.
    """
    good = missing(value).isNotNull() & missing(t).isNotNull()
    if sigma:
        good = good & (missing(sigma) > 0)
    rows = df.filter(good).withColumn("_w", F.pow(F.col(sigma), -2) if sigma else F.lit(1.0))
    centre = rows.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(t)) / F.sum("_w")).alias("_t0"), (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("_y0"))
    x, y, w = F.col(t) - F.col("_t0"), F.col(value) - F.col("_y0"), F.col("_w")
    sums = rows.join(centre, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"), F.sum(w * y * y).alias("_yy"), F.first("_t0").alias("t0"), F.first("_y0").alias("offset")
    )
    rate = F.try_divide("_xy", "_xx")
    scale = F.greatest(F.col("_yy") - rate * F.col("_xy"), F.lit(0.0)) / (F.col("n") - 2)
    return sums.filter(F.col("n") >= least).select(*keys, rate.alias("rate"), F.sqrt(scale / F.col("_xx")).alias("rate_sigma"), "t0", "offset", "n")


def trimmed_mean(df: DataFrame, keys: list[str], value: str, order: list[str] = [], share: int = 3, least: int = 3) -> DataFrame:  # noqa: B006
    """Mean of the middle: floor(n/share) values are left out at either end; null with fewer than ``least``.

    Where a group has more than ``VALUES_IN_ONE_BUFFER``, whole bins of values count by their sums and only
    the two bins where the ends are cut are looked into. Equal values are alike, so that their ``order``
    does not matter.
    """
    if _largest(df, keys, missing(value)) <= VALUES_IN_ONE_BUFFER:
        w = W.partitionBy(*keys)
        sorted_rows = df.filter(missing(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value, *order)), "_n": F.count("*").over(w)})
        ends = F.floor(F.col("_n") / share)
        middle = F.when((F.col("_n") >= least) & (F.col("_r") > ends) & (F.col("_r") <= F.col("_n") - ends), F.col(value))
        return sorted_rows.groupBy(*keys).agg(F.avg(middle).alias("trimmed_mean"), F.count("*").alias("n"))
    rows = _keyed(df, keys, value)
    w = W.partitionBy("_k")
    bins = rows.groupBy("_k", "_b").agg(F.count("*").alias("n"), F.sum("_v").alias("s")).withColumns({"all": F.sum("n").over(w), "below": F.sum("n").over(w.orderBy("_b")) - F.col("n")})
    cut = F.floor(F.col("all") / share)
    middle = lambda below, n: F.greatest(F.lit(0), F.least(below + n, F.col("all") - cut) - F.greatest(below, cut))
    bins = bins.withColumn("k", middle(F.col("below"), F.col("n")))
    whole = bins.filter("k = n").select("_k", "all", F.col("s").alias("part"), "k")
    part = rows.join(bins.filter("k > 0 and k < n").select("_k", "_b", "all", "below"), ["_k", "_b"]).groupBy("_k", "_b", "_v", "all", "below").agg(F.count("*").alias("m"))
    part = part.withColumn("at", F.col("below") + F.sum("m").over(W.partitionBy("_k", "_b").orderBy("_v")) - F.col("m")).withColumn("k", middle(F.col("at"), F.col("m")))
    both = whole.unionByName(part.select("_k", "all", (F.col("_v") * F.col("k")).alias("part"), "k"))
    means = both.groupBy("_k").agg((F.sum("part") / F.nullif(F.sum("k"), F.lit(0))).alias("mean"), F.max("all").alias("n"))
    groups = df.filter(missing(value).isNotNull()).select(*keys).distinct().withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return groups.join(means, "_k").select(*keys, F.when(F.col("n") >= least, F.col("mean")).alias("trimmed_mean"), "n")


def end_shift(df: DataFrame, keys: list[str], value: str, order: list[str], n: int) -> DataFrame:
    """Mean of the last n values less the mean of the first n; Spark keeps n rows a key in the map tasks."""
    rows = df.filter(missing(value).isNotNull())
    w = W.partitionBy(*keys)
    end = lambda by: rows.withColumn("_r", F.row_number().over(w.orderBy(*by))).filter(F.col("_r") <= n)
    first = end([F.col(c) for c in order]).groupBy(*keys).agg(F.avg(value).alias("_f"))
    last = end([F.col(c).desc() for c in order]).groupBy(*keys).agg(F.avg(value).alias("_l"))
    return first.join(last, keys).select(*keys, (F.col("_l") - F.col("_f")).alias("shift"))


def group_difference_from_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds centre, the median of the group, and departure from it."""
    centre = group_quantiles(df, keys, value, [0.5], ["centre"]).drop("n")
    return df.join(centre, keys).withColumn("departure", F.col(value) - F.col("centre"))


def common_mode(df: DataFrame, day: str, value: str, least: int = 15, places: int = 2) -> DataFrame:
    """Median of all stations' residuals per day and their number; null with fewer than ``least``."""
    out = df.groupBy(day).agg(F.median(missing(value)).alias("m"), F.count(missing(value)).alias("n"))
    return out.select(day, F.when(F.col("n") >= least, F.bround("m", places)).alias("common_mode"), "n")


def votes_by_day(df: DataFrame, day: str, dominant: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """Share of dominant votes per day: decided above the share, partial below it, incomplete with few votes."""
    out = df.groupBy(day).agg(F.count(dominant).alias("n_votes"), F.count_if(dominant).alias("n_dominant"))
    s = F.try_divide("n_dominant", "n_votes")
    return out.select(day, "n_votes", "n_dominant", s.alias("share"), F.when(F.col("n_votes") < least, "incomplete").when(s >= share, "decided").when(F.col("n_dominant") > 0, "partial").otherwise("").alias("status"))


def incomplete_newest(counts: DataFrame, day: str, n: str, newest: int = 3, base: int = 14, share: float = 0.7, least: int = 7) -> DataFrame:
    """Of the newest days those with fewer than ``share`` of the median of the ``base`` days before."""
    rows = counts.withColumn("_r", F.row_number().over(W.orderBy(F.col(day).desc())))
    level = rows.filter(F.col("_r").between(newest + 1, newest + base)).agg(F.median(n).alias("_m"), F.count("*").alias("_k"))
    return rows.filter(F.col("_r") <= newest).join(level, F.col("_k") >= least).filter(F.col(n) < share * F.col("_m")).select(day, n)


def window_gates(df: DataFrame, keys: list[str], t: str, value: str, start: float, end: float, *, least: int = 5, cover: float = 0.8) -> DataFrame:
    """Per key the epochs in [start, end), their span and whether enough of the window is covered."""
    inside = (F.col(t) >= start) & (F.col(t) < end) & missing(value).isNotNull()
    at = F.when(inside, F.col(t))
    out = df.groupBy(*keys).agg(F.count(at).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    return out.withColumn("passes", (F.col("n") >= least) & (F.coalesce("span", F.lit(0.0)) >= cover * (end - start)))
