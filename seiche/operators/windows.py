"""Order-dependent operators: deduplication, hysteresis, islands, gaps, re-zeroing, rolling baselines.

Every order ends in a column that makes it total, so that results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions.geo import number


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Aggregated as a struct: rows of a hot key are combined in the map tasks."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)])
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def smallest_sigma(df: DataFrame, key: list[str], sigma: str, position: str) -> DataFrame:
    """Per epoch the row of least sigma; a missing sigma counts as infinite, ties keep the first."""
    return first_per_key(df, key, [F.coalesce(number(sigma), F.lit(float("inf"))), F.col(position)])


def best_quality(df: DataFrame, key: list[str], quality: str, position: str, fill: str | None = None) -> DataFrame:
    """Per event the row of best quality (missing lowest, ties the last), ``fill`` from the best row that has it."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(F.coalesce(number(quality), F.lit(float("-inf"))).alias("q"), F.col(position).alias("p"))
    aggs = [F.max_by(F.struct(*rest), rank).alias("_row")]
    if fill:
        aggs.append(F.max_by(fill, F.when(number(fill).isNotNull(), rank)).alias("_fill"))
    out = df.groupBy(*key).agg(*aggs)
    return out.select(*key, *[(F.coalesce(number(F.col(f"_row.{c}")), F.col("_fill")) if c == fill else F.col(f"_row.{c}")).alias(c) for c in rest])


def hysteresis(start: Column, stay: Column, known: Column, partition: list[str], order: list[str]) -> Column:
    """Inside from a start until a known row that does not stay; unknown rows keep the state but are not flagged."""
    state = F.when(F.coalesce(start, F.lit(False)), 1).when(known & ~F.coalesce(stay, F.lit(False)), 0)
    inside = F.last(state, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (F.coalesce(inside, F.lit(0)) == 1) & known


def bridged(flag: Column, day: Column, partition: list[str], order: list[str], max_gap: int) -> Column:
    """Also flags the days between two flagged ones at most ``max_gap`` apart."""
    w = W.partitionBy(*partition).orderBy(*order)
    marked = F.when(flag, day)
    before = F.last(marked, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(marked, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return flag | F.coalesce(after - before <= max_gap + 1, F.lit(False))


def islands(df: DataFrame, partition: list[str], time: str, gap_s: float, position: str) -> DataFrame:
    """Runs of rows no more than ``gap_s`` apart: partition, island, first, last, n."""
    w = W.partitionBy(*partition).orderBy(time, position)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_s).cast("int"), F.lit(1))
    rows = df.filter(F.col(time).isNotNull()).withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*partition, "island").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def episodes(df: DataFrame, partition: list[str], day: str, start: str, stay: str, max_gap: int) -> DataFrame:
    """Runs of staying days bridged over gaps of at most ``max_gap`` days that hold a start day.

    They reach back over staying days without a gap and forward to the last staying day: rows
    before the first start that are separated by a gap do not belong to the episode.
    """
    on = df.filter(F.coalesce(F.col(stay), F.lit(False)) | F.coalesce(F.col(start), F.lit(False)))
    w = W.partitionBy(*partition).orderBy(day)
    step = F.datediff(F.col(day), F.lag(day).over(w))
    on = on.withColumn("_run", F.coalesce((step > max_gap + 1).cast("int"), F.lit(1))).withColumn("_tight", F.coalesce((step > 1).cast("int"), F.lit(1)))
    on = on.withColumns({"_run": F.sum("_run").over(w.rowsBetween(W.unboundedPreceding, 0)), "_tight": F.sum("_tight").over(w.rowsBetween(W.unboundedPreceding, 0))})
    begun = on.groupBy(*partition, "_run").agg(F.min_by("_tight", F.when(F.col(start), F.col(day))).alias("_from"))
    on = on.join(begun, [*partition, "_run"]).filter(F.col("_tight") >= F.col("_from"))
    return on.groupBy(*partition, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last")).drop("_run")


def rezeroed(value: Column, partition: list[str], order: list[str]) -> Column:
    """The value less the first one that is not missing."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return number(value) - F.first(number(value), ignorenulls=True).over(w)


def gap_seconds(time: str, partition: list[str], position: str) -> Column:
    w = W.partitionBy(*partition).orderBy(time, position)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    return (t - F.lag(t).over(w)) / 1e6


def largest_gap(df: DataFrame, partition: list[str], time: str, position: str) -> DataFrame:
    """The largest time between consecutive rows of each partition, in seconds; null for one row."""
    return df.withColumn("_g", gap_seconds(time, partition, position)).groupBy(*partition).agg(F.max("_g").alias("largest_gap_s"))


def rolling_quantile(value: str, quantile: float, partition: list[str], day_number: str, half_days: int, least: int) -> Column:
    """Exact quantile over a centred window of days, null with fewer than ``least`` values."""
    w = W.partitionBy(*partition).orderBy(day_number).rangeBetween(-half_days, half_days)
    return F.when(F.count(value).over(w) >= least, F.percentile(F.col(value), F.lit(quantile)).over(w))


def day_spine(df: DataFrame, partition: list[str], day: str) -> DataFrame:
    """One row for every day from a partition's first to its last."""
    span = df.groupBy(*partition).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return span.select(*partition, F.explode(F.sequence("_a", "_b")).alias(day))


def mad_kept(df: DataFrame, partition: list[str], value: str, times: float, floor: float = 0.0) -> DataFrame:
    """Rows within ``times`` scaled median absolute deviations of their group's median.

    Two exact medians joined back by group, by bins of values where a group is large.
    """
    from seiche.operators import aggregates

    rows = df.withColumn("_v", number(value))
    small = aggregates._largest(rows, partition, F.col("_v")) <= aggregates.VALUES_IN_ONE_BUFFER

    def medians(of: DataFrame, column: str, name: str) -> DataFrame:
        return of.groupBy(*partition).agg(F.median(column).alias(name)) if small else aggregates.group_quantiles(of, partition, column, [0.5], [name]).drop("n")

    rows = rows.join(medians(rows, "_v", "_m"), partition).withColumn("_d", F.abs(F.col("_v") - F.col("_m")))
    return rows.join(medians(rows, "_d", "_s"), partition).filter(F.col("_d") <= times * F.greatest(1.4826 * F.col("_s"), F.lit(floor))).drop("_v", "_m", "_s", "_d")


def ramp_removed(value: str, rate: Column, time_years: str, partition: list[str]) -> Column:
    """The value less a rate times the years since the partition's first epoch."""
    return F.col(value) - rate * (F.col(time_years) - F.min(time_years).over(W.partitionBy(*partition)))


def nearest_days(df: DataFrame, partition: list[str], day: str, target: str, n: int) -> DataFrame:
    """The n rows nearest in days to a date, earlier first among equals."""
    w = W.partitionBy(*partition).orderBy(F.abs(F.datediff(F.col(day), F.lit(target).cast("date"))), day)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def excursion(df: DataFrame, partition: list[str], day_number: str, value: str, *, half_days: int = 60, quantile: float = 0.2, least: int = 10, scale_days: int = 45, scale_least: int = 20) -> DataFrame:
    """Adds excursion above the rolling lower envelope and noise, the rolling median step scaled to a sigma."""
    w = W.partitionBy(*partition).orderBy(day_number)
    rows = df.withColumn("_step", F.abs(F.col(value) - F.lag(value).over(w)))
    return rows.withColumns(
        {
            "excursion": F.col(value) - rolling_quantile(value, quantile, partition, day_number, half_days, least),
            "noise": rolling_quantile("_step", 0.5, partition, day_number, scale_days // 2, scale_least) * (1.4826 / 2**0.5),
        }
    ).drop("_step")


def bumps(episodes_: DataFrame, days: DataFrame, partition: list[str], day: str, up: str, ratio: str, noise: str, *, flank_days: int = 20, least_ratio: float = 1.2, noise_times: float = 3.0, least_mm: float = 10.0) -> DataFrame:
    """Episodes (first, last) with ``kept`` and ``provisional``: whether the days of one are a bump and not a step or a trend.

    The median ratio inside must exceed ``least_ratio``. With no data after it an episode is kept on that
    alone, provisionally; with none before it is not. Else the median rise above the chord between
    the levels of the flanks, and the 90th percentile above the level after it, must both exceed
    the larger of ``noise_times`` the median noise and ``least_mm``. A day meets the few episodes of its
    partition whose flanks reach it.
    """
    e = episodes_.withColumn("_e", F.struct(*partition, "first", "last"))
    reach = e.select(*partition, "_e", F.explode(F.sequence(F.date_sub("first", flank_days), F.date_add("last", flank_days))).alias(day))
    rows = reach.join(days, [*partition, day])
    d, first, last = F.col(day), F.col("_e.first"), F.col("_e.last")
    before, inside, after = d < first, (d >= first) & (d <= last), d > last
    level = rows.groupBy("_e").agg(
        F.median(F.when(before, number(up))).alias("_b"), F.median(F.when(after, number(up))).alias("_a"), F.median(F.when(inside, number(ratio))).alias("_r"), F.median(F.when(inside, number(noise))).alias("_n"),
        F.percentile(F.when(inside, number(up)), F.lit(0.9)).alias("_p"),
    )
    share = (F.datediff(d, first) + 0.5) / (F.datediff(last, first) + 1)
    chord = F.col("_b") + (F.col("_a") - F.col("_b")) * share
    rise = rows.join(level, "_e").groupBy("_e").agg(F.median(F.when(inside, number(up) - chord)).alias("_rise"))
    need = F.greatest(noise_times * F.col("_n"), F.lit(least_mm))
    out = level.join(rise, "_e")
    strong = F.coalesce(F.col("_r") > least_ratio, F.lit(False))
    bump = F.coalesce((F.col("_rise") > need) & (F.col("_p") - F.col("_a") > need), F.lit(False))
    alone = F.col("_a").isNull()
    return out.select("_e.*", (strong & (alone | (F.col("_b").isNotNull() & bump))).alias("kept"), (strong & alone).alias("provisional"))
