"""Implausible spikes, stuck values and impossible readings, judged by each series itself.

Impossible readings are found by a filter. The rest is repartitioned by series and sorted by time
within the partitions; a task goes through its rows in stretches of whole series and computes, for
all series of a stretch at once, the levels of the neighbours before and after each epoch, the
series' usual scatter, and the tail cutoff: a generalised Pareto distribution is fitted to each
series' standardised residuals over a threshold (peaks over threshold, probability-weighted
moments), and its quantile at a fixed risk is the cutoff, held within ``bounds`` usual scatters.

The epochs of series longer than ``STRETCH`` are numbered in order and judged in stretches of that
many, so that no series is held by one task. A stretch has a margin of as many epochs on both sides
as an epoch is judged by, and the usual scatter, usual sigma and cutoff are those of the whole
series, selected exactly from its values counted in bins: the result is that of the series unsplit.

Defined results: null y, sigma or both raise no issue of that value; rows without a time are only
tested for impossible values; an epoch delivered again is flagged with each of its rows and counts
once; a constant series has no spikes; series with fewer than three epochs on a side of an
epoch leave that epoch's y unjudged; null parts of a key make a series of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.session import written

STRETCH = 200_000
NEIGHBOURS = 9
LIMIT_MM = 1_000_000.0
STUCK = 6
RISK = 1e-6
BOUNDS = (6.5, 8.0)
SHARE = 0.1
SCATTER_OF_STEP = 1.4826 / np.sqrt(2)
STEP, SIGMA, DEVIATION = 0, 1, 2


def _group_median(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of each group, NaN for empty groups."""
    order = np.lexsort((values, group))
    values, count = values[order], np.bincount(group, minlength=n)
    start = np.cumsum(count) - count
    out = np.full(n, np.nan)
    has = count > 0
    a, b = start[has] + (count[has] - 1) // 2, start[has] + count[has] // 2
    out[has] = (values[a] + values[b]) / 2
    return out


def _levels(y: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians of up to k epochs before, after, and both, NaN with fewer than three."""
    n = len(y)
    side = {}
    for sign in (-1, 1):
        table = np.full((n, k), np.nan)
        for j in range(1, min(k, n - 1) + 1):
            same = group[j:] == group[:-j]
            if sign < 0:
                table[j:, j - 1] = np.where(same, y[:-j], np.nan)
            else:
                table[:-j, j - 1] = np.where(same, y[j:], np.nan)
        side[sign] = table

    def median(table: np.ndarray) -> np.ndarray:
        table = np.sort(table, axis=1)
        count = (~np.isnan(table)).sum(1)
        rows = np.arange(n)
        out = (table[rows, np.maximum(count - 1, 0) // 2] + table[rows, np.minimum(count // 2, table.shape[1] - 1)]) / 2
        out[count < 3] = np.nan
        return out

    return median(side[-1]), median(side[1]), median(np.hstack([side[-1], side[1]]))


def tail_cutoffs(z: np.ndarray, group: np.ndarray, n: int, *, risk: float, bounds: tuple[float, float], share: float = SHARE) -> np.ndarray:
    """Per group the value that standardised residuals exceed with probability ``risk``.

    The largest ``share`` of a group's residuals, up to the upper bound, exceed its threshold.
    """
    low, high = bounds
    usual = z <= high
    z, group = z[usual], group[usual]
    order = np.lexsort((z, group))
    z, group = z[order], group[order]
    count = np.bincount(group, minlength=n)
    end = np.cumsum(count)
    m = np.floor(count * share).astype(np.int64)
    cut = np.full(n, high)
    ok = m >= 10
    if not ok.any():
        return cut
    threshold = np.zeros(n)
    threshold[ok] = z[end[ok] - m[ok] - 1]
    rank_from_end = end[group] - np.arange(len(z))  # 1 is the largest
    top = (rank_from_end <= m[group]) & ok[group]
    g, excess = group[top], z[top] - threshold[group[top]]
    # Probability-weighted moments of the excesses.
    above = (rank_from_end[top] - 1) / np.maximum(m[g] - 1, 1)
    b0 = np.bincount(g, excess, n) / np.maximum(m, 1)
    a1 = np.bincount(g, excess * above, n) / np.maximum(m, 1)
    cut[ok] = _cutoffs(threshold, b0, a1, count, m, risk=risk, bounds=bounds)[ok]
    return cut


def _cutoffs(threshold: np.ndarray, b0: np.ndarray, a1: np.ndarray, count: np.ndarray, m: np.ndarray, *, risk: float, bounds: tuple[float, float]) -> np.ndarray:
    """The cutoffs of groups of ``count`` whose ``m`` excesses have the probability-weighted moments b0 and a1."""
    low, high = bounds
    with np.errstate(all="ignore"):
        shape = np.clip(2 - b0 / (b0 - 2 * a1), -0.5, 0.25)
        scale = np.maximum(2 * b0 * a1 / (b0 - 2 * a1), 1e-12)
        odds = np.maximum(risk * count / np.maximum(m, 1), 1e-300)
        far = np.where(np.abs(shape) < 1e-6, -scale * np.log(odds), scale / np.where(np.abs(shape) < 1e-6, 1, shape) * (odds**-shape - 1))
        return np.clip(np.nan_to_num(threshold + far, nan=high), low, high)


def _once(group: np.ndarray, t: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows are the first of their group and time."""
    return np.append(True, (group[rows[1:]] != group[rows[:-1]]) | (t[rows[1:]] != t[rows[:-1]])) if len(rows) else np.zeros(0, bool)


def issues(group: np.ndarray, t: np.ndarray, y: np.ndarray, sigma: np.ndarray, *, given: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, stuck: int = STUCK, times: float = 8.0, risk: float = RISK, bounds: tuple[float, float] = BOUNDS) -> np.ndarray:
    """0, 1 (stuck) or 2 (spike) for rows in order of group and time; NaN is null. No impossible rows.

    ``given`` has the usual sigma, usual scatter and cutoff of each group, where they are not the group's own.
    """
    n_groups = int(group[-1]) + 1 if len(group) else 0
    out = np.zeros(len(y), np.int8)
    sig = np.isfinite(sigma)
    if sig.any():
        rows = np.flatnonzero(sig)
        once = rows[_once(group, t, rows)]
        usual = given[0] if given else _group_median(sigma[once], group[once], n_groups)
        with np.errstate(invalid="ignore"):
            out[sig & (sigma > times * usual[group])] = 2
    rows = np.flatnonzero(np.isfinite(y))
    if not len(rows):
        return out
    new = _once(group, t, rows)
    epoch_of_row = np.cumsum(new) - 1
    e = rows[new]
    v, g = y[e], group[e]
    joined = np.append(False, (v[1:] == v[:-1]) & (g[1:] == g[:-1]))
    run = np.cumsum(~joined) - 1
    long = np.bincount(run)[run] >= stuck
    before, after, both = _levels(v, g, NEIGHBOURS)
    if given:
        _, scatter, cutoff = given
    else:
        step = np.abs(np.diff(v))[g[1:] == g[:-1]]
        step_group = g[1:][g[1:] == g[:-1]]
        scatter = _group_median(step, step_group, n_groups)
        flat = scatter == 0
        if flat.any():
            moved = step > 0
            scatter = np.where(flat, _group_median(step[moved], step_group[moved], n_groups), scatter)
        scatter *= SCATTER_OF_STEP
        z = np.abs(v - both) / scatter[g]
        fit = np.isfinite(z)
        cutoff = tail_cutoffs(z[fit], g[fit], n_groups, risk=risk, bounds=bounds)
    own, ep = y[rows], epoch_of_row
    with np.errstate(invalid="ignore"):
        from_before, from_after = own - before[ep], own - after[ep]
        apart = np.minimum(np.abs(from_before), np.abs(from_after))
        spike = (from_before * from_after > 0) & (apart > cutoff[g[ep]] * scatter[g[ep]])
    out[rows[spike]] = 2
    out[rows[long[ep] & (own == v[ep])]] = 1
    return out


def _judged(judge: dict) -> Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]:
    def run(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).to_numpy()
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        given = tuple(col(c)[first] for c in ("usual", "scatter", "cutoff")) if "cutoff" in table.column_names else None
        found = issues(group, col("t"), col("y"), col("sigma"), given=given, **judge)
        hit = np.flatnonzero((found > 0) & col("own"))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(col("rec_id")[hit]), pa.array(np.array([None, "stuck", "spike"], object)[found[hit]], pa.string())], names=["rec_id", "issue"])

    return run


def _valued(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a series' statistics are taken from: the steps, sigmas and deviations of the stretches' own epochs.

    A value's bin is made of its leading bits and orders as the values do.
    """
    t, y, sigma, home = (table.column(c).to_numpy() for c in ("t", "y", "sigma", "home"))
    rows = np.flatnonzero(np.isfinite(sigma))
    once = rows[_once(group, t, rows)]
    once = once[home[once]]
    at, kind, value = [once], [np.full(len(once), SIGMA, np.int32)], [sigma[once]]
    rows = np.flatnonzero(np.isfinite(y))
    e = rows[_once(group, t, rows)]
    if len(e):
        v, g = y[e], group[e]
        step = np.append(np.nan, np.where(g[1:] == g[:-1], np.abs(np.diff(v)), np.nan))
        for k, x in ((STEP, step), (DEVIATION, np.abs(v - _levels(v, g, NEIGHBOURS)[2]))):
            use = home[e] & np.isfinite(x)
            at, kind, value = [*at, e[use]], [*kind, np.full(use.sum(), k, np.int32)], [*value, x[use]]
    rows, v = np.concatenate(at), np.concatenate(value)
    k1, k2 = (table.column(c).to_numpy()[rows] for c in ("k1", "k2"))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, np.concatenate(kind), (v.view(np.int64) >> 40).astype(np.int32), v)], names=["k1", "k2", "kind", "bin", "v"])


def _through(batches: Iterator[pa.RecordBatch], rows_at_once: int, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand sorted batches on in stretches of whole groups."""
    kept: list[pa.RecordBatch] = []
    held = 0

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        keys = [table.column(c).to_numpy() for c in ("k1", "k2", "stretch")]
        yield from work(table, np.cumsum(np.append(False, np.any([k[1:] != k[:-1] for k in keys], axis=0))))

    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held < rows_at_once:
            continue
        table = pa.Table.from_batches(kept)
        keys = [table.column(c).to_numpy() for c in ("k1", "k2", "stretch")]
        inner = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if not len(inner):
            continue
        stop = int(inner[-1]) + 1
        yield from run(table.slice(0, stop))
        kept = table.slice(stop).combine_chunks().to_batches()
        held = table.num_rows - stop
    if kept:
        yield from run(pa.Table.from_batches(kept))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of series and time, values before nulls, with the partition and its count of epochs with a value so far."""
    part, count, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, t = (batch.column(c).to_numpy() for c in ("k1", "k2", "t"))
        has = np.flatnonzero(batch.column("y").is_valid().to_numpy(zero_copy_only=False))
        new = np.zeros(batch.num_rows, np.int64)
        if len(has):
            a, b = has[1:], has[:-1]
            new[a] = (k1[a] != k1[b]) | (k2[a] != k2[b]) | (t[a] != t[b])
            new[has[0]] = last != (k1[has[0]], k2[has[0]], t[has[0]])
            last = (k1[has[-1]], k2[has[-1]], t[has[-1]])
        number = count + np.cumsum(new)
        count = int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(number)], names=[*batch.schema.names, "part", "number"])


def _in_stretches(rows: DataFrame, margin: int, parts: int) -> DataFrame:
    """Rows of long series with their stretch (home) and as margins of others, stretches being counted in epochs with a value."""
    order = ["k1", "k2", "t"]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("y").isNull(), "rec_id")
    numbered = written(sorted_rows.mapInArrow(_numbered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, number long"), "long-series-numbered")
    # One row a partition: the epochs in those before it.
    before = numbered.groupBy("part").agg(F.max("number").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).drop("n")
    rows = numbered.join(before, "part").withColumn("number", F.col("number") + F.col("before"))
    of = lambda shift: F.floor((F.col("number") + shift) / STRETCH)
    rows = rows.withColumns({"home_of": of(0), "stretch": F.explode(F.sequence(of(-margin), of(margin)))}).withColumn("home", F.col("stretch") == F.col("home_of"))
    return rows.withColumn("own", ~F.col("bad") & F.col("home")).select("k1", "k2", "stretch", "t", "rec_id", "y", "sigma", "own", "home")


def _series_statistics(values: DataFrame, *, risk: float, bounds: tuple[float, float]) -> DataFrame:
    """k1, k2, usual, scatter and cutoff from the values of whole series, exactly.

    Values are counted in bins; only the bins that hold the wanted ranks are looked into, and equal
    values count as one row.
    """
    series = ["k1", "k2"]
    sides = values.filter(F.col("kind") != DEVIATION)
    w = W.partitionBy(*series, "kind")
    n_zero = F.sum((F.col("v") == 0).cast("long"))
    bins = sides.groupBy(*series, "kind", "bin").agg(F.count("*").alias("n"), n_zero.alias("zeros"))
    bins = bins.withColumns({"all": F.sum("n").over(w), "zeros": F.sum("zeros").over(w), "below": F.sum("n").over(w.orderBy("bin")) - F.col("n")})
    # Where the median is zero, it is taken of the values above zero.
    bins = bins.withColumn("from", F.when(F.col("zeros") > F.floor(F.col("all") / 2), F.col("zeros")).otherwise(F.lit(0))).filter(F.col("from") < F.col("all"))
    bins = bins.withColumns({"r1": F.col("from") + F.floor((F.col("all") - F.col("from") - 1) / 2), "r2": F.col("from") + F.floor((F.col("all") - F.col("from")) / 2)})
    bins = bins.filter((F.col("below") <= F.col("r2")) & (F.col("below") + F.col("n") > F.col("r1"))).select(*series, "kind", "bin", "below", "r1", "r2")
    near = sides.join(bins, [*series, "kind", "bin"]).groupBy(*series, "kind", "bin", "below", "r1", "r2", "v").agg(F.count("*").alias("n"))
    near = near.withColumn("b", F.col("below") + F.sum("n").over(W.partitionBy(*series, "kind", "bin").orderBy("v")) - F.col("n"))
    ranked = lambda r: F.max(F.when((F.col("b") <= F.col(r)) & (F.col("b") + F.col("n") > F.col(r)), F.col("v")))
    medians = near.groupBy(*series, "kind").agg(((ranked("r1") + ranked("r2")) / 2).alias("median"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("median")))
    usual = written(medians.groupBy(*series).agg(of(SIGMA).alias("usual"), (of(STEP) * float(SCATTER_OF_STEP)).alias("scatter")), "long-series-usual")

    # The largest share of the standardised residuals up to the upper bound, by rank from the end.
    z = values.filter(F.col("kind") == DEVIATION).join(usual, series).withColumn("z", F.col("v") / F.col("scatter")).filter(F.col("z") <= bounds[1])
    w = W.partitionBy(*series)
    tops = z.groupBy(*series, "bin").agg(F.count("*").alias("n")).withColumns({"all": F.sum("n").over(w), "above": F.sum("n").over(w.orderBy(F.desc("bin"))) - F.col("n")})
    tops = tops.withColumn("m", F.floor(F.col("all") * SHARE)).filter((F.col("m") >= 10) & (F.col("above") <= F.col("m"))).select(*series, "bin", "all", "above", "m")
    top = z.join(tops, [*series, "bin"]).groupBy(*series, "bin", "all", "above", "m", "v", "z").agg(F.count("*").alias("n"))
    top = top.withColumn("a", F.col("above") + F.sum("n").over(W.partitionBy(*series, "bin").orderBy(F.desc("v"))) - F.col("n"))
    top = top.withColumn("k", F.greatest(F.lit(0), F.least("n", F.col("m") - F.col("a"))).cast("double"))
    sums = top.groupBy(*series, "all", "m").agg(
        F.max(F.when((F.col("a") <= F.col("m")) & (F.col("a") + F.col("n") > F.col("m")), F.col("z"))).alias("threshold"),
        F.sum(F.col("z") * F.col("k")).alias("s0"), F.sum(F.col("z") * (F.col("k") * F.col("a") + F.col("k") * (F.col("k") - 1) / 2)).alias("s1"),
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, m, threshold, s0, s1 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("all", "m", "threshold", "s0", "s1"))
            b0, a1 = s0 / m - threshold, (s1 / (m - 1) - threshold * m / 2) / m
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(_cutoffs(threshold, b0, a1, count, m, risk=risk, bounds=bounds))], names=["k1", "k2", "cutoff"])

    cutoffs = sums.mapInArrow(fitted, "k1 long, k2 long, cutoff double")
    return written(usual.join(cutoffs, series, "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(bounds[1]))), "long-series-statistics")


def implausible(epochs: DataFrame, *, series: tuple[str, ...] = ("station", "session_code", "component"), rec_id: str = "rec_id", t: str = "t", y: str = "y", sigma: str = "sigma", limit: float = LIMIT_MM, rows_at_once: int = 100_000, **judge: object) -> DataFrame:
    """rec_id and issue (impossible, stuck, spike) of the rows concerned; at most one a row."""
    infinite = float("inf")
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    # The series by two independent 64-bit hashes, which sort and compare faster than its names.
    rows = epochs.select(
        F.col(rec_id).alias("rec_id"), F.xxhash64(*series).alias("k1"), F.xxhash64(F.lit(7), *reversed(series)).alias("k2"), F.col(t).cast("double").alias("t"), number(y).alias("y"), number(sigma).alias("sigma")
    )
    bad = F.coalesce((F.col("sigma") <= 0) | (F.col("sigma") == infinite), F.lit(False)) | F.coalesce(F.abs("y") > limit, F.lit(False))
    impossible = rows.filter(bad).select("rec_id", F.lit("impossible").alias("issue"))
    # A row that is impossible by its sigma alone still holds a value between its neighbours.
    usable = rows.withColumns({"bad": bad, "y": F.when(F.abs("y") <= limit, F.col("y")), "sigma": F.when(~bad, F.col("sigma"))}).filter("t is not null and not isnan(t) and (y is not null or sigma is not null)")
    sizes = usable.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    long = written(sizes.filter(F.col("n") > STRETCH), "long-series")
    tasks = int(epochs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_long = long.agg(F.sum("n")).head()[0] or 0

    def by_stretch(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        rows = rows.repartition(tasks, "k1", "k2", "stretch").sortWithinPartitions("k1", "k2", "stretch", "t", "rec_id")
        return rows.mapInArrow(lambda batches: _through(batches, rows_at_once, work), schema)

    short = usable.join(long, ["k1", "k2"], "left_anti") if n_long else usable
    rows = short.select("k1", "k2", F.lit(0).alias("stretch"), "t", "rec_id", "y", "sigma", (~F.col("bad")).alias("own"))
    judged = impossible.unionByName(by_stretch(rows, _judged(judge), "rec_id long, issue string"))
    if not n_long:
        return judged
    whole = usable.join(long, ["k1", "k2"], "left_semi").select("k1", "k2", "t", "rec_id", "y", "sigma", "bad")
    stretches = _in_stretches(whole, NEIGHBOURS + judge.get("stuck", STUCK), max(tasks, -(-n_long // STRETCH)))
    values = written(by_stretch(stretches, _valued, "k1 long, k2 long, kind int, bin int, v double"), "long-series-values")
    usual = _series_statistics(values, risk=judge.get("risk", RISK), bounds=judge.get("bounds", BOUNDS))
    return judged.unionByName(by_stretch(stretches.join(usual, ["k1", "k2"], "left"), _judged(judge), "rec_id long, issue string"))
