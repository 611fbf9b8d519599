"""Screens and lookups of station series: sigma screens with a reference, declared rules, epochs beside others.

Rules are small tables with one row a rule; they meet the series by equi joins on the station, and
nothing is collected but a station's own few rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions.geo import number
from seiche.operators.windows import first_per_key, smallest_sigma


def first_samples(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n a key in the map tasks before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def offsets(df: DataFrame, keys: list[str], t: str, value: str, sigma: str, *, samples: int = 5, window: tuple[float, float] | None = None) -> DataFrame:
    """keys, offset: the mean weighted by 1/sigma of a window [from, to) or of the first samples; null where there are none."""
    rows = df.filter(number(value).isNotNull() & (number(sigma) > 0))
    rows = rows.filter((F.col(t) >= window[0]) & (F.col(t) < window[1])) if window else first_samples(rows, keys, [t], samples)
    return rows.groupBy(*keys).agg((F.sum(F.col(value) / F.col(sigma)) / F.sum(1 / F.col(sigma))).alias("offset"))


def screened(df: DataFrame, keys: list[str], t: str, value: str, sigma: str, *, most: float, scale: float = 1.0, samples: int = 5, window: tuple[float, float] | None = None, offset: DataFrame | None = None) -> DataFrame:
    """Rows with sigma below ``most``, scaled, less their offset (that of ``offset`` where it is given).

    For plots the scale turns metres into millimetres and the screen is in millimetres; for text
    products the reference is a window or the first samples.
    """
    rows = df.withColumns({value: F.col(value) * scale, sigma: F.col(sigma) * scale}).filter(number(sigma) < most)
    offset = offsets(rows, keys, t, value, sigma, samples=samples, window=window) if offset is None else offset
    return rows.join(offset, keys, "left").withColumn(value, F.col(value) - F.coalesce("offset", F.lit(0.0)))


def segments_excluded(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Each segment (station, file, last_epoch) with ``excluded``, the reason of the first rule that applies.

    A rule applies by the name of the folder, or where the last epoch lies before its year.
    """
    folder = F.element_at(F.split("file", "/"), -2)
    hit = (F.col("drop_dir").isNotNull() & (folder == F.col("drop_dir"))) | (F.col("drop_before_year").isNotNull() & (F.col("last_epoch") < F.col("drop_before_year")))
    found = segments.join(rules, "station").filter(F.coalesce(hit, F.lit(False))).groupBy("station", "file").agg(F.min(F.struct("rule_no", "reason")).getField("reason").alias("excluded"))
    return segments.join(found, ["station", "file"], "left")


def junctions_applied(series: DataFrame, rules: DataFrame, *, station: str = "station", component: str = "component", t: str = "t", y: str = "y", offset: str = "offset_m") -> DataFrame:
    """Adds to y the offsets of all rules of the station and component whose year lies after the epoch.

    A station has a few rules: they are one small array, summed within the row.
    """
    few = rules.groupBy(F.col("station").alias(station), F.col("component").alias(component)).agg(F.collect_list(F.struct("before_year", F.col(offset).alias("offset"))).alias("_rules"))
    total = F.aggregate(F.filter("_rules", lambda r: F.col(t) < r["before_year"]), F.lit(0.0), lambda s, r: s + r["offset"])
    return series.join(few, [station, component], "left").withColumn(y, F.col(y) + F.coalesce(total, F.lit(0.0))).drop("_rules")


def junctions_apply(product: str, hours: int = 24, products: tuple[str, ...] = ("plate", "itrf2008")) -> bool:
    """Reviewed offsets hold for two frames' daily sets only."""
    return product in products and hours == 24


def cut_at_steps(df: DataFrame, keys: list[str], t: str, steps: DataFrame, epoch: float, half_years: float) -> DataFrame:
    """Rows within ``half_years`` of an epoch on the epoch's side of every step (keys, step) of their key."""
    near = df.filter(F.abs(F.col(t) - epoch) <= half_years)
    inside = steps.filter(F.abs(F.col("step") - epoch) <= half_years)
    before, after = F.when(F.col("step") > epoch, F.col("step")), F.when(F.col("step") <= epoch, F.col("step"))
    edges = inside.groupBy(*keys).agg(F.max(after).alias("_from"), F.min(before).alias("_to"))
    rows = near.join(edges, keys, "left")
    return rows.filter((F.col("_from").isNull() | (F.col(t) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(t) < F.col("_to")))).drop("_from", "_to")


def step_declared(epochs: DataFrame, steps: DataFrame, keys: list[str], epoch: str = "epoch", within: float = 1e-3) -> DataFrame:
    """Each epoch with ``declared``, the nearest declared step of its key within a thousandth of a year."""
    own = steps.select(*keys, F.col("step").alias("_s"))
    pairs = epochs.join(own, keys).filter(F.abs(F.col(epoch) - F.col("_s")) <= within)
    best = pairs.groupBy(*keys, epoch).agg(F.min(F.struct(F.abs(F.col(epoch) - F.col("_s")), "_s")).getField("_s").alias("declared"))
    return epochs.join(best, [*keys, epoch], "left")


def with_nearby_epoch(positions: DataFrame, view: DataFrame, keys: list[str], t: str, within: float) -> DataFrame:
    """Rows that have an epoch of the view within the tolerance (inclusive): a semi join by buckets of it."""
    bucket = lambda c: F.floor(F.col(c) / (2 * within)).cast("long")
    rows = positions.withColumn("_b", bucket(t))
    other = view.select(*keys, F.col(t).alias("_v")).withColumn("_b", F.explode(F.array(bucket("_v") - 1, bucket("_v"), bucket("_v") + 1))).distinct()
    on = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in [*keys, "_b"]] + [F.abs(F.col(f"r.{t}") - F.col("o._v")) <= within]
    return rows.alias("r").join(other.alias("o"), on, "left_semi").drop("_b")


def nearest_epoch(df: DataFrame, keys: list[str], t: str, epoch: float) -> DataFrame:
    """The row of each key nearest to an epoch, the earlier of two."""
    return first_per_key(df.filter(F.col(t).isNotNull()), keys, [F.abs(F.col(t) - epoch), F.col(t)])


def data_ends(df: DataFrame, keys: list[str], t: str, end: float, days: float = 1.5) -> DataFrame:
    """keys, data_end: the last epoch before ``end`` where the data stop more than ``days`` before it and nothing follows, else null."""
    out = df.groupBy(*keys).agg(F.max(F.when(F.col(t) < end, F.col(t))).alias("_last"), F.max(t).alias("_any"))
    stops = (F.col("_last") < end - days / 365.25) & (F.col("_any") < end)
    return out.select(*keys, F.when(stops, F.col("_last")).alias("data_end"))


def per_component(df: DataFrame, keys: list[str], t: str, component: str, value: str, sigma: str, position: str) -> DataFrame:
    """The series with, for each component by itself, the row of least sigma of an epoch."""
    return smallest_sigma(df.filter(F.col(t).isNotNull()), [*keys, component, t], sigma, position)


def gathered(df: DataFrame, keys: list[str], t: str, sigma: str, position: str) -> DataFrame:
    """The rows of least sigma of each epoch with ``place``, their place in order of time."""
    best = smallest_sigma(df.filter(F.col(t).isNotNull()), [*keys, t], sigma, position)
    return best.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(t)))


def exact_displacement(df: DataFrame, keys: list[str], day: str, value: str, sigma: str, start: object, end: object) -> DataFrame:
    """keys, displacement, sigma: the value on the end date less that on the start date; null where a date is missing."""
    at = lambda c, d: F.max(F.when(F.col(day) == F.lit(d).cast("date"), F.col(c)))
    return df.groupBy(*keys).agg((at(value, end) - at(value, start)).alias("displacement"), F.hypot(at(sigma, end), at(sigma, start)).alias("sigma"))


def station_events(stations: DataFrame, events: DataFrame, areas: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events (name, kind, onset, regions) of the kinds that touch an area of each station; an unknown area touches none."""
    wanted = events.filter(F.col("kind").isin(*kinds)).select("name", "kind", "onset", F.explode("regions").alias("area"))
    return stations.join(areas, "station").join(wanted, "area").select("station", "name", "kind", "onset").distinct()


def joined_candidates(candidates: DataFrame, joins: DataFrame) -> DataFrame:
    """Moved stations as one: the members (joined, member, place) of a join become one row at its last member, over all their time.

    ``candidates``: station, lon, lat, first, last. Members that are missing are left out; stations of no join stay.
    """
    rows = candidates.join(joins.withColumnRenamed("member", "station"), "station", "left")
    alone = rows.filter("joined is null").select("station", "lon", "lat", "first", "last")
    at = F.max(F.struct("place", "lon", "lat"))
    moved = rows.filter("joined is not null").groupBy("joined").agg(at.alias("at"), F.min("first").alias("first"), F.max("last").alias("last"))
    return alone.unionByName(moved.select(F.col("joined").alias("station"), "at.lon", "at.lat", "first", "last"))


def same_view(records: DataFrame, key: str, detrended: str) -> DataFrame:
    """Keys (baselines) whose ends are of different views, some detrended and some not: to be refused."""
    return records.groupBy(key).agg(F.count_distinct(F.coalesce(F.col(detrended), F.lit(False))).alias("n")).filter("n > 1").select(key)


def within_span(first: Column, last: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """First before (strictly) and last at or after; no span is outside."""
    out = first.isNotNull() & last.isNotNull()
    if before is not None:
        out = out & (first < before)
    if after is not None:
        out = out & (last >= after)
    return F.coalesce(out, F.lit(False))


def stacked_stations(stations: DataFrame, active: set[str], box: tuple[float, float, float, float], station: str = "station") -> DataFrame:
    """Stations inside the box that belong to no active area, in order."""
    from seiche.functions.geo import in_box

    rows = stations.filter(in_box(F.col("lon"), F.col("lat"), *box))
    return rows.filter(~F.col(station).isin(sorted(active))) if active else rows
