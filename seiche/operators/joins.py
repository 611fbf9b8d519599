"""Joins Spark has no operator for: bands, nearest epochs, valid times, unique keys, neighbours, greedy linkage.

A band join sends one side to the buckets its tolerance touches, so that the rest is an equi join;
the exact condition follows. No side is broadcast unless Spark has measured it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.session import written


def band_join(a: DataFrame, b: DataFrame, ta: str, tb: str, tolerance: float, keys: list[str] = [], strict: bool = False) -> DataFrame:  # noqa: B006
    """Pairs whose numbers differ by at most (or less than) the tolerance; a pair meets in one bucket."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    left = a.filter(F.col(ta).isNotNull()).withColumn("_b", bucket(ta))
    right = b.filter(F.col(tb).isNotNull()).withColumn("_b", F.explode(F.array(bucket(tb) - 1, bucket(tb), bucket(tb) + 1)))
    gap = F.abs(F.col(ta) - F.col(tb))
    return left.join(right, ["_b", *keys]).filter(gap < tolerance if strict else gap <= tolerance).drop("_b")


def nearest_join(a: DataFrame, b: DataFrame, ta: str, tb: str, tolerance: float, a_id: str, keys: list[str] = [], strict: bool = True) -> DataFrame:  # noqa: B006
    """Each a row with the b row nearest in time; ties go to the earlier; b rows may serve again.

    The best pair is an aggregate over a struct, so a hot a row is reduced in the map tasks.
    """
    pairs = band_join(a, b, ta, tb, tolerance, keys, strict)
    rank = F.struct(F.abs(F.col(ta) - F.col(tb)).alias("_gap"), F.col(tb).alias("_at"), F.struct(*pairs.columns).alias("_row"))
    best = pairs.groupBy(a_id).agg(F.min(rank).getField("_row").alias("_row"))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in pairs.columns])


def unique_key_join(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Equal keys that occur once on either side; repeated and null keys join nothing."""

    def once(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r") if rest else F.lit(1).alias("_r"))
        return rows.filter(F.col("_n") == 1).select(F.col(key), *[F.col(f"_r.{c}").alias(c) for c in rest])

    return once(a, key_a).join(once(b, key_b), F.col(key_a) == F.col(key_b))


def ambiguous_keys(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Keys on both sides that are repeated on one of them: key, n_a, n_b."""
    na = a.filter(F.col(key_a).isNotNull()).groupBy(F.col(key_a).alias("key")).agg(F.count("*").alias("n_a"))
    nb = b.filter(F.col(key_b).isNotNull()).groupBy(F.col(key_b).alias("key")).agg(F.count("*").alias("n_b"))
    return na.join(nb, "key").filter("n_a > 1 or n_b > 1")


def valid_at(facts: DataFrame, periods: DataFrame, time: str, start: str, end: str, keys: list[str], closed: bool = True) -> DataFrame:
    """Facts with every period that holds their time: start <= t and end null or t <= end (t < end if not closed)."""
    until = F.col(time) <= F.col(end) if closed else F.col(time) < F.col(end)
    return facts.join(periods, keys).filter((F.col(start) <= F.col(time)) & (F.col(end).isNull() | until))


def step_sums(series: DataFrame, rules: DataFrame, time: str, before: str, amount: str, keys: list[str], out: str) -> DataFrame:
    """Adds the sum of the amounts of all rules of a key whose ``before`` lies after the row's time (strictly).

    Rules are reviewed by hand, a few a key: they are one small array, summed within the row, so that a
    key with a third of all rows needs no task of its own.
    """
    few = rules.groupBy(*keys).agg(F.collect_list(F.struct(F.col(before).alias("at"), F.col(amount).alias("a"))).alias("_rules"))
    total = F.aggregate(F.filter("_rules", lambda r: F.col(time) < r["at"]), F.lit(0.0), lambda s, r: s + r["a"])
    return series.join(few, keys, "left").withColumn(out, F.coalesce(total, F.lit(0.0))).drop("_rules")


def ordinal_join(a: DataFrame, b: DataFrame, keys: list[str], order_a: str, order_b: str, how: str = "left") -> DataFrame:
    """Join on keys and on the row's place among equal keys; null keys are keys."""
    place = lambda order: F.row_number().over(W.partitionBy(*keys).orderBy(order))
    left, right = a.withColumn("_place", place(order_a)), b.withColumn("_place", place(order_b)).withColumnsRenamed({k: f"_r_{k}" for k in keys} | {"_place": "_r_place"})
    on = F.col("_place") == F.col("_r_place")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop("_place", "_r_place", *[f"_r_{k}" for k in keys])


def duplicates_flagged(events: DataFrame, *, row: str, t: str, lat: str, lon: str, automatic: str, quality: str, seconds: float = 2.0, km: float = 10.0) -> DataFrame:
    """row and possible_duplicate of automatic rows with a better solution near in time and place.

    Better is a reviewed one, a higher quality (missing lowest), or at equal quality a later row;
    reviewed rows get null. ``t`` is in seconds.
    """
    from seiche.functions.geo import equirectangular_km

    rows = events.select(F.col(row).alias("row"), F.col(t).alias("t"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(automatic).alias("auto"), F.coalesce(F.nanvl(F.col(quality), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("q"))
    other = rows.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])
    pairs = band_join(rows.filter("auto"), other, "t", "o_t", seconds).filter("row <> o_row")
    near = equirectangular_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= km
    better = ~F.col("o_auto") | (F.col("o_q") > F.col("q")) | ((F.col("o_q") == F.col("q")) & (F.col("o_row") > F.col("row")))
    flagged = pairs.filter(near & better).select("row").distinct().withColumn("_dup", F.lit(True))
    out = rows.join(flagged, "row", "left")
    return out.select("row", F.when(F.col("auto"), F.coalesce("_dup", F.lit(False))).alias("possible_duplicate"))


#: Edges that one task goes through in order (a few MB); more are thinned by rounds first, with the same result.
EDGES_IN_ONE_TASK = 200_000


def greedy_pairs(edges: DataFrame, a: str, b: str, order: list[Column], in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """One-to-one pairs as taking the edges in order, each that still has both ends free.

    Rounds of mutual best edges: an edge that is first for both its ends is accepted and their
    other edges removed. With a total order (it ends in a and b) this is the sequential result; the
    globally first open edge is always mutual best, so every round accepts some. Each round is
    written to the shared folder. Once no more than ``in_one_task`` edges are open, one task takes
    them in order.
    """
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(a).alias("a"), F.col(b).alias("b"))
    open_edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), rank.alias("rank")), "greedy-edges")
    taken: DataFrame | None = None
    while open_edges.count() > in_one_task:
        best_a = open_edges.groupBy("a").agg(F.min("rank").alias("ra"))
        best_b = open_edges.groupBy("b").agg(F.min("rank").alias("rb"))
        won = written(best_a.join(best_b, F.col("ra") == F.col("rb")).select(F.col("ra.a").alias("a"), F.col("ra.b").alias("b")), "greedy-won")
        taken = won if taken is None else taken.unionByName(won)
        open_edges = written(open_edges.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"), "greedy-edges")

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used_a, used_b = set(), set()
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for k, (x, y) in enumerate(zip(pdf["a"], pdf["b"])):
                if x not in used_a and y not in used_b:
                    keep[k] = True
                    used_a.add(x)
                    used_b.add(y)
            yield pdf[keep]

    ends = open_edges.select("a", "b")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.schema)
    last = open_edges.repartition(1).sortWithinPartitions("rank").select("a", "b").mapInPandas(in_order, schema)
    taken = last if taken is None else taken.unionByName(last)
    return taken.select(F.col("a").alias(a), F.col("b").alias(b))


def catalogue_match(a: DataFrame, b: DataFrame, *, seconds: float, km: float, key: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, step: equal unique keys first, then the closest pairs in time and place one to one.

    Both have id, t (seconds), lat, lon. The cost of a pair is (dt/seconds)² + (d/km)², ties by
    |dt|, distance and ids; both tolerances are inclusive.
    """
    from seiche.functions.geo import equirectangular_km

    own = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("t").alias(f"{p}_t"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    left, right = own(a, "a"), own(b, "b")
    pairs = None
    if key:
        by_key = unique_key_join(a.select(F.col("id").alias("a_id"), F.col(key[0]).alias("ka")), b.select(F.col("id").alias("b_id"), F.col(key[1]).alias("kb")), "ka", "kb")
        pairs = written(by_key.select("a_id", "b_id", F.lit("id").alias("step")), "match-by-key")
        left, right = left.join(pairs.select("a_id"), "a_id", "left_anti"), right.join(pairs.select("b_id"), "b_id", "left_anti")
    near = band_join(left, right, "a_t", "b_t", seconds).withColumn("d", equirectangular_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).filter(F.col("d") <= km)
    dt = F.abs(F.col("a_t") - F.col("b_t"))
    found = greedy_pairs(near, "a_id", "b_id", [F.pow(dt / seconds, 2) + F.pow(F.col("d") / km, 2), dt, F.col("d")]).withColumn("step", F.lit("near"))
    return found if pairs is None else pairs.unionByName(found)


def _cell_size(band: Column, size: float | Column) -> Column:
    """Degrees of longitude of a cell in a band of latitude: ``size`` degrees of distance at its neighbours' far edge."""
    edge = F.least((F.abs(band + F.lit(0.5)) + 1.5) * size, F.lit(89.9))
    return size / F.cos(F.radians(edge))


def _in_cells(rows: DataFrame, lat: str, lon: str, km: float | Column, around: bool) -> DataFrame:
    """Adds _y and _x, the cell of ``km`` a row is in, or with ``around`` one row for each cell about it.

    Each band of latitude has cells of its own width, so that what is within ``km`` is in the same cell or
    in one beside it.
    """
    from seiche.functions.geo import KM_PER_DEGREE

    size = km / KM_PER_DEGREE
    y = F.floor(F.col(lat) / size)
    cell = lambda band: F.floor(F.col(lon) / _cell_size(band, size))
    if not around:
        return rows.withColumn("_y", y).withColumn("_x", cell(F.col("_y")))
    rows = rows.withColumn("_y", F.explode(F.array(y - 1, y, y + 1)))
    return rows.withColumn("_x", cell(F.col("_y"))).withColumn("_x", F.explode(F.array(F.col("_x") - 1, F.col("_x"), F.col("_x") + 1)))


def _banded(points: DataFrame, stations: DataFrame, km: float) -> DataFrame:
    """Points with the stations (_s, _lat, _lon, ...) within ``km``, met through cells of that size, and the distance."""
    from seiche.functions.geo import equirectangular_km

    left = _in_cells(points.filter("lat is not null and lon is not null"), "lat", "lon", km, False)
    pairs = left.join(_in_cells(stations, "_lat", "_lon", km, True), ["_y", "_x"]).drop("_y", "_x")
    return pairs.withColumn("km", equirectangular_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).filter(F.col("km") <= km)


#: Distances that one round of ``k_nearest`` works out, for each place and at least; the result does not depend on them.
PAIRS_A_POINT, PAIRS_A_ROUND = 60, 10_000_000


def _radius(points: DataFrame, stations: DataFrame, radii: list[float], k: int) -> float | None:
    """The largest of the radii (falling) whose cells hold few enough pairs, counted by cell; None where each has too many."""
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(r)).alias("r")) for n, r in enumerate(radii)]))

    def counted(rows: DataFrame, lat: str, lon: str, around: bool, out: str) -> DataFrame:
        cells = _in_cells(rows.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"), of.alias("_r")).select("lat", "lon", "_r.*"), "lat", "lon", F.col("r"), around)
        return cells.groupBy("n", "_y", "_x").agg(F.count("*").alias(out))

    pairs = counted(points, "lat", "lon", False, "p").join(counted(stations, "_lat", "_lon", True, "s").hint("merge"), ["n", "_y", "_x"])
    # One row a radius.
    made = {r.n: r.pairs for r in pairs.groupBy("n").agg(F.sum(F.col("p").cast("double") * F.col("s")).alias("pairs")).collect()}
    most = max(PAIRS_A_ROUND, PAIRS_A_POINT * k * points.count())
    return next((r for n, r in enumerate(radii) if made.get(n, 0.0) <= most), None)


def _first_radius(points: DataFrame, stations: DataFrame, start_km: float, k: int) -> float:
    """``start_km``, halved until few enough pairs are that near, down to less than a millimetre (2**-32 of 4 000 km)."""
    for most in (8, 16, 24, 32):
        if found := _radius(points, stations, [start_km / 2**n for n in range(most - 8, most)], k):
            return found
    return start_km / 2**31


def k_nearest(points: DataFrame, stations: DataFrame, k: int, *, point: str, station: str, start_km: float = 1000.0, max_km: float = 21_000.0) -> DataFrame:
    """The k nearest stations of each point (lat, lon on both): point, station, km, rank.

    Places count once: of the stations at one place only the k smallest can be among the nearest, and
    points at one place have the same ones. Places that have k stations within a radius are done; the
    others go on with a larger one. The first radius is ``start_km``, or less where that many stations
    are near that too many distances would be worked out; the later ones are at least twice the last.
    Ties go to the smaller station. Spark ranks within the map tasks before it shuffles.
    """
    placed = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"
    own = stations.filter(placed).select(F.col(station).alias("_s"), (F.col("lat") + 0.0).alias("_lat"), (F.col("lon") + 0.0).alias("_lon"))
    least = F.row_number().over(W.partitionBy("_lat", "_lon").orderBy("_s"))
    s = written(own.withColumn("_n", least).filter(F.col("_n") <= k).drop("_n"), "nearest-stations")
    whole = points.filter(placed).select(point, (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    left, done, last = written(whole.select("lat", "lon").distinct(), "nearest-left"), None, 0.0
    while last < max_km:
        if last:
            steps = sorted({min(last * 2**n, max_km) for n in range(1, 9)}, reverse=True)
            radius = steps[0] if len(steps) == 1 else _radius(left, s, steps, k) or steps[-1]
        else:
            radius = _first_radius(left, s, min(start_km, max_km), k)
        rank = F.row_number().over(W.partitionBy("lat", "lon").orderBy("km", "_s"))
        near = written(_banded(left, s, radius).withColumn("rank", rank).filter(F.col("rank") <= k).select("lat", "lon", F.col("_s").alias("station"), "km", "rank"), "nearest")
        full = near if radius >= max_km else near.join(near.filter(F.col("rank") == k).select("lat", "lon"), ["lat", "lon"], "left_semi")
        done = full if done is None else done.unionByName(full)
        left, last = written(left.join(full.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti"), "nearest-left"), radius
        if left.isEmpty():
            break
    # Rows of one point at several places share its ranks.
    rank = F.row_number().over(W.partitionBy(point).orderBy("km", "station"))
    return whole.join(done.drop("rank").hint("merge"), ["lat", "lon"]).select(point, "station", "km", rank.alias("rank")).filter(F.col("rank") <= k)


def pairs_within(stations: DataFrame, *, station: str, max_km: float) -> DataFrame:
    """Pairs of stations (a before b) no more than ``max_km`` apart, met through cells of that size."""
    from seiche.functions.geo import equirectangular_km

    s = stations.select(F.col(station).alias("a"), "lat", "lon").filter("lat is not null and lon is not null")
    b = _in_cells(s.select(F.col("a").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), "b_lat", "b_lon", max_km, True)
    pairs = _in_cells(s, "lat", "lon", max_km, False).join(b, ["_y", "_x"]).filter("a < b").withColumn("km", equirectangular_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")))
    return pairs.filter(F.col("km") <= max_km).select("a", "b", "km")


def kernel_mean(targets: DataFrame, donors: DataFrame, *, station: str, value: str, length_km: float, radius_km: float) -> DataFrame:
    """Distance-weighted mean of the donors within a radius, oneself left out: station, value, n, weight."""
    d = donors.select(F.col(station).alias("_d"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(value).alias("_v")).filter("_v is not null")
    rows = _banded(targets.select(station, "lat", "lon"), d, radius_km).filter(F.col("_d") != F.col(station)).withColumn("w", F.exp(-F.pow(F.col("km") / length_km, 2) / 2))
    return rows.groupBy(station).agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value), F.count("*").alias("n"), F.sum("w").alias("weight"))


def compared(a: DataFrame, b: DataFrame, key: str, *, numbers: dict[str, float], exact: list[str] = []) -> DataFrame:  # noqa: B006
    """Differences of two tables by key, one row a field: key, field, a, b.

    Numbers differ beyond their tolerance or when one is missing; exact fields differ null-safely;
    a key on one side only is a difference of the field "key".
    """
    left, right = a.select(key, *numbers, *exact).withColumn("_in", F.lit(True)), b.select(key, *numbers, *exact).withColumn("_in", F.lit(True))
    joined = left.alias("a").join(right.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    both = F.col("a._in").isNotNull() & F.col("b._in").isNotNull()
    text = lambda c: c.cast("string")
    tests = [F.when(~both, F.struct(F.lit("key").alias("field"), text(F.col(f"a.{key}")).alias("a"), text(F.col(f"b.{key}")).alias("b")))]
    for c, tol in numbers.items():
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        differ = F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > tol)
        tests.append(F.when(both & differ, F.struct(F.lit(c).alias("field"), text(x).alias("a"), text(y).alias("b"))))
    for c in exact:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        tests.append(F.when(both & ~x.eqNullSafe(y), F.struct(F.lit(c).alias("field"), text(x).alias("a"), text(y).alias("b"))))
    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), F.explode(F.array_compact(F.array(*tests))).alias("d")).select(key, "d.*")


def resolved_twins(rows: DataFrame, *, event: str, system: str, reviewed_system: str, order: list[Column], auto_value: str, nan_is_missing: bool = True) -> DataFrame:
    """One row an event: the reviewed solution where there is one, with the automatic twin's value beside it.

    NaN is a missing value, or with ``nan_is_missing`` false a value like any other.
    """
    from seiche.functions.geo import number
    from seiche.operators.windows import first_per_key

    one = first_per_key(rows.withColumn(auto_value, number(auto_value)) if nan_is_missing else rows, [event, system], order)
    picks, autos = one.filter(F.col(system) == reviewed_system), first_per_key(one.filter(F.col(system) != reviewed_system), [event], [F.col(system)])
    twins = autos.select(F.col(event), F.col(auto_value).alias("auto_value"))
    kept = picks.join(twins, event, "left")
    alone = autos.join(picks.select(event), event, "left_anti").withColumn("auto_value", F.col(auto_value))
    n = one.groupBy(event).agg(F.count("*").alias("n_solutions"))
    return kept.unionByName(alone).join(n, event)


def near_pairs(a: DataFrame, b: DataFrame, *, order: tuple[str, ...] = ()) -> DataFrame:
    """a_id, b_id: one to one by time and place, the smallest |dt|/seconds + distance/km first.

    ``a`` has id, t (seconds), lat, lon; ``b`` also s and km, its own tolerances (inclusive; one of 0
    matches nothing).
    """
    from seiche.functions.geo import equirectangular_km

    left = a.select(F.col("id").alias("a_id"), F.col("t").alias("a_t"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    right = b.filter("s > 0 and km > 0").select(F.col("id").alias("b_id"), F.col("t").alias("b_t"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "s", "km")
    # One row: the widest tolerance is the width of the buckets.
    widest = right.agg(F.max("s")).head()[0] or 1.0
    edges = band_join(left, right, "a_t", "b_t", widest)
    edges = edges.withColumns({"dt": F.abs(F.col("a_t") - F.col("b_t")), "d": equirectangular_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))}).filter("dt <= s and d <= km")
    return greedy_pairs(edges, "a_id", "b_id", [F.col("dt") / F.col("s") + F.col("d") / F.col("km"), *[F.col(c) for c in order]])


def catalogue_matches(a: DataFrame, b: DataFrame, *, tolerances: list[tuple[str, float, float]], id_joins: list[tuple[str, str, str]] = []) -> dict[str, DataFrame]:  # noqa: B006
    """pairs, unmatched_a, unmatched_b, steps and summary of two catalogues (id, t, lat, lon, magnitude and key columns).

    Equal keys that are unique on both sides match first, join by join (label, column of a, column of
    b); then the tolerances (label, seconds, km) in order, each over what the ones before left. Pairs
    carry the step, dt_s and dmag (b less a) and dist_km; steps the medians and 95th percentiles.
    """
    from seiche.functions.geo import equirectangular_km

    done: DataFrame | None = None
    summary: list[tuple[str, DataFrame]] = []
    for label, ka, kb in id_joins:
        left, right = (a, b) if done is None else (a.join(done.select(F.col("a_id").alias("id")), "id", "left_anti"), b.join(done.select(F.col("b_id").alias("id")), "id", "left_anti"))
        x, y = left.select(F.col("id").alias("a_id"), F.col(ka).alias("ka")), right.select(F.col("id").alias("b_id"), F.col(kb).alias("kb"))
        new = written(unique_key_join(x, y, "ka", "kb").select("a_id", "b_id", F.lit(f"id:{label}").alias("step")), "matched-by-id")
        summary.append((f"ambiguous:{label}", ambiguous_keys(x, y, "ka", "kb")))
        done = new if done is None else done.unionByName(new)
    for label, seconds, km in tolerances:
        left, right = (a, b) if done is None else (a.join(done.select(F.col("a_id").alias("id")), "id", "left_anti"), b.join(done.select(F.col("b_id").alias("id")), "id", "left_anti"))
        new = written(catalogue_match(left, right, seconds=seconds, km=km).withColumn("step", F.lit(label)), "matched-near")
        done = new if done is None else done.unionByName(new)
    own = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "t", "lat", "lon", "magnitude")])
    pairs = done.join(own(a, "a"), "a_id").join(own(b, "b"), "b_id")
    pairs = pairs.select("a_id", "b_id", "step", (F.col("b_t") - F.col("a_t")).alias("dt_s"), equirectangular_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("dist_km"), (F.col("b_magnitude") - F.col("a_magnitude")).alias("dmag"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    steps = pairs.groupBy("step").agg(F.count("*").alias("n"), q(F.abs("dt_s"), 0.5).alias("dt_median"), q(F.abs("dt_s"), 0.95).alias("dt_p95"), q(F.col("dist_km"), 0.5).alias("km_median"), q(F.col("dist_km"), 0.95).alias("km_p95"))
    un_a, un_b = a.join(done.select(F.col("a_id").alias("id")), "id", "left_anti"), b.join(done.select(F.col("b_id").alias("id")), "id", "left_anti")
    counts = a.agg(F.lit("n_a").alias("what"), F.count("*").alias("n"))
    for what, df in (("n_b", b), ("matched", done), ("unmatched_a", un_a), ("unmatched_b", un_b), *summary):
        counts = counts.unionByName(df.agg(F.lit(what).alias("what"), F.count("*").alias("n")))
    return {"pairs": pairs, "unmatched_a": un_a, "unmatched_b": un_b, "steps": steps, "summary": counts}
