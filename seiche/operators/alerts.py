"""Early warnings against events: travel times, ground-velocity magnitudes, the choice of a detection, sensors.

Detections with their stations and origins are frames; every verdict is a column or an aggregate over
(event, alert), combined in the map tasks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions import moment
from seiche.functions.geo import number


@dataclass(frozen=True)
class Fit:
    """The window of arrivals: after distance/vp less pre, before distance/vs and post (both open)."""

    # The standard of the pages.
    vp_km_s: float = 7.0
    vs_km_s: float = 3.0
    pre_s: float = 2.0
    post_s: float = 10.0
    min_stations: int = 3
    min_fraction: float = 0.5


@dataclass(frozen=True)
class Velocity:
    """Which stations count: those not left out, with a distance and a velocity, beyond the near field and not too far."""

    exclude_stations: tuple[str, ...] = ()
    exclude_class_codes: tuple[int, ...] = (22,)
    max_km: float = 300.0
    min_km: float | None = None
    nearfield_km: tuple[tuple[float, float], ...] = ((3.0, 5.0), (4.0, 10.0), (5.0, 20.0), (99.0, 30.0))
    inverse: str = "farfield"


@dataclass(frozen=True)
class Method:
    """How a detection is chosen and its magnitude made."""

    name: str
    settings: Velocity = Velocity()
    fit: Fit = Fit()
    window_s: float = 60.0
    require_fit: bool = True
    rank: str = "time"
    min_fit_fraction: float = 0.0


METHODS = {m.name: m for m in (Method("page"), Method("legacy", Velocity(inverse="exact")), Method("find_alert", window_s=30.0, require_fit=False))}


def resolved_method(method: str | Method, **changes: object) -> Method:
    """A method by name or as given, with what is not None of the changes; an unknown name raises."""
    if isinstance(method, str) and method not in METHODS:
        raise ValueError(f"no method {method!r}, but {sorted(METHODS)}")
    return replace(METHODS[method] if isinstance(method, str) else method, **{k: v for k, v in changes.items() if v is not None})


def fits_window(distance_km: Column, after_s: Column, fit: Fit = Fit()) -> Column:
    """Whether an arrival so long after the origin fits the distance; a missing one does not."""
    low, high = distance_km / fit.vp_km_s - fit.pre_s, distance_km / fit.vs_km_s + fit.post_s
    return F.coalesce((after_s > low) & (after_s < high) & ~F.isnan(distance_km), F.lit(False))


def travel_time_fits(rows: DataFrame, keys: list[str], *, distance: str = "distance_km", after: str = "after_s", fit: Fit = Fit()) -> DataFrame:
    """keys, n_fit, n_total, accepted: how many stations' arrivals fit; missing ones count in the total."""
    out = rows.groupBy(*keys).agg(F.count_if(fits_window(F.col(distance), F.col(after), fit)).alias("n_fit"), F.count("*").alias("n_total"))
    return out.withColumn("accepted", (F.col("n_fit") >= fit.min_stations) & (F.col("n_fit") / F.col("n_total") >= fit.min_fraction))


def velocity_stations(rows: DataFrame, keys: list[str], settings: Velocity = Velocity(), *, station: str = "station", code: str = "class_code", pgv: str = "pgv", distance: str = "distance_km") -> DataFrame:
    """Each station's row with mag_farfield, mag_exact, drop_reason (the first that applies, null where kept).

    The near field is cut at a distance that goes by the median magnitude of the stations kept so far.
    """
    v, d = number(pgv), number(distance)
    far, exact = moment.magnitude_far(v, d), moment.magnitude_exact(v, d)
    first = (
        F.when(F.col(station).isin(list(settings.exclude_stations)), "excluded_station")
        .when(F.coalesce(F.col(code).isin(list(settings.exclude_class_codes)), F.lit(False)), "excluded_class_code")
        .when(d.isNull(), "no_distance").when(v.isNull() | ~(v > 0), "bad_pgv").when(d > settings.max_km, "beyond_max_km")
    )
    rows = rows.withColumns({"mag_farfield": far, "mag_exact": exact, "_first": first})
    used = F.col("mag_farfield" if settings.inverse == "farfield" else "mag_exact")
    if settings.min_km is None:
        middle = rows.groupBy(*keys).agg(F.median(F.when(F.col("_first").isNull(), used)).alias("_m"))
        rows = rows.join(middle.withColumn("min_km", moment.near_field_limit(F.col("_m"), list(settings.nearfield_km))).drop("_m"), keys)
    else:
        rows = rows.withColumn("min_km", F.lit(float(settings.min_km)))
    reason = F.coalesce("_first", F.when(d <= F.col("min_km"), "nearfield"))
    return rows.withColumn("drop_reason", reason).drop("_first")


def velocity_magnitudes(stations: DataFrame, keys: list[str], settings: Velocity = Velocity()) -> DataFrame:
    """keys, magnitude (the median of the kept stations'), robust_mean (of their middle third), n_alert, n_kept."""
    used = F.col("mag_farfield" if settings.inverse == "farfield" else "mag_exact")
    value = F.when(F.col("drop_reason").isNull(), number(used))
    # A detection has at most a network's stations: their magnitudes are one small array.
    out = stations.groupBy(*keys).agg(F.median(value).alias("magnitude"), F.array_sort(F.collect_list(value)).alias("_v"), F.count("*").alias("n_alert"), F.count_if(F.col("drop_reason").isNull()).alias("n_kept"))
    n = F.size("_v")
    cut = F.floor(n / 3).cast("int")
    middle = F.when(n >= 3, F.slice("_v", cut + 1, n - 2 * cut))
    mean = F.aggregate(middle, F.lit(0.0), lambda s, x: s + x) / F.size(middle)
    return out.select(*keys, "magnitude", mean.alias("robust_mean"), "n_alert", "n_kept")


def associated(candidates: DataFrame, event: str, *, method: Method = METHODS["page"], dt: str = "dt_s", alert: list[str] = ["alert_day", "alert_id"]) -> DataFrame:  # noqa: B006
    """Candidates (event, alert, dt_s, n_fit, n_total, accepted) in the window (inclusive), with eligible and chosen.

    Chosen is one eligible detection an event: by time the nearest, then the earlier; by fit the accepted
    ones first, then those of the larger share and number of fitting stations, then by time.
    """
    share = F.coalesce(F.try_divide("n_fit", "n_total"), F.lit(0.0))
    eligible = F.lit(True)
    if method.require_fit:
        eligible = eligible & F.coalesce("accepted", F.lit(False))
    if method.min_fit_fraction > 0:
        eligible = eligible & (share >= method.min_fit_fraction)
    rows = candidates.filter(F.abs(dt) <= method.window_s).withColumn("eligible", eligible)
    by_time = [F.abs(F.col(dt)), F.col(dt), *[F.col(c) for c in alert]]
    by_fit = [~F.coalesce("accepted", F.lit(False)), -share, -F.coalesce("n_fit", F.lit(0))]
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*(by_fit if method.rank == "fit" else []), *by_time])])
    best = rows.filter("eligible").groupBy(event).agg(F.min(order).alias("_best"))
    return rows.join(best, event, "left").withColumn("chosen", F.coalesce(F.col("eligible") & (order == F.col("_best")), F.lit(False))).drop("_best")


def sensor_report(rows: DataFrame, sensors: DataFrame, *, code: int = 22, patterns: tuple[str, ...] = ("*GNSS*", "*GPS*"), time: str = "t") -> DataFrame:
    """Stations of detections (alert_id, station, class_code, t) that are marked with the code, or have a sensor of 1 Hz without it: sensor, issue."""
    from seiche.operators.predicates import glob_match

    there = (F.col("start_time") <= F.col(time)) & (F.col("end_time").isNull() | (F.col(time) <= F.col("end_time")))
    at = rows.select("alert_id", "station", time).distinct().join(sensors, "station").filter(there)
    seen = at.groupBy("alert_id", "station").agg(F.max(F.struct(glob_match(F.col("sensor"), patterns).alias("one_hz"), "sensor")).alias("s"))
    out = rows.join(seen, ["alert_id", "station"], "left").select(*rows.columns, "s.sensor", "s.one_hz")
    marked = F.coalesce(F.col("class_code") == code, F.lit(False))
    issue = F.when(marked & F.col("one_hz").isNull(), f"code{code}_unknown_sensor").when(marked & F.col("one_hz"), f"code{code}_one_hz").when(marked, f"code{code}_other_sensor").when(F.col("one_hz"), f"one_hz_without_code{code}")
    return out.withColumn("issue", issue).filter("issue is not null")


def nearest_velocity(automatic: DataFrame, cleaned: DataFrame, *, seconds: float = 0.5, km: float = 5.0) -> DataFrame:
    """row, mag_pgv: each cleaned row (row, t, lat, lon, ml, position) gives its magnitude to the automatic row nearest in place within the tolerances.

    Ties go to the earlier row; of several that meet one row the last stands.
    """
    from seiche.functions.geo import equirectangular_km
    from seiche.operators.joins import band_join

    right = cleaned.select(F.col("position").alias("p"), F.col("t").alias("ct"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.col("ml"))
    pairs = band_join(automatic.select("row", "t", "lat", "lon"), right, "t", "ct", seconds)
    pairs = pairs.withColumn("d", equirectangular_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).filter(F.col("d") <= km)
    own = pairs.groupBy("p").agg(F.min(F.struct("d", "row")).getField("row").alias("row"), F.first("ml").alias("ml"))
    return own.groupBy("row").agg(F.max_by("ml", "p").alias("mag_pgv"))


def alert_days(rows: DataFrame, roots: list[str], *, path: str = "file") -> DataFrame:
    """day, file: of each day's files those of the first root that has the day's year at all."""
    place = F.lit(None).cast("int")
    for k, root in reversed(list(enumerate(roots))):
        place = F.when(F.col(path).startswith(root), k).otherwise(place)
    day = F.regexp_extract(path, r"/(\d{4}/[a-z]{3}/\d{1,2})/", 1)
    rows = rows.select(path, place.alias("_place"), day.alias("day"), F.substring(day, 1, 4).alias("_year")).filter("_place is not null and day <> ''")
    return rows.withColumn("_best", F.min("_place").over(W.partitionBy("_year"))).filter("_place = _best").select("day", path)


def finished(day: Column, today: Column, days: int = 2) -> Column:
    """Whether a day is old enough not to change any more: only such days are kept in a cache."""
    return F.datediff(today, day) >= days


def parsed_day(files: Mapping[str, str], parse) -> tuple[list, list[str]]:
    """(what the files of a day give, their problems as text): one that cannot be read stops no other."""
    found, problems = [], []
    for name, body in sorted(files.items()):
        try:
            found.append(parse(body))
        except ValueError as e:
            problems.append(f"{name}: {e}")
    return found, problems
