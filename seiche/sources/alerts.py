"""Early-warning files: detections with a row a station, day lists, located detections, phase listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.sources.text import Source, lines, number, whole_texts, word, words


def detections(spark: SparkSession, paths: Source) -> tuple[DataFrame, DataFrame]:
    """(headers, stations) of .event files, keyed by file.

    The header has alert_id, t and the number of stations; a station row lon, lat, elevation,
    ground velocity, code, class code and second. A repeated station keeps its first row.
    """
    rows = lines(spark, paths, pattern="*.event").filter("trim(line) <> ''").withColumn("w", words(F.col("line")))
    w = lambda k: F.try_element_at("w", F.lit(k))
    clock = r"([A-Z][a-z]{2})\s+([A-Z][a-z]{2})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})"
    part = lambda k: F.regexp_extract("line", clock, k)
    head = rows.filter("line_no = 1").select("file", w(1).alias("alert_id"), F.try_to_timestamp(F.concat_ws(" ", part(2), part(3), part(5), part(4)), F.lit("MMM d yyyy HH:mm:ss")).cast("timestamp_ntz").alias("t"), F.try_element_at("w", F.lit(-1)).try_cast("int").alias("n_stations"))
    body = rows.filter("line_no > 1").select("file", "line_no", number(w(1)).alias("lon"), number(w(2)).alias("lat"), number(w(3)).alias("elevation"), number(w(4)).alias("pgv"), w(5).alias("station"), number(w(6)).alias("distance_km"), w(7).try_cast("int").alias("class_code"), number(w(9)).alias("second"))
    first = body.filter("station is not null").groupBy("file", "station").agg(F.min(F.struct("line_no", "lon", "lat", "elevation", "pgv", "distance_km", "class_code", "second")).alias("r"))
    return head, first.select("file", "station", *[f"r.{c}" for c in ("line_no", "lon", "lat", "elevation", "pgv", "distance_km", "class_code", "second")])


def day_index(spark: SparkSession, paths: Source) -> DataFrame:
    """file, alert_id, clock, n_a, n_b: one row a detection of the day pages."""
    pattern = r'<tr><td>\[<a href="(\d+)\.html">(\d\d:\d\d:\d\d)</a>\]\s*</td><td>\s*(\d+)</td><td>\s*(\d+)</td>'
    rows = whole_texts(spark, paths)
    each = rows.select("file", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("m"))
    return each.select("file", *[F.regexp_extract("m", pattern, k).alias(n) for k, n in enumerate(("alert_id", "clock"), 1)], *[F.regexp_extract("m", pattern, k).cast("int").alias(n) for k, n in enumerate(("n_a", "n_b"), 3)])


def located(spark: SparkSession, paths: Source) -> DataFrame:
    """alert_id, t, lat, lon, depth_km, magnitude, grade of alert.mag lines."""
    rows = lines(spark, paths, pattern="alert.mag").filter("trim(line) <> ''").withColumn("w", words(F.col("line"))).filter(F.size("w") >= 8)
    t = F.try_to_timestamp(F.concat(F.col("w")[1], F.lit(" "), F.regexp_extract(F.col("w")[2], r"^(\d{6})", 1)), F.lit("yyyyMMdd HHmmss")).cast("timestamp_ntz")
    return rows.select("file", "line_no", F.col("w")[0].alias("alert_id"), t.alias("t"), *[number(F.col("w")[k]).alias(n) for k, n in ((3, "lat"), (4, "lon"), (5, "depth_km"), (6, "magnitude"))], F.col("w")[7].alias("grade"))


def phases(spark: SparkSession, paths: Source) -> tuple[DataFrame, DataFrame]:
    """(origins, phases) of .evb files: latitude, longitude and depth with errors; station, phase, residual, distance."""
    rows = lines(spark, paths, pattern="*.evb")
    take = lambda p, k=1: F.max(F.regexp_extract("line", p, k).try_cast("double"))
    n = r"\s*(-?[\d.]+)"
    origins = rows.groupBy("file").agg(
        take(rf"^\s*latitude{n}").alias("latitude"), take(rf"^\s*latitude{n}\s*\+/-{n}", 2).alias("d_latitude"), take(rf"^\s*longitude{n}").alias("longitude"), take(rf"^\s*longitude{n}\s*\+/-{n}", 2).alias("d_longitude"),
        take(rf"^\s*focal depth{n}").alias("depth_km"), take(rf"^\s*focal depth{n}\s*\+/-{n}", 2).alias("d_depth"), take(rf"^\s*origin time.*\+/-{n}s").alias("d_time"),
    )
    line = F.col("line")
    rows = rows.filter(line.rlike(r"^\s?[a-z0-9]{3,4}\s+[ps]\s+\d\d\s+\d\d\s"))
    out = rows.select("file", "line_no", word(line, 1).alias("station"), word(line, 2).alias("phase"), *[number(word(line, k)).alias(c) for k, c in ((3, "hour"), (4, "minute"), (5, "second"), (6, "residual"), (7, "weight"), (8, "distance_km"), (9, "azimuth"))])
    return origins, out


def station_distances(phases_: DataFrame) -> DataFrame:
    """file, station, distance_km: that of a station's first phase."""
    rows = phases_.filter("station is not null")
    return rows.groupBy("file", "station").agg(F.min(F.struct("line_no", "distance_km")).getField("distance_km").alias("distance_km"))
