"""The day files of an earthquake archive: layouts, typed events, source blocks, and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions.geo import equirectangular_km
from seiche.functions.text import event_type
from seiche.operators.badrows import FPS_FIELDS
from seiche.operators.joins import band_join, greedy_pairs
from seiche.session import written
from seiche.sources.text import Layout, Source, at, clock_seconds, fixed_width, lines, number, whole_texts, words

# The layouts of the day files, each with its file, its width and the first and end columns of its fields.
LAYOUT_TABLE = {
    ("events.lib", "lib136", 136): """
        num 0 4, date 4 13, time 13 24, latitude 24 33, longitude 33 43, depth 43 50, mlw 50 55, event_type 55 59, id 59 92, sh_min 92 101,
        sh_max 101 108, azim_comp 108 115, num_of_polarities 115 118""",
    ("lib.mag", "mag141", 141): """
        num 0 4, date 4 13, time 13 24, latitude 24 33, longitude 33 43, depth 43 50, mlw 50 56, ml 56 62, num_of_st_ml 62 67, min_ml 67 73,
        max_ml 73 79, num_of_st_pha 79 82, num_of_p_pha 82 85, num_of_s_pha 85 88, num_of_polarities 88 92, d_time 92 98, d_latitude 98 104,
        d_longitude 104 110, d_depth 110 116, w_rms_res 116 123, min_dist_sta 123 130, max_azim_gap 130 136, vel_model 136 138, event_type 138 141""",
    ("lib.mag", "mag134", 134): """
        num 0 4, date 4 13, time 13 24, latitude 24 33, longitude 33 43, depth 43 50, mlw 50 56, ml 56 62, num_of_st_ml 62 67, min_ml 67 73,
        max_ml 73 79, num_of_st_pha 79 82, num_of_p_pha 82 85, num_of_s_pha 85 88, num_of_polarities 88 92, d_time 92 98, d_latitude 98 104,
        d_longitude 104 110, d_depth 110 116, min_dist_sta 116 123, max_azim_gap 123 129, vel_model 129 131, event_type 131 134""",
    ("aut.mag", "aut89", 89): "num 0 4, date 4 13, time 13 22, latitude 22 30, longitude 30 39, depth 39 45, ml 45 51, q 51 57, id 57 89",
    ("aut.mag", "aut57", 57): "num 0 4, date 4 13, time 13 22, latitude 22 30, longitude 30 39, depth 39 45, ml 45 51, q 51 57",
    ("aut.mag", "aut61", 61): "num 0 4, date 4 13, time 13 22, latitude 22 30, longitude 30 40, depth 40 48, ml 48 61",
    ("aut.mag", "aut117", 117): """
        num 0 4, date 4 13, time 13 22, latitude 22 30, longitude 30 40, depth 40 48, aux1 48 61, aux2 61 69, aux3 69 75, aux4 75 81, aux5 81 87,
        aux6 87 93, aux7 93 99, aux8 99 105, aux9 105 111, aux10 111 117""",
    ("cleanaut.mag", "aut89", 89): "num 0 4, date 4 13, time 13 22, latitude 22 30, longitude 30 39, depth 39 45, ml 45 51, q 51 57, id 57 89",
    ("events.ref", "ref114", 114): """
        date 4 10, time 11 21, latitude 21 28, longitude 28 35, q 35 43, depth 43 50, ml 50 56, dir 56 87, file_name 87 99, ref_id 99 110, flag 110 114""",
    ("events.ref", "ref108", 108): """
        date 4 10, time 11 21, latitude 21 28, longitude 28 35, q 35 43, depth 43 50, ml 50 56, dir 56 87, file_name 87 99, ref_id 99 110""",
}
_TEXT = ("date", "time", "id", "event_type", "vel_model", "dir", "file_name", "ref_id", "flag")


def _layouts() -> dict[str, list[Layout]]:
    out: dict[str, list[Layout]] = {}
    for (file, name, width), fields in LAYOUT_TABLE.items():
        parts = [f.split() for f in fields.split(",")]
        out.setdefault(file, []).append(Layout(name, width, tuple((n, int(a), int(b)) for n, a, b in parts), _TEXT))
    return out


LAYOUTS = _layouts()


def day_file(spark: SparkSession, paths: Source, kind: str) -> tuple[DataFrame, DataFrame]:
    """(records with ``t``, failed lines) of one kind of fixed-width day file."""
    good, failed = fixed_width(lines(spark, paths, pattern=kind), LAYOUTS[kind])
    if kind == "events.ref":
        # Two-digit years: from 90 on the last century. No magnitude is written as -8, and below -9 in the oldest files.
        century = F.when(F.substring("date", 1, 2).try_cast("int") >= 90, "19").otherwise("20")
        none = (F.col("ml") == -8) | (F.col("ml") <= -9)
        good = good.withColumns({"date": F.concat(century, "date"), "ml": F.when(~none, F.col("ml")), "id": F.when(F.col("dir") != "", F.concat("dir", "file_name"))})
    return good.withColumn("t", at(F.try_to_date("date", "yyyyMMdd"), clock_seconds(F.col("time")))), failed


def fault_planes(spark: SparkSession, paths: Source) -> tuple[DataFrame, DataFrame]:
    """(records with has_solution and ``t``, failed lines) of events.fps files.

    Without a solution (source FILE) the planes and what belongs to them are null.
    """
    rows = lines(spark, paths, pattern="events.fps").filter("trim(line) <> '' and line not like '#%'").withColumn("w", words(F.col("line")))
    text = {"date", "time", "id", "event_type", "source_file"}
    solved = F.col("source_file") != "FILE"
    good = rows.filter(F.size("w") == 33).select("file", "line_no", *[(F.col("w")[k] if n in text else number(F.col("w")[k])).alias(n) for k, n in enumerate(FPS_FIELDS)])
    planes = ("strike_a", "dip_a", "rake_a", "strike_b", "dip_b", "rake_b", "sh_min", "sh_max", "azim_comp", "relative_size", "corner_freq", "fault_radius", "stress_drop", "peak_slip", "num_of_polarities", "num_of_amplitudes", "unknown_pacc", "is_significant")
    good = good.withColumn("has_solution", solved).withColumns({c: F.when(solved, F.col(c)) for c in planes})
    good = good.withColumn("t", at(F.try_to_date("date", "yyyyMMdd"), clock_seconds(F.col("time"))))
    return good, rows.filter(F.size("w") != 33).select("file", "line_no", "line", F.concat(F.lit("fields "), F.size("w").cast("string")).alias("reason"))


def source_blocks(spark: SparkSession, paths: Source) -> DataFrame:
    """One row a .sp3 or .ap3 file; every field is null where its line is absent."""
    rows = whole_texts(spark, paths, "*.[sa]p3")
    field = lambda pattern, k=1: F.regexp_extract("value", pattern, k).try_cast("double")
    n = r"\s*(-?[\d.]+(?:E[+-]\d+)?)"
    plane = lambda p, k: field(rf"plane {p}{n}{n}{n}", k)
    return rows.select(
        "file",
        F.nullif(F.regexp_extract("value", r"file:\s*(\S+)", 1), F.lit("")).alias("event_file"),
        field(rf"seismic moment:{n}").alias("moment_nm"), field(rf"local magnitude:{n}").alias("local_magnitude"),
        *[plane(p, k).alias(f"{c}_{p}") for p in "ab" for k, c in enumerate(("strike", "dip", "rake"), 1)],
        field(rf"relative size{n}").alias("relative_size"), field(rf"azimuth of compression{n}").alias("azim_comp"),
        field(r"Of\s+(\d+)\s+first motion").alias("n_polarities"), field(r"(\d+)\s+amplitudes for").alias("n_amplitudes"), field(rf"{n}\s*% of all mechanisms").alias("acceptable_pct"),
        F.nullif(F.trim(F.regexp_extract("value", r"(?m)^\s*([A-Za-z -]+ dominates?)\s*$", 1)), F.lit("")).alias("faulting"),
    )


def reviewed_spine(fps: DataFrame, lib: DataFrame) -> DataFrame:
    """Full outer join of two files' events on (id, t); what is left over joins on ids unique on both sides."""
    f, l = fps.select("id", "t", F.struct(*fps.columns).alias("f")), lib.select("id", "t", F.struct(*lib.columns).alias("l"))  # noqa: E741
    both = f.join(l, ["id", "t"]).select("id", "f", "l")
    only_f = f.join(both.select("id", F.col("f.t").alias("t")), ["id", "t"], "left_anti")
    only_l = l.join(both.select("id", F.col("l.t").alias("t")), ["id", "t"], "left_anti")
    once = lambda df: df.withColumn("_n", F.count("*").over(W.partitionBy("id"))).filter("_n = 1").drop("_n")
    by_id = once(only_f).alias("x").join(once(only_l).alias("y"), "id").select("id", "f", "l")
    rest_f = only_f.join(by_id.select("id"), "id", "left_anti").select("id", "f", F.lit(None).cast(both.schema["l"].dataType).alias("l"))
    rest_l = only_l.join(by_id.select("id"), "id", "left_anti").select("id", F.lit(None).cast(both.schema["f"].dataType).alias("f"), "l")
    return both.unionByName(by_id).unionByName(rest_f).unionByName(rest_l)


def _with_lib_mag(spine: DataFrame, mag: DataFrame | None) -> DataFrame:
    """The spine with the lib.mag record of the same time and position to a thousandth of a degree (m), the first with the first and so on."""
    if mag is None:
        return spine.withColumn("m", F.lit(None).cast("struct<latitude:double,longitude:double,depth:double,mlw:double,ml:double,event_type:string>"))
    keys = ["_t", "_lat", "_lon", "_k"]

    def keyed(df: DataFrame, t: Column, lat: Column, lon: Column, order: list[Column]) -> DataFrame:
        df = df.withColumns({"_t": t, "_lat": F.rint(lat * 1000), "_lon": F.rint(lon * 1000)})
        return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys[:3]).orderBy(*order)))

    first = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"l.{c}"))
    left = keyed(spine, first("t"), first("latitude"), first("longitude"), [first("file"), first("line_no")])
    right = keyed(mag, F.col("t"), F.col("latitude"), F.col("longitude"), [F.col("file"), F.col("line_no")]).select(*[F.col(c).alias(f"{c}m") for c in keys], F.struct(*mag.columns).alias("m"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}m")) for c in keys]
    return left.join(right, same, "left").select(*spine.columns, "m")


def _automatic_solutions(automatic: DataFrame) -> DataFrame:
    """The best automatic row of each id, and every row without an id (listed again in its file, once)."""
    keep = F.struct("file", "line_no", "num", "t", "latitude", "longitude", "depth", "ml", "q", "id")
    named = automatic.filter("id is not null").groupBy("id").agg(F.max_by(keep, F.struct(F.coalesce("q", F.lit(float("-inf"))), "line_no")).alias("a"))
    unclear = F.when(F.col("num").isNull() | F.col("t").isNull(), F.col("line_no"))
    nameless = automatic.filter("id is null").groupBy("file", "num", "t", unclear).agg(F.min_by(keep, "line_no").alias("a"))
    return named.select("a.*").unionByName(nameless.select("a.*"))


def _near_pairs(reviewed: DataFrame, auto: DataFrame, within: tuple[float, float], within_no_id: tuple[float, float]) -> DataFrame:
    """One-to-one pairs r, a by time and place, the smallest dt/seconds + distance/km first; tolerances are inclusive, none of 0 matches."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = reviewed.select("r", micros("time").alias("r_us"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"), "r_file", "r_line")
    tolerance = lambda k: F.when(F.col("id").isNotNull(), F.lit(within[k])).otherwise(F.lit(within_no_id[k])).cast("double")
    right = auto.select("a", micros("t").alias("a_us"), F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"), F.col("file").alias("a_file"), F.col("line_no").alias("a_line"), tolerance(0).alias("s"), tolerance(1).alias("km"))
    right = right.filter("s > 0 and km > 0")
    edges = band_join(left, right, "r_us", "a_us", max(within[0], within_no_id[0], 1e-6) * 1e6)
    edges = edges.withColumns({"dt": F.abs(F.col("r_us") - F.col("a_us")) / 1e6, "d": equirectangular_km(F.col("r_lat"), F.col("r_lon"), F.col("a_lat"), F.col("a_lon"))}).filter("dt <= s and d <= km")
    return greedy_pairs(edges, "r", "a", [F.col("dt") / F.col("s") + F.col("d") / F.col("km"), *[F.col(c) for c in ("r_us", "r_file", "r_line", "a_file", "a_line")]])


def assembled_events(
    fps: DataFrame, lib: DataFrame, automatic: DataFrame, *, mag: DataFrame | None = None, second: DataFrame | None = None, within: tuple[float, float] = (2.0, 10.0), within_no_id: tuple[float, float] = (5.0, 25.0)
) -> DataFrame:
    """Reviewed events with the magnitude of their automatic solution, then the automatic solutions of no reviewed event.

    ``mag`` are the lib.mag records. An automatic solution belongs to the first reviewed event of
    its id; what is left is matched one to one within seconds and km (``within_no_id`` for rows
    without an id), over folders of days, as an event may lie beside midnight. ``second`` is the
    other automatic file: it serves folders without a row of the first, and reviewed events that
    are still without a solution, by id.
    """
    spine = _with_lib_mag(reviewed_spine(fps, lib), mag)
    first = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"l.{c}"))
    place = lambda c: F.coalesce(first(c), F.col(f"m.{c}"))
    reviewed = spine.select(
        F.monotonically_increasing_id().alias("r"), first("file").alias("r_file"), first("line_no").alias("r_line"),
        first("t").alias("time"), "id", place("latitude").alias("latitude"), place("longitude").alias("longitude"), place("depth").alias("depth_km"), F.coalesce("m.mlw", "l.mlw", "f.mlw").alias("mag_mlw"), F.col("m.ml").alias("mag_ml"),
        F.col("f.moment").alias("moment_nm"), F.coalesce("m.event_type", "l.event_type", "f.event_type").alias("event_type_code"), F.lit("manual").alias("evaluation_mode"), F.lit(None).cast("double").alias("quality"),
    )
    # Written, as the numbers of the rows must stay.
    reviewed = written(reviewed, "reviewed-events")
    if second is not None:
        folder = F.regexp_replace("file", "[^/]+$", "")
        others = second.withColumn("_folder", folder).join(automatic.select(folder.alias("_folder")).distinct(), "_folder", "left_anti").drop("_folder")
        automatic = automatic.unionByName(others, allowMissingColumns=True)
    auto = written(_automatic_solutions(automatic).withColumn("a", F.monotonically_increasing_id()), "automatic-solutions")

    one = reviewed.filter("id is not null").groupBy("id").agg(F.min(F.struct("time", "r_file", "r_line", "r")).getField("r").alias("r"))
    pairs = written(one.join(auto.select("id", "a"), "id").select("r", "a"), "automatic-by-id")
    pairs = pairs.unionByName(_near_pairs(reviewed.join(pairs, "r", "left_anti"), auto.join(pairs, "a", "left_anti"), within, within_no_id))
    reviewed = reviewed.join(pairs.join(auto.select("a", F.col("ml").alias("mag_auto")), "a"), "r", "left")
    if second is not None:
        by_id = _automatic_solutions(second).filter("id is not null").select("id", F.col("ml").alias("_ml"))
        reviewed = reviewed.join(by_id, "id", "left").withColumn("mag_auto", F.when(F.col("a").isNull(), F.col("_ml")).otherwise(F.col("mag_auto"))).drop("_ml")
    # Rows without an id are named by their folder and number.
    day = F.regexp_extract("file", r"(/\d{4}/[A-Za-z]{3}/\d{1,2}|/[^/]*)/[^/]*$", 1)
    name = F.coalesce("id", F.concat(day, F.lit("/aut.mag#"), F.coalesce(F.col("num").cast("long"), F.col("line_no").cast("long")).cast("string")))
    alone = auto.join(pairs, "a", "left_anti").select(
        F.col("t").alias("time"), name.alias("id"), "latitude", "longitude", F.col("depth").alias("depth_km"), F.col("ml").alias("mag_auto"), F.lit("automatic").alias("evaluation_mode"), F.col("q").alias("quality")
    )
    out = reviewed.drop("r", "a", "r_file", "r_line").unionByName(alone, allowMissingColumns=True)
    magnitude = F.coalesce("mag_mlw", "mag_ml", "mag_auto")
    kind = F.when(F.col("mag_mlw").isNotNull(), "Mlw").when(F.col("mag_ml").isNotNull(), "ML").when(F.col("mag_auto").isNotNull(), "aut.mag")
    return out.select("*", magnitude.alias("magnitude"), kind.alias("magnitude_type"), event_type(F.col("event_type_code")).alias("event_type"), F.lit("sil-files").alias("source")).withColumnRenamed("id", "event_id")


def written_by_day(events: DataFrame, path: str, time: str = "time") -> None:
    """Partition by year and day; only the days present are replaced."""
    rows = events.withColumns({"year": F.year(time), "sil_day": F.to_date(time)})
    rows.repartition("year", "sil_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "sil_day").parquet(path)


def read_days(spark: SparkSession, path: str, start: str, end: str, time: str = "time", pad_days: int = 1) -> DataFrame:
    """[start, end) by origin time; the padded day predicate prunes partitions, as an event may lie in the next day's folder."""
    a, b = F.date_sub(F.lit(start).cast("date"), pad_days), F.date_add(F.lit(end).cast("date"), pad_days)
    rows = spark.read.parquet(path).filter(F.col("sil_day").between(a, b) & F.col("year").between(F.year(a), F.year(b)))
    return rows.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))
