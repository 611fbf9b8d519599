"""Small tables that steer the work: CSV with required headers, nested documents, station lists, sensor data."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.functions.geo import number


def strict_csv(spark: SparkSession, path: str | DataFrame, headers: list[str], key: list[str] | None = None) -> DataFrame:
    """A CSV with '#' comments whose header must be one of ``headers`` (DDL); a repeated key raises.

    The CSV is a file anywhere, or lines read already. Values that are no number of their column's type
    raise, too, when the rows are read.
    """
    from seiche.sources.text import lines

    rows = lines(spark, path, charset="UTF-8").filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    head = rows.orderBy("file", "line_no").head()
    names = [c.strip() for c in (head["line"] if head else "").split(",")]
    ddl = next((h for h in headers if [c.split()[0] for c in h.split(",")] == names), None)
    if ddl is None:
        raise ValueError(f"unexpected header {','.join(names)!r}")
    body = rows.filter(F.col("line_no") > head["line_no"]).select(F.from_csv("line", ddl, {"mode": "FAILFAST"}).alias("r"))
    df = body.select("r.*")
    if key and (twice := df.groupBy(*key).count().filter("count > 1").head()):
        raise ValueError(f"repeated {twice.asDict()}")
    return df


# The headers of the small tables.
FIT_WINDOWS = ["sta string, window_start double, window_end double, comment string", "sta string, frame string, window_start double, window_end double, segments string, max_gap_years double, min_epochs int, min_span_years double, steps string, comment string"]
STEPS = ["sta string, epoch_yearf double, component string, kind string, source string, comment string"]
PROTECT_WINDOWS = ["sta string, start_yearf double, end_yearf double, comment string"]
OVERRIDES = ["sta string, despike boolean, window_order int, window_robust_iterations int, epoch_policy string, despike_n_sigma double, min_outlier_n double, min_outlier_e double, min_outlier_u double"]
NETWORK_DAYS = ["date date, status string, share double, n_bad int, n_voting int, n_bad_north int, n_bad_east int, n_bad_up int"]
COMMON_MODE = ["date date, cm_north double, cm_east double, cm_up double, n_north int, n_east int, n_up int, provisional boolean"]


def network_days(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return strict_csv(spark, path, NETWORK_DAYS).withColumn("status", F.coalesce("status", F.lit("")))


def steps_by_component(steps: DataFrame) -> DataFrame:
    """sta, epoch_yearf, north, east, up: whether a step is declared for the component (ALL is all)."""
    on = lambda c: F.bool_or(F.upper("component").isin(c, "ALL"))
    return steps.groupBy("sta", "epoch_yearf").agg(on("N").alias("north"), on("E").alias("east"), on("U").alias("up"))


def resolved_settings(stations: DataFrame, settings: DataFrame, frame: str, defaults: dict[str, object]) -> DataFrame:
    """A station's row for the frame, else its row without one, else the defaults, field by field."""
    own = settings.filter(F.col("frame") == frame).drop("frame")
    general = settings.filter(F.col("frame").isNull() | (F.col("frame") == "")).drop("frame")
    fields = [c for c in own.columns if c != "sta"]
    rows = stations.select("sta").join(own.withColumnsRenamed({c: f"o_{c}" for c in fields}), "sta", "left").join(general.withColumnsRenamed({c: f"g_{c}" for c in fields}), "sta", "left")
    return rows.select("sta", *[F.coalesce(f"o_{c}", f"g_{c}", F.lit(defaults.get(c))).alias(c) for c in fields])


def yaml_document(path: str, block: str | None = None) -> dict:
    """A YAML document, or the mapping at a dotted path of it; {} where the path is absent."""
    import yaml

    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    for k in block.split(".") if block else ():
        doc = doc.get(k, {}) if isinstance(doc, dict) else {}
    return doc


def events_table(spark: SparkSession, doc: dict) -> DataFrame:
    """name, kind, onset, end of declared events, by onset; regions as an array."""
    date = lambda v: v if isinstance(v, (dt.date, type(None))) else dt.date.fromisoformat(str(v))
    rows = [(k, v.get("kind"), date(v.get("onset")), date(v.get("end")), list(v.get("regions", []))) for k, v in doc.items()]
    return spark.createDataFrame(sorted(rows, key=lambda r: (str(r[2]), r[0])), "name string, kind string, onset date, end date, regions array<string>")


def areas_table(spark: SparkSession, doc: dict) -> DataFrame:
    """area, station of every section whose name ends in _areas."""
    rows = sorted({(a, s.upper()) for section, areas in doc.items() if section.endswith("_areas") for a, stations in (areas or {}).items() for s in (stations.get("stations") if isinstance(stations, dict) else stations) or ()})
    return spark.createDataFrame(rows, "area string, station string")


def parameters_of(spark: SparkSession, doc: dict, schema: int = 1) -> DataFrame:
    """station, frame, component, name, value, sigma of a parameter document; another schema raises."""
    if doc.get("schema") != schema:
        raise ValueError(f"parameter schema {doc.get('schema')}, not {schema}")
    rows = [(sta, r.get("frame"), comp, name, float(v[0]), float(v[1]) if len(v) > 1 else None) for sta, r in doc.get("stations", {}).items() for comp, values in r.get("params", {}).items() for name, v in values.items()]
    return spark.createDataFrame(rows, "station string, frame string, component string, name string, value double, sigma double")


def parameter_records(spark: SparkSession, path: str, schema: int = 1) -> DataFrame:
    """``parameters_of`` a file."""
    return parameters_of(spark, json.loads(Path(path).read_text(encoding="utf-8")), schema)


def median_over_networks(rows: DataFrame, fields: tuple[str, ...], day: str = "date", n: str = "num") -> DataFrame:
    """Per date the median over networks of each field; rows without residuals are dropped, unknown numbers kept."""
    return rows.filter(F.col(n).isNull() | F.isnan(n) | (F.col(n) > 0)).groupBy(day).agg(*[F.median(number(f)).alias(f) for f in fields])


def autcln_daily(spark: SparkSession, path: str) -> DataFrame:
    """Per date the median over networks of each statistic; rows without residuals are dropped, unknown numbers kept."""
    fields = ("rms", "num", "ams", "ams_ratio", "atelv_a", "atelv_b", "atelv_low", "az_absmean", "el_absmean")
    rows = spark.read.option("header", "true").schema("date date, net string, " + ", ".join(f"{f} double" for f in fields)).csv(path)
    return median_over_networks(rows, fields)


def complete_rows(rows: DataFrame, time: str, values: list[str], start: str, end: str) -> DataFrame:
    """Texts as a time and numbers; rows with a missing value dropped, closed on both ends, repeats kept."""
    rows = rows.select(F.try_to_timestamp(time).cast("timestamp_ntz").alias(time), *[number(F.col(v).try_cast("double")).alias(v) for v in values]).dropna()
    return rows.filter(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def hydrology(spark: SparkSession, paths: str | list[str], time: str, values: list[str], start: str, end: str) -> DataFrame:
    """``complete_rows`` of yearly CSV files."""
    return complete_rows(spark.read.option("header", "true").csv(paths), time, values, start, end)


def multigas(observations: DataFrame, acquisitions: DataFrame, stations: DataFrame, kinds: DataFrame, station: str, start: str, end: str, names: list[str]) -> DataFrame:
    """observation_time and one column a kind, from four tables; the first row of an acquisition is left out.

    Bounds are inclusive, as a database reads them; CO2 comes in per cent of 10 000.
    """
    rows = observations.join(acquisitions, "acquisition_id").join(stations, "station_id").join(kinds, "kind_id")
    rows = rows.filter((F.col("station_name") == station) & F.col("observation_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    first = rows.groupBy("acquisition_id").agg(F.min("observation_time").alias("_first"))
    rows = rows.join(first, "acquisition_id").filter(F.col("observation_time") > F.col("_first"))
    wide = rows.groupBy("observation_time").pivot("kind_name", names).agg(F.first("value"))
    return wide.withColumn("co2", F.col("co2") * 1e-4) if "co2" in names else wide


def through_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 8, **options: str) -> DataFrame:
    """A database table read in parts of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.options(**options).load()


def plates(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """station, plate of whitespace-separated lines; the last line of a station counts."""
    from seiche.sources.text import lines, words

    rows = lines(spark, path).filter("trim(line) <> '' and line not like '#%'").withColumn("w", words(F.col("line"))).filter(F.size("w") >= 2)
    return rows.groupBy(F.upper(F.col("w")[0]).alias("station")).agg(F.max_by(F.upper(F.col("w")[1]), "line_no").alias("plate"))
