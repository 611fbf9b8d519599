"""Catalogues as web services answer them: GeoJSON, FDSN text and channels, QuakeML, paged windows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seiche.operators.predicates import guarded
from seiche.operators.stamps import instants
from seiche.operators.windows import first_per_key
from seiche.sources.text import Source, number, plain_lines, whole_texts


def utc(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the instant of a textual time as a timestamp."""
    rows = df.withColumns({"_field": F.lit("time"), "_zone": F.lit(None).cast("string")})
    rows = instants(rows, field="_field", text=column, zone="_zone", out="_us")
    return rows.withColumn(out, F.timestamp_micros("_us")).drop("_field", "_zone", "_us")


def geojson_features(spark: SparkSession, paths: Source) -> DataFrame:
    """file, pos, lon, lat, depth_km (of the coordinates) and properties, a map of names to JSON text."""
    rows = whole_texts(spark, paths).select("file", F.try_parse_json("value").alias("v"))
    features = rows.select("file", F.posexplode(F.expr("try_variant_get(v, '$.features', 'array<variant>')")).alias("pos", "f"))
    at = lambda k: F.expr(f"try_variant_get(f, '$.geometry.coordinates[{k}]', 'double')")
    props = F.expr("try_cast(try_variant_get(f, '$.properties', 'variant') as map<string,variant>)")
    return features.select("file", "pos", at(0).alias("lon"), at(1).alias("lat"), at(2).alias("depth_km"), F.transform_values(props, lambda k, v: F.to_json(v)).alias("properties"))


def prop(name: str, kind: str = "string") -> Column:
    """A property of ``geojson_features`` by name, typed; null where it is absent or of another type."""
    text = F.try_element_at("properties", F.lit(name))
    plain = F.when(text != "null", F.when(text.startswith('"'), F.expr(f"try_variant_get(try_parse_json(try_element_at(properties, '{name}')), '$', 'string')")).otherwise(text))
    return plain if kind == "string" else plain.try_cast(kind)


def geojson_events(spark: SparkSession, paths: Source, source: str) -> DataFrame:
    """Catalogue events of GeoJSON answers: the first of each id, out-of-range values null, further properties kept."""
    rows = geojson_features(spark, paths)
    known = ("event_id", "time", "type", "magnitude", "magnitude_type", "evaluation_mode", "evaluation_status", "depth", "phases", "updated_time")
    out = rows.select(
        "file", "pos", prop("event_id").alias("event_id"), prop("time").alias("time_text"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.coalesce(prop("depth", "double"), "depth_km").alias("depth_km"),
        prop("magnitude", "double").alias("magnitude"), prop("magnitude_type").alias("magnitude_type"), prop("evaluation_mode").alias("evaluation_mode"), prop("evaluation_status").alias("evaluation_status"),
        prop("type").alias("event_type"), prop("phases", "long").alias("n_phases"), F.map_filter("properties", lambda k, v: ~k.isin(*known)).alias("extra"), F.lit(source).alias("source"),
    )
    out = utc(out, "time_text", "time").drop("time_text")
    out = first_per_key(out.filter("event_id is not null"), ["event_id"], [F.col("file"), F.col("pos")]).drop("file", "pos")
    return guarded(out, {"latitude": (-90, 90), "longitude": (-180, 180), "depth_km": (-5, 800), "magnitude": (-3, 10)}, ["latitude", "longitude"])


# The columns of FDSN event and channel text.
EVENT_TEXT = ("event_id", "time", "latitude", "longitude", "depth_km", "author", "catalog", "contributor", "contributor_id", "magnitude_type", "magnitude", "magnitude_author", "location", "event_type")
CHANNEL_TEXT = ("network", "station", "location", "channel", "latitude", "longitude", "elevation", "depth", "azimuth", "dip", "sensor", "scale", "scale_freq", "scale_units", "sample_rate", "start_time", "end_time")


def _bars(spark: SparkSession, paths: Source, names: tuple[str, ...], numbers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    rows = plain_lines(spark, paths).filter("trim(line) <> '' and line not like '#%'").withColumn("p", F.split("line", r"\|", -1))
    good = rows.filter(F.size("p") == len(names)).select("file", *[(number(F.col("p")[k]) if n in numbers else F.nullif(F.trim(F.col("p")[k]), F.lit(""))).alias(n) for k, n in enumerate(names)])
    return good, rows.filter(F.size("p") != len(names)).select("file", "line", F.concat(F.lit("fields "), F.size("p").cast("string")).alias("reason"))


def fdsn_events(spark: SparkSession, paths: Source) -> tuple[DataFrame, DataFrame]:
    """(events, failed lines) of FDSN event text; the mode follows from the author."""
    rows, failed = _bars(spark, paths, EVENT_TEXT, ("latitude", "longitude", "depth_km", "magnitude"))
    mode = F.when(F.lower("author").rlike("auto|scauto|scevent"), "automatic").when(F.col("author").isNotNull(), "manual")
    return utc(rows.withColumnRenamed("time", "time_text"), "time_text", "time").drop("time_text").withColumn("evaluation_mode", mode), failed


def fdsn_channels(spark: SparkSession, paths: Source) -> tuple[DataFrame, DataFrame]:
    """(channels, failed lines) of FDSN station text; an open end is null."""
    rows, failed = _bars(spark, paths, CHANNEL_TEXT, ("latitude", "longitude", "elevation", "depth", "azimuth", "dip", "scale", "scale_freq", "sample_rate"))
    return rows.withColumns({c: F.try_to_timestamp(F.regexp_replace(c, "Z$", "")).cast("timestamp_ntz") for c in ("start_time", "end_time")}), failed


_REAL = "STRUCT<value: STRING, uncertainty: STRING>"
_QUAKEML = f"""_publicID STRING, preferredOriginID STRING, type STRING,
origin ARRAY<STRUCT<_publicID: STRING, time: {_REAL}, latitude: {_REAL}, longitude: {_REAL}, depth: {_REAL}, evaluationMode: STRING, evaluationStatus: STRING>>,
magnitude ARRAY<STRUCT<_publicID: STRING, mag: {_REAL}, type: STRING, originID: STRING>>,
pick ARRAY<STRUCT<_publicID: STRING, time: {_REAL}, phaseHint: STRING>>,
focalMechanism ARRAY<STRUCT<_publicID: STRING, nodalPlanes: STRUCT<nodalPlane1: STRUCT<strike: {_REAL}, dip: {_REAL}, rake: {_REAL}>, nodalPlane2: STRUCT<strike: {_REAL}, dip: {_REAL}, rake: {_REAL}>>>>"""


def quakeml(spark: SparkSession, paths: Source) -> dict[str, DataFrame]:
    """events, origins, magnitudes, picks and mechanisms of QuakeML files, keyed by event_id."""
    rows = spark.read.format("xml").option("rowTag", "event").option("ignoreNamespace", "true").schema(_QUAKEML).load(paths)
    rows = rows.withColumn("event_id", F.element_at(F.split("_publicID", "/"), -1))
    child = lambda name: rows.select("event_id", F.explode(name).alias("c"))
    d = lambda path: number(F.col(f"c.{path}.value"))
    return {
        "events": rows.select("event_id", F.col("type").alias("event_type"), F.col("preferredOriginID").alias("preferred_origin_id")),
        "origins": child("origin").select("event_id", F.col("c._publicID").alias("origin_id"), F.try_to_timestamp(F.regexp_replace("c.time.value", "Z$", "")).cast("timestamp_ntz").alias("time"), d("latitude").alias("latitude"), d("longitude").alias("longitude"), (d("depth") / 1000).alias("depth_km"), F.col("c.evaluationMode").alias("evaluation_mode"), F.col("c.evaluationStatus").alias("evaluation_status")),
        "magnitudes": child("magnitude").select("event_id", F.col("c._publicID").alias("magnitude_id"), d("mag").alias("magnitude"), F.col("c.type").alias("magnitude_type"), F.col("c.originID").alias("origin_id")),
        "picks": child("pick").select("event_id", F.col("c._publicID").alias("pick_id"), F.try_to_timestamp(F.regexp_replace("c.time.value", "Z$", "")).cast("timestamp_ntz").alias("time"), F.col("c.phaseHint").alias("phase")),
        "mechanisms": child("focalMechanism").select("event_id", F.col("c._publicID").alias("mechanism_id"), *[d(f"nodalPlanes.nodalPlane{k}.{a}").alias(f"{a}{k}") for k in (1, 2) for a in ("strike", "dip", "rake")]),
    }


def bisected(count: Callable[[float, float], int], start: float, end: float, limit: int, least: float = 1.0) -> list[tuple[float, float]]:
    """Half-open windows that each hold at most ``limit`` rows by the service's count, halved until they do."""
    if end - start <= least or count(start, end) <= limit:
        return [(start, end)]
    middle = (start + end) / 2
    return bisected(count, start, middle, limit, least) + bisected(count, middle, end, limit, least)


class _Window(InputPartition):
    def __init__(self, start: float, end: float) -> None:
        super().__init__(None)
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    """Reads each window of time from the service; windows are the partitions."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def _transport(self) -> Callable[[str, dict[str, str]], str]:
        import importlib

        if name := self.options.get("transport"):
            module, _, attribute = name.rpartition(":")
            return getattr(importlib.import_module(module), attribute)
        from urllib.parse import urlencode
        from urllib.request import urlopen

        return lambda url, query: urlopen(f"{url}?{urlencode(query)}", timeout=60).read().decode("utf-8")

    def _ask(self, start: float, end: float, **more: str) -> str:
        stamp = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        return self._transport()(self.options["url"], {"starttime": stamp(start), "endtime": stamp(end), **more})

    def partitions(self) -> list[InputPartition]:
        start, end = (dt.datetime.fromisoformat(self.options[k].replace("Z", "+00:00")) for k in ("start", "end"))
        a, b = (x.replace(tzinfo=x.tzinfo or dt.timezone.utc).timestamp() for x in (start, end))
        count = lambda s, e: int(json.loads(self._ask(s, e, format="count"))["count"])
        return [_Window(s, e) for s, e in bisected(count, a, b, int(self.options.get("limit", "10000")))]

    def read(self, partition: _Window) -> Iterator[tuple[str, str]]:
        for f in json.loads(self._ask(partition.start, partition.end, format="geojson")).get("features", []):
            yield str((f.get("properties") or {}).get("event_id")), json.dumps(f, sort_keys=True)


class PagedSource(DataSource):
    """``spark.read.format("seiche_paged")`` with url, start, end, limit, and transport ("module:function") for tests."""

    @classmethod
    def name(cls) -> str:
        return "seiche_paged"

    def schema(self) -> str:
        return "event_id string, body string"

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(dict(self.options))
