"""Typed catalogues: column specifications, coercion, validation in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seiche.functions.geo import number

SCHEMA_VERSION = 4


@dataclass(frozen=True)
class Spec:
    """A column: its Spark type, whether null is allowed, closed values, inclusive range."""

    name: str
    kind: str
    nullable: bool = True
    allowed: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None


# Sources, magnitude types, modes, statuses and event types of a catalogue.
SOURCES = ("sil-files", "quakes-sil", "skjalftalisa", "quakes-seiscomp", "fdsn-seiscomp")
MAGNITUDE_TYPES = ("Mlw", "ML", "Msil_auto", "aut.mag", "events.ref", "ML_SIL", "Mpgv_w", "M", "Mpgv_alert")
MODES = ("manual", "automatic")
STATUSES = ("preliminary", "confirmed", "reviewed", "final", "rejected", "reported")
EVENT_TYPES = ("earthquake", "explosion", "not locatable", "not existing", "other")

EVENTS = (
    Spec("time", "timestamp", False),
    Spec("source", "string", False, SOURCES),
    Spec("event_id", "string", False),
    Spec("sil_path", "string"),
    Spec("sil_aut_path", "string"),
    Spec("latitude", "double", False, None, -90, 90),
    Spec("longitude", "double", False, None, -180, 180),
    Spec("depth_km", "double", True, None, -5, 800),
    Spec("h_err_km", "double", True, None, 0),
    Spec("depth_err_km", "double", True, None, 0),
    Spec("magnitude", "double", True, None, -3, 10),
    Spec("magnitude_type", "string", True, MAGNITUDE_TYPES),
    *(Spec(m, "double", True, None, -3, 10) for m in ("mag_mlw", "mag_ml", "mag_auto", "mag_pgv")),
    Spec("moment_nm", "double", True, None, 0),
    Spec("evaluation_mode", "string", False, MODES),
    Spec("evaluation_status", "string", True, STATUSES),
    Spec("event_type", "string", True, EVENT_TYPES),
    Spec("event_type_code", "string"),
    Spec("quality", "double", True, None, 0, 100),
    Spec("n_phases", "bigint", True, None, 0),
    Spec("azimuthal_gap", "double", True, None, 0, 360),
    Spec("updated_time", "timestamp"),
    Spec("possible_duplicate", "boolean"),
)

MECHANISMS = (
    Spec("time", "timestamp", False),
    Spec("source", "string", False, SOURCES),
    Spec("event_id", "string", False),
    Spec("method", "string"),
    Spec("strike1", "double", False, None, 0, 360),
    Spec("dip1", "double", False, None, 0, 90),
    Spec("rake1", "double", False, None, -180, 180),
    Spec("strike2", "double", True, None, 0, 360),
    Spec("dip2", "double", True, None, 0, 90),
    Spec("rake2", "double", True, None, -180, 180),
    *(Spec(c, "double") for c in ("quality", "misfit", "stress_drop_mpa", "corner_freq_hz")),
    *(Spec(c, "bigint", True, None, 0) for c in ("n_polarities", "n_amplitudes")),
    Spec("sil_faulting_class", "string"),
    Spec("planes_inconsistent", "boolean"),
)


def struct_type(specs: Iterable[Spec]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{s.name} {s.kind}" for s in specs))


def coerced(df: DataFrame, specs: Iterable[Spec]) -> DataFrame:
    """Missing columns as null, known ones cast and first, extra ones kept last; NaN becomes null.

    A value that cannot be cast becomes null; ``validated`` reports required ones. Extra columns
    whose names differ from a known one only in case keep their data under their own name.
    """
    have = set(df.columns)

    def column(s: Spec) -> Column:
        if s.name not in have:
            return F.lit(None).cast(s.kind).alias(s.name)
        c = F.col(f"`{s.name}`").try_cast(s.kind)
        return (number(c) if s.kind == "double" else c).alias(s.name)

    specs = list(specs)
    known = {s.name for s in specs}
    return df.select(*[column(s) for s in specs], *[F.col(f"`{c}`") for c in df.columns if c not in known])


def checks(df: DataFrame, *, required: Iterable[str] = (), ranges: dict[str, tuple[float | None, float | None]] | None = None, allowed: dict[str, Iterable[str]] | None = None, key: list[str] | None = None) -> DataFrame:
    """One row of counts: missing_<c>, outside_<c>, unknown_<c>, repeated_key, n_rows."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required]
    for c, (low, high) in (ranges or {}).items():
        v = number(c)
        bad = F.lit(False)
        bad = bad | (v < low) if low is not None else bad
        bad = bad | (v > high) if high is not None else bad
        counts.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"outside_{c}"))
    for c, values in (allowed or {}).items():
        counts.append(F.count_if(F.coalesce(~F.col(c).isin(list(values)), F.lit(False))).alias(f"unknown_{c}"))
    if key:
        counts.append((F.count("*") - F.count_distinct(*key)).alias("repeated_key"))
    return df.agg(*counts, F.count("*").alias("n_rows"))


def validated(df: DataFrame, specs: Iterable[Spec], examples: int = 5) -> DataFrame:
    """column, issue (missing column, missing, out of range, unknown value), n, examples; no rows are dropped."""
    have = set(df.columns)
    rows, absent = [], []
    for s in specs:
        if s.name not in have:
            absent.append(s.name)
            continue
        c = F.col(f"`{s.name}`")
        v = number(c) if s.kind == "double" else c
        if not s.nullable:
            rows.append((s.name, "missing", v.isNull()))
        if s.allowed:
            rows.append((s.name, "unknown value", ~c.isin(list(s.allowed))))
        if s.low is not None or s.high is not None:
            bad = F.lit(False)
            bad = bad | (v < s.low) if s.low is not None else bad
            bad = bad | (v > s.high) if s.high is not None else bad
            rows.append((s.name, "out of range", bad))
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(n).alias("column"), F.lit(i).alias("issue"), F.col(f"`{n}`").cast("string").alias("value"))) for n, i, t in rows]))
    out = df.select(F.explode(found).alias("f")).select("f.*").groupBy("column", "issue").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    if absent:
        spark = df.sparkSession
        out = out.unionByName(spark.createDataFrame([(n, "missing column", None, None, None) for n in absent], "column string, issue string, n long, least string, greatest string"))
    return out


def ordered(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """The listed columns that are there first, then the others in their order."""
    head = [c for c in first if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*head, *[c for c in df.columns if c not in head]]])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that are there under other names; two that would get one name raise."""
    out = [names.get(c, c) for c in df.columns]
    if len({n.lower() for n in out}) != len(out):
        raise ValueError(f"one name twice in {out}")
    return df.toDF(*out)
