"""Mixed timestamp formats and time zones, normalised to microseconds since 1970-01-01 UTC.

Every notation is taken apart by one pattern into date, clock, half of day and zone; the parts are
checked as a calendar would and put together as integers, so precision is never lost to a double.
Stamps without a zone get the stated default or, where ``instants`` is given the offset history that
``zone_evidence`` finds to violate the order of ingestion least, the zone of their source and time.

Defined results: null, blank and unreadable texts, dates and clock readings that do not exist and
local times skipped by a change of clocks have no instant; a local time that occurs twice is its
first occurrence; unknown zone names count as missing; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Abbreviations of European and North American zones, minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "TRT": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "HDT": -540,
}

_DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}-?\d{3}|\d{8}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}[ -][A-Za-z]{3,9}\.?[ -]\d{4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{6}(?:[.,]\d+)?"
_STAMP = rf"^({_DATE})(?:[Tt, ] *({_CLOCK}) *([AaPp]\.?[Mm]\.?)? *([+\-−]\d{{2}}(?::?\d{{2}})?|[A-Za-z]{{1,5}})?)?$"
_CTIME = r"^[A-Za-z]{3},? ([A-Za-z]{3}) +(\d{1,2}) ([\d:.,]+)( [A-Za-z]{1,5}| [+-]\d{2}:?\d{2})? (\d{4})$"
_PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:[0-5]\d(?:\.\d{1,9})?(?:[Zz]|[+-]\d{2}:\d{2})$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _int(c: Column) -> Column:
    return c.try_cast("long")


def _days(year: str, month: str, day: str) -> Column:
    """Days since 1970 of a date that exists, else null, by whole-number arithmetic in the proleptic Gregorian calendar.

    Years are counted from March, so that the leap day is a year's last.
    """
    y, m = f"({year} - if({month} <= 2, 1, 0))", f"({month} + if({month} > 2, -3, 9))"
    leap = f"({year} % 4 = 0 and ({year} % 100 <> 0 or {year} % 400 = 0))"
    last = f"case when {month} = 2 then if({leap}, 29, 28) when {month} in (4, 6, 9, 11) then 30 else 31 end"
    count = f"{y} * 365 + {y} div 4 - {y} div 100 + {y} div 400 + (153 * {m} + 2) div 5 + {day} - 1 - 719468"
    return F.expr(f"case when {year} between 1 and 9999 and {month} between 1 and 12 and {day} between 1 and {last} then {count} end").cast("long")


def _apart(array: Column) -> Column:
    """The array itself, by a function that keeps its projection out of the fused stage.

    The parts of a stamp fused into one method would exceed what the JVM compiles.
    """
    return F.transform(array, lambda x: x)


def _stage(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` as a generator of one row.

    Filters on a result and later projections are not pushed into it, which would write its
    expressions out again wherever they are used.
    """
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names the session's Java knows (a few hundred, whatever the data)."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _with_zoned(rows: DataFrame, seconds: str, zone: Column, out: str) -> DataFrame:
    """Adds UTC seconds of local seconds in a named zone: the first of two, null where skipped."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = _stage(rows, {"_zn": zone})
    # Only other zones than UTC need a zone's rules.
    rows = _stage(rows, {"_local": F.when(F.col("_zn") != "UTC", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(seconds).cast("decimal(18,6)")))})
    rows = _stage(rows, {"_utc": F.expr("convert_timezone(_zn, 'UTC', _local)")})
    back = F.expr("convert_timezone('UTC', _zn, _utc) = _local")
    utc = F.expr("cast(unix_date(cast(_utc as date)) as long) * 86400 + hour(_utc) * 3600 + minute(_utc) * 60 + second(_utc)")
    return _stage(rows, {out: F.when(F.col("_zn") == "UTC", F.col(seconds)).when(back, utc)}).drop("_local", "_zn", "_utc")


def _of(stamps: DataFrame, column: str) -> Column:
    """An input column within the result of ``parsed_stamps``."""
    return F.col(f"in_{stamps.columns.index(column)}")


def parsed_stamps(stamps: DataFrame, *, field: str = "field_name", text: str = "raw_text", epochs: str = "ref_epoch", years: str = "t") -> DataFrame:
    """local_s, micros, leap (second 60), offset_s (null: no zone in the text), number_us, and the input.

    The input's columns come as in_0, in_1, ..., so that no name of theirs can clash. ``number_us`` is set for bare numbers, which are UTC by definition. Built in stages that each
    use the columns of the one before, so that no expression is written out more than once.
    """
    rows = stamps.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(stamps.columns)], F.col(field).alias("_field"), F.col(text).alias("_text"))
    kind = F.when(F.col("_field") == epochs, "epoch").when(F.col("_field") == years, "year")
    raw = F.trim(F.regexp_replace(F.col("_text"), r"[\s\u00a0\u202f]+", " "))
    # The commonest notation, with its offset, is read by one cast; its text is then null and costs no more patterns.
    plain = F.when(F.col("_text").rlike(_PLAIN) & kind.isNull(), F.unix_micros(F.upper("_text").try_cast("timestamp")))
    rows = _stage(rows, {"_k": kind, "_fast": plain})
    rows = _stage(rows, {"_s": F.when(F.col("_fast").isNull(), F.regexp_replace(raw, _CTIME, "$2 $1 $5 $3$4"))})
    number, epoch, share = r"^(-?\d+)(?:[.,](\d*))?$", r"^(\d{2}|\d{4}):(\d{1,3}):(\d{1,5})$", r"^(\d{4})(?:[.,](\d+))?$"
    rows = _stage(rows, {"_k": F.when(F.col("_k").isNull() & F.col("_s").rlike(number), "number").otherwise(F.coalesce("_k", F.lit("stamp")))})
    # Three texts that every notation is brought to: a date Y-M-D or Y-DDD, a clock, a zone.
    # The notation's pattern is run once: its groups come out between marks, a text that is none of it whole.
    is_stamp = F.col("_k") == "stamp"
    rows = _stage(rows, {"_p": F.when(is_stamp, F.split(F.regexp_replace("_s", _STAMP, "$1\x1f$2\x1f$3\x1f$4"), "\x1f", -1))})
    part = lambda i: F.when(is_stamp, F.when(F.size("_p") == 4, F.col("_p")[i - 1]).otherwise(""))
    rows = _stage(rows, {"_d": part(1), "_c": part(2), "_h": part(3), "_z": F.upper(F.translate(part(4), "−", "-"))})
    brought = lambda *forms: reduce(lambda d, f: F.regexp_replace(d, *f), forms, F.col("_d"))
    date = (
        F.when(F.col("_d").rlike("[A-Za-z]"), brought((r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?[ -](\d{4})$", "$3-$2-$1"), (r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", "$3-$1-$2")))
        .when(F.col("_d").contains("-"), F.col("_d"))
        .when(F.col("_d").contains("/"), F.translate("_d", "/", "-"))
        .when(F.col("_d").contains("."), brought((r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")))
        .otherwise(brought((r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), (r"^(\d{4})(\d{3})$", "$1-$2")))
    )
    # Share and epoch notations give a date too: the first day of their year, to count from.
    rows = _stage(rows, 
        {
            "_d": _apart(F.split(F.when(F.col("_k") == "stamp", date).when(F.col("_k") == "year", F.regexp_replace("_s", share, "$1-1-1")).when(F.col("_k") == "epoch", F.regexp_replace("_s", epoch, "$1-$2")), "-")),
            "_c": F.split(F.regexp_replace(F.regexp_replace("_c", r"^(\d{2})(\d{2})(\d{2})", "$1:$2:$3"), ",", "."), "[:.]"),
            "_pm": F.upper(F.substring("_h", 1, 1)),
            "_zm": F.rpad(F.regexp_replace(F.substring("_z", 2, 9), ":", ""), 4, "0"),
        }
    )
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    month = at("_d", 2)
    named = (F.instr(F.lit(_MONTHS), F.lower(month)) + 2) / 3
    year = _int(at("_d", 1))
    rows = _stage(rows, 
        {
            "_y": F.when((F.col("_k") == "epoch") & (F.length(at("_d", 1)) == 2), year + F.when(year <= 50, 2000).otherwise(1900)).otherwise(year),
            "_m": F.when(month.rlike("^[A-Za-z]"), F.when(named == F.floor(named), named.cast("long"))).otherwise(_int(month)),
            "_dd": _int(at("_d", 3)),
            "_hh": _int(at("_c", 1)),
            "_mi": F.coalesce(_int(at("_c", 2)), F.lit(0)),
            "_ss": F.coalesce(_int(at("_c", 3)), F.lit(0)),
            "_us": F.coalesce(_int(F.rpad(F.substring(at("_c", 4), 1, 6), 6, "0")), F.lit(0)),
            "_zh": _int(F.substring("_zm", 1, 2)),
            "_zi": _int(F.substring("_zm", 3, 2)),
        }
    )
    rows = _stage(rows, 
        {
            "_first": _days("_y", "1", "1"),
            "_next": _days("(_y + 1)", "1", "1"),
            "_day": F.when(F.size("_d") == 3, _days("_y", "_m", "_dd")),
            "_us": _apart(F.array("_us")),
            "_hh": F.expr("case when _c[0] = '' or _c is null then 0 when _pm = '' then _hh when _hh between 1 and 12 then _hh % 12 + if(_pm = 'P', 12, 0) end"),
        }
    )
    names = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    rows = _stage(rows, 
        {
            # The day itself, counted within the year where the notation does so.
            "_day": F.expr("case when _day is not null then _day when size(_d) = 2 and _m between 1 and _next - _first then _first + _m - 1 end"),
            "_sod": F.expr("case when _hh between 0 and 23 and _mi between 0 and 59 and _ss between 0 and 60 then _hh * 3600 + _mi * 60 + if(_ss = 60, 0, _ss) end"),
            "leap": F.expr("coalesce(_k = 'stamp' and _ss = 60, false)"),
            "_off": F.when(F.col("_z").rlike("^[+-]"), F.expr("case when _zh <= 18 and _zi <= 59 then (_zh * 3600 + _zi * 60) * if(_z like '-%', -1, 1) end")).when(F.col("_z") != "", F.try_element_at(names, F.col("_z"))),
            "_size": F.when(F.col("_k") == "number", F.abs(_int(F.regexp_extract("_s", number, 1)))),
            "_frac": _apart(F.array(F.when(F.col("_k") == "number", F.regexp_extract("_s", number, 2)))),
            "_sec": F.when(F.col("_k") == "epoch", _int(F.regexp_extract("_s", epoch, 3))),
            # The zero keeps a year without a share readable.
            "_part": F.when((F.col("_k") == "year") & F.col("_s").rlike(share) & (F.col("_y") > 0), F.concat(F.lit("0."), F.substring(F.regexp_extract("_s", share, 2), 1, 18), F.lit("0"))).try_cast("decimal(20,18)"),
        }
    )
    rows = _stage(rows, {"_places": F.expr("case when _size < 100000000000 then 6 when _size < 100000000000000 then 3 else 0 end")})
    out = _stage(rows, 
        {
            "number_us": F.expr("case when _fast is not null then _fast when _k = 'number' then (_size * cast(pow(10, _places) as long) + if(_places = 0, 0, coalesce(try_cast(rpad(substring(_frac[0], 1, _places), _places, '0') as long), 0))) * if(_s like '-%', -1, 1) end"),
            "local_s": F.expr(
                "case when _k = 'stamp' and (_z = '' or _off is not null) then _day * 86400 + _sod"
                " when _k = 'epoch' and _sec <= 86400 then _day * 86400 + _sec"
                " when _k = 'year' then _first * 86400 + cast(round(_part * cast((_next - _first) * 86400 as decimal(10,0)), 0) as long) end"
            ),
            "micros": F.expr("if(_k = 'stamp' and not leap, _us[0], 0)"),
            "offset_s": F.col("_off"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _usable(spark: SparkSession, name: Column) -> Column:
    return name.isin(*known_zones(spark)) | name.rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$")


def observed_zones(stamps: DataFrame, *, zone: str = "zone_name") -> list[str]:
    """The known zone names that the stamps give (a few hundred at most, whatever the data)."""
    name = F.trim(F.col(zone))
    return sorted(r[0] for r in stamps.select(name).filter(name.isin(*known_zones(stamps.sparkSession))).distinct().collect())


def instants(
    stamps: DataFrame, *, zone: str = "zone_name", default_zone: str = "UTC", out: str = "utc_us", zones: DataFrame | None = None, source: str = "field_name", received: str = "received_at", **columns: str
) -> DataFrame:
    """The rows with ``utc_us``, the instant in microseconds, null where the stamp denotes none.

    An offset or abbreviation in the text decides, else the zone column, else the zone that
    ``zones`` (source, zone, and since and until of the time of ingestion, open where null) has for
    the stamp, else ``default_zone``. Intervals of one source must not overlap.
    """
    spark, rows, default = stamps.sparkSession, parsed_stamps(stamps, **columns), F.lit(default_zone)
    if zones is not None:
        bound = lambda c: (F.col(c) if c in zones.columns else F.lit(None)).cast("timestamp_ntz").alias(f"_{c}")
        history = zones.select(F.col("source").alias("_source"), F.col("zone").alias("_est"), bound("since"), bound("until"))
        came = _of(stamps, received)
        within = (F.col("_since").isNull() | (F.col("_since") <= came)) & (F.col("_until").isNull() | (came < F.col("_until")))
        rows = rows.join(history, _of(stamps, source).eqNullSafe(F.col("_source")) & within, "left")
        default = F.when(_usable(spark, F.col("_est")), F.col("_est")).otherwise(default)
    name = F.trim(_of(stamps, zone))
    # A text with its own offset, and a bare number, need no zone.
    rows = _stage(rows, {"_zoneless": F.expr("case when offset_s is null and number_us is null then local_s end")})
    rows = _with_zoned(rows, "_zoneless", F.when(_usable(spark, name), name).otherwise(default), "zoned_s")
    value = F.expr("coalesce(number_us, (if(offset_s is not null, local_s - offset_s, zoned_s) + if(leap, 60, 0)) * 1000000 + micros)")
    kept = [_of(stamps, c).alias(c) for c in stamps.columns if c.lower() != out.lower()]
    return _stage(rows, {"_value": value.cast("long")}).select(*kept, F.col("_value").alias(out))


def zone_evidence(stamps: DataFrame, candidates: list[str], *, source: str = "field_name", received: str = "received_at", zone: str = "zone_name", period: str | None = None, **columns: str) -> DataFrame:
    """Per source and candidate zone: zone-less stamps, violations and the median lag to ingestion.

    With a ``period`` (as of date_trunc) also per period of ingestion: since.

    A stamp read in the wrong zone may lie after its own ingestion or fall into a skipped hour:
    both are violations. ``rank`` 1 is the offset history with the fewest, the shortest lag
    breaking ties. One row a source, candidate and map task is shuffled.
    """
    rows = parsed_stamps(stamps, **columns).filter(F.col("local_s").isNotNull() & F.col("offset_s").isNull() & F.col("number_us").isNull() & _of(stamps, zone).isNull())
    came = _of(stamps, received)
    known = F.unix_date(came.cast("date")).cast("long") * 86400 + F.hour(came) * 3600 + F.minute(came) * 60 + F.second(came).cast("long")
    rows = rows.withColumn("known", known)
    lags = []
    for i, name in enumerate(candidates):
        rows = _with_zoned(rows, "local_s", F.lit(name), f"zone_{i}")
        lags.append(F.struct(F.lit(name).alias("zone"), (F.col("known") - F.col(f"zone_{i}")).alias("lag_s")))
    group = {"source": _of(stamps, source)} | ({"since": F.date_trunc(period, came).cast("timestamp_ntz")} if period else {})
    long = rows.select(*[c.alias(n) for n, c in group.items()], F.explode(F.array(*lags)).alias("t")).select(*group, "t.*")
    scored = long.groupBy(*group, "zone").agg(
        F.count("*").alias("n_stamps"),
        F.count_if(F.col("lag_s").isNull() | (F.col("lag_s") < 0)).alias("n_violations"),
        F.percentile_approx("lag_s", 0.5, 1000).alias("median_lag_s"),
    )
    order = W.partitionBy(*group).orderBy("n_violations", F.abs("median_lag_s"), "zone")
    return scored.withColumn("rank", F.row_number().over(order))


def offset_history(evidence: DataFrame) -> DataFrame:
    """The chosen zone of each source: source, zone; of evidence by period also since and until, without gaps, open at both ends."""
    best = evidence.filter("rank = 1")
    if "since" not in evidence.columns:
        return best.select("source", "zone")
    w = W.partitionBy("source").orderBy("since")
    best = best.filter("since is not null").withColumns({"until": F.lead("since").over(w), "since": F.when(F.row_number().over(w) > 1, F.col("since"))})
    return best.select("source", "zone", "since", "until")
