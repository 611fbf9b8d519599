"""Text files as numbered lines, fixed-width layouts, numbers with marks for missing ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where files are read from: paths, or a frame of files already read (file, line_no, line; for whole texts file, value).
Source = "str | list[str] | DataFrame"


def _of_pattern(rows: DataFrame, pattern: str | None) -> DataFrame:
    """The rows of files whose name matches a shell pattern."""
    if pattern is None:
        return rows
    from seiche.operators.predicates import glob_match

    return rows.filter(glob_match(F.element_at(F.split("file", "/"), -1), [pattern]))


def lines(spark: SparkSession, paths: Source, pattern: str | None = None, charset: str = "ISO-8859-1") -> DataFrame:
    """file, line_no (from 1), line of small files, each read whole; compressed ones are left to ``packed_lines``.

    For files larger than an executor's memory use ``plain_lines``, which splits them but numbers nothing.
    """
    if isinstance(paths, DataFrame):
        return _of_pattern(paths.select("file", "line_no", "line"), pattern)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(paths)
    text = rows.filter(~F.col("path").endswith(".gz")).select(F.col("path").alias("file"), F.decode("content", charset).alias("value"))
    return numbered(text, "\n$")


def numbered(texts: DataFrame, cut: str = "$^") -> DataFrame:
    """file, line_no, line of whole texts (file, value); ``cut`` is taken off first."""
    parts = F.split(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), cut, ""), "\n", -1)
    return texts.select("file", F.posexplode(parts).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_no"), "line")


def whole_texts(spark: SparkSession, paths: Source, pattern: str | None = None) -> DataFrame:
    """file, value of texts read whole; Spark unpacks compressed ones by suffix."""
    if isinstance(paths, DataFrame):
        return _of_pattern(paths.select("file", "value"), pattern)
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")


def packed_lines(spark: SparkSession, paths: Source) -> DataFrame:
    """file, line_no, line of files that Spark unpacks by suffix, each read whole."""
    if isinstance(paths, DataFrame):
        return paths.select("file", "line_no", "line")
    return numbered(whole_texts(spark, paths))


def plain_lines(spark: SparkSession, paths: Source) -> DataFrame:
    if isinstance(paths, DataFrame):
        return paths.select("file", "line")
    return spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def words(line: Column) -> Column:
    """The words of a line, none for a blank one."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def word(line: Column, k: int) -> Column:
    return F.try_element_at(words(line), F.lit(k))


def number(text: Column) -> Column:
    """A double; blank, stars, NaN and anything else that is none give null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def clock_seconds(text: Column) -> Column:
    """Seconds of HHMMSS.sss or HH:MM:SS.s; blanks are zeros, second 60 goes on into the next minute."""
    digits = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), ":", "")
    digits = F.regexp_replace(digits, " ", "0")
    h, m, s = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int"), F.substring(digits, 5, 12).try_cast("double")
    return F.when(h.between(0, 23) & m.between(0, 59) & (s >= 0) & (s < 61), h * 3600 + m * 60 + s)


def at(day: Column, seconds: Column) -> Column:
    """A date and seconds of the day as a timestamp without zone, to the microsecond."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


@dataclass(frozen=True)
class Layout:
    """Fields by first and end column; ``text`` names those that are no numbers."""

    name: str
    width: int
    fields: tuple[tuple[str, int, int], ...]
    text: tuple[str, ...] = ()


def fixed_width(rows: DataFrame, layouts: list[Layout], line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(records, failed lines) of lines whose layout is told by their width.

    Fields are stripped; blank, stars and NaN mean missing. A line of no known width, or with a
    field that is no number, fails with a reason; blank lines are neither. Records have the fields
    of all layouts.
    """
    rows = rows.filter(F.trim(line) != "").withColumn("layout", F.create_map(*[F.lit(x) for lay in layouts for x in (lay.width, lay.name)])[F.length(line)])
    names = list(dict.fromkeys(f for lay in layouts for f, _, _ in lay.fields))
    text = {t for lay in layouts for t in lay.text}
    raw: dict[str, Column] = {}
    for n in names:
        value = F.lit(None).cast("string")
        for lay in layouts:
            for f, a, b in lay.fields:
                if f == n:
                    value = F.when(F.col("layout") == lay.name, F.trim(F.substring(line, a + 1, b - a))).otherwise(value)
        raw[n] = value
    parts = rows.withColumns({f"_{n}": F.when(~raw[n].rlike(r"^(\*+|[Nn][Aa][Nn]|)$"), raw[n]) for n in names})
    bad = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull() & F.col(f"_{n}").try_cast("double").isNull(), F.lit(n)) for n in names if n not in text]))
    parts = parts.withColumn("reason", F.when(F.col("layout").isNull(), F.concat(F.lit("width "), F.length(line).cast("string"))).when(F.size(bad) > 0, F.concat(F.lit("no number: "), F.array_join(bad, ", "))))
    keep = [c for c in rows.columns if c not in (line, "layout")]
    good = parts.filter("reason is null").select(*keep, "layout", *[(F.col(f"_{n}") if n in text else F.col(f"_{n}").try_cast("double")).alias(n) for n in names])
    return good, parts.filter("reason is not null").select(*keep, line, "reason")
