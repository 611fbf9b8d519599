"""Series that keep growing: bucket medians, sessions and late corrections as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.session import shared_dir, written


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The files at a path (a file or a folder) as a stream with the schema they have now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_now(stream: DataFrame, mode: str = "update", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process what is there and return everything written, with ``batch``, the micro-batch.

    A batch run again after a failure replaces its own output. With the same ``checkpoint`` and
    ``out`` a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    checkpoint, out = checkpoint or shared_dir(spark, "stream-checkpoint"), out or shared_dir(spark, "stream-out")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def streamed_bucket_medians(spark: SparkSession, path: str, time: str, width: str, value: str, lateness: str = "2 days", files_per_batch: int = 1000) -> DataFrame:
    """bucket, value (median), n of tumbling windows, kept up to date as files arrive.

    A bucket is written again by every batch that adds to it; the last one counts. Rows later than
    ``lateness`` are dropped by the stream: buckets that hold fewer rows than the source has for
    them are computed again from the source.
    """
    median = F.median(F.when(~F.isnan(value), F.col(value))).alias("value")
    timed = lambda rows: rows.withColumn("_t", F.col(time).cast("timestamp"))
    buckets = timed(stream_of(spark, path, files_per_batch)).withWatermark("_t", lateness).groupBy(F.window("_t", width)).agg(median, F.count("*").alias("n"))
    out = run_to_now(buckets.select(F.col("window.start").alias("bucket"), "value", "n"))
    last = out.groupBy("bucket").agg(F.max(F.struct("batch", "value", "n")).alias("l")).select("bucket", "l.value", "l.n")
    source = timed(spark.read.parquet(path)).withColumn("bucket", F.window("_t", width)["start"])
    counted = source.groupBy("bucket").agg(F.count("*").alias("n_all"))
    short = written(counted.join(last, "bucket", "left").filter("n is null or n < n_all").select("bucket"), "late-buckets")
    again = source.join(short, "bucket", "left_semi").groupBy("bucket").agg(median, F.count("*").alias("n"))
    whole = last.join(short, "bucket", "left_anti").unionByName(again)
    return whole.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "value", "n")


def sessions(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, first, n of runs of rows less than ``gap`` apart; works on a stream as on a table."""
    grouped = rows.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("first"), "n")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both tables, the latest of each key by ``order``; a change replaces what it equals."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    rank = F.struct(*order, "_new", F.struct(*rest).alias("_row"))
    return both.groupBy(*keys).agg(F.max(rank).getField("_row").alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def reviewed_over_automatic(rows: DataFrame, key: str, mode: str, order: list[str]) -> DataFrame:
    """The automatic row of an event stands until a reviewed one is there; of each the latest."""
    rest = [c for c in rows.columns if c != key]
    rank = F.struct((F.col(mode) == "manual").alias("r"), *order, F.struct(*rest).alias("_row"))
    return rows.groupBy(key).agg(F.max(rank).getField("_row").alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files (file, size, mtime) that are new, or not of the size and time they had when they were last taken."""
    known = state.select("file", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    rows = listing.join(known, "file", "left")
    return rows.filter("_s is null or _s <> size or _m <> mtime").select("file", "size", "mtime")


def harvested(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of the files read again in the place of those of the same keys."""
    return upserted(current.withColumn("_run", F.lit(0)), fresh.withColumn("_run", F.lit(1)), keys, ["_run"]).drop("_run")


def harvest_state(state: DataFrame, taken: DataFrame) -> DataFrame:
    """The state after a run: what was taken replaces what was known of the same files."""
    return state.join(taken.select("file"), "file", "left_anti").unionByName(taken)


def gathered_days(cached: DataFrame, wanted: DataFrame, today: object, *, day: str = "day", recent_days: int = 30, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cached rows that may be used, days to be read anew) of the wanted days.

    A day is final once it is more than ``recent_days`` old; a younger one is always read again and never
    kept, so rows may come that late.
    """
    final = F.datediff(F.lit(today).cast("date"), F.col(day)) > recent_days
    have = cached.select(day).distinct().filter(final & F.lit(not refresh))
    return cached.join(have.join(wanted.select(day).distinct(), day), day, "left_semi"), wanted.select(day).distinct().join(have, day, "left_anti")


def storable_days(read: DataFrame, today: object, *, day: str = "day", recent_days: int = 30) -> DataFrame:
    """Of the rows just read those of final days: what goes into the cache."""
    return read.filter(F.datediff(F.lit(today).cast("date"), F.col(day)) > recent_days)
