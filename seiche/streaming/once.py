"""Messages delivered more than once: keep exactly one copy of each.

One stream parses each message once and writes its identifier. A second one, a streaming
aggregation, keeps for every identifier seen the delivery that arrived first and the one that
arrived last. Its state store is keyed by the identifier, expires by the event-time watermark and
is checkpointed with the offsets; the sink writes each micro-batch under its batch number, so a
batch that is run again after a failure replaces its own output. Where first and last differ, the
others are repeats. Deliveries later than the watermark are dropped by the state store and found
again by a lookup of the span of messages older than it.

Defined results: rows with a null in any part of the identifier are no messages and never
dropped; ties in arrival go to the smallest delivery number; exact repeats of a row with one
delivery number count as one delivery; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seiche.operators.stamps import instants
from seiche.session import shared_dir


Prepare = Callable[[DataFrame], DataFrame]


def message_identity(messages: DataFrame, *, event_id: str = "event_id", updated_time: str = "updated_time") -> DataFrame:
    """Adds k_event (case and outer blanks ignored) and k_instant (timestamp UTC)."""
    rows = messages.withColumns({"_field": F.lit("updated_time"), "_zone": F.lit(None).cast("string")})
    rows = instants(rows, field="_field", text=updated_time, zone="_zone", out="k_instant").drop("_field", "_zone")
    rows = rows.withColumn("k_event", F.lower(F.regexp_replace(F.col(event_id), r"^\s+|\s+$", "")))
    return rows.withColumn("k_instant", F.timestamp_micros("k_instant"))


def identified(spark: SparkSession, path: str, *, key: list[str], arrived: str, number: str, prepare: Prepare, files_per_batch: int, checkpoint: str, out: str, event_time: str) -> DataFrame:
    """All messages as key, own (arrived, number), each parsed once: streams the files that are new at ``path`` into ``out``.

    Within a file the rows are in order of the event time, so that a reader of a span skips the rest.
    """
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file or a folder
    rows = prepare(rows).filter(" and ".join(f"`{k}` is not null" for k in [*key, arrived, number]))
    rows = rows.select(*key, F.struct(F.col(arrived).alias("at"), F.col(number).alias("number")).alias("own"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.sortWithinPartitions(event_time).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(out)


def first_deliveries(spark: SparkSession, messages: str, *, key: list[str], event_time: str, lateness: str, files_per_batch: int, checkpoint: str, out: str, schema: StructType) -> tuple[DataFrame, datetime.datetime]:
    """Run the state store over the messages that are new; returns key, first, n and the latest watermark that dropped rows.

    An identifier leaves the state store once the watermark, the latest event time less
    ``lateness``, has passed it. Called again with the same folders it goes on where it was. Hot
    identifiers cost one row a map task: the minimum is combined before the shuffle.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{messages}/batch=*")
    first = rows.withWatermark(event_time, lateness).groupBy(*key).agg(F.min("own").alias("first"), F.max("own").alias("last"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    first.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(first.schema).option("recursiveFileLookup", "true").parquet(out)
    return seen.groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last")), _watermark(spark, checkpoint)


def _watermark(spark: SparkSession, checkpoint: str) -> datetime.datetime:
    """The watermark of the last batch that read anything: no row after it was ever dropped as late.

    From the stream's log of offsets, of which Spark keeps the last hundred batches.
    """
    log = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(F.input_file_name(), "value").collect()
    before, out = None, 0
    for name, text in sorted(log, key=lambda r: int(r[0].rsplit("/", 1)[-1])):
        _, about, offset = text.strip().split("\n", 2)
        if offset != before:
            out, before = json.loads(about)["batchWatermarkMs"], offset
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=out)


def repeated_deliveries(
    spark: SparkSession,
    path: str,
    *,
    key: list[str],
    event_time: str,
    arrived: str = "received_at",
    number: str = "delivery_id",
    prepare: Prepare = lambda df: df,
    lateness: str = "30 days",
    files_per_batch: int = 1000,
    folder: str | None = None,
) -> DataFrame:
    """Every delivery to be dropped: key, number. Exactly one delivery of each identifier is left.

    ``event_time`` is a timestamp of the key. Called again with the same ``folder``, which holds the
    checkpoints, the messages and the state store's output, it goes on with the files that are new.
    The state store decides for every identifier after its watermark. Only identifiers not after
    the watermark of a batch can have been dropped there as late; for them the messages are looked
    up, a span of event time that the reader finds by the files' statistics.
    """
    folder = folder or shared_dir(spark, "once")
    messages = f"{folder}/messages"
    stream = {"files_per_batch": files_per_batch, "event_time": event_time, "key": key}
    rows = identified(spark, path, arrived=arrived, number=number, prepare=prepare, checkpoint=f"{folder}/checkpoint-messages", out=messages, **stream)
    first, watermark = first_deliveries(spark, messages, lateness=lateness, checkpoint=f"{folder}/checkpoint-first", out=f"{folder}/first", schema=rows.schema, **stream)
    since = F.lit(watermark).cast(rows.schema[event_time].dataType)
    # Most identifiers came once: only the others' messages are looked at.
    repeated = first.filter((F.col(event_time) > since) & (F.col("first") != F.col("last"))).select(*key, "first")
    late = rows.filter(F.col(event_time) <= since)
    looked = late.groupBy(*key).agg(F.min("own").alias("first"), F.max("own").alias("last")).filter("first <> last").select(*key, "first")
    dropped = rows.join(repeated, key).unionByName(late.join(looked, key)).filter("own <> first")
    return dropped.select(*key, F.col("own.number").alias(number)).distinct()
