"""Session factory and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "seiche", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; the settings for tests and single machines."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Where it is unset on a single machine
    (a local master) a temporary folder is made and set on the context, and later calls reuse it;
    on a cluster a folder of one machine would lose data, so that raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="seiche-")
            context.setCheckpointDir(base)
            base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Write one text file wherever the path is, through a temporary name and a rename: a reader sees all of it or nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside)
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, True)
    fs.rename(beside, target)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
