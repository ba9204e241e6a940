"""Cuts of the lineage that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where the setting is absent, a local session gets a temporary folder, and any
    other master an error: executors would write where nobody else reads."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not at and held.isDefined():
        at = held.get()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="foliomill-")
    if not held.isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new path below the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/foliomill/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it was counted and has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
