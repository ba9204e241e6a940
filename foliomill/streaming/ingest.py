"""Files as a stream: the stateless text path over a folder that grows, and deduplication by digest within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators import text
from foliomill.operators.detect import basename


def texts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, name, text, modified: text files of a folder as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), basename(F.col("path")).alias("name"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("modified"))


def markdown(stream: DataFrame) -> DataFrame:
    return text.to_markdown(stream)


def fresh(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Texts not seen within the watermark, by digest; state is bounded by it."""
    return stream.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withWatermark("modified", delay).dropDuplicatesWithinWatermark(["digest"])


def to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything at hand now, then done; a second run takes up what is new."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
