"""What an application may set once for its session; operators set nothing."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: Spark's own bound is 64 MB, of which a worker and its executor hold several copies.
BATCH, KEY, OWN = "16777216b", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def tuned(spark: SparkSession) -> SparkSession:
    """The session with smaller Arrow batches, unless its owner has chosen a bound; the same for every plan, whenever it runs."""
    if spark.conf.get(KEY, OWN) == OWN:
        spark.conf.set(KEY, BATCH)
    return spark
