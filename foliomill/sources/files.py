"""Files and bytes as rows of sources, and Markdown files as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.detect import REMOTE, SOURCE_BYTES, basename, portable, source_error

#: Whole files that are extracted before their rows are passed on.
FILE_BATCH = 16


def remote(name: str) -> bool:
    """Whether a name has a scheme that is refused."""
    return name.split(":", 1)[0].lower() in REMOTE and ":" in name


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id, name, content, error_code: the files below a folder.

    Sizes are tested on the listing, so that a file beyond the limit is not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    ok = files.where(F.col("length") <= SOURCE_BYTES).select("path", "content", F.lit(None).cast("string").alias("error_code"))
    over = files.where(F.col("length") > SOURCE_BYTES).select("path", F.lit(None).cast("binary").alias("content"), F.lit("limit_exceeded").alias("error_code"))
    rows = ok.unionByName(over)
    return rows.select(F.xxhash64("path").alias("doc_id"), basename(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("name"), "content", "error_code")


def from_memory(spark: SparkSession, items: list[tuple[str | None, bytes]]) -> DataFrame:
    """The same columns for (name, bytes) pairs; remote names are refused, not fetched."""
    rows = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(items)], "doc_id long, name string, content binary")
    return rows.withColumn("error_code", source_error(F.coalesce("name", F.lit("")), F.octet_length("content")))


def output_names(results: DataFrame) -> DataFrame:
    """`results` with output_name and name_error: a stem that two results share, or a name that is not portable, is an error."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rows = results.withColumn("output_name", F.concat(stem, F.lit(".md")))
    shared = rows.groupBy("output_name").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(shared, "output_name", "left")
    return rows.withColumn("name_error", F.when(F.col("_n").isNotNull(), "names collide").when(~portable(F.col("output_name")), "name is not portable")).drop("_n")


def write_markdown(results: DataFrame, path: str) -> None:
    """One folder partition for each output, its only row the Markdown."""
    good = output_names(results).where("error_code IS NULL AND name_error IS NULL")
    good.select(F.regexp_replace("markdown", "\n$", "").alias("value"), "output_name").write.partitionBy("output_name").text(path)
