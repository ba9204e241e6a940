"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.plans.lineage import written

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "few", "identity", "remainder", "short", "slots", "table", "texts", "written"]

#: Rows that a Python function looks at together; texts are long, so these are few. Arrow batches are bounded in bytes by Spark.
BATCH_ROWS = 256
#: A table is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """`batches` cut to `rows` rows or fewer; no setting of the session is touched, for plans that have yet to run share it."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (string) of `docs`; other columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def identity(doc_id: Column, text: Column) -> list[Column]:
    """slot and mark: 128 bits that name a row by its id and its whole text. Only rows that are equal in both share them."""
    held = F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text
    return [F.xxhash64(*held).alias("slot"), F.xxhash64(F.lit("mark"), *reversed(held)).alias("mark")]


def slots(docs: DataFrame, *others: str | Column) -> DataFrame:
    """doc_id, slot, mark (see `identity`), text (null is empty), then `others`."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), *identity(doc_id, text), text.alias("text"), *others)


def remainder(doc_id: str, parts: int):
    """crc32 of doc_id as text, mod `parts`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it was counted and has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
