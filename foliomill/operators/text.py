"""Plain text and Markdown: from a document's text to blocks, and to Markdown in one narrow step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import pytext as T

#: Bytes a text document may have, and characters an output may have.
TEXT_BYTES, OUTPUT_CHARS = 20_000_000, 400_000
BLANK_LINES = r"\n(?:[ \t]*\n)+"


def paragraphs(text: Column) -> Column:
    """Paragraphs of a plain text that hold more than white space; array of string."""
    return F.filter(F.split(T.newlines(text), BLANK_LINES, -1), lambda p: ~T.is_blank(p))


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, block_index (from 1), kind, text: a row for each paragraph."""
    return docs.select("doc_id", F.posexplode(paragraphs(F.col(text))).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("block_index"), F.lit("text").alias("kind"), "text")


def fitting(rendered: Column, budget: int) -> Column:
    """How many leading blocks fit in the budget, joined by blank lines and closed by a newline."""
    start = F.struct(F.lit(1).cast("long").alias("total"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, block: Column) -> Column:
        total = acc["total"] + F.length(block) + F.when(acc["n"] > 0, 2).otherwise(0)
        full = acc["full"] | (total > budget)
        return F.struct(F.when(full, acc["total"]).otherwise(total).alias("total"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    return F.aggregate(rendered, start, step)["n"]


def to_markdown(docs: DataFrame, budget: int = OUTPUT_CHARS) -> DataFrame:
    """doc_id, markdown, n_blocks, n_warnings, error_code: plain texts rendered without a shuffle, for a text's blocks lie in its row."""
    held = docs.select("doc_id", F.octet_length("text").alias("bytes"), F.transform(paragraphs(F.coalesce("text", F.lit(""))), lambda p: T.escape(T.drop_trailing_newlines(p))).alias("rendered"))
    held = held.withColumn("n", fitting(F.col("rendered"), budget))
    error = F.when(F.col("bytes") > TEXT_BYTES, "limit_exceeded").when(F.size("rendered") == 0, "no_usable_content").when(F.col("n") == 0, "limit_exceeded")
    return held.select(
        "doc_id",
        F.when(error.isNull(), F.concat(F.array_join(F.slice("rendered", 1, F.col("n")), "\n\n"), F.lit("\n"))).alias("markdown"),
        F.when(error.isNull(), F.col("n")).otherwise(0).alias("n_blocks"),
        F.when(error.isNull() & (F.col("n") < F.size("rendered")), 1).otherwise(0).alias("n_warnings"),
        error.alias("error_code"),
    )
