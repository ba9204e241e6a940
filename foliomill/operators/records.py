"""Operators on records of many documents: digests, bounded warnings, ordering and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: warnings of one code that are kept for a document.
WARNINGS_PER_CODE = 20


def canonical(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """digest, first (the least `order`), n: one row for each distinct digest, by partial aggregation."""
    return rows.groupBy(digest).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def replay(rows: DataFrame, outcomes: DataFrame, digest: str) -> DataFrame:
    """Every occurrence with the outcome found once for its digest; null where there is none."""
    return rows.join(outcomes, digest, "left")


def bounded(warnings: DataFrame, keep: int = WARNINGS_PER_CODE, same_code: bool = False) -> DataFrame:
    """doc_id, code, rank, message: the first `keep` warnings of each code by seq, then a summary of the rest.

    The summary has the rank `keep` + 1, and a code of its own unless `same_code`. Ranks within a code that floods one document
    are limited before the shuffle.
    """
    by = Window.partitionBy("doc_id", "code").orderBy("seq")
    first = warnings.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep).select("doc_id", "code", "rank", "message")
    rest = warnings.groupBy("doc_id", "code").agg((F.count("*") - keep).alias("n")).where("n > 0")
    told = F.concat(F.col("n").cast("string"), F.lit(" additional "), F.col("code"), F.lit(" warnings suppressed")) if same_code else F.concat(F.lit("suppressed "), F.col("n").cast("string"), F.lit(" additional "), F.col("code"), F.lit(" warnings"))
    code = F.col("code") if same_code else F.lit("office_warnings_truncated")
    return first.unionByName(rest.select("doc_id", code.alias("code"), F.lit(keep + 1).alias("rank"), told.alias("message")))


def ordinals(slots: DataFrame, *group: str) -> DataFrame:
    """`slots` with object_index: their place by anchor row, column, kind and ordinal."""
    return slots.withColumn("object_index", F.row_number().over(Window.partitionBy(*group).orderBy("row", "col", "kind_rank", "ordinal")))


def column_letters(number: Column) -> Column:
    """Spreadsheet letters of a column number from 1 to 18278 (three letters)."""
    letter = lambda n: F.chr((F.lit(65) + n).cast("long"))
    one, two = number - 1, number - 27
    three = number - 703
    return (
        F.when(number <= 26, letter(one))
        .when(number <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def column_number(letters: Column) -> Column:
    return F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def dot(counters: DataFrame, weights: dict[str, int], group: str) -> DataFrame:
    """group, cost: counters weighted and summed."""
    cost = sum((F.col(c) * w for c, w in weights.items()), F.lit(0))
    return counters.groupBy(group).agg(F.sum(cost).alias("cost"))


def peak(events: DataFrame, group: str) -> DataFrame:
    """group, peak: the most intervals (start, stop) open at once; an end counts before a start at the same instant."""
    edges = events.select(group, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(group, "e.*")
    edges = edges.groupBy(group, "at", "d").agg(F.sum("d").alias("step"))
    open_ = F.sum("step").over(Window.partitionBy(group).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("open", open_).groupBy(group).agg(F.max("open").alias("peak"))


#: What a log line must not show.
SECRET, PATHS = r"(?i)\b(api_key|token|provider_payload|prompt)=\S+", r"(^|[^\p{L}\p{N}_.])/[^\s]+"


def redact(message: Column) -> Column:
    """A log message without secrets and absolute paths."""
    return F.regexp_replace(F.regexp_replace(message, SECRET, "$1=[REDACTED]"), PATHS, "$1[REDACTED]")
