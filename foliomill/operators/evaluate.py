"""Evaluation: quality metrics against a policy, manifests, structure of rendered Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.pytext import lines, strip


def metrics(observations: DataFrame, policy: DataFrame, categories: DataFrame) -> DataFrame:
    """metric, category (null: all), ratio, unresolved, passed.

    observations: item_id, category, metric, numerator, denominator, unresolved. policy: metric, minimum, maximum. A category
    without rows of a metric counts as one unresolved; a metric passes if it and all its categories do. Both levels come from
    one pass over partial sums by metric and category.
    """
    cells = policy.select("metric").crossJoin(F.broadcast(categories))  # a few metrics by a few categories
    sums = observations.groupBy("metric", "category").agg(
        F.sum(F.when(~F.col("unresolved"), F.col("numerator"))).alias("num"), F.sum(F.when(~F.col("unresolved"), F.col("denominator"))).alias("den"), F.sum(F.col("unresolved").cast("long")).alias("open")
    )
    held = cells.join(sums, ["metric", "category"], "left").withColumn("open", F.coalesce("open", F.lit(1)))
    both = held.groupingSets([["metric"], ["metric", "category"]], "metric", "category").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("open").alias("unresolved"))
    rated = both.withColumn("ratio", F.when(F.col("den") > 0, F.col("num") / F.col("den"))).join(policy, "metric")
    ok = F.when(F.col("minimum").isNotNull(), F.col("ratio") >= F.col("minimum")).otherwise(F.col("ratio") <= F.col("maximum"))
    rated = rated.withColumn("alone", F.coalesce(ok, F.lit(False)))
    every = rated.groupBy("metric").agg(F.bool_and("alone").alias("every"))
    out = rated.join(every, "metric")
    return out.select("metric", "category", "ratio", "unresolved", F.when(F.col("category").isNull(), F.col("every")).otherwise(F.col("alone")).alias("passed"))


def invalid_observations(observations: DataFrame, policy: DataFrame) -> DataFrame:
    """item_id, metric, problem: repeated pairs, metrics not in the policy, numbers out of order."""
    twice = observations.groupBy("item_id", "metric").agg(F.count("*").alias("n")).where("n > 1").select("item_id", "metric", F.lit("duplicate").alias("problem"))
    unknown = observations.join(policy, "metric", "left_anti").select("item_id", "metric", F.lit("unknown metric").alias("problem"))
    wrong = observations.where("NOT (0 <= numerator AND numerator <= denominator)").select("item_id", "metric", F.lit("out of range").alias("problem"))
    return twice.unionByName(unknown).unionByName(wrong)


def crossing(items: DataFrame, digest: str, split: str) -> DataFrame:
    """digest, splits: contents that lie in more than one split."""
    return items.groupBy(digest).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def table_count(markdown: Column) -> Column:
    """Pipe tables in Markdown: lines with a pipe that a delimiter row follows."""
    all_ = lines(markdown)
    cells = lambda x: F.split(F.regexp_replace(strip(x), r"^\|+|\|+$", ""), r"\|")
    rule = lambda x: (F.size(cells(x)) > 1) & F.forall(cells(x), lambda c: c.rlike(r"^\s*:?-{3,}:?\s*$"))
    pairs = F.arrays_zip(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0))).alias("a"), F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0))).alias("b"))
    return F.size(F.filter(pairs, lambda p: p["a"].contains("|") & rule(p["b"])))


def anchors_in_order(markdown: Column, anchors: Column) -> Column:
    """Whether all anchors are there, their first places in order."""
    at = F.transform(anchors, lambda a: F.instr(markdown, a))
    return F.forall(at, lambda p: p > 0) & (at == F.sort_array(at))


def anchor_hashes(rendered: DataFrame) -> DataFrame:
    """doc_id, position, digest: SHA-256 of each stripped line of `markdown` that is not blank."""
    kept = F.filter(F.transform(lines(F.col("markdown")), strip), lambda x: x != "")
    return rendered.select("doc_id", F.posexplode(kept).alias("position", "line")).select("doc_id", "position", F.sha2(F.col("line").cast("binary"), 256).alias("digest"))


def same_outcome(runs: DataFrame) -> DataFrame:
    """doc_id, stable: whether all runs (run, markdown) of a document gave the same."""
    return runs.groupBy("doc_id").agg((F.count_distinct(F.sha2(F.col("markdown").cast("binary"), 256)) == 1).alias("stable"))
