"""Toxicity (operator 2): a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram. From labelled rows r = log(share of toxic rows that have it / share of other
rows), smoothed; of r only what lies beyond `SURE` standard errors counts, so that chance in rare n-grams says nothing. Every
feature is scaled by that, none is left out for want of room, and a logistic regression with an l2 penalty is fitted on them by
dual coordinate descent, rows weighted to the classes' true shares.

Learned from: labels joined to documents whose crc32(doc_id as text) mod 5 is not 0, on a sample of at most `SAMPLE` labelled
rows, up to half of them toxic; who is in the sample is decided by a hash of doc_id. Only the text enters a score. Labels with
a null id or a value other than 0 and 1 are ignored; of several labels of one document the largest counts.

Null texts are scored like empty ones. Without labels of both classes every score is the share of toxic labels (0 if there are
none). A null doc_id is not held out. Repeated rows are kept. An empty table gives an empty table. Columns other than doc_id,
text and toxic are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import remainder, short, written
from foliomill.llm.ngrams import batches, grams

#: Most labelled rows that are learned from, and tasks that make their features.
SAMPLE, TASKS = 8000, 16
SIZES, DIMS = (4, 5, 6), 1 << 18
#: The smoothing of counts, standard errors of a ratio that don't count, the bound of a row's dual variable, passes over the rows.
SMOOTHING, SURE, COST, EPOCHS = 0.5, 2.0, 1.0, 30
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.float32))
    bias: float = -50.0


#: Texts whose buckets are marked at once, so that the marks take little memory.
MARKED = 32


def present(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket), once for each bucket that a text has, in order of the texts."""
    found = []
    for first in range(0, len(texts), MARKED):
        some = texts[first : first + MARKED]
        seen = np.zeros(len(some) * DIMS, bool)
        for number, bucket in grams(some, SIZES, DIMS):
            seen[number.astype(np.int64) * DIMS + bucket] = True
        found.append(np.flatnonzero(seen) + first * DIMS)
    pairs = np.concatenate(found) if found else np.empty(0, np.int64)
    return pairs >> 18, pairs & DIMS - 1


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, list[int], list[float]]:
    """(toxic, text) of the labelled rows learned from; labels of each class; the share of each that was drawn."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = [0, 0]
    for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        n[r.toxic] = r.n
    toxic = min(n[1], max(sample // 2, sample - n[0]))
    share = [min(1.0, (sample - toxic) / max(n[0], 1)), min(1.0, toxic / max(n[1], 1))]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    few = marks.where(drawn < limit).orderBy(drawn, "doc_id").limit(sample)  # at most `sample` small rows: they are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"), n, share


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and a bias: the least of |w|^2 / 2 + sum(cost * log loss), by dual coordinate descent.

    rows: the buckets of each row, of which the values are `scale`. The bias is a feature of its own. Rows are taken in turns
    drawn with a fixed seed; for each one its dual variable a, between 0 and its cost, is moved by Newton steps.
    """
    sign, w, b = np.where(y == 1, 1.0, -1.0), np.zeros(len(scale)), 0.0
    size = np.array([(scale[at] ** 2).sum() + 1 for at in rows])
    a = np.minimum(1e-3 * cost, 1e-8)
    for at, s, x in zip(rows, sign, a):
        w[at] += s * x * scale[at]
        b += s * x
    turns = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in turns.permutation(len(rows)):
            at, c = rows[i], cost[i]
            values = scale[at]
            margin, old, x = sign[i] * (w[at] @ values + b), a[i], a[i]
            for _ in range(20):  # g(x) = size * (x - old) + margin + log(x / (c - x)) = 0, which rises with x
                g = size[i] * (x - old) + margin + np.log(x / (c - x))
                step = g / (size[i] + c / (x * (c - x)))
                new = x - step
                x = x / 10 if new <= 0 else (x + 9 * c) / 10 if new >= c else new
                x = min(max(x, 1e-12 * c), c * (1 - 1e-12))
                if abs(g) < 1e-4:
                    break
            if (d := x - old) != 0:
                w[at] += sign[i] * d * values
                b += sign[i] * d
                a[i], moved = x, max(moved, abs(d) / c)
        if moved < 1e-3:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of `docs` that may be learned from."""
    rows, n, share = sampled(docs, labels, sample)
    if not n[0] or not n[1]:
        return Model(bias=50.0 if n[1] else -50.0)

    rows = written(rows.repartition(TASKS))

    def partial(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, DIMS), np.int64)
        for batch in short(batches_):
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for first, some in batches(batch.column(1).to_pylist()):
                number, bucket = present(some)
                for c in (0, 1):
                    counts[c] += np.bincount(bucket[toxic[first + number] == c], minlength=DIMS)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(counts[c, at]) for c in (0, 1))], ["bucket", "n0", "n1"])

    summed = rows.mapInArrow(partial, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, DIMS))
    counts[:, summed["bucket"].to_numpy()] = summed["n0"].to_numpy(), summed["n1"].to_numpy()
    seen = np.zeros(2)
    for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        seen[r.toxic] = r.n
    if not seen.all():
        return Model(bias=50.0 if seen[1] else -50.0)
    scale = ratios(counts, seen)
    useful = scale != 0

    def features(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches_):
            at: list[np.ndarray] = []
            for _, some in batches(batch.column(1).to_pylist()):
                number, bucket = present(some)
                number, bucket = number[useful[bucket]], bucket[useful[bucket]]
                at += np.split(bucket.astype(np.int32), np.searchsorted(number, np.arange(1, len(some))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["toxic", "at"])

    got = rows.mapInArrow(features, "toxic int, at array<int>").toArrow()
    y, of = got["toxic"].to_numpy(), []
    for held in got["at"].chunks:  # views: the features are held once
        starts, buckets = held.offsets.to_numpy(), held.values.to_numpy()
        of += [buckets[s:e] for s, e in zip(starts, starts[1:])]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(of[i]), xxhash.xxh64_intdigest(of[i])))  # whatever the order of the tasks
    weight = np.where(y[order] == 1, 1 / share[1], 1 / share[0])
    w, b = logistic([of[i] for i in order], y[order], scale, COST * weight / weight.mean())
    return Model((w * scale).astype(np.float32), float(b))


def ratios(counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Log-count ratio of every bucket, less `SURE` standard errors. counts: 2 x buckets; seen: rows of each class."""
    smooth = counts + SMOOTHING
    r = np.log(smooth[1] / (seen[1] + 2 * SMOOTHING)) - np.log(smooth[0] / (seen[0] + 2 * SMOOTHING))
    return np.sign(r) * np.maximum(np.abs(r) - SURE * np.sqrt((1 / smooth).sum(axis=0)), 0)


def score(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5), then the columns `others` of `docs` as they are."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches_):
            logits = np.full(batch.num_rows, model.bias)
            for first, some in batches([t or "" for t in batch.column(2).to_pylist()]):
                number, bucket = present(some)
                logits[first : first + len(some)] += np.bincount(number, model.weights[bucket], minlength=len(some))
            p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *batch.columns[3:]], ["doc_id", "held_out", "score", "predicted", *batch.schema.names[3:]])

    held_out = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    rows = rows.select("doc_id", held_out, "text", *others)
    extra = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int{extra}")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the model does not reject, with all their columns."""
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    return score(whole, model, "whole").where("predicted = 0").select("whole.*")
