"""Language identification (operator 1).

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams, trained by the follow-the-regularised-
leader proximal update with an elastic net (l1 and l2), then calibrated by one temperature on rows kept aside.

Learned from: text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2. Document frequencies are counted
over all of these. Weights are fitted on a sample of at most `SAMPLE` of them, as many of each language as there are, up to an
equal share; who is in the sample is decided by a hash of doc_id. Neither lang nor source nor doc_id enters a prediction.

Null texts and texts without a letter get `und` with score 0; so does every text if there is nothing to learn from. A null
doc_id is never learned from and is not held out. At most the `CLASSES` most frequent values of lang are learned, so that dirty
values cannot swell the model; ties go to the smaller value. Repeated rows are kept. An empty table gives an empty table. Columns other
than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import remainder, short
from foliomill.llm.ngrams import batches, grams

#: Most rows that weights are fitted on.
SAMPLE = 2000
#: Most languages that are learned.
CLASSES = 256
SIZES, DIMS, EPOCHS = (1, 2, 3), 1 << 13, 3
#: Step size and its floor, and the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
FOLDS, HELD_OUT = 4, 2


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS + 1, 0), np.float32))
    temperature: float = 1.0


def sparse(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, how often) of every bucket that a text has, in order."""
    out = np.zeros(len(texts) * dims, np.int32)
    for number, bucket in grams(texts, SIZES, dims):
        out += np.bincount(number.astype(np.int64) * dims + bucket, minlength=len(out)).astype(np.int32)
    at = np.flatnonzero(out)
    return at // dims, at % dims, out[at]


def weighted(number: np.ndarray, bucket: np.ndarray, tf: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """TF-IDF with logarithmic term counts, so that each text's values have length one."""
    x = np.log1p(tf.astype(np.float32)) * idf[bucket]
    return x / np.maximum(np.sqrt(np.bincount(number, x * x, minlength=texts)), 1e-9)[number]


def logits(number: np.ndarray, bucket: np.ndarray, x: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """texts x classes: the sum over the buckets that a text has; the last row of `weights` is the bias."""
    used = weights[:-1].any(axis=1)[bucket]
    number, bucket, x = number[used], bucket[used], x[used]
    return np.stack([np.bincount(number, x * weights[bucket, c], minlength=texts) for c in range(weights.shape[1])], axis=1) + weights[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, classes: int, epochs: int = EPOCHS, l1: float = L1) -> np.ndarray:
    """Weights (dims x classes) by FTRL-proximal; rows: (columns, values)."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def lazily(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    turns = np.random.default_rng(7)
    for _ in range(epochs):
        for i in turns.permutation(len(rows)):
            at, x = rows[i]
            w = lazily(z[at], n[at])
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return lazily(z, n).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the learnable rows of `docs`."""
    rows = learnable(docs)
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES).collect()}
    if not found:
        return Model()
    langs = sorted(found)
    rows = rows.where(F.col("lang").isin(langs))
    total = sum(found.values())

    def partial(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS, np.int64)
        for batch in short(batches_):
            for _, some in batches(batch.column(0).to_pylist()):
                df += np.bincount(sparse(some)[1], minlength=DIMS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["bucket", "n"])

    df = np.zeros(DIMS, np.int64)
    for r in rows.select("text").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1

    share = max(1, sample // len(langs))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    limit = F.create_map(*(x for k, n in found.items() for x in (F.lit(k), F.lit(int(min(1.0, share / n) * (1 << 30))))))
    picked = rows.where(drawn < limit[F.col("lang")]).select("lang", drawn.alias("drawn"), "text")

    def features(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches_):
            held = batch.column(2).to_pylist()
            at, tf = [], []
            for _, some in batches(held):
                number, bucket, times = sparse(some)
                cuts = np.searchsorted(number, np.arange(1, len(some)))
                at += np.split(bucket.astype(np.int32), cuts)
                tf += np.split(times, cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["lang", "drawn", "at", "tf"])

    got = picked.mapInArrow(features, "lang string, drawn long, at array<int>, tf array<int>").orderBy("drawn", "lang", "at").limit(sample).toArrow()
    y = np.array([langs.index(x) for x in got["lang"].to_pylist()], np.int64)
    data = []
    for at, tf in zip(got["at"].chunks and got["at"].combine_chunks() or [], got["tf"].chunks and got["tf"].combine_chunks() or []):
        i = at.values.to_numpy().astype(np.int64)
        x = weighted(np.zeros(len(i), np.int64), i, tf.values.to_numpy(), idf, 1)
        data.append((np.append(i, DIMS), np.append(x, 1).astype(np.float32)))
    apart = np.arange(len(y)) % 5 == 0  # rows kept aside for the temperature; the order is that of a hash
    train = [i for i in range(len(y)) if not apart[i]] or [*range(len(y))]
    w = ftrl([data[i] for i in train], y[train], DIMS + 1, len(langs))
    kept = np.flatnonzero(apart)
    apart_logits = np.array([data[i][1] @ w[data[i][0]] for i in kept]).reshape(len(kept), len(langs))
    return Model(langs, idf, w, temperature(apart_logits, y[kept]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the calibrated probability of lang_pred)."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches_):
            texts = batch.column(2).to_pylist()
            lettered = [bool(model.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for first, some in batches([t if ok else "" for t, ok in zip(texts, lettered)]):
                if not model.langs:
                    break
                number, bucket, tf = sparse(some)
                x = weighted(number, bucket, tf, model.idf, len(some))
                p = softmax(logits(number, bucket, x, model.weights, len(some)) / model.temperature)
                for k, best in enumerate(p.argmax(axis=1)):
                    if lettered[first + k]:
                        lang[first + k], score[first + k] = model.langs[best], p[k, best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
