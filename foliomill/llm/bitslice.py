"""Exact top-k inner products on a bit-sliced index (operator 7).

Components are quantised to floor(scale * x). Candidates are dealt into blocks; a block's index holds, for every attribute
(dimension) and every bit, one bitmap over the block's rows, rows in order of vec_id, numbers in two's complement. A query adds
its multiples of the attributes: multiples by small digits are made once for a block by adding slices, and are summed for many
queries at a time with bitwise full adders. From the sum's slices the best rows are selected from the most significant slice
downward: rows that are surely in (G) and rows still in question (E) are bitmaps as well. Rows left in question at the end
have the same score and are taken in order of vec_id. Blocks' best rows are ranked together.

Queries are the rows whose vec_id is divisible by `every`; they meet the candidates block by block, never row by row.

Input: embeddings (vec_id, embedding). Vectors that are null or hold null, NaN or infinite components take no part, nor do
null vec_ids. Components of any size are summed and ranked exactly: a bitmap more for each bit, in Python's whole numbers
where 64 bits do not hold them; scores that a long does not hold are given as the nearest long. Vectors of unlike length are
compared on the components both have. Rows with one vec_id are rows of their own: each is a candidate for the other, and each
query row has its own ranks. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import written

SCALE, K, EVERY = 64, 20, 20
#: About so many rows make a block; so many queries are held by a task, and so many are summed at once.
BLOCK, HELD, TOGETHER = 8192, 16_384, 64
#: Multiples are made of digits to this base.
DIGIT = 5
#: Vectors with a component of this size or more are kept in blocks of their own, of so many rows, for they need more bitmaps.
WIDE, WIDE_BLOCK = float(1 << 24), 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, embedding, wide, of the vectors that take part; written, so that the numbers stay."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    wide = F.exists("embedding", lambda v: F.abs(v) >= WIDE)
    return written(rows.where(finite).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", wide.alias("wide")))


def quantised(vectors: list[list[float]], dims: int, scale: int) -> np.ndarray:
    """rows x dims: floor(scale * x); whole numbers without bound where 64 bits may not hold them."""
    x = np.zeros((len(vectors), dims))
    for r, v in enumerate(vectors):
        x[r, : len(v)] = v
    if np.abs(x).max(initial=0) * scale < 1 << 62:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 1 << 53 else floor(v * scale)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def beyond(score: int) -> bytes | None:
    """What orders scores that a long cannot tell apart: their size and digits, complemented if negative."""
    if LEAST < score < MOST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


def bit_length(values: np.ndarray) -> int:
    """Bits of the largest absolute value."""
    return int(np.abs(values).max(initial=0)).bit_length()


def sliced(values: np.ndarray) -> np.ndarray:
    """bits x attributes x words: bitmaps over the rows of `values` (rows x attributes), in two's complement."""
    rows, dims = values.shape
    bits = bit_length(values) + 1
    words = (rows + 63) // 64
    out = np.zeros((bits, dims, 8 * words), np.uint8)
    for b in range(bits):
        packed = np.packbits((values >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[b, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add(total: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
    """total += slices << shift, bit by bit for all rows at once; the last of `slices` is the sign and stands for all above it."""
    carry = np.zeros_like(total[0])
    for w in range(shift, len(total)):
        a, b = total[w], slices[min(w - shift, len(slices) - 1)]
        half = a ^ b
        both = a & b
        np.bitwise_xor(half, carry, out=total[w])
        np.bitwise_and(half, carry, out=carry)
        np.bitwise_or(both, carry, out=carry)


class Index:
    """The bitmaps of a block's rows, and the multiples of its attributes by small digits."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, slices: np.ndarray):
        self.rows, self.ids, self.slices = rows, ids, slices
        self.words = slices.shape[2]
        half = 1 << DIGIT - 1
        self.multiples = np.zeros((2 * half + 1, slices.shape[0] + DIGIT, *slices.shape[1:]), np.uint64)
        once = slices
        for m in range(1, half + 1):
            self.multiples[half + m] = self.multiples[half + m - 1]
            add(self.multiples[half + m], once)
        for m in range(1, half + 1):  # -x is the complement of x plus one
            less = ~self.multiples[half + m]
            carry = np.full_like(less[0], 0xFFFFFFFFFFFFFFFF)
            for w in range(len(less)):
                less[w], carry = less[w] ^ carry, less[w] & carry
            self.multiples[half - m] = less
        self.half = half

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """slices x queries x words: inner products with every row."""
        dims = self.slices.shape[1]
        most = bit_length(queries) + self.slices.shape[0] + max(dims, 1).bit_length() + 1
        total = np.zeros((most, len(queries), self.words), np.uint64)
        rest, shift = queries.copy(), 0
        while rest.any():
            digit = ((rest + self.half - 1) % (1 << DIGIT) - (self.half - 1)).astype(np.int64)  # from -half + 1 to half
            for j in np.flatnonzero(digit.any(axis=0)):
                add(total, self.multiples[digit[:, j] + self.half, :, j].transpose(1, 0, 2), shift)
            rest, shift = (rest - digit) >> DIGIT, shift + DIGIT
        return total

    def best(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query its best k rows of the block, its own left out: (vec_ids, scores)."""
        total = self.scores(queries)
        open_ = np.zeros((len(queries), 64 * self.words), bool)
        open_[:, : len(self.ids)] = self.rows[None, :] != query_rows[:, None]
        maybe = np.packbits(open_, axis=1, bitorder="little").view(np.uint64)
        sure = np.zeros_like(maybe)
        for w in range(len(total) - 1, -1, -1):
            slice_ = ~total[w] if w == len(total) - 1 else total[w]  # the sign: rows without it are the larger ones
            high = maybe & slice_
            many = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64)[:, None] > k
            sure, maybe = np.where(many, sure, sure | high), np.where(many, high, maybe & ~slice_)
        weights = [1 << w for w in range(len(total) - 1)] + [-(1 << len(total) - 1)]
        for i in range(len(queries)):
            rows = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            if len(rows) < k:  # those left have one score; the least ids come first
                tied = np.flatnonzero(np.unpackbits(maybe[i].view(np.uint8), bitorder="little"))
                rows = np.concatenate([rows, tied[: k - len(rows)]])
            bits = total[:, i, rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)
            exact = np.int64 if len(weights) < 64 else object
            score = np.zeros(len(rows), exact)
            for w, weight in enumerate(weights):
                score = score + bits[w].astype(exact) * weight
            yield self.ids[rows], score


def built(rows: DataFrame, dims: int, scale: int, blocks: int, block: int) -> DataFrame:
    """block, rows, ids, slices, bits: the index of each block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[float]]] = []

        def index() -> pa.RecordBatch:
            slices = sliced(quantised([v for *_, v in held], dims, scale))
            numbers, ids = (np.array([h[i] for h in held], np.int64).tobytes() for i in (1, 2))
            cols = [pa.array([held[0][0]], pa.int64()), *(pa.array([x], pa.binary()) for x in (numbers, ids, slices.tobytes())), pa.array([slices.shape[0]], pa.int32())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["block", "rows", "ids", "slices", "bits"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != row[0] or len(held) >= block):
                    yield index()
                held.append(row)
        if held:
            yield index()

    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    return rows.select(dealt, "row", "vec_id", "embedding").repartition(blocks, "block").sortWithinPartitions("block", "vec_id").mapInArrow(build, "block long, rows binary, ids binary, slices binary, bits int")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score.

    Blocks and queries meet in a grid of cells, a task each: a row of cells has a part of the blocks, a column at most about
    `HELD` queries. There are as many cells as columns need or as keep the cores busy, not one for each block and bundle. A
    task holds its queries with their best rows so far, and takes the blocks one after another.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    query = F.pmod("vec_id", F.lit(every)) == 0
    seen = rows.agg(F.count_if(~F.col("wide")).alias("n"), F.count_if("wide").alias("wide"), F.max(F.size("embedding")).alias("dims"), F.count_if(query).alias("queries")).first()
    dims = seen.dims or 0
    block = min(block, max(block * 64 // max(dims, 1), 64))  # so that the bitmaps of a block take like memory
    wide = min(block, WIDE_BLOCK)
    few, more = -(-seen.n // block), -(-seen.wide // wide)
    parts = [built(rows.where(some), dims, scale, n, 2 * size) for some, n, size in (("NOT wide", few, block), ("wide", more, wide)) if n]
    if not parts or not seen.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = 4 * spark.sparkContext.defaultParallelism
    columns = max(-(-seen.queries // HELD), min(wanted // (few + more), -(-seen.queries // (4 * TOGETHER))), 1)
    lines = min(few + more, max(1, -(-wanted // columns)))
    at = lambda line, column: (line * F.lit(columns) + column).cast("int").alias("cell")
    index = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    index = index.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), F.pmod(F.xxhash64("block", "bits"), F.lit(lines)).alias("line"), "*")
    asked = rows.where(query).select(F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), F.pmod(F.xxhash64("row", F.lit("query")), F.lit(columns)).alias("column"), "*")
    sides = asked.select(at(F.col("line"), F.col("column")), F.lit(False).alias("indexed"), "wide", "row", "vec_id", "embedding")
    both = sides.unionByName(index.select(at(F.col("line"), F.col("column")), F.lit(True).alias("indexed"), "rows", "ids", "slices", "bits"), allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            n = [len(v) for v, _ in best]
            scores = [int(x) for _, s in best for x in s]
            cols = [np.repeat([a[0] for a in asked], n), np.repeat([a[1] for a in asked], n), [x for v, _ in best for x in v.tolist()], [min(max(x, LEAST), MOST) for x in scores]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(map(beyond, scores), pa.binary())], ["row", "query_id", "vec_id", "score", "beyond"])

        for batch in batches:
            for at, indexed, _, row, vec_id, embedding, numbers, ids, slices, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if at != cell:
                    if best:
                        yield out()
                    cell, asked, best, sets = at, [], [], []
                if not indexed:
                    asked.append((row, vec_id, embedding))
                    continue
                if not sets:  # all queries of the cell are here; values of one size are summed together
                    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked)
                    for s in range(0, len(asked), TOGETHER):
                        some = asked[s : s + TOGETHER]
                        sets.append((s, np.array([a[0] for a in some], np.int64), quantised([a[2] for a in some], dims, scale)))
                if not asked:
                    continue
                held = Index(np.frombuffer(numbers, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(slices, np.uint64).reshape(bits, dims, -1))
                for s, query_rows, values in sets:
                    for q, (found, scores) in enumerate(held.best(query_rows, values, k), s):
                        v, x = np.concatenate([best[q][0], found]), np.concatenate([best[q][1], scores])
                        first = sorted(range(len(v)), key=lambda i: (-x[i], v[i]))[:k] if x.dtype == object else np.lexsort((v, -x))[:k]
                        best[q] = v[first], x[first]
        if best:
            yield out()

    found = both.repartitionById(lines * columns, "cell").sortWithinPartitions("cell", "indexed", "wide", "row").mapInArrow(search, "row long, query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_id, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.row_id <> b.row_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
