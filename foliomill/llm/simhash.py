"""SimHash near-duplicates by the generalised pigeonhole principle (operator 6).

1. Each text becomes a 64-bit fingerprint: the majority bits of the XXH64 (seed 42) of its 4-word shingles.
2. Over all distinct fingerprints the co-occurrence of bits is counted. Correlated bits are grouped into partitions, for bits
   that say the same select best when they are looked at together.
3. Thresholds t_i with sum(t_i + 1) = t + 1 are dealt to the partitions by dynamic programming on estimated numbers of keys and
   candidates: two fingerprints within t bits must differ by t_i bits or fewer in some partition i. t_i = -1 leaves a
   partition out.
4. For a partition with threshold t_i, a fingerprint is filed under its bits there with each choice of t_i bits left out.
   Fingerprints that share a key are verified on all 64 bits. Within a key, a forest that joins all that are linked is
   emitted, never all pairs: each fingerprint reached is compared with those not yet reached only.
5. Components are found by alternating stars, over distinct fingerprints; equal fingerprints are one node.

Input: documents (doc_id, text). Null and empty texts have fingerprint zero and are linked like any other. Rows with a null
doc_id get a component like any other row (null if the component has no other id). Repeated rows are kept. An empty table
gives an empty table. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import identity, short, slots, texts, written
from foliomill.llm.components import components

BITS, SHINGLE, WITHIN, SEED = 64, 4, 4, 42
#: Thresholds are planned for so many distinct fingerprints at least, so that small and large inputs are probed alike.
PLANNED = 1 << 24
#: Cost of verifying a candidate, in costs of filing a key.
VERIFY = 0.05


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint. bytes.lower() lowers A-Z only, and bytes.split() splits at 0x20 and 0x09-0x0D only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(joined, SEED)]
    else:
        ends = [*accumulate([len(w) + 1 for w in words])]  # one past the blank behind each word
        hashes = [h(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :])]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view(np.int64)[0])


def fingerprints(rows: DataFrame, *others: str, width: int = SHINGLE) -> DataFrame:
    """fp (signed long) of `text`, and the columns `others` (long) as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found = [fingerprint(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *batch.columns[1:]], ["fp", *others])

    return rows.select("text", *others).mapInArrow(run, ", ".join(["fp long", *(f"{c} long" for c in others)]))


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits; counted over all of them, summed by cell before it reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            n += len(raw)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int64()), pa.array(np.append(total.ravel(), n), pa.int64())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        out[r.cell] = r.n
    return out


def agreement(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that two fingerprints agree in bit a, and in both of bits a and b."""
    n = max(int(counts[-1]), 1)
    both = counts[:-1].reshape(BITS, BITS) / n
    one = np.diag(both).copy()
    alone = one**2 + (1 - one) ** 2
    only_a, only_b = one[:, None] - both, one[None, :] - both
    neither = 1 - one[:, None] - one[None, :] + both
    return alone, both**2 + only_a**2 + only_b**2 + neither**2


def groups(counts: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size; each bit joins the open group with which it is correlated most."""
    alone, pair = agreement(counts)
    tied = np.log(np.maximum(pair, 1e-12) / np.maximum(np.outer(alone, alone), 1e-12))
    np.fill_diagonal(tied, 0)
    sizes = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    left, out = set(range(BITS)), []
    for size in sizes:
        start = max(left, key=lambda b: (sum(tied[b][c] for c in left), -b))
        group = [start]
        left.discard(start)
        while len(group) < size:
            best = max(left, key=lambda b: (sum(tied[b][c] for c in group), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def estimated_cost(group: list[int], threshold: int, counts: np.ndarray, n: float) -> float:
    """Keys filed for one fingerprint, and candidates met under them, in costs of a key."""
    if threshold < 0:
        return 0.0
    if threshold > len(group):
        return float("inf")
    alone, pair = agreement(counts)
    bits, chance = list(group), float(np.log(alone[group[0]]))
    for k, b in enumerate(bits[1:], 1):  # each bit given the earlier one with which it is correlated most
        given = max(float(np.log(max(pair[b][a], 1e-12)) - np.log(max(alone[a], 1e-12))) for a in bits[:k])
        chance += min(given, 0.0)
    freed = threshold * float(np.mean(np.log(alone[bits])))
    keys = comb(len(group), threshold)
    return keys * (1 + VERIFY * n * float(np.exp(min(chance - freed, 0.0))))


def plan(counts: np.ndarray, within: int = WITHIN, planned: int = PLANNED) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, at the least estimated cost over all numbers of partitions."""
    n, best, chosen = max(int(counts[-1]), planned), float("inf"), []
    for parts in range(1, within + 2):
        laid = groups(counts, parts)
        # table[s]: the least cost of the partitions so far with sum(t_i + 1) = s, and their thresholds
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in laid:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, ts) in table.items():
                for t in range(-1, within - s + 1):
                    if (c := cost + estimated_cost(group, t, counts, n)) < after.get(s + t + 1, (float("inf"), []))[0]:
                        after[s + t + 1] = (c, [*ts, t])
            table = after
        cost, ts = table.get(within + 1, (float("inf"), []))
        if cost < best:
            best, chosen = cost, [(g, t) for g, t in zip(laid, ts) if t >= 0]
    return chosen


def masks_of(chosen: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(mask, salt) of every key that a fingerprint is filed under."""
    out = []
    for bits, threshold in chosen:
        whole = sum(1 << b for b in bits)
        for freed in combinations(bits, threshold):
            mask = whole & ~sum(1 << b for b in freed)
            out.append((mask, (len(out) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return out


def keyed(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp: a row for each key. Keys are mixed to 64 bits; a clash only adds candidates, all of which are verified."""
    masks = masks_of(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask, salt in masks:
                key = ((fp & np.uint64(mask)) ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fp: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Index pairs that join all fingerprints linked within one key; those already reached aren't compared again."""
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= within
            if near.any():
                found = rest[near].tolist()
                out += [(x, y) for y in found]
                front += found
                rest = rest[~near]
    return out


def links(keys: DataFrame, within: int = WITHIN) -> DataFrame:
    """u, v: edges between fingerprints that differ in `within` bits or fewer; a forest within each key."""

    def of_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cuts, len(key)))
        two = cuts[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= within]
        u, v = [fp[near]], [fp[near + 1]]
        for s, n in zip(cuts[size > 2].tolist(), size[size > 2].tolist()):
            if pairs := forest(fp[s : s + n], within):
                a, b = np.array(pairs).T
                u.append(fp[s + a])
                v.append(fp[s + b])
        return np.concatenate(u), np.concatenate(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = of_runs(key, fp) if len(key) else (fp, fp)
            pairs = np.unique(np.stack([u.view(np.int64), v.view(np.int64)]), axis=1) if len(u) else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            if cut:
                yield out(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        yield out(held_key, held_fp)

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def rooted(fps: DataFrame, within: int = WITHIN, planned: int = PLANNED) -> DataFrame:
    """fp, root (the least fingerprint of its component) for every distinct fp of `fps`."""
    nodes = written(fps.select("fp").distinct())
    chosen = plan(bit_counts(nodes), within, planned)
    found = components(links(keyed(nodes, chosen), within))
    return nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, width: int = SHINGLE, within: int = WITHIN, planned: int = PLANNED) -> DataFrame:
    """doc_id, fp (signed long), component_id (the smallest doc_id reachable)."""
    fps = written(fingerprints(texts(docs), "doc_id", width=width))
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(rooted(fps, within, planned), "fp")  # a row for each fingerprint
    named = ids.join(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = SHINGLE, within: int = WITHIN, planned: int = PLANNED) -> DataFrame:
    """Of each component one row of `docs`, with all its columns: the one with the smallest doc_id (null is the largest), and of
    several such rows that with the least `identity`; of rows equal in both any one, and then they differ in other columns only.
    Unlike texts that share a doc_id are judged apart."""
    fps = written(fingerprints(slots(docs), "doc_id", "slot", "mark", width=width))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "slot", "mark")
    first = fps.groupBy("fp").agg(F.min(order).alias("first")).join(rooted(fps, within, planned), "fp")
    kept = first.groupBy("root").agg(F.min("first").alias("first")).select("first.slot", "first.mark")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), *identity(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return whole.join(kept, ["slot", "mark"]).dropDuplicates(["slot", "mark"]).select("whole.*")


def as_hex(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
