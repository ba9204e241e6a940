"""Removal of repeated passages by a distributed suffix array (operator 9).

A byte goes if a string of `width` bytes that covers it also starts anywhere else, in the same document or another.

1. Every start p of a `width`-byte string is filed under the least hash of the 64-byte grams inside the string. Equal strings
   have equal keys, whatever surrounds them, and neighbouring starts mostly share theirs: starts are kept as runs, about one
   for 70 bytes of text, and a run of any length (a text of blanks) is one row. Runs are written once.
2. Runs whose key's gram occurs once in the corpus hold no repeated string. Keys are counted with partial sums before the shuffle.
3. A key under which more than `CROWD` unlike pieces meet is split by more of the string: starts are dealt by their distance to
   the key's gram, `PARTS[0]` distances together, and filed under a hash of the bytes that all strings of such a part cover, and
   where that is still crowded under a hash of the whole string. Equal strings stay together, and step 2 drops what occurs
   once: so contexts of a common passage leave its key, and at last only equal pieces share one.
4. For the runs left the text around them is fetched from their documents. Equal pieces in one batch become one row.
5. Pieces with the same key meet in one task, which sorts the suffixes that start in them (deep-shallow sorting) and marks
   those equal to a neighbour over all `width` bytes. A task takes whole keys, a bounded number of bytes at a time; pieces that
   are equal throughout are held once, and passed on as they come once a second one was seen.
6. Marked starts become byte intervals, gathered by document, and are cut out.

Input: documents (doc_id, text). Null text counts as empty; texts under `width` bytes lose nothing. A repeated row is a copy
like any other: both lose what they share. Null doc_ids are kept; rows are told apart by 128 bits of id and text. An empty table
gives an empty table. Columns other than doc_id and text are ignored, or passed on by `remove`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import short, slots, written
from foliomill.llm.deepshallow import order

WIDTH, GRAM = 200, 64
#: Positions hashed at once, so that they stay in the processor's cache; bytes of pieces sorted at once.
HASHED, SORTED = 1 << 15, 4 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Unlike pieces under one key from which on it is split, and how many distances to its gram are kept together by each split.
CROWD, PARTS = 2048, (17, 1)
#: Crowded keys are told to the scan by this many bits; a key that shares its bit with a crowded one is split as well.
MARKS = 1 << 20
RUN = "key long, slot long, mark long, start int, size int, shape long, n int"


class Sums:
    """Hashes of any stretch of a buffer, from running sums."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power, self.back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (BASE, INVERSE))
        self.sums = np.append(np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def least_hashes(buf: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of a `width`-byte string in `buf`: the least hash (48 bits) of the grams inside it, whether two have it, and
    how far on the first of them begins."""
    n = max(len(buf) - width + 1, 0)
    out, twice, far = np.empty(n, np.uint64), np.empty(n, bool), np.empty(n, np.int64)
    span, low = width - gram + 1, np.uint64(16)
    for s in range(0, n, HASHED):
        h = buf[s : s + HASHED + width - 1].astype(np.uint64) + np.uint64(1)
        k, power = 1, BASE
        while k < gram:  # gram is a power of two
            h = h[:-k] * np.uint64(power) + h[k:]
            power, k = power * power & (1 << 64) - 1, 2 * k
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h = h >> low << low
        at = np.arange(len(h), dtype=np.uint64)
        ends = []
        for least in (h | at, h | (np.uint64(0xFFFF) - at)):  # the leftmost and the rightmost gram with the least hash
            grown = 1
            while 2 * grown <= span:
                least = np.minimum(least[:-grown], least[grown:])
                grown *= 2
            ends.append(np.minimum(least[: grown - span], least[span - grown :]) if grown < span else least)
        left, right = ends
        out[s : s + len(left)] = left >> low
        twice[s : s + len(left)] = (left & np.uint64(0xFFFF)) != np.uint64(0xFFFF) - (right & np.uint64(0xFFFF))
        far[s : s + len(left)] = (left & np.uint64(0xFFFF)).astype(np.int64) - np.arange(len(left))
    return out, twice, far


def bit_of(key):
    """The bit of a key (numpy array or column)."""
    if isinstance(key, np.ndarray):
        return (key >> np.uint64(20) & np.uint64(MARKS - 1)).astype(np.int64)
    return F.shiftrightunsigned(key, 20).bitwiseAND(F.lit(MARKS - 1))


def runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, levels: list[tuple[int, np.ndarray]] = ()) -> DataFrame:
    """key, slot, mark, start, size, shape, n: consecutive starts that share a key. shape: a hash of the bytes that their strings
    cover; n is 2 if the key's gram occurs in them more than once.

    levels: (part, marked bits). Only starts whose key is marked are taken, under a finer key: their distance to the key's gram,
    `part` distances together, and a hash of the bytes that the strings of all starts of such a part cover; level by level.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 64):  # many numbers are held for every byte
            texts = batch.column(2)
            ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
            raw = texts.buffers()[2]
            buf = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)
            ends = (ends - ends[0]).astype(np.int64)
            key, twice, far = least_hashes(buf, width, gram)
            begin, stop = ends[:-1], np.maximum(ends[1:] - width + 1, ends[:-1])  # valid starts of each text
            inside = np.zeros(len(buf) + 1, np.int8)
            np.add.at(inside, begin, 1)
            np.add.at(inside, stop, -1)
            valid = np.cumsum(inside[: len(key)]).astype(bool)
            sums = Sums(buf)
            for part, bits in levels:
                p = np.flatnonzero(valid)
                p = p[bits[bit_of(key[p])]]
                low = far[p] // part * part
                core = p + far[p] - low
                key[p] = mixed(sums.of(core, core + width - part + 1) ^ key[p] + low.astype(np.uint64))
                valid = np.zeros(len(key), bool)
                valid[p] = True
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
            at = begin[begin < stop]
            new[at] = valid[at]
            last = valid.copy()
            last[:-1] &= ~valid[1:] | new[1:]
            first, size = np.flatnonzero(new), np.flatnonzero(last) - np.flatnonzero(new) + 1
            again = twice.copy()  # the gram occurs twice in a string, or the next string has another gram
            again[1:] |= valid[1:] & ~new[1:] & (far[1:] != far[:-1] - 1)
            seen = np.append(0, np.cumsum(again & valid))
            many = (seen[first + size] > seen[first]) | (size > width - gram + 1)
            doc = np.searchsorted(ends, first, side="right") - 1
            shape = sums.of(first, first + size + width - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first].view(np.int64)), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array((first - ends[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(shape.view(np.int64)), pa.array(many.astype(np.int32) + np.int32(1))],
                ["key", "slot", "mark", "start", "size", "shape", "n"],
            )

    return docs.select("slot", "mark", "text").mapInArrow(scan, RUN)


def pieces(docs: DataFrame, repeated: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, piece (the bytes that a run's strings cover), and the runs that have it: slots, marks, starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for slot, mark, text, held in zip(*(batch.column(c).to_pylist() for c in ("slot", "mark", "text", "held"))):
                raw = text.encode()
                for r in held:
                    found.setdefault((r["key"], raw[r["start"] : r["start"] + r["size"] + width - 1]), []).append((slot, mark, r["start"]))
            keys, parts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(parts, pa.binary()), *(pa.array([[m[i] for m in ms] for ms in found.values()], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32())))],
                ["key", "piece", "slots", "marks", "starts"],
            )

    by_doc = repeated.groupBy("slot", "mark").agg(F.collect_set(F.struct("key", "start", "size")).alias("held"))
    # every column of docs goes along, so that its shuffle is the one that `remove` and `digests` need again
    return docs.join(by_doc, ["slot", "mark"]).mapInArrow(cut, "key long, piece binary, slots array<long>, marks array<long>, starts array<int>")


def marked(parts: list[bytes], keys: list[int], many: list[bool], width: int) -> list[list[tuple[int, int]]]:
    """For each of some distinct pieces, the byte intervals in it that strings repeated under its key cover. keys: of each piece,
    in order; many: the piece occurs more than once."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(size) - size
    n = size - width + 1
    of = np.repeat(np.arange(len(parts)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    pos = base[of] + within
    group = np.cumsum(np.append(True, np.diff(np.array(keys)) != 0))
    ordered, equal = order(buf, pos, group[of], width)
    twice = equal.copy()
    twice[:-1] |= equal[1:]
    flag = np.zeros(len(buf) + 1, bool)
    flag[ordered[twice]] = True
    flag[pos] |= np.array(many, bool)[of]
    on = flag[pos]
    edge = np.append(True, (of[1:] != of[:-1])) if len(of) else np.empty(0, bool)
    first = on.copy()
    first[1:] &= ~on[:-1] | edge[1:]
    last = on.copy()
    last[:-1] &= ~on[1:] | edge[1:]
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    for i, s, e in zip(of[a].tolist(), within[a].tolist(), (within[b] + width).tolist()):
        out[i].append((s, e))
    return out


def covered(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """slot, mark, start, stop: byte intervals of documents that repeated strings cover."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, bytes], int] = {}
        parts: list[bytes] = []
        keys: list[int] = []
        members: list[tuple | None] = []  # the one run that has the piece; None if there are more, which were passed on
        rows: list[tuple[int, int, int, int]] = []
        held, last = 0, None

        def whole(piece: bytes, ms: tuple) -> None:
            rows.extend((slot, mark, s, s + len(piece)) for slot, mark, s in zip(*ms))

        def out() -> pa.RecordBatch:
            cols = [*zip(*rows)] if rows else [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["slot", "mark", "start", "stop"])
            rows.clear()
            return batch

        def flush() -> pa.RecordBatch:
            for spans, ms in zip(marked(parts, keys, [m is None for m in members], width) if parts else (), members):
                if spans and ms:
                    rows.extend((slot, mark, s + a, s + b) for slot, mark, s in zip(*ms) for a, b in spans)
            for x in (at, parts, keys, members):
                x.clear()
            return out()

        for batch in batches:
            for few in (batch.slice(s, 4096) for s in range(0, batch.num_rows, 4096)):
                for key, piece, *ms in zip(*(c.to_pylist() for c in few.columns)):
                    if held >= SORTED and key != last:
                        yield flush()
                        held = 0
                    last = key
                    if (i := at.setdefault((key, piece), len(parts))) == len(parts):
                        parts.append(piece)
                        keys.append(key)
                        members.append(tuple(ms))
                        held += len(piece)
                        if len(ms[0]) > 1:
                            whole(piece, members[i])
                            members[i] = None
                    else:
                        if members[i]:
                            whole(piece, members[i])
                            members[i] = None
                        whole(piece, ms)
                if len(rows) > 1 << 16:
                    yield out()
        yield flush()

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(solve, "slot long, mark long, start int, stop int")


def intervals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """slot, mark, spans (array of start, stop) for the rows of `slots` that lose something."""
    levels, found = [], None
    for part in (*PARTS, None):
        every = written(runs(docs, width, gram, levels))
        often = written(every.groupBy("key").agg(F.sum("n").alias("times")).where("times > 1"))  # a table, so that a skewed join can be split
        repeated = written(every.drop("n").join(often, "key"))
        unlike = repeated.where(F.col("times") > crowd).select("key", "shape").distinct().groupBy("key").count().where(F.col("count") > crowd)
        bits = unlike.select(bit_of(F.col("key")).alias("bit")).distinct().toArrow()["bit"].to_numpy() if part else ()  # at most MARKS
        repeated = repeated.drop("times", "shape")
        if len(bits):
            levels.append((part, np.isin(np.arange(MARKS), bits)))
            split = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"bit": pa.array(bits)})))
            repeated = repeated.withColumn("bit", bit_of(F.col("key"))).join(split, "bit", "left_anti").drop("bit")
        found = repeated if found is None else found.unionByName(repeated)
        if not len(bits):
            break
    return covered(pieces(docs, found, width), width).groupBy("slot", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in gone)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in gone), len(raw)]))


def whole_characters(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """`gone` without the characters of which it holds only some bytes."""
    out = []
    for s, e in gone:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = slots(docs)  # the same columns on both sides of the joins, so that texts are shuffled once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            out: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, gone = text.encode(), merged(spans)
                out.append((len(raw), sum(e - s for s, e in gone), len(gone), sha256(kept(raw, gone) if gone else raw).hexdigest()))
            cols = [*zip(*out)] if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = intervals(rows, width, gram, crowd)
    return rows.join(found, ["slot", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """`docs` with all its columns, repeated passages cut out of `text` in whole characters; n_chars, if there, is counted anew."""
    rows = slots(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            out = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans:
                    raw = text.encode()
                    text = kept(raw, whole_characters(raw, merged(spans))).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], ["text", "rest"])

    found = intervals(rows, width, gram)
    joined = rows.join(found, ["slot", "mark"], "left").select("text", "spans", "rest")
    schema = f"text string, rest {joined.schema['rest'].dataType.simpleString()}"
    out = joined.mapInArrow(run, schema)
    cols = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols)
