import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from foliomill.llm import deepshallow, suffixdedup  # noqa: E402


def brute(rows, width):
    raws = [(t or "").encode() for _, t in rows]
    n = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if n[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        keep = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, sha256(keep).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40, size=900):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ñ", k=r.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(r.randrange(20, 120))) for _ in range(6)]
    rows = [None, "", "short", " " * 1500, "ab" * 400, "x" * 199, "x" * 200, "x" * 201, "🦩" * 70 + "tail", "y" + "🦩" * 70]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(5, size // 10)))]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            parts += [s[r.randrange(0, 60) :], " ".join(word() for _ in range(r.randrange(0, 40)))]
        rows.append("".join(parts))
    rows += [rows[12], rows[12] + "!", "?" + rows[13]]
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[14]), (3, "same id, other text"), (15, rows[15])]


def test_order_is_the_sorted_order():
    r = random.Random(2)
    for trial in range(60):
        text = "".join(r.choices("ab", k=60)) * r.randrange(1, 6) + "".join(r.choices("abc", k=300)) + "a" * r.randrange(0, 300)
        buf = np.frombuffer((text * 2).encode(), np.uint8)
        width = r.choice([8, 9, 16, 41, 50, 64, 100])
        pos = np.array(r.sample(range(len(buf) - width + 1), 200))
        group = np.sort(np.array([r.randrange(1, 5) for _ in pos])) if trial % 2 else np.zeros(200, int)
        got, equal = deepshallow.order(buf, pos, group, width)
        keys = [(g, bytes(buf[p : p + width])) for g, p in zip(group, got)]
        assert sorted(zip(group, got)) == sorted(zip(group, pos)) and keys == sorted(keys)
        assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_tries_of_many_suffixes():
    r = random.Random(5)
    base = "".join(r.choices("ab", k=120))
    buf = np.frombuffer("".join(base[: r.randrange(50, 120)] + "".join(r.choices("ab", k=80)) for _ in range(300)).encode(), np.uint8)
    pos = np.arange(len(buf) - 99)
    got, equal = deepshallow.order(buf, pos, np.zeros(len(pos), int), 100)
    keys = [bytes(buf[p : p + 100]) for p in got]
    assert sorted(got.tolist()) == pos.tolist() and keys == sorted(keys) and equal.tolist()[1:] == [a == b for a, b in zip(keys, keys[1:])]


def test_keys_depend_on_the_string_alone():
    r = np.random.default_rng(1)
    s = r.integers(0, 255, 200).astype(np.uint8)
    a, b = np.concatenate([r.integers(0, 255, 40000).astype(np.uint8), s]), np.concatenate([s, r.integers(0, 255, 300).astype(np.uint8)])
    assert suffixdedup.least_hashes(a)[0][-1] == suffixdedup.least_hashes(b)[0][0]
    assert len(suffixdedup.least_hashes(a)[0]) == len(a) - 199 and len(suffixdedup.least_hashes(a[:150])[0]) == 0


@pytest.mark.parametrize("seed,width,gram,crowd", [(1, 200, 64, 2048), (2, 40, 16, 2048), (3, 200, 64, 1), (4, 40, 16, 1), (5, 40, 32, 3)])
def test_digests_equal_brute_force(spark, seed, width, gram, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, slot string, start int")
    got = sorted([tuple(r) for r in suffixdedup.digests(df, width, gram, crowd).collect()], key=str)
    assert got == brute(rows, width)
    assert suffixdedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_are_told_apart(spark):
    """Two texts of which Spark's 32-bit hashes are equal, both without an id; one shares a passage with a third row."""
    from pyspark.sql import functions as F

    filler = "abcdefghijklmnopqrstuvwxyz"
    made = spark.range(200_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1_000_000).cast("string"), 512)).alias("t"))
    pair = made.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").orderBy("h").first().ts[:2]
    rows = [(None, pair[0]), (None, pair[1]), (7, filler + pair[0])]
    got = [tuple(r) for r in suffixdedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows, 200)


def test_pieces_are_sorted_key_by_key_and_repeated_ones_passed_on(spark):
    rows = corpus(4, n=25)
    raw = [(t or "").encode() for _, t in rows]
    parts = [*dict.fromkeys(r for r in raw if len(r) >= 40)]
    whole = suffixdedup.marked(parts, [0] * len(parts), [False] * len(parts), 40)
    n = Counter(p[i : i + 40] for p in parts for i in range(len(p) - 39))
    for p, spans in zip(parts, whole):
        on = {i for i in range(len(p) - 39) if n[p[i : i + 40]] > 1}
        assert {i for s, e in spans for i in range(s, e - 39)} == on


def test_texts_are_cut_in_whole_characters(spark):
    flamingo = "🦩" * 60
    rows = [(1, "é" + flamingo + "a", "en", 62), (2, flamingo + "b", None, 61), (3, "clean", "en", 5), (4, None, "en", None)]
    out = {r.doc_id: r for r in suffixdedup.remove(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")).collect()}
    assert out[1].text == "éa" and out[1].n_chars == 2 and out[1].lang == "en"
    assert out[2].text == "b" and out[3].text == "clean" and not out[4].text
