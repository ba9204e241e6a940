import random
import re

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from foliomill.llm import simhash  # noqa: E402


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    if not words:
        return 0
    rows = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Component by fingerprint."""
    fps = sorted(set(fps))
    at = {f: f for f in fps}

    def root(f):
        while at[f] != f:
            f = at[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                at[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["Été", "ÀB", "x y"]
    rows = [None, "", "  \t", "One", "one", "one two three", "a b c d", "A B  C\nD"]
    for _ in range(40):
        words = r.choices(vocab, k=r.randrange(30, 200))
        rows.append(" ".join(words))
        for _ in range(r.randrange(0, 6)):
            near = words[:]
            for _ in range(r.randrange(0, 3)):
                near[r.randrange(len(near))] = r.choice(vocab)
            rows.append(" ".join(near))
    return rows


def test_fingerprints_are_as_defined():
    for t in corpus():
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t), t


def test_classes_equal_brute_force(spark):
    rows = [(i * 7 % 997, t, "x", "y") for i, t in enumerate(corpus())] + [(None, "a b c d", "x", "y"), (3, None, None, None)]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")).collect()
    of = brute([plain_fingerprint(r[1]) for r in rows])
    ids = {}
    for d, t, *_ in rows:
        f = of[plain_fingerprint(t)]
        if d is not None:
            ids[f] = min(d, ids.get(f, d))
    want = sorted(str((d, plain_fingerprint(t), ids.get(of[plain_fingerprint(t)]))) for d, t, *_ in rows)
    assert sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == want
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_random_links_are_all_found(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for b in base:
        for _ in range(8):
            x = b
            for k in r.sample(range(64), r.randrange(0, 6)):
                x ^= 1 << k
            fps.append(x)
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for planned in (100, 1 << 24):
        chosen = simhash.plan(simhash.bit_counts(nodes), planned=planned)
        assert sum(t + 1 for _, t in chosen) == 5
        found = {x.node: x.root for x in simhash.components(simhash.links(simhash.keyed(nodes, chosen))).collect()}
        want = brute([f % (1 << 64) for f in signed])
        groups = {}
        for f in signed:
            groups.setdefault(found.get(f, f), set()).add(f % (1 << 64))
        expected = {}
        for f, g in want.items():
            expected.setdefault(g, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_correlated_bits_are_grouped():
    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (4000, 64))
    for k in range(8):
        bits[:, 40 + k] = bits[:, 3]
    counts = np.append((bits.T @ bits).ravel(), 4000)
    assert any({3, *range(40, 48)} <= set(g) for g in simhash.groups(counts, 3))
