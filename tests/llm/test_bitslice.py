import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from foliomill.llm import bitslice  # noqa: E402


def brute(rows, k, every):
    held = [(i, [floor(Fraction(x) * 64) for x in v]) for i, v in rows if not (i is None or v is None or any(x is None or not np.isfinite(x) for x in v))]
    out = []
    for a, (i, qa) in enumerate(held):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(qa, qb)), j) for b, (j, qb) in enumerate(held) if b != a)[:k]
            out += [(i, n, j, min(max(-s, bitslice.LEAST), bitslice.MOST)) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_slices_add_like_numbers():
    r = np.random.default_rng(0)
    for values, queries in ((r.integers(-40, 40, (130, 7)), r.integers(-900, 900, (5, 7))), (r.integers(-40, 40, (70, 3)).astype(object) * 2**90, r.integers(-9, 9, (2, 3)).astype(object) * 3**50)):
        index = bitslice.Index(np.arange(len(values)), np.arange(len(values)), bitslice.sliced(values))
        total = index.scores(queries)
        want = queries @ values.T
        for i in range(len(queries)):
            for row in range(len(values)):
                bits = [int(total[w, i, row >> 6]) >> (row & 63) & 1 for w in range(len(total))]
                assert sum(b << w for w, b in enumerate(bits[:-1])) - (bits[-1] << len(bits) - 1) == want[i, row]


@pytest.mark.parametrize("seed,block", [(1, 64), (2, 10_000)])
def test_results_equal_brute_force(spark, seed, block):
    r = random.Random(seed)
    vec = lambda: [r.choice([-0.4, 0.1, 0.1, r.uniform(-0.5, 0.5)]) for _ in range(8)]
    rows = [(i * 3, vec()) for i in range(230)]
    rows += [(9, rows[3][1]), (1001, None), (1002, [1.0, None]), (1003, [float("nan")]), (1004, [float("inf"), 0.0]), (None, vec()), (1020, []), (1040, [0.5, 0.25]), (1005, [3e9, -1e30]), (60, vec())]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, block string")
    got = sorted(tuple(x) for x in bitslice.top_k(df, k=20, every=20, block=block).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 20, 20)
    assert bitslice.top_k(df.limit(0)).count() == 0


def test_large_components_and_shared_ids_are_whole(spark):
    rows = [(20, [3e6, 1.0]), (1, [3e6, 0.0]), (1, [5.0, 5.0]), (2, [1.2e6, 0.0]), (20, [3e6, 1.0]), (40, [0.0, 0.25]), (3, [1e300, -1e300]), (4, [1e300, -1e299]), (60, [1.0, 1e250]), (5, [-1e300, 7.0]), (6, [-2.0**62, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in bitslice.top_k(df, block=4).collect())
    assert got == brute(rows, 20, 20)
    assert (20, 1, 4, bitslice.MOST) in got and any(s == 36864000000000000 for *_, s in got)
