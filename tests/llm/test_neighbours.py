import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours as N

EVERY = "id % 20 = 0"


def ordered(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def brute(rows, k=20):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        best = {}
        for v in (v for i, v in good if i == q):
            for i, w in good:
                if i != q and len(w) == len(v):
                    best[i] = max(best.get(i, -math.inf), ordered(v, w))
        out += [(q, n, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k], 1)]
    return out


def mine(df, **kw):
    return sorted(tuple(r) for r in N.search(df, EVERY, **kw).collect())


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def single(v):
    return [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    rnd = random.Random(3)
    rows = [(i, single([rnd.gauss(0, 1) for _ in range(5)])) for i in range(70)]
    rows += [(100, None), (120, []), (140, [0.0] * 5), (160, [1.0, None, 1.0, 1.0, 1.0]), (180, [math.nan] * 5), (200, [math.inf, 0.0, 0.0, 0.0, 0.0]), (None, [9.0] * 5)]
    rows += [(220, [1.0, 2.0]), (221, [2.0, 1.0]), (240, [1.0, 2.0, 3.0])]  # other lengths
    rows += rows[:25]  # rows that repeat
    rows += [(20, single([3.0, 0, 0, 0, 1])), (7, single([5.0, 0, 0, 1, 1]))]  # another vector of an id
    assert mine(table(spark, rows, kind)) == brute(rows)
    assert mine(table(spark, rows, kind), cell_bytes=200) == brute(rows)


def test_ties_and_one_vector_of_many_rows(spark):
    rnd = random.Random(4)
    hot = single([0.5, 0.5, -0.25])
    rows = [(i, hot if i % 3 else single([rnd.gauss(0, 1) for _ in range(3)])) for i in range(400)]
    assert mine(table(spark, rows).repartition(6)) == brute(rows)


def test_lengths_of_any_size(spark):
    """Bounds hold for very long and very short vectors side by side, and where scores are close."""
    rnd = random.Random(5)
    rows = [(i, single([rnd.gauss(0, 1) * 10.0 ** rnd.choice([-25, -3, 0, 0, 0, 12]) for _ in range(7)])) for i in range(300)]
    rows += [(1000 + i, single([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0 + i * 1e-6])) for i in range(60)]
    assert mine(table(spark, rows)) == brute(rows)


def test_no_rows_and_few_candidates(spark):
    assert mine(table(spark, [])) == []
    assert mine(table(spark, [(0, [1.0])])) == []
    assert mine(table(spark, [(0, [1.0]), (1, [2.0])])) == [(0, 1, 1, 2.0)]
    clash = table(spark, [(0, [1.0]), (1, [2.0])]).withColumns({"id": F.lit(5), "v": F.lit("x"), "score": F.lit(1), "k1": F.lit(2)})
    assert mine(clash) == [(0, 1, 1, 2.0)]


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((50, 2100)), rng.standard_normal((60, 2100)) * 10.0 ** rng.integers(-3, 3, (60, 1))
    (a, sa, na, ea), (b, sb, nb, eb) = N.quantise(x), N.quantise(y)
    p = N.product(a, b)
    assert (p == a.astype(np.int64) @ b.astype(np.int64).T).all()
    bound = (na + ea)[:, None] * eb[None, :] + ea[:, None] * nb[None, :]
    assert (np.abs(x @ y.T - p * sa[:, None] * sb[None, :]) <= bound * (1 + 1e-9)).all()


def test_few_pairs_are_computed_again(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs, inner = [0], N.inner
    monkeypatch.setattr(N, "inner", lambda a, b: pairs.__setitem__(0, pairs[0] + len(a)) or inner(a, b))
    at, near, score = N.nearest(np.arange(300), x[:300], np.arange(8192), x, 20)
    assert len(at) == 300 * 20
    assert pairs[0] < 0.02 * 300 * 8192
    exact = x[:300] @ x.T
    exact[np.arange(300), np.arange(300)] = -np.inf
    assert (np.sort(np.argsort(-exact, 1)[:, :20], 1) == np.sort(near.reshape(300, 20), 1)).all()
