"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest

from corvane.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score double, rank int"


def brute(rows):
    good = []
    for r, (id, v, label, *_) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((id, (label + 1) % 10 if id is not None and id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v], r))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731  shorter ones count as padded
    order = lambda s, b: (-s, b[0] is None, b[0] or 0)
    for a in good:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((dot(a[2], b[2]), b) for b in good if b[3] != a[3]), key=lambda x: (*order(*x), x[1][3]))
        for p, b in [x for x in scored if x[1][1] == a[1]][:5]:
            found = [(s, c) for s, c in scored if c[1] != a[1] and 30 * p <= 100 * s <= 90 * p][:10]
            yield from ((a[0], b[0], rank, c[0], p, s) for rank, (s, c) in enumerate(found, 1))


def held(spark, rows, parts=3):
    got = [tuple(r) for r in H.mined(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def drawn(n, dims, seed, spread=1.0, distinct=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(distinct or n, dims)) * spread
    return [[float(np.float32(x)) for x in base[i % len(base)]] for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "spread", "distinct"), [(900, 16, 0.2, None), (700, 5, 1.0, 40), (500, 8, 1e5, None), (400, 1, 1.0, None)])
def test_against_all_products(spark, monkeypatch, n, dims, spread, distinct):
    """Small blocks, so that anchors meet many; few different vectors, so that scores tie."""
    monkeypatch.setattr(H, "ROWS", 64)
    monkeypatch.setattr(H, "ANCHORS", 3)
    rows = [(i, v, i % 4, "r", 1.0, 2) for i, v in enumerate(drawn(n, dims, 3, spread, distinct))]
    assert held(spark, rows, 5)


def test_correlated_vectors_are_discarded_early():
    """Leading components hold most of the products, so that few pairs survive, and none that counts is lost."""
    rng = np.random.default_rng(5)
    q = np.floor(256 * (rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 32)) + 0.01 * rng.normal(size=(3000, 32))))
    axes = np.linalg.eigh(q.T @ q)[1][:, ::-1].copy()
    row = lambda s: {"n": len(s), "rows": np.arange(len(s)).tobytes(), "ids": list(range(len(s))), "labels": np.zeros(len(s), np.int64).tobytes(), "q": np.ascontiguousarray(s).tobytes()}
    a, b = H.Vectors(row(q[:50]), "", axes, [4, 8, 16]), H.Vectors(row(q), "", axes, [4, 8, 16])
    exact = (q[:50] @ q.T).astype(np.int64)
    least = np.sort(exact, axis=1)[:, -9].astype(float)  # a score that nine rows reach
    everything = np.ones((50, 3000), bool)
    i, j, score = H.survivors(a, b, [4, 8, 16], slice(0, 50), everything, least, least * 1.001 + 9)
    want = {(x, y) for x, y in zip(*np.nonzero((exact >= least[:, None]) & (exact <= least[:, None] * 1.001 + 9)), strict=True)}
    assert set(zip(i, j, strict=True)) == want and (score == exact[i, j]).all() and len(want) >= 50
    checked = []
    real, H.products = H.products, lambda a, b, i, j: checked.append(len(i)) or real(a, b, i, j)
    try:
        H.survivors(a, b, [4, 8, 16], slice(0, 50), everything, least)
    finally:
        H.products = real
    assert 450 <= sum(checked) < 1500  # of 150,000 pairs few are verified


def test_odd_rows(spark):
    rng = random.Random(2)
    vectors = drawn(600, 6, 8, 0.5, 60)
    odd = [None, [None] * 6, [float("nan")] * 6, [float("inf"), *[0.0] * 5], [1.0], [], [1e30] * 6]
    rows = [(rng.choice([None, i, i, 7 * i, 100]), rng.choice(odd[:-1]) if i % 9 == 0 else v, rng.choice([None, 0, 1, 2]), "r", None, None) for i, v in enumerate(vectors)]
    rows = [r for r in rows if r[0] is None or r[0] % 100 or r[1] != []]
    held(spark, rows + rows[:30])
    huge = [(7777, odd[-1], 1, "r", None, None)]  # out of range: takes no part
    assert sorted(H.mined(spark.createDataFrame(rows + huge, SCHEMA)).collect(), key=str) == sorted(H.mined(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)


def test_empty_and_alone(spark):
    assert held(spark, []) == []
    assert held(spark, [(100, [1.0, 2.0], 1, "r", 1.0, 1)]) == []
    assert held(spark, [(100, [0.0], 1, None, None, None), (1, [0.0], 1, None, None, None), (2, [0.0], 2, None, None, None)]) == [(100, 1, 1, 2, 0, 0)]
