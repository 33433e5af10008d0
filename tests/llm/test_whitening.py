"""Whitening against plain exact arithmetic, and its eigenvectors against hard matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from bandlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, vector string"


def hard(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(len(values)) - q.T @ q / 2)  # orthogonal to the last bit
    return (q * np.array(values, np.longdouble)) @ q.T


@pytest.mark.parametrize(
    "values",
    [[9, 5, 3, 1], [1 + k * 1e-9 for k in range(6)] + [7, 2e-5], [4, 4, 4, 1, 1, 0], [5, 5 + 1e-13, 5 - 1e-13, 1e-12, 0, 0], [3], [2.0**-k for k in range(40)], [1 + k * 1e-4 for k in range(20)]],
)
def test_eigenvectors_are_right_to_more_than_double_precision(values):
    matrix = hard(values)
    matrix = (matrix + matrix.T) / 2
    found, x = whitening.eigenvectors(matrix)
    size = float(np.abs(matrix).max())
    assert np.all(np.diff(found) <= 1e-17 * size)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17 * len(values)
    assert np.abs(matrix @ x - x * found).max() < 4e-18 * size * len(values)
    assert np.allclose(np.sort(np.array(values, float))[::-1], found.astype(float), rtol=0, atol=1e-15 * size)


def plain(rows, components=8):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(c))) + 100000 for c in vector]))
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[i] for _, x in kept) for i in range(d)]
    covariance = [[sum(Fraction((n * x[i] - sums[i]) * (n * x[j] - sums[j]), n * n) for _, x in kept) / n for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in covariance]))
    order = np.argsort(-values)[:components]
    out = {}
    for vec_id, x in kept:
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        for k, at in enumerate(order):
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            out[vec_id, k + 1] = (n, deviation, centred @ vectors[:, at] / math.sqrt(values[at]), values[at] / values.sum())
    return out


def test_rows_equal_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    turn = rng.normal(size=(12, 12))
    rows = [(i, [float(v) for v in rng.normal(size=12) @ turn]) for i in range(150)]
    rows += [(1000, None), (1001, [None] * 12), (1002, [math.nan] + [0.0] * 11), (1003, [math.inf] + [0.0] * 11), (1004, [-0.25] * 12)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(1005, [1.0, 2.0], 1, "x"), (1006, [], 1, "x")], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame).collect()}
    want = plain(rows)
    assert set(got) == set(want) and len(want) == 151 * 8
    sign = {k: np.sign(sum(got[i, k].whitened * want[i, k][2] for i in range(150))) for k in range(1, 9)}
    for key, (n, deviation, whitened, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened * sign[key[1]] == pytest.approx(whitened, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= r.identity_error < 1e-10


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None)])).count() == 0
    one = whitening.whiten(frame([(None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(None, 1, 1, 0, 0.0, 0.0, 1.0), (None, 2, 1, 0, 0.0, 0.0, 1.0)]
    twice = whitening.whiten(frame([(1, [1.0]), (1, [1.0]), (2, [3.0])])).collect()  # repeated rows count each time
    assert sorted((r.vec_id, r.n, r.deviation) for r in twice) == [(1, 3, 2048**2), (1, 3, 2048**2), (2, 3, 4096**2)]
    assert twice[0].identity_error < 1e-12 and twice[0].explained == pytest.approx(1)
    far = whitening.whiten(frame([(k, [float(k % 7) * 2.0**40, float(k % 3)]) for k in range(40)])).collect()  # beyond what a long can hold
    assert {r.deviation for r in far if r.vec_id % 7 == 6} == {None} and {r.whitened for r in far if r.component == 2} == {0.0}
    alone = whitening.whiten(frame([(k, [float(k % 7) * 2.0**40]) for k in range(40)])).collect()
    assert max(r.identity_error for r in alone) < 1e-9
    assert whitening.whiten(frame([(1, [1e30]), (2, [1.0])])).count() == 1
