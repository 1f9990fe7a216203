import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from palimpsest.llm import spectrum, whiten

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()),
    T.StructField("component", T.DoubleType()), T.StructField("a.b", T.StringType()),
])


@pytest.mark.parametrize("kind", range(6))
def test_leading_pairs_and_counts_of_hard_matrices(kind):
    rng = np.random.default_rng(kind)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        q, _r = np.linalg.qr(rng.standard_normal((n, n)))
        e = [
            rng.standard_normal(n), np.sort(rng.random(n)) * 10.0 ** rng.integers(-8, 8), np.round(rng.random(n) * 3),
            1 + rng.random(n) * 1e-10, 10.0 ** -np.arange(n), np.where(np.arange(n) < n // 2, rng.random(n), 0.0),
        ][kind]
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        want = np.linalg.eigvalsh(a)[::-1]
        shift = rng.choice(want) + rng.standard_normal() * max(1e-3, abs(want).max()) / 10
        assert spectrum.inertia_below(a, shift) == (want < shift).sum()
        found, k, scale = spectrum.leading(a, 8), min(8, n), max(abs(want).max(), 1e-300)
        assert np.abs(found.values - want[:k]).max() <= 1e-12 * scale
        assert np.abs(found.vectors.T @ found.vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-12 * scale * n
        assert (found.above <= np.arange(k)).all() and (found.upto > np.arange(k)).all()


def test_no_rows_and_zero_matrices():
    assert spectrum.leading(np.zeros((0, 0)), 8).values.shape == (0,)
    zero = spectrum.leading(np.zeros((3, 3)), 8)
    assert (zero.values == 0).all() and (zero.vectors == np.eye(3)).all()


def vectors(seed, n, dim):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1 / (1 + d)) for d in range(dim)]
        out.append((i, v, "x", 1.0, None))
    return [*out, out[0], out[0], (None, out[1][1], None, None, None)]


def brute(rows):
    fine = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    dim = max(len(r[1]) for r in fine)
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in [*r[1], *[0.0] * (dim - len(r[1]))]] for r in fine]
    n, s = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    value, vector = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-value)[:8]
    return fine, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], z @ vector[:, order] / np.sqrt(value[order]), value[order] / value.sum()


@pytest.mark.parametrize("dim", [12, 3])
def test_equals_brute_force(spark, dim):
    rows = vectors(1, 90, dim)
    rows += [(200, None, "", 0.0, ""), (201, [*[0.5] * (dim - 1), None], "", 0.0, ""), (202, [float("nan")] * dim, "", 0.0, "")]
    rows += [(203, [float("inf")] * dim, "", 0.0, ""), (204, [], "", 0.0, ""), (205, [0.25], "", 0.0, ""), (206, [1.5] * dim, "", None, None)]
    fine, deviation, white, explained = brute(rows)
    found = whiten.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    k = min(8, dim)
    assert len(found) == len(fine) * k
    own = sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained) for r in found)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-10
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0))
    sign = [1.0] * k
    i = 0
    for c in range(k):  # either sign, the same for all rows
        mine = np.array([r[5] for r in own if r[2] == c + 1])
        ids = [(r[0], r[1]) for r in own if r[2] == c + 1]
        theirs = np.array([white[j][c] for j in order])
        assert ids == [(fine[j][0] is None, fine[j][0] or 0) for j in order]
        sign[c] = 1.0 if mine @ theirs > 0 else -1.0
        assert np.abs(mine - sign[c] * theirs).max() < 1e-8
    for c in range(k):
        assert all(abs(r[6] - explained[c]) < 1e-12 for r in own if r[2] == c + 1)
    kept = sorted((fine[j][0] is None, fine[j][0] or 0, deviation[j]) for j in order)
    assert sorted((r[0], r[1], r[4]) for r in own if r[2] == 1) == kept
    assert {r[3] for r in own} == {len(fine)}


def test_degenerate_tables(spark):
    assert whiten.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None, "", 0.0, "")], SCHEMA)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [0.5, 1.0], "", 0.0, "")] * 3, SCHEMA)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, float(i)], "", 0.0, "") for i in range(5)], SCHEMA)
    rows = whiten.whiten(flat).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12


def test_large_numbers_stay_exact():
    centre = whiten.Centre(4_000_000_000, [4_000_000_000 * 100_000 + 1, 7])
    assert centre.deviation(np.array([[100_001, 0]])) == [None]
    assert centre.deviation(np.array([[100_000, 0]])) == [(4_000_000_000 * 100_000 - 4_000_000_000 * 100_000 - 1) ** 2 + 49]
    huge = whiten.grid(whiten.pa.array([[1e30, -1e30]], whiten.pa.list_(whiten.pa.float64())), 2)
    assert huge.tolist() == [[whiten.EDGE + whiten.LIFT, -whiten.EDGE + whiten.LIFT]]
