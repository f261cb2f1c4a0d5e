"""Whitening against a plain computation over all rows, and its odd rows."""

import math
import random

import numpy as np
import pytest

from logloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, label int"


def by_hand(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), c @ q[:, ::-1], e[::-1]


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def as_op(spark, df):
    import tempfile

    where = tempfile.mkdtemp()
    df.write.parquet(f"{where}/embeddings.parquet")
    return whitening.op11_whitening(spark, where)


@pytest.mark.parametrize("dims,most", [(40, 32), (5, 5)])
def test_equals_a_plain_computation(spark, dims, most):
    rng = random.Random(dims)
    vectors = [[np.float32(rng.gauss(0, 1 + k)).item() for k in range(dims)] for _ in range(300)]
    vectors += [vectors[0]] * 400 + [vectors[1]] * 3  # one vector in more than half of all rows
    got = collected(as_op(spark, spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA)))
    n, deviation, turned, e = by_hand(vectors)
    assert sorted(got) == list(range(n))
    for k in range(most):
        mine = np.array([got[i][k + 1].whitened for i in range(n)])
        want = turned[:, k] / math.sqrt(e[k])
        assert np.allclose(mine, want * np.sign((mine * want).sum()), atol=1e-9)
    assert [got[i][1].deviation for i in range(n)] == deviation.tolist()
    assert {(r.n, r.identity_error < 1e-9, len(v)) for v in got.values() for r in v.values()} == {(n, True, most)}
    assert all(abs(got[0][k + 1].explained - e[k] / e.sum()) < 1e-12 for k in range(most))


def test_odd_rows(spark):
    fine = [(i, [float(i % 7), float(i % 5), 2.0, float(i % 3)], "c", None) for i in range(60)]
    odd = [(100, None, "c", 1), (101, [1.0, None, 1.0, 1.0], "c", 1), (102, [1.0, float("nan"), 1.0, 1.0], "c", 1), (103, [float("inf"), 0.0, 0.0, 0.0], "c", 1),
           (104, [1.0], "c", 1), (105, [3e38, 0.0, 0.0, 0.0], "c", 1), (106, [], "c", 1), (None, [1.0, 2.0, 2.0, 0.5], "c", 1), (0, fine[0][1], "c", 1)]
    got = as_op(spark, spark.createDataFrame(fine + odd, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {*range(60), None} and {r.n for r in got} == {62}
    assert {r.component for r in got} == {1, 2, 3}  # the third dimension doesn't vary
    assert sum(r.vec_id == 0 for r in got) == 6
    assert max(r.identity_error for r in got) < 1e-9


def test_nothing_to_whiten(spark):
    assert as_op(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    assert as_op(spark, spark.createDataFrame([(i, [1.0, 2.0], "c", 1) for i in range(5)], SCHEMA)).collect() == []


def test_exact_beyond_64_bits():
    x = np.array([[1 << 51, 5], [-(1 << 51), 7], [3, 9]], np.int64)
    w = np.array([1 << 40, 3, 1], np.int64)
    n, s = int(w.sum()), whitening._exact_sums(x, w)
    assert s == [sum(int(a) * int(b) for a, b in zip(x[:, k], w)) for k in range(2)]
    got = whitening._centred(x, n, s)
    assert np.allclose(got, [[(n * int(v) - t) / n for v, t in zip(row, s)] for row in x], rtol=1e-15)
    assert whitening._deviations(x, n, s)[0] is None
    assert whitening._deviations(x, 3, x.sum(axis=0).tolist())[0] is None


def test_weights_of_one(spark):
    rows = [(i, [float(i), float(i * i % 5)], "c", 1) for i in range(6)] + [(9, [0.0, 0.0], "c", 1)] * 20
    white, model = whitening.whiten(spark.createDataFrame(rows, SCHEMA), weights="one")
    assert model.n == 6 and white.count() == 26
    n, _, _, e = by_hand([r[1] for r in rows[:6]])
    assert np.allclose(model.eigenvalues, e)
