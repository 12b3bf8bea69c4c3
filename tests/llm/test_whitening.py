"""Whitening against exact integers and numpy, defined cases."""

import math
import random

import numpy as np
import pytest

from civitas.llm import queries, whitening
from conftest import SF_SMALL


def exact(vectors):
    """n, S, covariance (divisor n) of x by Python integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n ** 3 for j in range(d)] for i in range(d)])
    return x, y, s, cov


def check(rows, ids, vectors, components=32):
    x, y, s, cov = exact(vectors)
    n, d = len(x), len(x[0])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(components, d)
    assert len(rows) == n * k
    got = {(r.id, r.component): r for r in rows}
    white = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    mean = np.array(x, float) - np.array([v / n for v in s])
    want = mean @ vecs[:, :k] / np.sqrt(values[:k])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < 1e-6
    assert np.abs(np.cov(white.T, bias=True) - np.eye(k)).max() < 1e-8
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8
    for i, yi in zip(ids, y):
        assert got[i, 1].deviation == sum(v * v for v in yi)
    for c in range(k):
        assert math.isclose(got[ids[0], c + 1].explained, values[c] / np.trace(cov), rel_tol=1e-9)
    assert {r.n for r in rows} == {n}


def test_query_on_the_table(spark):
    table = [r for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    rows = queries.QUERIES["op13_whitening"](spark, SF_SMALL).withColumnRenamed("vec_id", "id").collect()
    check(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_small_dimensions_and_repeats(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1), rng.gauss(0, 3), rng.gauss(5, 2)] for _ in range(40)]
    vectors += vectors[:10]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(4)
    check(whitening.whiten(df, "id", "v").collect(), list(range(50)), vectors)
    two = whitening.whiten(df, "id", "v", components=2).collect()
    check(two, list(range(50)), vectors, components=2)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 9), (None, [2.0, 2.5], 9), (3, [4.0, -1.0], 9), (3, [4.0, -1.0], 9),
            (4, None, 9), (5, [1.0, None], 9), (6, [nan, 1.0], 9), (7, [1.0, -inf], 9), (8, [], 9),
            (9, [1.0, 2.0, 3.0], 9)]
    df = spark.createDataFrame(rows, "id long, v array<float>, component int")
    out = whitening.whiten(df, "id", "v").collect()
    assert sorted((r.id, r.component) for r in out if r.id is not None) == \
        [(1, 1), (1, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert {r.n for r in out} == {4} and len(out) == 8
    assert whitening.whiten(df.limit(0), "id", "v").columns == \
        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(df.limit(0), "id", "v").count() == 0
    assert whitening.whiten(df.where("id = 1"), "id", "v").count() == 0     # no spread
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "id long, v array<double>")
    assert {r.component for r in whitening.whiten(line, "id", "v").collect()} == {1}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])],
                                 "id long, v array<double>")
    assert {r.deviation for r in whitening.whiten(huge, "id", "v").collect() if r.id == 1} == {None}


@pytest.mark.parametrize("top", [5, 2 ** 31, 2 ** 45, 2 ** 60])
def test_sums_of_squares_are_exact(top):
    rng = random.Random(top)
    z = [[rng.randrange(-top, top + 1) for _ in range(3)] for _ in range(9000)]
    want = [sum(r[i] ** 2 for r in z) for i in range(3)]
    assert whitening.sum_of_squares(np.array(z, np.int64)) == want
    assert whitening.sum_of_squares(np.array(z, object)) == want


def test_digits_keep_sums():
    rng = random.Random(1)
    values = [rng.randrange(-2 ** 150, 2 ** 150) for _ in range(50)] + [0, -1, 2 ** 160]
    rows = [whitening.digits(v) for v in values]
    assert [whitening.number(r) for r in rows] == values
    assert whitening.number([sum(c) for c in zip(*rows)]) == sum(values)


def test_wide_values_take_python_integers():
    x = np.array([[2 ** 62, 1], [-2 ** 62, 3]], np.int64)
    y = whitening.centred(x, 10, [0, 4])
    assert y.dtype == object and y.tolist() == [[10 * 2 ** 62, 6], [-10 * 2 ** 62, 26]]
