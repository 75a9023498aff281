"""Whitening against exact sums, and a decomposition of the covariance computed plainly in one place."""

import math
from fractions import Fraction

import numpy as np
import pytest

from crossloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string, component string"


def frame(spark, vectors, parts=5, first=0):
    rows = [(first + i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "x", "y") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plainly(vectors, k=32):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    away = (n * x - s).astype(np.float64) / n
    cov = away.T @ away / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [sum(int(n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], away @ u / np.sqrt(e), e / np.trace(cov)


def check(got, ids, vectors, k=32):
    n, deviation, white, explained = plainly(vectors, k)
    table = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert set(table) == {(i, c) for i in ids for c in range(1, white.shape[1] + 1)}
    shown = np.array([[table[i, c + 1]["whitened"] for c in range(white.shape[1])] for i in ids])
    sign = np.sign((shown * white).sum(axis=0))
    assert np.abs(shown * sign - white).max() < 1e-6
    assert np.allclose([table[ids[0], c + 1]["explained"] for c in range(white.shape[1])], explained, rtol=1e-8)
    assert all(table[i, 1]["deviation"] == d and table[i, 1]["n"] == n for i, d in zip(ids, deviation, strict=True))
    errors = {r["identity_error"] for r in table.values()}
    assert len(errors) == 1 and errors.pop() < 1e-8
    assert np.abs(shown.T @ shown / n - np.eye(white.shape[1])).max() < 1e-8


def test_equals_plain(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) / 8
    vectors[200:] = vectors[5]  # a third of all rows
    got = whitening.whiten(frame(spark, vectors.tolist()))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got, list(range(300)), vectors)


def test_odd_vectors_are_dropped(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(50, 6)).tolist()
    odd = [None, [], [1.0, None, 2, 3, 4, 5], [math.nan, 1, 2, 3, 4, 5], [math.inf, 1, 2, 3, 4, 5], [-math.inf] * 6, [1.0, 2.0], [1.0] * 7]
    check(whitening.whiten(frame(spark, vectors).union(frame(spark, odd, first=100))), list(range(50)), vectors, 6)


def test_repeated_and_null_ids_are_answered_each(spark):
    vectors = np.random.default_rng(5).normal(size=(20, 3)).tolist()
    rows = [(None if i % 3 == 0 else i % 2, v) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.count() == 60 and got.where("vec_id is null").count() == 21
    assert got.agg({"n": "max"}).first()[0] == 20


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 7, [None, [math.nan]], [[]]])
def test_tables_without_variance_give_no_rows(spark, vectors):
    got = whitening.whiten(frame(spark, vectors))
    assert got.collect() == [] and len(got.columns) == 7


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(6)
    vectors = np.c_[rng.normal(size=(40, 3)), np.full((40, 2), 0.5)]
    vectors[:, 2] = vectors[:, 0]
    got = whitening.whiten(frame(spark, vectors.tolist()))
    assert {r["component"] for r in got.select("component").collect()} == {1, 2}
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-8


def test_merge_is_exact_enough_far_from_zero():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (5000, 4)) + 10**9
    parts = [whitening.Moments.of(p) for p in np.array_split(x, 37)]
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    s = [Fraction(int(v)) for v in x.sum(axis=0)]
    want = [[float(sum((int(a) - s[i] / 5000) * (int(b) - s[j] / 5000) for a, b in zip(x[:, i].tolist(), x[:, j].tolist(), strict=True))) for j in range(2)] for i in range(2)]
    assert total.n == 5000 and total.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(total.scatter[:2, :2], want, rtol=1e-9)


def test_deviations_beyond_a_long_are_null():
    away = np.array([[3, 4], [3_000_000_000, 0], [3_100_000_000, 0]])
    assert whitening.deviations(away).to_pylist() == [25, 9 * 10**18, None]


def test_too_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e200]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()
