"""Whitening against exact fractions and a plain eigen-solve."""

import math
from fractions import Fraction

import numpy as np
import pytest

from mosaiq.llm import queries, whitening


def exact_covariance(x):
    """In integers: n^3 V of the rows of x."""
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    d = [[n * v - t for v, t in zip(row, s, strict=True)] for row in x]
    return [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(len(s))] for i in range(len(s))], d


def checked(vectors, got, most=8):
    x = [[math.floor(1024 * float(v)) + 100_000 for v in row] for row in vectors.values()]
    cover, d = exact_covariance(x)
    v = np.array([[float(c) for c in row] for row in cover])
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:most], p[:, ::-1][:, :most]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == len(x) and abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-9 * r.explained and r.identity_error < 1e-9
    assert set(by) == set(vectors)
    w = np.array([[by[i][k + 1].whitened for k in range(len(e))] for i in vectors])
    for k, i in enumerate(vectors):
        assert {r.deviation for r in by[i].values()} == {sum(c * c for c in d[k])}
    want = np.array(d, float) / len(x) @ p / np.sqrt(e)
    assert np.allclose(np.abs(w), np.abs(want), rtol=1e-6, atol=1e-7)
    assert np.abs(w.T @ w / len(x) - np.eye(len(e))).max() < 1e-9


def test_error_free_parts():
    """Slices and their products lose nothing, though entries differ by many orders."""
    r = np.random.default_rng(1)
    s = r.normal(size=(1000, 3)) * 10.0 ** r.integers(-6, 6, size=(1000, 3))
    value = whitening.two_sum(s, s * 1e-17 * r.normal(size=s.shape))
    total = None
    for part in whitening.outer_products(value):
        total = whitening.add(total, (part, np.zeros_like(part))) if total else (part, np.zeros_like(part))
    full = [[Fraction(a) + Fraction(b) for a, b in zip(*row, strict=True)] for row in zip(value[0].tolist(), value[1].tolist(), strict=True)]
    for i in range(3):
        for j in range(3):
            want = sum(row[i] * row[j] for row in full)
            size = sum(abs(row[i] * row[j]) for row in full)
            assert abs(Fraction(total[0][i, j]) + Fraction(total[1][i, j]) - want) <= size / 2**90


@pytest.mark.parametrize("seed", [1, 2])
def test_against_fractions(spark, seed):
    r = np.random.default_rng(seed)
    vectors = {int(k): row.tolist() for k, row in enumerate(r.normal(size=(300, 11)) * np.linspace(0.05, 3, 11))}
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 9), (903, [float("nan")] * 11), (904, [float("inf")] * 11), (905, [1.0] * 4)]
    rows = [(k, v, "x", 1) for k, v in [*vectors.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component int").repartition(5)
    checked(vectors, whitening.whiten(df).collect())


def test_edges(spark):
    kind = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 2.0])], kind)).count() == 0
    # fewer components than asked for, ids of other types, nulls and repeats
    got = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), (None, [3.0, 2.0]), ("a", [1.0, 2.0])], kind)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == [("None", 1, 3), ("a", 1, 3), ("a", 1, 3)]
    assert all(abs(abs(r.whitened) - (2**0.5 if r.vec_id is None else 0.5**0.5)) < 1e-12 for r in got)
    # entries and deviations that no long holds
    huge = whitening.whiten(spark.createDataFrame([("a", [3e38]), ("b", [-3e38]), ("c", [0.0])], kind)).collect()
    assert {r.vec_id: r.deviation for r in huge} == {"a": None, "b": None, "c": 0} and all(abs(r.explained - 1) < 1e-12 for r in huge)


def test_large_means_lose_nothing(spark):
    """Deviations of one unit beside a mean of 2^40 units."""
    vectors = {k: [2.0**30 + k % 7 / 1024, 2.0**29 - k % 5 / 1024, k % 3 / 1024] for k in range(500)}
    checked(vectors, whitening.whiten(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect())


def test_embeddings(spark, sf):
    got = queries.op13_embedding_whitening(spark, sf).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    checked(vectors, got)
