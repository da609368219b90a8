import math
from fractions import Fraction

import numpy as np
import pytest

from docassay.llm import q_whitening
from docassay.llm.whitening import orthogonal_columns, pivoted_cholesky, principal_components, whiten, whole_numbers
from docassay.sources import read_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("d,rank,scale", [(1, 1, 1.0), (2, 2, 1.0), (5, 3, 1e6), (17, 17, 1e-9), (40, 7, 1.0), (64, 64, 1.0)])
def test_eigenvectors(d, rank, scale):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank) * scale
    v = a @ a.T
    g, order = pivoted_cholesky(v)
    assert g.shape[1] == rank and np.allclose(np.triu(g, 1), 0) and np.allclose(g @ g.T, v[np.ix_(order, order)], atol=1e-13 * np.abs(v).max())
    r = orthogonal_columns(g)
    cosines = r.T @ r / np.outer(np.linalg.norm(r, axis=0), np.linalg.norm(r, axis=0))
    assert np.abs(cosines - np.eye(rank)).max() < 1e-14
    e, u = principal_components(v, 16)
    want = np.linalg.eigh(v)[0][::-1][: len(e)]
    assert len(e) == min(16, rank) and np.allclose(e, want, rtol=1e-9) and np.allclose(v @ u, u * e, atol=1e-13 * np.abs(v).max())


def exact(vectors):
    """(n, sums, covariance as fractions) of the distinct vectors."""
    fit = [list(x) for x in {tuple(x) for x in vectors}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    z = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    return n, sums, [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(d)] for i in range(d)]


def check(got, rows, most=16, tolerance=1e-9):
    """Rows of the result against exact sums and numpy's eigenvalues; rows: {vec_id: vector}."""
    n, sums, v = exact(rows.values())
    v = np.array([[float(x) for x in r] for r in v])
    e = np.linalg.eigh(v)[0][::-1]
    rank = min(most, np.linalg.matrix_rank(v / np.sqrt(np.outer(v.diagonal(), v.diagonal())), hermitian=True))
    by = {}
    for x in got:
        by.setdefault(x.vec_id, {})[x.component] = x
    assert by.keys() == rows.keys()
    fit = {}
    for i, own in by.items():
        assert sorted(own) == list(range(1, rank + 1))
        for c, x in own.items():
            assert x.n == n and abs(x.explained - e[c - 1] / np.trace(v)) <= 1e-9 and x.identity_error < 1e-9
            deviation = sum((n * a - s) ** 2 for a, s in zip(rows[i], sums))
            assert x.deviation == (deviation if deviation < 2**63 else None)
        fit[tuple(rows[i])] = [own[c].whitened for c in range(1, rank + 1)]
    w, x = np.array(list(fit.values())), np.array([[float(a - Fraction(s, n)) for a, s in zip(k, sums)] for k in fit])
    assert np.abs(w.T @ w / n - np.eye(rank)).max() < 1e-9
    e = np.array([own[c].explained for c in sorted(own)]) * np.trace(v)  # the small ones are more exact than numpy's
    # whitened is x projected on a unit vector over sqrt(e): the covariance of both gives back sqrt(e) times the vector
    components = x.T @ w / n / np.sqrt(e[:rank])
    assert np.allclose(np.linalg.norm(components, axis=0), 1, atol=1e-9)
    assert np.allclose(v @ components, components * e, atol=tolerance * e[0])


def test_the_query(spark):
    rows = {x.vec_id: [math.floor(64 * a) + 1_000_000 for a in x.embedding] for x in read_table(spark, SF, "embeddings").collect()}
    check(q_whitening.query(spark, SF).collect(), rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [[float(x) for x in rng.normal(size=5) * [1, 9, 0.01, 3, 200]] for _ in range(60)]
    good += [good[0]] * 40 + [[-3e6, 0.0, 1.0, 2.0, 3.0]]  # repeated rows, a far one
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [nan] * 5, [1.0, inf, 0.0, 0.0, 0.0], [-inf] + [0.0] * 4, [1e30] * 5]
    short = [[1.0, 2.0], [4.0, 2.5], [1.0, 2.0]]
    rows = list(enumerate([*good, *bad, *short, [], [7.0]]))
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, n int").repartition(3)
    vectors = df.select("*", whole_numbers("embedding", 64, 1_000_000).alias("vector"))
    got = whiten(vectors).collect()
    whole = {i: [math.floor(64 * a) + 1_000_000 for a in v] for i, v in rows if v in good or v in short}
    check([x for x in got if x.vec_id < len(good)], {i: v for i, v in whole.items() if i < len(good)}, tolerance=1e-6)  # the far one: e from 0.3 to 10^15
    at = len(good) + len(bad)
    two = [x for x in got if x.vec_id >= at]
    assert [(x.vec_id, x.component, x.n) for x in sorted(two)] == [(at, 1, 2), (at + 1, 1, 2), (at + 2, 1, 2)]  # one component of two vectors
    assert {x.vec_id for x in got} == {*range(len(good)), at, at + 1, at + 2}


def test_small_spread_on_a_large_mean_and_large_deviations(spark):
    rows = {i: [10**15 + (i == 3), 5 - i % 2, 10**9 * (i % 3)] for i in range(50)}
    df = spark.createDataFrame(list(rows.items()), "vec_id int, vector array<long>")
    n, sums, v = exact(rows.values())
    got = whiten(df, most=3).collect()
    e = np.linalg.eigvalsh(np.array([[float(x) for x in r] for r in v]))[::-1]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in rows.items()}
    assert {(x.vec_id, x.deviation) for x in got} == {(i, w if w < 2**63 else None) for i, w in want.items()}
    assert {x.component for x in got} == {1, 2, 3} and max(x.identity_error for x in got) < 1e-6
    rest = [[float(v[i][j] - v[i][2] * v[2][j] / v[2][2]) for j in (0, 1)] for i in (0, 1)]  # what the large one leaves
    want = np.array([e[0], *np.linalg.eigvalsh(rest)[::-1]])
    assert e[0] > 1e17 and all(abs(x.explained / (want[x.component - 1] / want.sum()) - 1) < 1e-9 for x in got)
    far = whiten(spark.createDataFrame([(1, [0, 2**61]), (2, [0, -(2**61)])], "vec_id int, vector array<long>")).collect()
    assert [(x.vec_id, x.deviation, round(abs(x.whitened), 9)) for x in sorted(far)] == [(1, None, 1.0), (2, None, 1.0)]


def test_empty_table_and_single_vector(spark):
    assert whiten(spark.createDataFrame([], "vec_id long, vector array<long>")).count() == 0
    assert whiten(spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, None)], "vec_id long, vector array<long>")).count() == 0
