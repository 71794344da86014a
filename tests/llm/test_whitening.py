import math
from fractions import Fraction

import numpy as np
import pytest

from hearth.llm import double_double as D
from hearth.llm import queries, whitening


def exact_covariance(x):
    """Of whole numbers, in fractions."""
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, deviation string").repartition(3)


def test_double_double_keeps_106_bits():
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(7, 9)) * 10.0 ** rng.integers(-8, 8, (7, 9)) for _ in "ab")
    p = D.two_prod(a, b)
    s = D.two_sum(a, b)
    for k in np.ndindex(a.shape):
        assert Fraction(p[0][k]) + Fraction(p[1][k]) == Fraction(a[k]) * Fraction(b[k])
        assert Fraction(s[0][k]) + Fraction(s[1][k]) == Fraction(a[k]) + Fraction(b[k])
    t = D.fractions(D.total((a, np.zeros_like(a))))
    m = D.matmul((a, np.zeros_like(a)), (b.T, np.zeros_like(b.T)))
    for i in range(7):
        want = sum(map(Fraction, a[i]))
        assert abs(t[i] - want) <= sum(abs(Fraction(v)) for v in a[i]) / 2**100
        dot = sum(Fraction(x) * Fraction(y) for x, y in zip(a[i], b[i]))
        assert abs(Fraction(m[0][i, i]) + Fraction(m[1][i, i]) - dot) <= sum(abs(Fraction(x) * Fraction(y)) for x, y in zip(a[i], b[i])) / 2**95
    q = D.over((np.array([1.0]), np.array([0.0])), 3)
    assert abs(D.fractions(q)[0] - Fraction(1, 3)) < Fraction(1, 2**104)


def test_covariance_is_the_exact_one(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(150, 5)) * [1e6, 1.0, 1e-2, 1.0, 300.0] + [1e8, 0, 0, -5, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(4)
    n, s = whitening.sums(df, "embedding", whitening.whole)
    x = [[math.floor(1024 * c) + 100_000 for c in r] for r in m.tolist()]
    assert n == 150 and s == [sum(r[i] for r in x) for i in range(5)]
    v = whitening.covariance(df, "embedding", D.from_fractions([t / n for t in s]), whitening.whole)
    want = exact_covariance(x)
    for i in range(5):
        for j in range(5):
            assert abs(Fraction(v[0][i, j]) + Fraction(v[1][i, j]) - want[i][j]) <= Fraction(1, 2**85) * (1 + abs(want[i][i]) + abs(want[j][j]))
    # the smallest of eigenvalues 18 orders of magnitude apart
    values, axes = whitening.eigen(v)
    assert (np.diff(values) < 0).all() and values[0] / values[-1] > 1e15
    assert values.sum() == pytest.approx(float(sum(want[i][i] for i in range(5))), rel=1e-14)
    assert np.abs(axes.T @ axes - np.eye(5)).max() < 1e-14
    exact = np.array([[float(w) for w in r] for r in want])
    for e, u in zip(values, axes.T):
        residual = [sum(w * Fraction(c) for w, c in zip(r, u.tolist())) - Fraction(e) * Fraction(c) for r, c in zip(want, u.tolist())]
        assert max(abs(float(r)) for r in residual) <= 1e-15 * np.abs(exact).max()
    model = whitening.fitted(df)
    assert whitening.whiteness(whitening.whitened(df, model, 5)) < 1e-4


def test_query_against_brute_force(spark, sf):
    rows = queries.op12_whitening(spark, sf).collect()
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = {k: [math.floor(1024 * c) + 100_000 for c in v] for k, v in data.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[i] for v in x.values()) for i in range(d)]
    centred = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(r, s)] for r in x.values()])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    assert len(rows) == 8 * n and {r.component for r in rows} == set(range(1, 9)) and {r.n for r in rows} == {n}
    by = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, 9):
        want = centred @ axes[:, -c] / np.sqrt(values[-c])
        got = np.array([by[k, c].whitened for k in x])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert by[next(iter(x)), c].explained == pytest.approx(values[-c] / values.sum(), rel=1e-10)
    for k in list(x)[:50]:
        assert by[k, 1].deviation == sum((n * v - t) ** 2 for v, t in zip(x[k], s))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    kept = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [0.5, -1.0, 3.0]), (4, [2.0, 0.25, 3.0]), (5, [-3.0, 0.0, 3.0])]
    rows = whitening.whitening(frame(spark, kept + [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [1.0, inf, 1.0]), (10, [])])).collect()
    assert len(rows) == 15 and {r.n for r in rows} == {5} and {r.vec_id for r in rows} == {1, None, 4, 5}
    assert all((r.whitened is None) == (r.component == 3) for r in rows) and {r.explained for r in rows if r.component == 3} == {0.0}
    assert rows[0].identity_error < 1e-9
    alone = whitening.whitening(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in alone] == [(None, None, None, 0)] * 4
    assert whitening.whitening(frame(spark, [(1, None)])).count() == 0 and whitening.whitening(frame(spark, [(1, None)]).limit(0)).columns == rows[0].__fields__
    with pytest.raises(Exception, match="different lengths|components in one column"):
        whitening.whitening(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    far = whitening.deviations(np.array([[2.0**40, 0.0], [0.0, 1.0]]), 10**6, (5, 7))
    assert far.to_pylist()[0] == (10**6 * 2**40 - 5) ** 2 + 49
