"""Least squares from co-moments against numpy's on whole columns."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import regress


def frame(spark, x, y, t=None):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(int(0 if t is None else t[i]), *map(float, x[i]), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, ["t", *names, "y"]).repartition(5), names


def sums_of(x, y):
    """The row that Spark's aggregates give, from numpy."""
    cols = np.c_[x, y]
    names = [*[f"x{i}" for i in range(x.shape[1])], "y"]
    centred = cols - cols.mean(axis=0)
    centred -= centred.mean(axis=0)
    c = centred.T @ centred / len(y)
    out = {"n": float(len(y))} | {f"m_{a}": cols[:, i].mean() for i, a in enumerate(names)}
    return out | {f"c_{a}__{b}": c[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}, names[:-1]


def centred_lstsq(x, y):
    """What lstsq gives before the shift drowns its digits."""
    beta = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
    return y.mean() - x.mean(axis=0) @ beta, beta


@pytest.mark.parametrize("shift", [0.0, 1e2, 5e3, 1e4, 1e6, 1e8])
def test_shifted_factors_keep_their_slope(spark, shift):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 30.0]])
    y = x @ [2.0, -1.0, 0.05] + rng.normal(size=2000)
    x[:, 0] += shift
    x[:, 2] -= 7 * shift
    df, names = frame(spark, x, y)
    b0, beta = regress.fit_ols(df, names)
    want0, want = centred_lstsq(x, y)
    assert np.allclose(beta, want, rtol=1e-6, atol=1e-7)
    assert abs(b0 - want0) <= 1e-6 * max(1, abs(want0))
    if shift <= 1e4:
        assert np.allclose([b0, *beta], np.linalg.lstsq(np.c_[np.ones(2000), x], y, rcond=None)[0], rtol=1e-6, atol=1e-6)
    b0, beta = regress.fit_ridge(df, names, 50.0)
    c = x - x.mean(axis=0)
    assert np.allclose(beta, np.linalg.solve(c.T @ c + 50 * np.eye(3), c.T @ (y - y.mean())), rtol=1e-6, atol=1e-7)


def test_per_period_fits_of_shifted_factors(spark):
    rng = np.random.default_rng(4)
    t = np.repeat([0, 1, 2], [300, 40, 5])
    x, y = rng.normal(size=(345, 2)), rng.normal(size=345)
    y += x @ [1.0, 2.0]
    x += np.array([1e6, -1e7])
    df, names = frame(spark, x, y, t)
    got = {r["t"]: r for r in regress.fit_per_period(df, names, base=["x1"]).collect()}
    for p in range(3):
        own, out = x[t == p], y[t == p]
        want0, want = centred_lstsq(own, out)
        assert np.allclose(got[p]["beta"], want, rtol=1e-6) and np.isclose(got[p]["intercept"], want0, rtol=1e-6)
        for r2, cols in ((got[p]["r2"], [0, 1]), (got[p]["r2_base"], [1])):
            b0, b = centred_lstsq(own[:, cols], out)
            assert np.isclose(r2, 1 - np.sum((out - b0 - own[:, cols] @ b) ** 2) / np.sum((out - out.mean()) ** 2), atol=1e-7)


SINGULAR = {
    "twice the same": lambda x: np.c_[x[:, 0], x[:, 0], x[:, 1]],
    "a constant": lambda x: np.c_[x[:, 0], np.full(len(x), 4.0), x[:, 1]],
    "zeros": lambda x: np.c_[np.zeros(len(x)), x[:, 0], np.zeros(len(x))],
    "a sum, other units": lambda x: np.c_[x[:, 0], 1000 * x[:, 1], x[:, 0] + x[:, 1]],
    "more factors than rows": lambda x: np.c_[x[:3], x[:3] ** 2, x[:3] ** 3],
    "one row": lambda x: x[:1],
}


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("kind", SINGULAR)
def test_singular_data_give_the_shortest_solution(kind, intercept):
    rng = np.random.default_rng(5)
    x = SINGULAR[kind](rng.normal(size=(60, 2)))
    y = rng.normal(size=len(x)) + 3
    sums, names = sums_of(x, y)
    b0, beta = regress.solve_ridge(sums, names, 0.0, intercept=intercept)
    whole = np.c_[np.ones(len(x)), x] if intercept else x
    want = np.linalg.lstsq(whole, y, rcond=None)[0]
    assert np.allclose([b0, *beta] if intercept else beta, want, atol=1e-6)


def test_a_shifted_copy_is_a_copy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 1))
    y = 2 * x[:, 0] + 0.1 * rng.normal(size=500)
    df, names = frame(spark, np.c_[x, x + 1e6], y)
    b0, beta = regress.fit_ols(df, names)
    assert np.isclose(sum(beta), 2, atol=0.02) and max(map(abs, beta)) < 1e3


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.0, 0.5, 20.0]), st.booleans(), st.integers(1, 4))
def test_well_posed_fits_equal_numpy(seed, alpha, intercept, k):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(50, k)) * 10.0 ** rng.integers(-2, 3, k) + rng.normal(size=k), rng.normal(size=50) + 1
    sums, names = sums_of(x, y)
    b0, beta = regress.solve_ridge(sums, names, alpha, intercept=intercept)
    whole = np.c_[np.ones(50), x] if intercept else x
    penalty = alpha * np.eye(whole.shape[1])
    if intercept:
        penalty[0, 0] = 0
    want = np.linalg.solve(whole.T @ whole + penalty, whole.T @ y)
    assert np.allclose([b0, *beta] if intercept else beta, want, rtol=1e-6, atol=1e-8)


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 4.0), (0, None, 9.0), (0, 3.0, None), (0, 4.0, 8.0)], "t int, x double, y double")
    b0, (b,) = regress.fit_ols(df, ["x"])
    assert np.allclose([b0, b], [0, 2])
    assert [r["t"] for r in regress.fit_per_period(df, ["x"]).collect()] == [0]
    with pytest.raises(ValueError):
        regress.fit_ols(df.where("t > 5"), ["x"])
    with pytest.raises(ValueError):
        regress.fit_ridge(df, ["x"], -1.0)
