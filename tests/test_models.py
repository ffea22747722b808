"""Linear family against numpy closed forms / optimality conditions,
random Fourier features, and a pyspark.ml fit smoke test."""

import numpy as np
import pytest

from velas.operators import linear, mlzoo


def _prepared(spark, n=400, d=5, seed=0, dependent=False, chunk_rows=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d))
    if dependent:
        x[:, -1] = x[:, 0] + x[:, 1]  # an exactly dependent column
    x = (x - x.mean(0)) / x.std(0)    # standardised, as prepared rows are
    y = 3.0 + x @ rng.normal(0, 2, d) + rng.normal(0, 0.5, n)
    cols = [f"f{j}" for j in range(d)]
    rows = [("S", i, i, True, float(y[i]), *map(float, x[i])) for i in range(n)]
    schema = "symbol string, rn long, idx long, is_train boolean, label double, " + ", ".join(
        f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema), cols, x, y


def _coefs(spark, df, cols, **kw):
    out = {r.model: (r.intercept, np.array(r.coef)) for r in linear.fit_linear(df, cols, **kw).collect()}
    return out


def test_ols_and_ridge_closed_form(spark):
    df, cols, x, y = _prepared(spark)
    got = _coefs(spark, df, cols, chunk_rows=97)  # several chunks per symbol
    a = np.column_stack([np.ones(len(y)), x])
    theta = np.linalg.lstsq(a, y, rcond=None)[0]
    b, w = got["Linear Regression"]
    assert b == pytest.approx(theta[0], abs=1e-9) and np.allclose(w, theta[1:], atol=1e-9)
    xc, yc = x - x.mean(0), y - y.mean()
    wr = np.linalg.solve(xc.T @ xc + np.eye(len(cols)), xc.T @ yc)
    b, w = got["Ridge Regression"]
    assert np.allclose(w, wr, atol=1e-9) and b == pytest.approx(y.mean() - x.mean(0) @ wr, abs=1e-9)


def test_ols_rank_deficient_predictions(spark):
    df, cols, x, y = _prepared(spark, dependent=True)
    b, w = _coefs(spark, df, cols)["Linear Regression"]
    a = np.column_stack([np.ones(len(y)), x])
    theta = np.linalg.lstsq(a, y, rcond=None)[0]
    assert np.allclose(b + x @ w, a @ theta, atol=1e-8)


@pytest.mark.parametrize("model,l1,l2", [("Lasso Regression", 1.0, 0.0), ("ElasticNet", 0.5, 0.5)])
def test_lasso_elastic_kkt(spark, model, l1, l2):
    df, cols, x, y = _prepared(spark, seed=3)
    b, w = _coefs(spark, df, cols)[model]
    n = len(y)
    r = y - b - x @ w
    grad = x.T @ r / n - l2 * w  # subgradient condition: |grad_j| <= l1, = l1*sign(w_j) if w_j != 0
    for j in range(len(cols)):
        if abs(w[j]) > 1e-10:
            assert grad[j] == pytest.approx(l1 * np.sign(w[j]), abs=1e-7)
        else:
            assert abs(grad[j]) <= l1 + 1e-7
    assert abs(r.mean()) < 1e-9  # intercept unpenalised


def test_rff_approximates_rbf_kernel():
    d = 6
    w, b = mlzoo.rff_weights(d, dim=20000)
    rng = np.random.default_rng(5)
    p, q = rng.normal(0, 1, d), rng.normal(0, 1, d)
    zp = np.sqrt(2 / 20000) * np.cos(w @ p + b)
    zq = np.sqrt(2 / 20000) * np.cos(w @ q + b)
    assert zp @ zq == pytest.approx(np.exp(-np.sum((p - q) ** 2) / d), abs=0.03)


def test_pyspark_ml_fit_runs(spark):
    df, cols, x, y = _prepared(spark, n=200, d=4, seed=7)
    df = df.withColumn("is_train", df.idx < 160)
    out = mlzoo.fit_predict(df, "Random Forest", cols, classify=False).collect()
    assert len(out) == 40 and all(r.p is not None for r in out)


def test_grouped_logistic_matches_newton(spark):
    rng = np.random.default_rng(11)
    n, d = 300, 4
    x = rng.normal(0, 1, (n, d))
    x = (x - x.mean(0)) / x.std(0)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + x @ np.array([1.0, -2.0, 0.5, 0.0]))))).astype(float)
    cols = [f"f{j}" for j in range(d)]
    rows = [("S", i, i, True, float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, rn long, idx long, is_train boolean, label double, "
                               + ", ".join(f"{c} double" for c in cols))
    got = linear.fit_logistic(df, cols, chunk_rows=70).collect()[0]
    # independent solve: plain gradient descent to convergence on the same objective
    a = np.column_stack([np.ones(n), x])
    th = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[0, 0] = 0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-a @ th))
        th -= 0.002 * (a.T @ (p - y) + reg @ th)
    assert got.intercept == pytest.approx(th[0], abs=1e-6)
    assert np.allclose(got.coef, th[1:], atol=1e-6)
