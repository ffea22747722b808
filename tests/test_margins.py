"""Margin classifier: optimality, independence of chunks, calibrated probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from velas.operators import margins


def _rows(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for symbol, w in (("A", [1.5, -1.0, 0.0]), ("B", [0.2, 0.2, 2.0])):
        x = rng.normal(0, 1, (n, 3))
        up = rng.random(n) < 1 / (1 + np.exp(-(x @ np.array(w))))
        out += [(symbol, i, i, i < n * 2 // 3, float(up[i]), *map(float, x[i])) for i in range(n)]
    out += [("C", i, i, i < 4, 1.0, float(i), 0.0, 0.0) for i in range(6)]  # one class only
    return out, spark.createDataFrame(out, "symbol string, rn long, idx long, is_train boolean, label double, "
                                           "a double, b double, c double")


def test_gradient_is_zero_for_any_chunking(spark):
    rows, df = _rows(spark)
    found = {}
    for chunk in (100_000, 97):
        train = df.where("is_train").select("symbol", F.lit(-1).alias("fit"), F.floor(F.col("idx") / chunk).alias("chunk"),
                                            F.array("a", "b", "c").alias("x"), "label")
        found[chunk] = {r.symbol: r for r in margins.fit_margins(train).collect()}
        assert all(r.converged for r in found[chunk].values())
    for symbol in "AB":
        x = np.array([r[5:] for r in rows if r[0] == symbol and r[3]])
        s = np.array([2 * r[4] - 1 for r in rows if r[0] == symbol and r[3]])
        r = found[97][symbol]
        w = np.array(r.coef)
        inside = np.maximum(0, 1 - s * (r.intercept + x @ w))
        assert np.abs(w - 2 * x.T @ (s * inside)).max() < 1e-6 and abs((s * inside).sum()) < 1e-6
        assert r.coef == pytest.approx(found[100_000][symbol].coef, abs=1e-9)
    assert found[97]["C"].intercept == 1.0 and set(found[97]["C"].coef) == {0.0}


def test_probabilities_are_calibrated_on_rows_held_out(spark):
    rows, df = _rows(spark)
    got = margins.predict(df, ["a", "b", "c"]).collect()
    assert len(got) == sum(not r[3] for r in rows)
    assert all(r.p == 1.0 and r.prob_up > 0.99 for r in got if r.symbol == "C")
    for symbol in "AB":
        mine = [r for r in got if r.symbol == symbol]
        prob, y = np.array([r.prob_up for r in mine]), np.array([r.y for r in mine])
        assert np.mean([r.p == r.y for r in mine]) > 0.7
        assert np.mean((prob - y) ** 2) < 0.2 and abs(prob.mean() - y.mean()) < 0.07
        order = np.argsort([r.margin for r in mine])
        assert np.all(np.diff(prob[order]) >= 0)


def test_optimality_tells_optimal_from_shifted_coefficients(spark):
    _, df = _rows(spark)
    fitted = margins.fit_whole(df, ["a", "b", "c"])
    good = {r.symbol: r for r in margins.optimality(df, fitted, ["a", "b", "c"]).collect()}
    assert {s: r.n_violated for s, r in good.items()} == {"A": 0, "B": 0, "C": 0} and good["C"].n == 4
    shifted = fitted.withColumn("coef", F.transform("coef", lambda v: v + 0.1))
    assert all(r.n_violated > 0 for r in margins.optimality(df, shifted, ["a", "b", "c"]).collect())
