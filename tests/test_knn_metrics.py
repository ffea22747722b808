"""Exact KNN against brute force, and metric definitions on known inputs."""

import numpy as np
import pytest

from velas.operators import knn, metrics


def _prepared(spark, n_train, n_test, d, seed, clustered=False):
    rng = np.random.default_rng(seed)
    rows = []
    for sym in ("A", "B"):
        xs = rng.normal(0, 1, (n_train + n_test, d))
        if clustered:
            xs[: n_train // 2] += 8.0  # a far cluster leaves sparse buckets
        labels = rng.normal(0, 1, n_train + n_test)
        for i in range(n_train + n_test):
            rows.append((sym, i, i < n_train, float(labels[i]), *map(float, xs[i])))
    cols = [f"f{j}" for j in range(d)]
    schema = "symbol string, rn long, is_train boolean, label double, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema), cols, rows


def _brute(rows, d, k=5):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for sym, rs in by.items():
        train = [r for r in rs if r[2]]
        for q in (r for r in rs if not r[2]):
            qa = np.array(q[4:])
            ds = sorted((float(np.sqrt(((qa - np.array(t[4:])) ** 2).sum())), t[1], t[3]) for t in train)
            out[(sym, q[1])] = float(np.mean([x[2] for x in ds[:k]]))
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_knn_is_exact(spark, clustered):
    df, cols, rows = _prepared(spark, 300, 60, 6, seed=2, clustered=clustered)
    got = {(r.symbol, r.rn): r.p for r in knn.knn_predict(df, cols).collect()}
    want = _brute(rows, 6)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)


def test_classification_report(spark):
    y = [1, 1, 1, 0, 0, 1, 0, 1]
    p = [1, 0, 1, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([("S", "direction", "m", float(a), float(b)) for a, b in zip(y, p)],
                               "symbol string, target string, model string, y double, p double")
    rep = metrics.classification_report(df).collect()[0]
    # class 1: tp=4 fp=1 fn=1 ; class 0: tp=2 fp=1 fn=1
    assert rep.precision_1 == pytest.approx(0.8) and rep.recall_1 == pytest.approx(0.8)
    assert rep.precision_0 == pytest.approx(2 / 3) and rep.recall_0 == pytest.approx(2 / 3)
    assert rep.accuracy == pytest.approx(6 / 8)
    assert rep.weighted_f1 == pytest.approx((0.8 * 5 + (2 / 3) * 3) / 8)
    cm = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 4}


def test_regression_metrics(spark):
    y = np.array([1.0, 2.0, 3.0, 4.0])
    p = np.array([1.5, 1.5, 3.5, 3.0])
    df = spark.createDataFrame([("S", "price", "m", float(a), float(b)) for a, b in zip(y, p)],
                               "symbol string, target string, model string, y double, p double")
    r = metrics.regression_metrics(df).collect()[0]
    assert r.mse == pytest.approx(np.mean((y - p) ** 2))
    assert r.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert r.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r.mae ** 2 <= r.mse


def test_best_model_ties_go_to_declared_order(spark):
    m = spark.createDataFrame(
        [("S", "direction", "A", "accuracy", 0.6), ("S", "direction", "B", "accuracy", 0.6),
         ("S", "price", "A", "mse", 2.0), ("S", "price", "B", "mse", 1.0)],
        "symbol string, target string, model string, metric string, value double")
    order = spark.createDataFrame([("direction", "B", 0), ("direction", "A", 1), ("price", "A", 0),
                                   ("price", "B", 1)], "target string, model string, model_ordinal int")
    best = {r.target: r.best_model for r in metrics.best_model(m, order).collect()}
    assert best == {"direction": "B", "price": "B"}


def test_neighbours_reject_most_rows_and_keep_ties(spark):
    """Rows near a plane in eight dimensions: the distances taken for a test row
    grow far slower than the training rows; equal rows go to the earlier one."""
    rng = np.random.default_rng(5)
    plane = rng.normal(0, 1, (2, 8))
    taken = {}
    for n in (1500, 6000):
        xs = rng.normal(0, 1, (n + 100, 2)) @ plane + rng.normal(0, 0.01, (n + 100, 8))
        xs[n // 2: n // 2 + 10] = xs[0]  # ties
        xs[n] = xs[0]
        rows = [("A", i, i < n, float(i), *map(float, x)) for i, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "symbol string, rn long, is_train boolean, label double, "
                                   + ", ".join(f"f{j} double" for j in range(8)))
        found = knn.neighbours(df, [f"f{j}" for j in range(8)]).collect()
        assert len(found) == 500
        got = {}
        for r in found:
            got.setdefault(r.rn, []).append((r.nn_rank, r.t_rn))
        for q, near in got.items():
            dist = np.sqrt(((xs[:n] - xs[q]) ** 2).sum(axis=1))
            assert [t for _, t in sorted(near)] == np.lexsort((np.arange(n), dist))[:5].tolist()
        taken[n] = np.mean([r.n_compared for r in found])
    assert taken[1500] < 1500 / 5 and taken[6000] < 2 * taken[1500]


def test_few_training_rows_give_all_of_them(spark):
    df = spark.createDataFrame([("A", i, i < 3, float(i), float(i), 1.0) for i in range(5)],
                               "symbol string, rn long, is_train boolean, label double, a double, b double")
    found = knn.neighbours(df, ["a", "b"]).collect()
    assert sorted((r.rn, r.t_rn) for r in found) == [(q, t) for q in (3, 4) for t in range(3)]


def test_cells_out_of_reach_give_no_rows():
    import pandas as pd
    pair = {"symbol": "A", "slab": 1, "part": 0, "rn": [7], "x": [0.0, 0.0], "g": [0.0] * 10, "labels": [1.0], "radius": [0.5],
            "low": [9.0] * 10, "high": [9.0] * 10, "t_rn": [1], "t_x": [9.0, 9.0], "t_g": [9.0] * 10, "t_label": [2.0]}
    measure = knn._measure_pairs(1, 2, 1, knn._Block.found)
    assert list(measure(iter([pd.DataFrame([pair])]))) == []
    near = [f for f in measure(iter([pd.DataFrame([{**pair, "radius": [99.0]}])]))]
    assert len(near) == 1 and near[0]["dist"].tolist() == [np.sqrt(162.0)]
