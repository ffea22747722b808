"""Forests and boosted trees against plain-Python searches, and both ways of growing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from velas.operators import trees as T

FEATS = ["a", "b", "c"]


def frame(spark, n=120, symbols=("S", "T"), classify=False, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        x = rng.normal(size=(n, 3)).round(1)
        x[:, 2] = 0.0  # a feature without values
        y = 2 * (x[:, 0] > 0.3) + x[:, 1] ** 2 + rng.normal(size=n) * 0.05
        y = (y > np.median(y)).astype(float) if classify else y
        rows += [(s, i, bool(i < 0.8 * n), float(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, rn long, is_train boolean, label double, a double, b double, c double")


def brute_split(x, a, g, l2, least):
    """Best (feature, threshold) over all distinct values, ties to the first."""
    best = None
    for f in range(x.shape[1]):
        for t in sorted(set(x[:, f]))[:-1]:
            left = x[:, f] <= t
            if min(a[left].sum(), a[~left].sum()) < least:
                continue
            gain = sum(g[m].sum() ** 2 / (a[m].sum() + l2) for m in (left, ~left)) - g.sum() ** 2 / (a.sum() + l2)
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, t
    return best


@pytest.mark.parametrize("name,classify", [("Gradient Boosting", False), ("Gradient Boosting", True), ("XGBoost", False),
                                           ("XGBoost", True), ("Random Forest", False)])
def test_first_split_equals_brute_force(spark, name, classify):
    df = frame(spark, n=60, classify=classify)
    kind = T.kind_of(name, classify)
    nodes = T.fit_trees(df, FEATS, kind).where("tree <= 0").toPandas()
    for s, g in df.where("is_train").toPandas().groupby("symbol"):
        g = g.sort_values("rn")
        x, y = g[FEATS].to_numpy(), g["label"].to_numpy()
        if kind.boosted:
            stats = T.boost_stats(y, np.full(len(y), T.start_margin(y.mean(), kind)), kind)
        else:
            stats = T.forest_stats(y, g["rn"].to_numpy(), 0)
        root = nodes[(nodes.symbol == s) & (nodes.tree == 0) & (nodes.node == 0)].iloc[0]
        _, f, t = brute_split(x, stats[:, 0], stats[:, 1], kind.l2, kind.least)
        # bagged rows may leave a gap: thresholds in one gap give one split
        assert root.feature == f
        used = stats[:, 0] > 0
        assert ((x[used, f] <= root.threshold) == (x[used, f] <= t)).all()
        start = nodes[(nodes.symbol == s) & (nodes.tree == -1)].iloc[0]
        assert start.value == pytest.approx(T.start_margin(y.mean(), kind))


def plain_boost(x, y, asked, kind):
    """Boosting by recursion over all distinct values, one node at a time."""
    def tree(rows, stats, depth):
        s = stats[rows]
        found = brute_split(x[rows], s[:, 0], s[:, 1], kind.l2, kind.least) if depth and len(rows) > 1 else None
        if found is None or found[0] <= 1e-10 * max(s[:, 1].sum() ** 2 / (s[:, 0].sum() + kind.l2), 1e-300):
            return s[:, 1].sum() / (s[:, 2].sum() + kind.l2)
        _, f, t = found
        left = x[rows][:, f] <= t
        return f, t, tree(rows[left], stats, depth - 1), tree(rows[~left], stats, depth - 1)

    def value(node, r):
        while isinstance(node, tuple):
            node = node[2] if r[node[0]] <= node[1] else node[3]
        return node

    margin = np.full(len(y), T.start_margin(y.mean(), kind))
    out = np.full(len(asked), margin[0])
    for _ in range(kind.trees):
        grown = tree(np.arange(len(y)), T.boost_stats(y, margin, kind), kind.depth)
        margin += kind.rate * np.array([value(grown, r) for r in x])
        out += kind.rate * np.array([value(grown, r) for r in asked])
    return out


@pytest.mark.parametrize("name", ["Gradient Boosting", "XGBoost"])
@pytest.mark.parametrize("classify", [False, True])
def test_boosting_equals_plain_python(spark, name, classify):
    import dataclasses
    df = frame(spark, n=50, symbols=("S",), classify=classify, seed=4)
    kind = dataclasses.replace(T.kind_of(name, classify), trees=8)
    got = T.predict_trees(df.where("not is_train"), T.fit_trees(df, FEATS, kind), FEATS, kind).toPandas().sort_values("rn")
    pdf = df.toPandas().sort_values("rn")
    train, test = pdf[pdf.is_train], pdf[~pdf.is_train]
    want = plain_boost(train[FEATS].to_numpy(), train.label.to_numpy(), test[FEATS].to_numpy(), kind)
    np.testing.assert_allclose(got.prob_up if classify else got.p, 1 / (1 + np.exp(-want)) if classify else want, rtol=1e-6)


@pytest.mark.parametrize("name,classify", [("Random Forest", False), ("Random Forest", True), ("XGBoost", True)])
def test_levels_over_chunks_equal_one_task(spark, name, classify):
    """A symbol above the limit is grown level by level over chunks, its forest's
    small nodes in one task each, with the same predictions."""
    import dataclasses
    df = frame(spark, classify=classify, seed=2)
    kind = dataclasses.replace(T.kind_of(name, classify), trees=3, depth=4)
    test = df.where("not is_train")
    one = T.predict_trees(test, T.fit_trees(df, FEATS, kind), FEATS, kind)
    many = T.predict_trees(test, T.fit_trees(df, FEATS, kind, local_rows=40, chunk_rows=16), FEATS, kind, chunk_rows=7)
    key = ["symbol", "rn"]
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (one, many))
    assert len(a) == test.count() and (a[key] == b[key]).all().all()
    np.testing.assert_allclose(a["prob_up" if classify else "p"], b["prob_up" if classify else "p"], rtol=1e-9)


def test_quality_constant_label_and_one_row(spark):
    df = frame(spark, n=400, symbols=("S",))
    for name in ("Random Forest", "Gradient Boosting", "XGBoost"):
        p = T.fit_predict_trees(df, name, FEATS, False).toPandas()
        assert ((p.y - p.p) ** 2).mean() < 0.15 * p.y.var()
    flat = df.withColumn("label", F.lit(3.0)).where("rn < 3 or rn >= 396")
    for name in ("Random Forest", "Gradient Boosting", "XGBoost"):
        p = T.fit_predict_trees(flat, name, FEATS, False).toPandas()
        assert len(p) == 4 and np.allclose(p.p, 3.0, atol=0.5 if name == "XGBoost" else 1e-9 if name != "Random Forest" else 3.0)


def test_bags_are_poisson_and_stable():
    w = T.bag_weights(3, np.arange(200_000))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert (w[1000:2000] == T.bag_weights(3, np.arange(1000, 2000))).all()
    assert (w != T.bag_weights(4, np.arange(200_000))).any()
