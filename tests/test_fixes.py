"""Short series, flat series, one-class labels, file layouts, stored models."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from velas.operators import artifacts, knn, linear, metrics, mlzoo, prep, stats
from velas.operators.indicators import FEATURES
from velas.plans import features as fplan
from velas.session import materialize
from velas.sources import files

FEATS = list(FEATURES)


@pytest.fixture(scope="module")
def short(spark):
    """Two series of 163 bars: MA200 has no value anywhere."""
    rng = np.random.default_rng(4)
    rows = []
    for s in ("AAA", "BBB"):
        price = 100.0
        for i in range(163):
            o, price = price, price * (1 + 0.01 * rng.standard_normal())
            hi, lo = max(o, price) * 1.005, min(o, price) * 0.995
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), o, hi, lo, price, float(rng.integers(1000, 9000))))
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, "
                                       "close double, volume double")
    return materialize(fplan.features(bars))


def test_every_grouped_model_predicts_every_holdout_row(short):
    prepared = prep.prepare(short, "next_close")
    n_test = prepared.where("not is_train").count()
    assert prepared.where("ma200 <> 0 or ma200 is null").count() == 0
    assert knn.knn_predict(prepared, FEATS).where("p is not null").count() == n_test
    coefs = materialize(linear.fit_linear(prepared, FEATS))
    assert coefs.where("not converged").count() == 0
    got = linear.predict_linear(prepared.where("not is_train"), coefs, FEATS)
    assert got.where("p is not null and not isnan(p)").count() == 4 * n_test
    assert mlzoo.fit_predict(prepared, "SVR", FEATS, False).where("p is not null").count() == n_test
    direction = prep.prepare(short, "next_direction")
    assert mlzoo.fit_predict(direction, "Logistic Regression", FEATS, True).where("p is not null").count() == n_test
    assert mlzoo.fit_predict(direction, "Random Forest", FEATS, True).where("p is not null").count() == n_test


def test_left_out_feature_equals_its_absence(short):
    rest = [f for f in FEATS if f != "ma200"]
    prepared = prep.prepare(short, "next_close")
    for model in linear.LINEAR_MODELS:
        a, b = ({(r.symbol, r.rn): r.p for r in linear.predict_linear(
            prepared.where("not is_train"), materialize(linear.fit_linear(prepared, fs, models=(model,))), fs).collect()}
            for fs in (FEATS, rest))
        assert a.keys() == b.keys()
        assert all(math.isclose(a[k], b[k], rel_tol=1e-5) for k in a)


def test_usable_features(short):
    fills = prep.fit_imputer(prep.split_flags(short.select("symbol", "rn", *FEATS)))
    for r in prep.usable_features(fills).collect():
        assert "ma200" not in r.usable and r.n_usable == len(FEATS) - 1
        assert r.usable == [f for f in FEATS if f != "ma200"]


def test_one_class_symbol_is_constant(spark):
    rows = [("one", i, i, True, 1, float(i), float(i % 3)) for i in range(20)] + [
        ("two", i, i, True, int(i > 9), float(i % 7), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, rn long, idx long, is_train boolean, label int, a double, b double")
    coefs = materialize(linear.fit_logistic(df, ["a", "b"]))
    assert all(r.converged for r in coefs.collect())
    got = linear.predict_logistic(df, coefs, ["a", "b"])
    assert {r.p for r in got.where("symbol = 'one'").collect()} == {1.0}
    assert {r.p for r in got.where("symbol = 'two'").collect()} == {0.0, 1.0}


def test_flat_series(spark):
    rows = [("flat", 0.0)] * 30 + [("live", x / 10) for x in range(30)]
    df = spark.createDataFrame(rows, "symbol string, daily_return double")
    hist = stats.return_histogram(df).groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    assert {r.symbol: r.n for r in hist} == {"flat": 30, "live": 30}
    density = stats.return_density(df).groupBy("symbol").agg(F.count("density").alias("n")).collect()
    assert {r.symbol: r.n for r in density} == {"flat": 0, "live": stats.DENSITY_GRID}


def test_bar_files_of_both_layouts(spark, tmp_path):
    for s in ("AAA", "B.C"):
        (tmp_path / f"{s}_historical.csv").write_text(
            "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,n/a,2,1,1.5,7\n")
    for _ in range(3):
        got = files.scan_bars(spark, str(tmp_path), layout="files").collect()
    assert sorted((r.symbol, r.date.day, r.open) for r in got if r.date.day == 2) == [("AAA", 2, 1.0), ("B.C", 2, 1.0)]
    assert all(r.open is None for r in got if r.date.day == 3)
    assert {r.symbol for r in files.scan_bars(spark, str(tmp_path), ["AAA"], layout="files").collect()} == {"AAA"}
    out = str(tmp_path / "folders")
    files.write_bars_csv(files.scan_bars(spark, str(tmp_path / "*.csv"), layout="files"), out)
    n = len(files.BARS_CSV_SCHEMA.fields)
    for _ in range(3):
        assert files.scan_bars(spark, out).count() == 4
    assert len(files.BARS_CSV_SCHEMA.fields) == n


def test_unlisted_model_is_ranked(spark):
    m = spark.createDataFrame([("s", "price", "listed", "mse", 2.0), ("s", "price", "new", "mse", 1.0)],
                              "symbol string, target string, model string, metric string, value double")
    order = spark.createDataFrame([("price", "listed", 0)], "target string, model string, model_ordinal int")
    assert metrics.best_model(m, order).first()["best_model"] == "new"
    assert metrics.rank_models(m, order).count() == 2


def test_indicator_queries_are_lazy_and_pruned(spark):
    from velas.plans import catalog
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = catalog.q_roc(spark, "/root/testdata/sf0.001")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) <= len(seen) + 1  # the parquet footer
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan and "collect_list" not in plan
    assert plan.count("Window [") <= 4


def test_model_folder(short, tmp_path):
    folder = str(tmp_path / "models")
    a = materialize(short.where("symbol = 'AAA'"))
    fitted = {(r.symbol, r.rn, r.target, r.model): r.p for r in artifacts.save(a, folder).collect()}
    assert [r.symbol for r in artifacts.unknown_symbols(short, folder).collect()] == ["BBB"]
    scored = artifacts.score(short, folder).collect()
    assert {r.symbol for r in scored} == {"AAA"}
    again = {(r.symbol, r.rn, r.target, r.model): r.p for r in scored}
    assert all(math.isclose(p, again[k], rel_tol=1e-9, abs_tol=1e-9) for k, p in fitted.items())
    both = artifacts.train_or_load(short, folder)
    n = {(r.symbol, r.target): r["count"] for r in both.groupBy("symbol", "target").count().collect()}
    assert n == {(s, t): short.where(F.col("symbol") == s).count() for s in ("AAA", "BBB") for t in artifacts.TARGETS}
    assert artifacts.unknown_symbols(short, folder).isEmpty()


@pytest.mark.skipif("VELAS_BAR_FILES" not in os.environ, reason="set VELAS_BAR_FILES to a folder of bar CSVs")
def test_published_quality(spark):
    bars = files.scan_bars(spark, os.environ["VELAS_BAR_FILES"], layout="files")
    feat = materialize(fplan.features(bars, variant="analysis"))
    prepared = prep.prepare(feat, "next_close")
    coefs = materialize(linear.fit_linear(prepared, FEATS))
    pred = linear.predict_linear(prepared.where("not is_train"), coefs, FEATS).select(
        "symbol", "model", F.col("label").alias("y"), "p").union(
        knn.knn_predict(prepared, FEATS).select("symbol", F.lit("KNN"), "y", "p"))
    mse = {(r.symbol, r.model): r.m for r in pred.groupBy("symbol", "model").agg(
        F.avg((F.col("y") - F.col("p")) ** 2).alias("m")).collect()}
    want = {"Linear Regression": 210.0982, "Ridge Regression": 105.2675, "KNN": 1141.7347}
    for model, value in want.items():
        assert mse["JNJ", model] == pytest.approx(value, abs=1e-3)
