"""Registered queries for models, predictions, connectors and chart tables.

Model fits have no SQL oracle (rows-only check by the driver; numeric tests
in tests/); connectors and chart tables do (see ``velas.oracle``).
"""

from __future__ import annotations

import hashlib
import pkgutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.functions.rounding import F32, round_report
from velas.operators import artifacts, knn, ledger, linear, margins, metrics, mlzoo, predict, prep
from velas.operators.indicators import FEATURES
from velas.plans import catalog as C
from velas.session import materialize, scratch_path
from velas.sources import bars as bsrc
from velas.sources import files

TARGETS = C.TARGET_COLUMNS  # price/direction/volatility -> column
FEATS = list(FEATURES)


def _prepared(spark, sf, target_col):
    return prep.prepare(materialize(C._feat(spark, sf)), target_col)


def _model_query(name: str, target: str):
    classify = target == "direction"

    def q(spark, sf):
        out = mlzoo.fit_predict(_prepared(spark, sf, TARGETS[target]), name, FEATS, classify)
        return out.withColumns({"target": F.lit(target), "model": F.lit(name)})
    return q


def _shared_fit(prepared: DataFrame) -> DataFrame:
    """Hold-out predictions of the linear family and KNN for all targets (one
    prepared table and one neighbour search serve all three)."""
    labels = {f"y_{t}": t == "direction" for t in TARGETS}
    k = knn.knn_predict_multi(prepared, FEATS, labels)
    parts = [k.withColumn("target", F.substring(F.col("label"), 3, 100)).drop("label")
             .withColumn("model", F.lit("KNN"))]
    test = prepared.where(~F.col("is_train"))
    for target in ("price", "volatility"):
        coefs = linear.fit_linear(prepared.withColumn("label", F.col(f"y_{target}")), FEATS)
        lin = linear.predict_linear(test.select("symbol", "rn", F.col(f"y_{target}").alias("label"), *FEATS),
                                    coefs, FEATS).select(
            "symbol", "rn", F.col("label").cast("double").alias("y"), "p", "model",
            F.lit(None).cast("double").alias("prob_up"))
        parts.append(lin.withColumn("target", F.lit(target)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _single_fit(target: str, name: str):
    def fit(prepared: DataFrame) -> DataFrame:
        classify = target == "direction"
        out = mlzoo.fit_predict(prepared.withColumn("label", F.col(f"y_{target}")), name, FEATS, classify)
        if not classify:
            out = out.withColumn("prob_up", F.lit(None).cast("double"))
        return out.withColumns({"target": F.lit(target), "model": F.lit(name)})
    return fit


def _models_of(target: str):
    return mlzoo.CLASSIFICATION_MODELS if target == "direction" else mlzoo.REGRESSION_MODELS


#: every candidate in declared order (ties for the best model go to the earlier one)
MODEL_ORDER = [(t, m, i) for t in TARGETS for i, m in enumerate(_models_of(t))]


def candidate_fits(targets) -> list[ledger.Fit]:
    """All candidates of the targets; those of one pass together, the longest first."""
    shared = [(t, m) for t, m, _ in MODEL_ORDER
              if m == "KNN" or m in linear.LINEAR_MODELS and t != "direction"]
    singles = [(t, m) for t, m, _ in MODEL_ORDER if (t, m) not in shared and t in targets]
    singles.sort(key=lambda c: c[1] != "Random Forest")
    return [([c], _single_fit(*c)) for c in singles[:2]] + [(shared, _shared_fit)] + [([c], _single_fit(*c)) for c in singles[2:]]


def code_version() -> str:
    """Hash of the modules that the candidates' predictions depend on: another
    version of one starts another ledger."""
    parts = [pkgutil.get_data("velas.operators", f"{m}.py") for m in (
        "indicators", "targets", "prep", "linear", "knn", "margins", "trees", "mlzoo")]
    parts += [pkgutil.get_data("velas.plans", f"{m}.py") for m in ("features", "layout")]
    parts += [pkgutil.get_data("velas.functions", f"{m}.py") for m in ("ema", "windows")]
    return hashlib.sha256(b"\0".join(p or b"" for p in parts)).hexdigest()[:16]


def ledger_predictions(spark, sf, targets=tuple(TARGETS)) -> tuple[DataFrame, DataFrame]:
    """Hold-out predictions (long: symbol, rn, target, model, y, p, prob_up) of
    every candidate, from the ledger in the shared folder, and the feature
    table.  Candidates that the ledger has for the same rows are not fitted again."""
    feat = materialize(C._feat(spark, sf))
    prepared = materialize(prep.prepare_multi(feat, TARGETS))
    bars = feat.select("symbol", "date", "open", "high", "low", "close", "volume")
    pred = ledger.fit_absent(prepared, bars, candidate_fits(targets), scratch_path(spark, f"bakeoff-ledger-{code_version()}"))
    return pred.where(F.col("target").isin(*targets)), feat


def _metrics(pred: DataFrame) -> DataFrame:
    reg = metrics.regression_metrics(pred.where("target != 'direction'"))
    cls = metrics.classification_metrics(pred.where("target = 'direction'"))
    return metrics.metrics_long(reg, cls)


def q_predict_next_bar(spark, sf):
    pred, feat = ledger_predictions(spark, sf)
    order = spark.createDataFrame(MODEL_ORDER, "target string, model string, model_ordinal int")
    champs = metrics.best_model(_metrics(pred), order).select(
        "symbol", "target", F.col("best_model").alias("model"))
    latest = C.clean.latest_n(feat, 1).select("symbol", "rn", "date", "close")
    return predict.next_bar_record(predict.champion_predictions(pred, champs), latest)


def q_prediction_report(spark, sf):
    return predict.prediction_report(q_predict_next_bar(spark, sf))


def q_sink_predictions(spark, sf):
    rec = q_predict_next_bar(spark, sf).withColumn("run_date", F.current_date())
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    files.write_table(rec, path, partition_by=["run_date"], fmt="csv")
    return spark.read.option("header", True).csv(path)


def _bakeoff(spark, sf, targets):
    out, _ = ledger_predictions(spark, sf, targets)
    kinds = [metrics.regression_metrics(out.where("target != 'direction'"))
             if set(targets) - {"direction"} else None,
             metrics.classification_metrics(out.where("target = 'direction'")) if "direction" in targets else None]
    return round_report(metrics.metrics_long(*kinds), {"value": F32})


def q_model_bakeoff(spark, sf):
    """Every model of the family on every target: hold-out metrics, long form.
    All but the multilayer perceptron are fitted for all symbols at once."""
    return _bakeoff(spark, sf, list(TARGETS))


def q_bakeoff_price(spark, sf):
    return _bakeoff(spark, sf, ["price"])


def q_bakeoff_direction(spark, sf):
    return _bakeoff(spark, sf, ["direction"])


def q_bakeoff_volatility(spark, sf):
    return _bakeoff(spark, sf, ["volatility"])


def q_sink_features(spark, sf):
    """Write the feature table partitioned by symbol and read it back."""
    path = scratch_path(spark, f"features-{uuid.uuid4().hex}")
    files.write_table(C._feat(spark, sf), path, partition_by=["symbol"])
    return round_report(spark.read.parquet(path))


def q_scan_bars(spark, sf):
    """Round trip of the bars through per-symbol CSV files."""
    path = scratch_path(spark, f"bars-csv-{uuid.uuid4().hex}")
    files.write_bars_csv(bsrc.bars_from_orders(spark, sf), path)
    return round_report(files.scan_bars(spark, path))


def q_sink_metrics(spark, sf):
    pred, _ = ledger_predictions(spark, sf)
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    files.write_table(_metrics(pred), path, fmt="csv")
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def q_model_roundtrip(spark, sf):
    """Persist prep parameters and fitted coefficients, reload, re-score:
    the reloaded model must give the same predictions."""
    feat = materialize(C._feat(spark, sf))
    prepared = prep.prepare(feat, "next_close")
    coefs = materialize(linear.fit_linear(prepared, FEATS))  # fitted once, used and written
    base = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    files.write_table(coefs, f"{base}/coefficients", partition_by=["symbol"])
    files.write_table(prep.prep_params(feat), f"{base}/prep_params", partition_by=["symbol"])
    loaded = spark.read.parquet(f"{base}/coefficients")
    test = prepared.where(~F.col("is_train")).select("symbol", "rn", *FEATS)
    a = linear.predict_linear(test, coefs, FEATS).select("symbol", "rn", "model", F.col("p").alias("p_fit"))
    b = linear.predict_linear(test, loaded, FEATS).select("symbol", "rn", "model", F.col("p").alias("p_loaded"))
    same = F.abs(F.col("p_fit") - F.col("p_loaded")) <= F.lit(1e-9) * F.abs(F.col("p_fit"))
    return (a.join(b, ["symbol", "rn", "model"], "left").groupBy("symbol", "model")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(same.cast("long"), F.lit(0))).alias("n_same")))


def q_score_loaded(spark, sf):
    """Fit and store every symbol's models, score the feature table from the
    stored tables alone, and count the hold-out rows whose reloaded prediction
    equals the one made while fitting, per symbol, target and model."""
    feat = materialize(C._feat(spark, sf))
    folder = scratch_path(spark, f"model-folder-{uuid.uuid4().hex}")
    fitted = artifacts.save(feat, folder)
    loaded = artifacts.score(feat, folder).withColumnRenamed("p", "q")
    same = F.abs(F.col("p") - F.col("q")) <= F.lit(1e-9) * F.greatest(F.abs(F.col("p")), F.lit(1.0))
    return (fitted.join(loaded.select("symbol", "rn", "target", "model", "q"), ["symbol", "rn", "target", "model"], "left")
            .groupBy("symbol", "target", "model")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(same.cast("long"), F.lit(0))).alias("n_same")))


def q_next_bar_job(spark, sf):
    """The whole job: bars, features, models fitted or loaded, champions,
    next-bar record and report (every series' latest row)."""
    feat = materialize(C._feat(spark, sf))
    folder = scratch_path(spark, f"model-folder-{uuid.uuid4().hex}")
    artifacts.save(feat, folder)
    latest = C.clean.latest_n(feat, 1)
    scored = artifacts.train_or_load(latest, folder)
    return predict.prediction_report(predict.next_bar_record(
        scored, latest.select("symbol", "rn", "date", "close")))


def q_fit_optimality(spark, sf):
    """Optimality conditions of the linear family (price) and logistic
    regression (direction), recomputed from all training rows."""
    prepared = materialize(prep.prepare_multi(materialize(C._feat(spark, sf)), TARGETS))
    price = prepared.withColumn("label", F.col("y_price"))
    direction = prepared.withColumn("label", F.col("y_direction"))
    logistic = materialize(linear.fit_logistic(direction, FEATS)).withColumn("model", F.lit("Logistic Regression"))
    return linear.optimality(price, materialize(linear.fit_linear(price, FEATS)), FEATS).unionByName(
        linear.optimality(direction, logistic, FEATS))


def q_margin_optimality(spark, sf):
    """Optimality conditions of the margin classifier (direction) on the scaled
    features, recomputed from all training rows."""
    prepared = materialize(prep.prepare(materialize(C._feat(spark, sf)), "next_direction"))
    return margins.optimality(prepared, materialize(margins.fit_whole(prepared, FEATS)), FEATS)


def q_bakeoff_coverage(spark, sf):
    """Hold-out rows and finite predictions of every candidate in the ledger."""
    pred, _ = ledger_predictions(spark, sf)
    finite = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") < float("inf"))
    return pred.groupBy("symbol", "target", "model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rn").alias("n_rows"), F.sum(finite.cast("long")).alias("n_finite"))


def q_parse_event_props(spark, sf):
    ev = bsrc.read_table(spark, sf, "events")
    return ev.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def q_epoch_to_date(spark, sf):
    ev = bsrc.read_table(spark, sf, "events")
    secs = files.ntz_to_epoch(F.col("ts"))
    return ev.select("event_id", secs.alias("epoch"), files.epoch_to_date(secs).alias("date"))


def q_chart_price_history(spark, sf):
    return round_report(predict.chart_price_history(C._feat(spark, sf, "analysis")))


def q_chart_indicators(spark, sf):
    return round_report(predict.chart_indicators(C._feat(spark, sf, "analysis")), {"value": F32})


def q_union_symbols(spark, sf):
    """The series of all symbols as one bar table, from one scan."""
    return round_report(bsrc.union_symbols([C._bars(spark, sf)]))


def _backtest_window(feat, prepared):
    """(rows, labels, KNN predictions) of the backtest window."""
    from velas.operators import backtest
    window = backtest.backtest_rows(feat).select("symbol", "rn", "in_sample")
    rows = materialize(prepared.join(window, ["symbol", "rn"]))
    # the window's rows as queries of the neighbour search, the training rows as neighbours
    asked = prepared.where("is_train").unionByName(rows.drop("in_sample").withColumn("is_train", F.lit(False)))
    near = knn.knn_predict_multi(asked, FEATS, {f"y_{t}": t == "direction" for t in TARGETS}).select(
        "symbol", "rn", F.substring("label", 3, 100).alias("target"), F.lit("KNN").alias("model"), "p", "prob_up")
    labels = rows.select("symbol", "rn", "in_sample", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"y_{t}").cast("double").alias("y")) for t in TARGETS])).alias("_l")
    ).select("symbol", "rn", "in_sample", "_l.*")
    return rows, labels, near


def q_backtest_models(spark, sf):
    """M21 with fitted models: the last 60 bars of every series scored for
    price, direction and volatility by the linear family, logistic regression
    (fitted on the chronological training split) and KNN (training rows as
    neighbours); actuals from the next bar; ``in_sample`` marks bars that were
    also training rows."""
    feat = materialize(C._feat(spark, sf))
    models, prepared = artifacts.fit_models(feat)
    rows, labels, near = _backtest_window(feat, prepared)
    pred = artifacts.apply_models(rows, models).unionByName(near).join(labels, ["symbol", "rn", "target"])
    return pred.select("symbol", "rn", "in_sample", "model", "target", "y", "p")


def q_backtest_summary_knn(spark, sf):
    """A12 for KNN on all three targets."""
    from velas.operators import backtest
    feat = materialize(C._feat(spark, sf))
    _, labels, near = _backtest_window(feat, prep.prepare_multi(feat, TARGETS))
    pred = near.join(labels, ["symbol", "rn", "target"])
    return round_report(backtest.backtest_summary(pred), C.BACKTEST_SCALES)


MODEL_QUERIES = {
    "union_symbols": q_union_symbols,
    "backtest_models": q_backtest_models,
    "backtest_summary_knn": q_backtest_summary_knn,
    "backtest_persistence": C.q_backtest_pairs,
    "ols_predict": _model_query("Linear Regression", "price"),
    "ridge_predict": _model_query("Ridge Regression", "price"),
    "lasso_predict": _model_query("Lasso Regression", "price"),
    "elastic_predict": _model_query("ElasticNet", "price"),
    "rf_regress": _model_query("Random Forest", "volatility"),
    "gbt_regress": _model_query("Gradient Boosting", "volatility"),
    "xgb_like_regress": _model_query("XGBoost", "volatility"),
    "rff_regress": _model_query("SVR", "price"),
    "logistic_predict": _model_query("Logistic Regression", "direction"),
    "rf_classify": _model_query("Random Forest", "direction"),
    "gbt_classify": _model_query("Gradient Boosting", "direction"),
    "xgb_like_classify": _model_query("XGBoost", "direction"),
    "rff_svc": _model_query("SVC", "direction"),
    "mlp_classify": _model_query("MLP", "direction"),
    "fit_optimality": q_fit_optimality,
    "margin_optimality": q_margin_optimality,
    "model_bakeoff": q_model_bakeoff,
    "bakeoff_coverage": q_bakeoff_coverage,
    "bakeoff_price": q_bakeoff_price,
    "bakeoff_direction": q_bakeoff_direction,
    "bakeoff_volatility": q_bakeoff_volatility,
    "predict_next_bar": q_predict_next_bar,
    "prediction_report": q_prediction_report,
    "sink_predictions": q_sink_predictions,
    "sink_features": q_sink_features,
    "scan_bars": q_scan_bars,
    "sink_metrics": q_sink_metrics,
    "model_roundtrip": q_model_roundtrip,
    "score_loaded": q_score_loaded,
    "next_bar_job": q_next_bar_job,
    "parse_event_props": q_parse_event_props,
    "epoch_to_date": q_epoch_to_date,
    "chart_price_history": q_chart_price_history,
    "chart_indicators": q_chart_indicators,
}
