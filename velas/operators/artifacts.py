"""Fitted models as tables: save, load, score new bars without fitting.

A model folder holds parquet tables keyed by symbol:

* ``prep``      fill means, training means and deviations of every feature;
* ``models``    (symbol, target, model, intercept, coef, converged): the linear
                family for price and volatility, logistic regression for
                direction;
* ``champions`` (symbol, target, model): the best of these on the hold-out.

``score`` reads them and applies them to a feature table.  It never fits: rows
of symbols that the folder does not know are left out of its result and
listed by ``unknown_symbols``; ``train_or_load`` fits them when asked to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velas.operators import linear, metrics, prep
from velas.operators.indicators import FEATURES
from velas.session import materialize

TARGETS = {"price": "next_close", "direction": "next_direction", "volatility": "next_volatility"}
LOGISTIC = "Logistic Regression"


def fit_prep(feat: DataFrame, features=FEATURES, test_size: float = prep.TEST_SIZE) -> DataFrame:
    """One row per symbol: fill means (all rows), means and deviations (training rows)."""
    flagged = prep.split_flags(feat.select("symbol", "rn", *features), test_size)
    fills = prep.fit_imputer(flagged, features)
    return fills.join(prep.fit_scaler(prep.apply_imputer(flagged, fills, features), features), "symbol")


def apply_prep(rows: DataFrame, fitted: DataFrame, features=FEATURES) -> DataFrame:
    fills = fitted.select("symbol", *[f"_fill_{f}" for f in features])
    scaler = fitted.select("symbol", *[f"_{k}_{f}" for f in features for k in ("mean", "sd")])
    return prep.apply_scaler(prep.apply_imputer(rows, fills, features), scaler, features)


def fit_models(feat: DataFrame, features=FEATURES) -> tuple[DataFrame, DataFrame]:
    """(models, prepared rows) of every symbol in a feature table."""
    prepared = prep.prepare_multi(feat, TARGETS, features)
    parts = []
    for target in TARGETS:
        labelled = prepared.withColumn("label", F.col(f"y_{target}"))
        fitted = (linear.fit_logistic(labelled, list(features)).withColumn("model", F.lit(LOGISTIC))
                  if target == "direction" else linear.fit_linear(labelled, list(features)))
        parts.append(fitted.select("symbol", F.lit(target).alias("target"), "model", "intercept", "coef", "converged"))
    return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2])), prepared


def apply_models(rows: DataFrame, models: DataFrame, features=FEATURES) -> DataFrame:
    """(symbol, rn, target, model, p, prob_up) for prepared rows and all their models."""
    x = F.array(*[F.col(f) for f in features])
    dot = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    up = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
    direction = F.col("target") == "direction"
    return (rows.join(models, "symbol").withColumn("_z", F.col("intercept") + dot)
            .select("symbol", "rn", "target", "model",
                    F.when(direction, (up > 0.5).cast("double")).otherwise(F.col("_z")).alias("p"),
                    F.when(direction, up).alias("prob_up")))


def holdout(prepared: DataFrame, models: DataFrame, features=FEATURES) -> DataFrame:
    """Predictions of the test rows with their labels ``y``."""
    test = prepared.where(~F.col("is_train"))
    labels = test.select("symbol", "rn", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"y_{t}").cast("double").alias("y")) for t in TARGETS])).alias("_l")
    ).select("symbol", "rn", "_l.*")
    return apply_models(test, models, features).join(labels, ["symbol", "rn", "target"])


def champions(pred: DataFrame) -> DataFrame:
    """(symbol, target, model) with the best hold-out metric."""
    spark = pred.sparkSession
    order = [(t, m, i) for t in ("price", "volatility") for i, m in enumerate(linear.LINEAR_MODELS)]
    long = metrics.metrics_long(metrics.regression_metrics(pred.where("target <> 'direction'")),
                                metrics.classification_metrics(pred.where("target = 'direction'")))
    best = metrics.best_model(long, spark.createDataFrame([*order, ("direction", LOGISTIC, 0)],
                                                          "target string, model string, model_ordinal int"))
    return best.select("symbol", "target", F.col("best_model").alias("model"))


def save(feat: DataFrame, folder: str, features=FEATURES, mode: str = "errorifexists") -> DataFrame:
    """Fit every symbol of ``feat`` and write the folder's tables; returns the
    hold-out predictions the champions were chosen by."""
    models, prepared = fit_models(feat, features)
    pred = materialize(holdout(prepared, models, features))
    fit_prep(feat, features).write.mode(mode).parquet(f"{folder}/prep")
    models.write.mode(mode).parquet(f"{folder}/models")
    champions(pred).write.mode(mode).parquet(f"{folder}/champions")
    return pred


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{t}") for t in ("prep", "models", "champions"))


def unknown_symbols(feat: DataFrame, folder: str) -> DataFrame:
    """Symbols of ``feat`` for which the folder has no model."""
    fitted, _, _ = load(feat.sparkSession, folder)
    return feat.select("symbol").distinct().join(fitted.select("symbol"), "symbol", "left_anti")


def score(feat: DataFrame, folder: str, features=FEATURES, only_champions: bool = False) -> DataFrame:
    """(symbol, rn, target, model, p, prob_up) from stored tables alone."""
    fitted, models, best = load(feat.sparkSession, folder)
    if only_champions:
        models = models.join(best, ["symbol", "target", "model"], "left_semi")
    rows = apply_prep(feat.select("symbol", "rn", *features), fitted, features)
    return apply_models(rows, models, features)


def train_or_load(feat: DataFrame, folder: str, features=FEATURES) -> DataFrame:
    """Champion scores of ``feat``; symbols the folder lacks are fitted and added first."""
    missing = unknown_symbols(feat, folder)
    if not missing.isEmpty():
        save(materialize(feat.join(missing, "symbol", "left_semi")), folder, features, mode="append")
    return score(feat, folder, features, only_champions=True)
