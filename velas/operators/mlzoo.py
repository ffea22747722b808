"""Model family for next price, direction and volatility.

* Linear family (OLS, ridge, lasso, elastic net): grouped sufficient
  statistics, any number of symbols in one pass (``velas.operators.linear``).
* KNN: relational, exact (``velas.operators.knn``).
* Logistic regression: grouped Newton iterations, all symbols at once
  (``velas.operators.linear.fit_logistic``).
* Forests, first- and second-order boosting: grouped histogram trees, all
  symbols at once (``velas.operators.trees``).
* Multilayer perceptron: a ``pyspark.ml`` estimator fitted per symbol; the
  symbols are submitted concurrently from a small thread pool.
* Kernel SVM: re-aimed as random Fourier features (Rahimi & Recht, 2007) of
  the RBF kernel, computed by an Arrow-batched pandas UDF, followed by the
  grouped ridge (SVR) or the margin classifier with calibrated probabilities
  (SVC, ``velas.operators.margins``) - an approximation by design, fitted for
  all symbols at once.

Prepared rows: symbol, rn, idx, is_train, label, scaled feature columns.
Prediction rows: symbol, rn, y, p (+ prob_up for classifiers).
"""

from __future__ import annotations

import functools
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.operators import knn, linear, margins, trees
from velas.session import scratch_path

SEED = 42
RFF_DIM = 256
FIT_THREADS = 8

TREE_MODELS = ("Random Forest", "Gradient Boosting", "XGBoost")

# Declared model order per target (ties go to the earlier one).
REGRESSION_MODELS = ("Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet",
                     "Random Forest", "Gradient Boosting", "SVR", "KNN", "XGBoost")
CLASSIFICATION_MODELS = ("Logistic Regression", "Random Forest", "Gradient Boosting", "SVC", "KNN",
                         "MLP", "XGBoost")


def rff_weights(d: int, dim: int = RFF_DIM, seed: int = SEED):
    """Random Fourier features of exp(-gamma ||x - y||^2), gamma = 1/d
    (unit-variance features)."""
    rng = np.random.default_rng(seed)
    gamma = 1.0 / d
    w = rng.normal(0.0, math.sqrt(2 * gamma), (dim, d))
    b = rng.uniform(0, 2 * math.pi, dim)
    return w, b


def add_rff(df: DataFrame, features, dim: int = RFF_DIM) -> DataFrame:
    """Append ``z`` = random Fourier features (Arrow-batched pandas UDF).

    gamma counts the features a symbol uses; those left out are 0 on all its rows."""
    w, b = rff_weights(len(features), dim)
    scale = math.sqrt(2.0 / dim)

    @F.pandas_udf("array<double>")
    def rff(x: pd.Series) -> pd.Series:
        m = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, w.shape[1]))
        z = scale * np.cos(m @ w.T + b)
        return pd.Series(list(z))

    used = df.groupBy("symbol").agg(*[F.max(F.abs(F.col(f)) > 0).cast("int").alias(f"_u_{f}") for f in features])
    total = sum((F.col(f"_u_{f}") for f in features[1:]), F.col(f"_u_{features[0]}"))
    stretch = used.select("symbol", F.sqrt(F.lit(float(len(features))) / F.greatest(total, F.lit(1))).alias("_stretch"))
    return (df.join(stretch, "symbol")
            .withColumn("z", rff(F.array(*[F.col(f) * F.col("_stretch") for f in features]))).drop("_stretch"))


def _vectors(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def _fit_mlp(prepared: DataFrame, symbol: str, features) -> DataFrame:
    """Hold-out predictions of one symbol's multilayer perceptron."""
    rows = _vectors(prepared.where(F.col("symbol") == symbol), features)
    est = MultilayerPerceptronClassifier(layers=[len(features), 100, 50, 2], maxIter=500, seed=SEED, labelCol="label_d")
    model = est.fit(rows.where("is_train").withColumn("label_d", F.col("label").cast("double")))
    return model.transform(rows.where(~F.col("is_train"))).select(
        "symbol", "rn", F.col("label").cast("double").alias("y"), F.col("prediction").alias("p"),
        F.element_at(vector_to_array("probability"), 2).alias("prob_up"))


def by_symbol(prepared: DataFrame) -> DataFrame:
    """The prepared rows written once, a folder per symbol: each per-symbol fit
    then reads its own files.  Rebalancing cuts a large symbol into several
    files by size and keeps a small one whole."""
    spark = prepared.sparkSession
    path = scratch_path(spark, f"by-symbol-{uuid.uuid4().hex}")
    prepared.hint("rebalance", "symbol").write.partitionBy("symbol").parquet(path)
    return spark.read.schema(prepared.schema).parquet(path)


def symbols_of(prepared: DataFrame) -> list[str]:
    return sorted(r[0] for r in prepared.select("symbol").distinct().collect())


def fit_predict(prepared: DataFrame, name: str, features, classify: bool) -> DataFrame:
    """Hold-out predictions of model ``name`` for every symbol."""
    if name in linear.LINEAR_MODELS and not classify:
        coefs = linear.fit_linear(prepared, features, models=(name,))
        test = prepared.where(~F.col("is_train")).select("symbol", "rn", "label", *features)
        return linear.predict_linear(test, coefs, features).select(
            "symbol", "rn", F.col("label").cast("double").alias("y"), "p")
    if name in ("SVR", "SVC"):
        # kernel machines re-aimed: random Fourier features of the RBF kernel,
        # then ridge regression / the squared-hinge margin classifier, grouped by symbol
        z = add_rff(prepared.select("symbol", "rn", "idx", "is_train", "label", *features), features)
        zf = ("z", RFF_DIM)
        test = z.where(~F.col("is_train")).select("symbol", "rn", "label", "z")
        if classify:
            return margins.predict(z, zf).drop("margin")
        coefs = linear.fit_linear(z, zf, models=("Ridge Regression",))
        return linear.predict_linear(test, coefs, zf).select(
            "symbol", "rn", F.col("label").cast("double").alias("y"), "p")
    if name == "Logistic Regression" and classify:
        coefs = linear.fit_logistic(prepared, features)
        test = prepared.where(~F.col("is_train")).select("symbol", "rn", "label", *features)
        return linear.predict_logistic(test, coefs, features).select(
            "symbol", "rn", F.col("label").cast("double").alias("y"), "p", "prob_up")
    if name == "KNN":
        out = knn.knn_predict(prepared, list(features), classify=classify)
        return out
    if name in TREE_MODELS:
        return trees.fit_predict_trees(prepared, name, features, classify)
    if name != "MLP" or not classify:
        raise KeyError(name)
    prepared = by_symbol(prepared)
    with ThreadPoolExecutor(max_workers=FIT_THREADS) as pool:
        parts = list(pool.map(lambda s: _fit_mlp(prepared, s, features), symbols_of(prepared)))
    return functools.reduce(DataFrame.unionByName, parts)
