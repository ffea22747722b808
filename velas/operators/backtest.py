"""Backtest over the last bars of every series.

Scoring row i with the actuals of row i+1 needs no self-join: the feature
table already carries next_close / next_direction / next_volatility, which
for every row but the series' last are the next row's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.operators import metrics
from velas.operators.prep import split_flags

WINDOW = 60  # fixed value: bars in the backtest window


def backtest_rows(feat: DataFrame, window: int = WINDOW) -> DataFrame:
    """The first window-1 of the last ``window`` rows (the last has no
    actual), with ``in_sample`` = the row was in the chronological training
    split of the same table."""
    flagged = split_flags(feat)
    return (flagged.where((F.col("idx") >= F.col("n") - window) & (F.col("idx") < F.col("n") - 1))
            .withColumn("in_sample", F.col("is_train")).drop("is_train"))


def persistence_predictions(rows: DataFrame) -> DataFrame:
    """Baseline 'next bar = this bar': price = close, direction = sign of the
    last move, volatility = current volatility.  Long prediction table."""
    base = ["symbol", "rn", "date", "in_sample"]
    price = rows.select(*base, F.lit("price").alias("target"), F.col("next_close").alias("y"),
                        F.col("close").alias("p"))
    direction = rows.select(*base, F.lit("direction").alias("target"),
                            F.col("next_direction").cast("double").alias("y"),
                            F.when(F.col("daily_return") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("p"))
    vol = rows.select(*base, F.lit("volatility").alias("target"), F.col("next_volatility").alias("y"),
                      F.col("volatility").alias("p"))
    return (price.unionByName(direction).unionByName(vol)
            .withColumn("model", F.lit("persistence")))


def backtest_summary(pred: DataFrame) -> DataFrame:
    """One row per symbol: price MSE/MAE/R2, direction accuracy and weighted
    precision/recall/F1, volatility MSE/MAE/R2."""
    reg = metrics.regression_metrics(pred.where(F.col("target") != "direction"))
    cls = metrics.classification_report(pred.where(F.col("target") == "direction"))
    price = reg.where("target = 'price'").select(
        "symbol", F.col("mse").alias("price_mse"), F.col("mae").alias("price_mae"),
        F.col("r2").alias("price_r2"))
    vol = reg.where("target = 'volatility'").select(
        "symbol", F.col("mse").alias("volatility_mse"), F.col("mae").alias("volatility_mae"),
        F.col("r2").alias("volatility_r2"))
    d = cls.select("symbol", F.col("accuracy").alias("direction_accuracy"),
                   F.col("weighted_precision").alias("direction_precision"),
                   F.col("weighted_recall").alias("direction_recall"),
                   F.col("weighted_f1").alias("direction_f1"))
    return price.join(d, "symbol").join(vol, "symbol")
