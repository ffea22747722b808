"""Scores over prediction tables.

A prediction table has columns symbol, target, model, y (actual), p
(predicted); classification predictions are 0/1 doubles.  Every metric is a
grouped aggregation keyed by (symbol, target, model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "target", "model"]


def regression_metrics(pred: DataFrame, keys=KEYS) -> DataFrame:
    """MSE, MAE and R^2 = 1 - SSE/SST (SST around the mean of y)."""
    err = F.col("y") - F.col("p")
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        F.var_pop("y").alias("_var"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))
    return agg.select(*keys, "n", "mse", "mae", r2.alias("r2"))


def confusion_matrix(pred: DataFrame, keys=KEYS) -> DataFrame:
    """Counts of (actual, predicted) for classes 0/1, zero cells included."""
    cells = pred.groupBy(*keys).agg(
        *[F.sum(F.when((F.col("y") == a) & (F.col("p") == b), 1).otherwise(0)).alias(f"c{a}{b}")
          for a in (0, 1) for b in (0, 1)])
    entries = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                        F.col(f"c{a}{b}").cast("bigint").alias("n"))
               for a in (0, 1) for b in (0, 1)]
    return cells.select(*keys, F.explode(F.array(*entries)).alias("_c")).select(*keys, "_c.*")


def classification_report(pred: DataFrame, keys=KEYS) -> DataFrame:
    """Per class precision/recall/F1/support plus accuracy and the macro and
    support-weighted averages (0/0 -> 0), one row per key."""
    y, p = F.col("y"), F.col("p")
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).alias(f"c{a}{b}")
          for a in (0, 1) for b in (0, 1)])

    def ratio(num, den):
        return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))

    cols = {}
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
        cols[f"precision_{k}"] = prec
        cols[f"recall_{k}"] = rec
        cols[f"support_{k}"] = tp + fn
    agg = agg.withColumns(cols)
    f1 = {}
    for k in (0, 1):
        pr, rc = F.col(f"precision_{k}"), F.col(f"recall_{k}")
        f1[f"f1_{k}"] = F.when(pr + rc == 0, F.lit(0.0)).otherwise(2 * pr * rc / (pr + rc))
    agg = agg.withColumns(f1)
    n = F.col("n").cast("double")
    s0, s1 = F.col("support_0").cast("double"), F.col("support_1").cast("double")
    out = {"accuracy": (F.col("c00") + F.col("c11")).cast("double") / n}
    for m in ("precision", "recall", "f1"):
        out[f"macro_{m}"] = (F.col(f"{m}_0") + F.col(f"{m}_1")) / F.lit(2.0)
        out[f"weighted_{m}"] = (F.col(f"{m}_0") * s0 + F.col(f"{m}_1") * s1) / n
    agg = agg.withColumns(out)
    return agg.drop("c00", "c01", "c10", "c11")


def classification_metrics(pred: DataFrame, keys=KEYS) -> DataFrame:
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def metrics_long(reg: DataFrame | None = None, cls: DataFrame | None = None) -> DataFrame:
    """Stack metric columns into (symbol, target, model, metric, value)."""
    parts = []
    if reg is not None:
        parts.append(reg.select(*KEYS, F.explode(F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mse", "mae", "r2")]
        )).alias("_m")).select(*KEYS, "_m.*"))
    if cls is not None:
        parts.append(cls.select(*KEYS, F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_model(metrics: DataFrame, order: DataFrame) -> DataFrame:
    """Best model per (symbol, target): lowest MSE for regression targets,
    highest accuracy for direction; ties go to the first model in declared
    order.  ``order`` is the (target, model, model_ordinal) spec table; a model
    that it does not list comes after those that it does."""
    m = metrics.where(F.col("metric").isin("mse", "accuracy")).join(order, ["target", "model"], "left")
    score = F.when(F.col("metric") == "accuracy", -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("symbol", "target").orderBy(score.asc_nulls_last(), F.col("model_ordinal").asc_nulls_last(), F.col("model"))
    return (m.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("symbol", "target", F.col("model").alias("best_model"), "metric", "value"))


def rank_models(metrics: DataFrame, order: DataFrame) -> DataFrame:
    """Rank of each model per (symbol, target): ascending MSE / descending accuracy."""
    m = metrics.where(F.col("metric").isin("mse", "accuracy")).join(order, ["target", "model"], "left")
    score = F.when(F.col("metric") == "accuracy", -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("symbol", "target").orderBy(score.asc_nulls_last(), F.col("model_ordinal").asc_nulls_last(), F.col("model"))
    return m.select("symbol", "target", "model", "metric", "value",
                    F.row_number().over(w).alias("rank"))


def metrics_pivot(metrics: DataFrame, metric_names=("mse", "mae", "r2", "accuracy")) -> DataFrame:
    """Wide table: one row per (symbol, target, model), one column per metric."""
    return metrics.groupBy(*KEYS).pivot("metric", list(metric_names)).agg(F.first("value"))
