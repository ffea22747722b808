"""Margin classifier with calibrated probabilities for every symbol.

min 0.5 |w|^2 + C * sum max(0, 1 - s (b + w x))^2 with s = -1 or 1: the squared
hinge is smooth, so Newton steps on the rows inside the margin reach the optimum
in a few passes.  Each pass sums the loss, gradient and Hessian per (fit,
chunk) and takes one small solve per fit; a step that raises the loss is
halved.  Fits that are done no longer read rows.

Probabilities: the training rows are dealt to ``FOLDS`` folds by a hash; the
margins of a fold come from a fit on the others, and a logistic regression of
the labels on these margins turns the margin of the whole fit into a
probability.  All fits of all symbols (the whole and one per fold) share the
passes.  No group holds more than a chunk; the driver reads only whether any fit
goes on.  A fit whose labels are all one class gives that class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velas.operators import linear
from velas.session import materialize

MARGIN_C = 1.0  # fixed value: inverse L2 strength of the reference model
FOLDS = 3
MAX_ITER, TOL = 60, 1e-8
WHOLE = -1  # the fit on all training rows

PARTIAL = "symbol string, fit int, loss double, g array<double>, h array<double>, n long, ones long"
STATE = ("symbol string, fit int, theta array<double>, best array<double>, step array<double>, "
         "loss double, size double, open boolean")


def _partial(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
    y = pdf["label"].to_numpy(dtype=float)
    s = np.where(y > 0.5, 1.0, -1.0)
    inside = np.maximum(0.0, 1.0 - s * (x @ np.asarray(pdf["theta"].iloc[0], dtype=float)))
    held = x[inside > 0]
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "fit": [pdf["fit"].iloc[0]], "loss": [float(inside @ inside)],
                         "g": [(-2.0 * x.T @ (s * inside)).tolist()], "h": [(2.0 * held.T @ held).ravel().tolist()],
                         "n": [len(y)], "ones": [int((y > 0.5).sum())]})


def _advance(c: float):
    """Per fit: take the trial point when its objective is not above the best
    one and go a Newton step on from it, else halve the step."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        now = pdf.iloc[0]
        theta = np.asarray(now["theta"], dtype=float)
        n, ones = int(pdf["n"].sum()), int(pdf["ones"].sum())
        out = {"symbol": [now["symbol"]], "fit": [now["fit"]]}
        if ones in (0, n):
            constant = np.zeros(len(theta))
            constant[0] = 1.0 if ones else -1.0
            return pd.DataFrame({**out, "theta": [constant.tolist()], "best": [constant.tolist()],
                                 "step": [(0 * theta).tolist()], "loss": [0.0], "size": [0.0], "open": [False]})
        loss = c * float(pdf["partial_loss"].sum()) + 0.5 * float(theta[1:] @ theta[1:])
        best, step, kept = np.asarray(now["best"], dtype=float), np.asarray(now["step"], dtype=float), float(now["loss"])
        if loss <= kept + 1e-12 * abs(kept):
            reg = np.eye(len(theta))
            reg[0, 0] = 0.0
            g = c * np.vstack(pdf["g"].to_numpy()).sum(axis=0) + reg @ theta
            h = c * np.vstack(pdf["h"].to_numpy()).sum(axis=0).reshape(len(theta), -1) + reg
            best, kept, step = theta, loss, np.linalg.lstsq(h, g, rcond=None)[0]
        else:
            step = step / 2
        size = float(np.max(np.abs(step)))
        return pd.DataFrame({**out, "theta": [(best - step).tolist()], "best": [best.tolist()], "step": [step.tolist()],
                             "loss": [kept], "size": [size], "open": [size > TOL]})
    return fn


def _margin(x: Column) -> Column:
    return F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)


def fit_margins(rows: DataFrame, c: float = MARGIN_C) -> DataFrame:
    """(symbol, fit, intercept, coef, converged) from rows (symbol, fit, chunk, x, label)."""
    dim = F.size("x") + 1
    zeros = F.array_repeat(F.lit(0.0), F.first(dim))
    state = materialize(rows.groupBy("symbol", "fit").agg(zeros.alias("theta")).select(
        "symbol", "fit", "theta", F.col("theta").alias("best"), F.col("theta").alias("step"),
        F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("size"), F.lit(True).alias("open")))
    for _ in range(MAX_ITER):
        going = state.where("open")
        sums = (rows.join(going.select("symbol", "fit", "theta"), ["symbol", "fit"])
                .groupBy("symbol", "fit", "chunk").applyInPandas(_partial, PARTIAL)
                .withColumnRenamed("loss", "partial_loss"))
        moved = going.join(sums, ["symbol", "fit"]).groupBy("symbol", "fit").applyInPandas(_advance(c), STATE)
        state = materialize(state.where("not open").unionByName(moved))
        if state.where("open").isEmpty():
            break
    return state.select("symbol", "fit", F.get("best", F.lit(0)).alias("intercept"),
                        F.slice("best", 2, F.size("best") - 1).alias("coef"), (~F.col("open")).alias("converged"))


def _fold(name: str = "rn") -> Column:
    return F.pmod(F.xxhash64(name), F.lit(FOLDS)).cast("int")


def predict(prepared: DataFrame, features, c: float = MARGIN_C, chunk_rows: int = linear.CHUNK_ROWS) -> DataFrame:
    """(symbol, rn, y, p, prob_up, margin) of the hold-out rows: p is the side of
    the margin, prob_up its calibrated probability."""
    x, _ = linear._x(features)
    given = materialize(prepared.select("symbol", "rn", "idx", "is_train", F.col("label").cast("double").alias("label"), x.alias("x")))
    train = given.where("is_train").withColumn("chunk", (F.col("idx") / F.lit(chunk_rows)).cast("long"))
    fits = F.array(F.lit(WHOLE), *[F.lit(f) for f in range(FOLDS)])
    rows = materialize(train.withColumn("fold", _fold()).select(
        "symbol", "chunk", "x", "label", F.explode(F.filter(fits, lambda f: f != F.col("fold"))).alias("fit")))
    fitted = materialize(fit_margins(rows, c))
    left_out = train.withColumn("fit", _fold()).join(fitted, ["symbol", "fit"])
    sigmoid = linear.fit_logistic(left_out.select("symbol", "idx", "is_train", "label", F.array(_margin(F.col("x"))).alias("m")),
                                  ("m", 1), chunk_rows=chunk_rows)
    whole = given.where("not is_train").join(fitted.where(F.col("fit") == WHOLE).drop("fit", "converged"), "symbol")
    asked = whole.select("symbol", "rn", F.col("label").alias("y"), F.array(_margin(F.col("x"))).alias("m"))
    side = F.col("m")[0]
    return linear.predict_logistic(asked, sigmoid, ("m", 1)).select(
        "symbol", "rn", "y", (side > 0).cast("double").alias("p"), "prob_up", side.alias("margin"))


def fit_whole(prepared: DataFrame, features, c: float = MARGIN_C, chunk_rows: int = linear.CHUNK_ROWS) -> DataFrame:
    """(symbol, fit, intercept, coef, converged) on all training rows of every symbol."""
    x, _ = linear._x(features)
    return fit_margins(materialize(prepared.where("is_train").select(
        "symbol", F.lit(WHOLE).alias("fit"), (F.col("idx") / F.lit(chunk_rows)).cast("long").alias("chunk"),
        x.alias("x"), F.col("label").cast("double").alias("label"))), c)


def optimality(prepared: DataFrame, fitted: DataFrame, features, c: float = MARGIN_C, tol: float = 1e-7) -> DataFrame:
    """Per symbol the training rows and the number of coefficients
    (``n_violated``, the intercept included) whose optimality condition does not
    hold, recomputed from all training rows: w_j = 2 C sum s max(0, 1 - s f) x_j,
    per row within ``tol``.  A symbol with one class has the constant of that class."""
    label = F.col("label").cast("double")
    side = F.when(label > 0.5, 1.0).otherwise(-1.0)
    rows = (prepared.where("is_train").join(fitted, "symbol")
            .withColumn("_r", side * F.greatest(F.lit(0.0), 1.0 - side * _margin(F.array(*[F.col(f) for f in features])))))
    sums = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), (F.min(label) == F.max(label)).alias("_constant"), F.sum("_r").alias("_g0"),
        F.array(*[F.sum(F.col("_r") * F.col(f)) for f in features]).alias("_g"))
    off = F.filter(F.zip_with("_g", "coef", lambda g, w: F.abs(w - 2 * c * g)), lambda v: v > tol * F.col("n"))
    violated = F.size(off) + (2 * c * F.abs("_g0") > tol * F.col("n")).cast("int")
    return sums.join(fitted, "symbol").select(
        "symbol", "n", F.when(F.col("_constant"), (F.array_max(F.transform("coef", F.abs)) > 0).cast("int")).otherwise(violated)
        .cast("long").alias("n_violated"))
