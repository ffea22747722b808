"""Linear model family per symbol from one grouped pass (M1-M4).

Ordinary least squares, ridge, lasso and elastic net all depend on the data
only through the upper-triangular factor R of [1 | X | y]:

1. training rows are cut into chunks of ``CHUNK_ROWS`` rows per symbol;
   ``applyInPandas`` returns each chunk's R (a (d+2) x (d+2) block) - a
   tall-skinny QR, so no group holds more than one chunk;
2. per symbol, the stacked chunk factors (#chunks x (d+2) rows) are reduced
   by one more QR, and the models are solved from that small factor:
   OLS by least squares on R (minimum-norm when features are exactly
   dependent), ridge by appending sqrt(alpha) * I rows, lasso / elastic net
   by coordinate descent on the Gram matrix R'R.
3. coefficients (one row per symbol and model) are joined back and applied
   with JVM array expressions.

Objectives (n = training rows, features standardised on training rows):
OLS  min ||y - b - Xw||^2;  ridge  + alpha ||w||^2;
lasso  (1/2n)||y - b - Xw||^2 + alpha ||w||_1;
elastic net  (1/2n)||...||^2 + alpha r ||w||_1 + alpha (1 - r)/2 ||w||^2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000
# Regularisation of the reference models.
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 1.0
ENET_ALPHA, ENET_L1_RATIO = 1.0, 0.5
CD_MAX_ITER = 100_000

LINEAR_MODELS = ("Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet")


def _chunk_r(d: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, d))
        a = np.column_stack([np.ones(len(pdf)), x, pdf["label"].to_numpy(dtype=float)])
        r = np.linalg.qr(a, mode="r")
        counts = np.zeros(len(r), dtype=np.int64)
        counts[0] = len(pdf)  # the chunk's row count, carried once
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "n": counts,
                             "r": [row.tolist() for row in r]})
    return fn


def _soft(z, t):
    return np.sign(z) * max(abs(z) - t, 0.0)


def _kkt_ok(g, c, n, l1, l2, w, tol):
    """Optimality of min (1/2n)(w'Gw - 2c'w) + l1|w|_1 + (l2/2)|w|^2."""
    grad = (c - g @ w) / n - l2 * w
    act = w != 0
    ok_act = np.all(np.abs(grad[act] - l1 * np.sign(w[act])) <= tol)
    ok_zero = np.all(np.abs(grad[~act]) <= l1 + tol)
    return ok_act and ok_zero


def _independent(g, idx, w, rel: float = 1e-10):
    """Greedy linearly independent subset of columns ``idx`` (largest |w|
    first), judged on the Gram matrix: keep a column when its residual after
    projection on the kept ones is above ``rel`` of its norm."""
    kept: list[int] = []
    for j in sorted(idx, key=lambda k: -abs(w[k])):
        if kept:
            gk = g[np.ix_(kept, kept)]
            b = g[kept, j]
            res = g[j, j] - b @ np.linalg.lstsq(gk, b, rcond=None)[0]
        else:
            res = g[j, j]
        if res > rel * max(g[j, j], 1e-300):
            kept.append(j)
    return np.array(sorted(kept), dtype=int)


def _active_set(g, c, n, l1, l2, w, tol, max_steps: int = 60):
    """Refine the support suggested by ``w``: solve the equality system on a
    linearly independent support, drop coordinates whose sign flips, add the
    worst violator of the optimality conditions, repeat.  Returns a point
    satisfying the conditions, or None."""
    d = len(c)
    sign = np.sign(w)
    act = list(np.nonzero(w)[0])
    for _ in range(max_steps):
        idx = _independent(g, np.array(act, dtype=int), np.abs(w) + 1.0) if l2 == 0 else np.array(act, dtype=int)
        cand = np.zeros(d)
        if len(idx):
            a = g[np.ix_(idx, idx)] + n * l2 * np.eye(len(idx))
            cand[idx] = np.linalg.lstsq(a, c[idx] - n * l1 * sign[idx], rcond=None)[0]
        if _kkt_ok(g, c, n, l1, l2, cand, tol):
            return cand
        flipped = [j for j in idx if cand[j] != 0 and np.sign(cand[j]) != sign[j]]
        grad = (c - g @ cand) / n - l2 * cand
        viol = [(abs(grad[j]) - l1, j) for j in range(d) if j not in set(idx)]
        worst = max(viol) if viol else (-1.0, -1)
        if flipped:
            act = [j for j in idx if j not in flipped]
        elif worst[0] > tol:
            j = worst[1]
            sign[j] = np.sign(grad[j])
            act = list(idx) + [j]
        else:
            return None
    return None


def _coordinate_descent(g, c, n, l1, l2, sweeps_per_check: int = 20):
    """Coordinate descent with an exact active-set finish.

    After every block of sweeps the current support and signs define a
    linear system (G_AA + n l2 I) w_A = c_A - n l1 s_A; its solution is
    accepted as soon as it satisfies the optimality conditions.  Returns the
    weights and whether they have converged."""
    d = len(c)
    w = np.zeros(d)
    diag = np.diag(g)
    scale = max(1.0, float(np.max(np.abs(c))) / n)
    tol = 1e-9 * scale

    def objective(v):
        return (v @ g @ v - 2 * c @ v) / (2 * n) + l1 * np.abs(v).sum() + 0.5 * l2 * v @ v

    # warm start: the support and signs of a ridge-like solution often are
    # the final ones; the exact active-set step then finishes immediately
    start = np.linalg.lstsq(g + n * (l1 + l2) * np.eye(d), c, rcond=None)[0]
    cand = _active_set(g, c, n, l1, l2, start, tol, max_steps=4 * d)
    if cand is not None:
        return cand, True
    last = np.inf
    next_check = sweeps_per_check
    for sweep in range(CD_MAX_ITER):
        for j in range(d):
            if diag[j] <= 0:
                continue
            rho = c[j] - g[j] @ w + diag[j] * w[j]
            w[j] = _soft(rho, n * l1) / (diag[j] + n * l2)
        if (sweep + 1) % sweeps_per_check:
            continue
        if sweep + 1 == next_check:  # exact finish on a doubling schedule
            next_check *= 2
            cand = _active_set(g, c, n, l1, l2, w, tol)
            if cand is not None:
                return cand, True
        # exactly dependent features leave flat directions in which w may
        # drift while the fitted values (unique for every solution) no
        # longer change: stop once the objective has converged
        cur = objective(w)
        if last - cur <= 1e-15 * abs(cur) + 1e-300:
            return w, True
        last = cur
    return w, False


def _solve(d: int, models=LINEAR_MODELS):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack(pdf["r"].to_numpy())
        r = np.linalg.qr(stacked, mode="r")
        n = int(pdf["n"].sum())
        k = d + 1  # intercept + features
        rx, ry = r[:k, :k], r[:k, k]
        out = []
        # OLS: least squares on the factor (minimum norm if rank deficient)
        theta = np.linalg.lstsq(rx, ry, rcond=None)[0]
        out.append(("Linear Regression", theta[0], theta[1:], True))
        # ridge: penalise the slopes only
        pen = np.zeros((d, k))
        pen[:, 1:] = np.sqrt(RIDGE_ALPHA) * np.eye(d)
        theta = np.linalg.lstsq(np.vstack([rx, pen]), np.concatenate([ry, np.zeros(d)]), rcond=None)[0]
        out.append(("Ridge Regression", theta[0], theta[1:], True))
        # lasso / elastic net on centred Gram statistics
        gram = r.T @ r
        mean_x = gram[0, 1:k] / n
        mean_y = gram[0, k] / n
        gxx = gram[1:k, 1:k] - n * np.outer(mean_x, mean_x)
        cxy = gram[1:k, k] - n * mean_x * mean_y
        for name, l1, l2 in (("Lasso Regression", LASSO_ALPHA, 0.0),
                             ("ElasticNet", ENET_ALPHA * ENET_L1_RATIO, ENET_ALPHA * (1 - ENET_L1_RATIO))):
            if name in models:
                w, converged = _coordinate_descent(gxx, cxy, n, l1, l2)
                out.append((name, mean_y - mean_x @ w, w, converged))
        out = [o for o in out if o[0] in models]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "model": [o[0] for o in out],
                             "intercept": [float(o[1]) for o in out],
                             "coef": [list(map(float, o[2])) for o in out],
                             "converged": [o[3] for o in out]})
    return fn


def _x(features):
    """Feature vector: a list of column names, or the name of an array column
    given as a 1-tuple ``("z", dim)``."""
    if isinstance(features, tuple) and len(features) == 2 and isinstance(features[1], int):
        return F.col(features[0]), features[1]
    return F.array(*[F.col(f) for f in features]), len(features)


def fit_linear(prepared: DataFrame, features, chunk_rows: int = CHUNK_ROWS,
               models=LINEAR_MODELS) -> DataFrame:
    """(symbol, model, intercept, coef array, converged) for the linear models."""
    x, d = _x(features)
    train = prepared.where("is_train").select(
        "symbol", (F.col("idx") / F.lit(chunk_rows)).cast("long").alias("chunk"),
        x.alias("x"), F.col("label").cast("double").alias("label"))
    factors = train.groupBy("symbol", "chunk").applyInPandas(
        _chunk_r(d), "symbol string, n long, r array<double>")
    return factors.groupBy("symbol").applyInPandas(
        _solve(d, models), "symbol string, model string, intercept double, coef array<double>, converged boolean")


def predict_linear(rows: DataFrame, coefs: DataFrame, features) -> DataFrame:
    """Score rows with every fitted model of their symbol (JVM expressions)."""
    x, _ = _x(features)
    dot = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(coefs, "symbol").withColumn("p", F.col("intercept") + dot).drop("intercept", "coef", "converged")


# --- logistic regression (M10) by grouped Newton iterations -----------------
LOGISTIC_C = 1.0  # fixed value: inverse L2 strength of the reference model
NEWTON_MAX_ITER, NEWTON_TOL = 100, 1e-10
MAX_STEP = 10.0          # largest change of a coefficient in one Newton step
ONE_CLASS_LOGIT = 30.0   # intercept that stands for certainty


def _logistic_partial(d: int):
    """Per (symbol, chunk): gradient and Hessian of the summed log-loss at the
    symbol's current coefficients."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
        y = pdf["label"].to_numpy(dtype=float)
        theta = np.asarray(pdf["theta"].iloc[0], dtype=float)
        z = x @ theta
        p = 0.5 * (1.0 + np.tanh(0.5 * z))  # stable sigmoid
        g = x.T @ (p - y)
        h = (x * (p * (1 - p))[:, None]).T @ x
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "theta": [theta.tolist()],
                             "g": [g.tolist()], "h": [h.ravel().tolist()],
                             "n": [len(y)], "ones": [int(y.sum())]})
    return fn


def _logistic_step(d: int, c: float):
    """Per symbol: sum the partials, add the L2 term (slopes only), one
    Newton step of bounded length.  Objective: 0.5 |w|^2 + C * sum log-loss.
    A symbol whose labels are all one class gets that class as a constant."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        k = d + 1
        theta = np.asarray(pdf["theta"].iloc[0], dtype=float)
        n, ones = int(pdf["n"].sum()), int(pdf["ones"].sum())
        if ones in (0, n):
            constant = [ONE_CLASS_LOGIT if ones else -ONE_CLASS_LOGIT] + [0.0] * d
            return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "theta": [constant], "step": [0.0]})
        g = c * np.sum(np.vstack(pdf["g"].to_numpy()), axis=0)
        h = c * np.sum(np.vstack(pdf["h"].to_numpy()), axis=0).reshape(k, k)
        reg = np.eye(k)
        reg[0, 0] = 0.0
        g = g + reg @ theta
        h = h + reg
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        step *= min(1.0, MAX_STEP / max(float(np.max(np.abs(step))), 1e-300))
        new = theta - step
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "theta": [new.tolist()],
                             "step": [float(np.max(np.abs(step)))]})
    return fn


def fit_logistic(prepared: DataFrame, features, c: float = LOGISTIC_C,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(symbol, intercept, coef, converged) of L2 logistic regression for every symbol.

    The training rows are written once; each Newton iteration is one pass of
    grouped partial sums (no group larger than a chunk) and one small
    per-symbol solve.  The driver only reads the largest step size."""
    from velas.session import materialize
    x, d = _x(features)
    train = materialize(prepared.where("is_train").select(
        "symbol", (F.col("idx") / F.lit(chunk_rows)).cast("long").alias("chunk"),
        x.alias("x"),
        F.col("label").cast("double").alias("label")))
    zeros = F.array(*[F.lit(0.0)] * (d + 1))
    coef = materialize(train.select("symbol").distinct().withColumn("theta", zeros))
    for _ in range(NEWTON_MAX_ITER):
        partial = train.join(coef, "symbol").groupBy("symbol", "chunk").applyInPandas(
            _logistic_partial(d), "symbol string, theta array<double>, g array<double>, h array<double>, n long, ones long")
        coef = materialize(partial.groupBy("symbol").applyInPandas(
            _logistic_step(d, c), "symbol string, theta array<double>, step double"))
        if coef.agg(F.max("step")).first()[0] <= NEWTON_TOL:
            break
    return coef.select("symbol", F.get(F.col("theta"), 0).alias("intercept"),
                       F.slice(F.col("theta"), 2, d).alias("coef"),
                       (F.col("step") <= NEWTON_TOL).alias("converged"))


def predict_logistic(rows: DataFrame, coefs: DataFrame, features) -> DataFrame:
    """Probability of class 1 and the 0/1 prediction (threshold 0.5)."""
    x, _ = _x(features)
    dot = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("intercept") + dot)))
    out = rows.join(coefs, "symbol").withColumn("prob_up", prob)
    return out.withColumn("p", F.when(F.col("prob_up") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))).drop(
        "intercept", "coef", "converged")


# --- optimality of the fits (M1-M4, M10) -------------------------------------
def optimality(prepared: DataFrame, coefs: DataFrame, features, tol: float = 1e-7) -> DataFrame:
    """Per symbol and model the training rows and the number of coefficients
    (``n_violated``, the intercept included) whose optimality condition does not hold.

    The conditions are recomputed from all training rows: with g_j the mean of
    residual * feature j, OLS needs g_j = 0, ridge g_j = alpha w_j / n, lasso and
    elastic net g_j - l2 w_j = l1 sign(w_j), or |g_j| <= l1 where w_j = 0; logistic
    regression is ridge with 1 / C and y - P(y = 1) as residual.  ``tol`` is
    relative to the label's spread, as the features have unit variance."""
    x, _ = _x(features)
    dot = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    fit = F.col("intercept") + dot
    logistic = F.col("model") == "Logistic Regression"
    rows = (prepared.where("is_train").join(coefs, "symbol")
            .withColumn("_y", F.col("label").cast("double"))
            .withColumn("_r", F.col("_y") - F.when(logistic, 1 / (1 + F.exp(-fit))).otherwise(fit)))
    sums = rows.groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_pop("_y"), F.lit(0.0)).alias("_spread"), F.avg("_r").alias("_g0"),
        F.array(*[F.avg(F.col("_r") * F.col(f)) for f in features]).alias("_g"))
    ridge = F.when(logistic, 1 / LOGISTIC_C).when(F.col("model") == "Ridge Regression", RIDGE_ALPHA).otherwise(0.0)
    l1 = F.when(F.col("model") == "Lasso Regression", LASSO_ALPHA).when(
        F.col("model") == "ElasticNet", ENET_ALPHA * ENET_L1_RATIO).otherwise(0.0)
    l2 = F.when(F.col("model") == "ElasticNet", ENET_ALPHA * (1 - ENET_L1_RATIO)).otherwise(ridge / F.col("n"))
    off = F.zip_with("_g", "coef", lambda g, w: F.when(w == 0, F.greatest(F.abs(g) - l1, F.lit(0.0))).otherwise(
        F.abs(g - l2 * w - l1 * F.signum(w))))
    allowed = tol * F.col("_spread") + 1e-9
    return (sums.join(coefs, ["symbol", "model"])
            .select("symbol", "model", "n", (F.size(F.filter(off, lambda v: v > allowed))
                                              + (F.abs("_g0") > allowed).cast("int")).cast("long").alias("n_violated")))
