"""Technical indicators (W1-W20) as layered window expressions.

Each function appends columns to a bar DataFrame that carries ``rn`` (row
order) and, for the EMA, ``_q`` (offset inside the partition).  Windows are
taken from a ``SeriesWindow`` so the same code runs on whole series or on
halo blocks.  Layers only reference columns of earlier layers, and all
layers share one partition/order spec, so Spark shuffles once and re-sorts
only for the EMA sub-block sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.functions.ema import add_ema, add_emas
from velas.functions.windows import SeriesWindow, full, list_mad, list_mean, rolling_list, safe_div

# Fixed values that define the indicators (window lengths, spans, constants).
MA_WINDOWS = (5, 10, 20, 50, 200)
EMA_FAST, EMA_SLOW, EMA_SIGNAL = 12, 26, 9
RSI_WINDOW = 14
BB_WINDOW, BB_WIDTH = 20, 2.0
STOCH_WINDOW, STOCH_SMOOTH = 14, 3
ATR_WINDOW = 14
ROC_LAG = 10
CCI_WINDOW, CCI_CONSTANT = 20, 0.015
MOMENTUM_LAG = 4
VOL_WINDOW, ANNUALISATION = 21, 252
RSI_UPPER, RSI_LOWER = 70.0, 30.0
STOCH_UPPER, STOCH_LOWER = 80.0, 20.0

# The features and their order.
FEATURES = (
    "open", "high", "low", "close", "volume",
    "ma5", "ma10", "ma20", "ma50", "ma200",
    "ema12", "ema26", "macd", "macd_signal", "macd_hist",
    "rsi", "bb_upper", "bb_middle", "bb_lower", "stoch_k", "stoch_d",
    "atr", "obv", "roc", "williams_r", "cci", "momentum", "volatility",
)


def add_lags(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Layer 1: previous closes and the typical price."""
    return df.withColumns({
        "_prev_close": F.lag("close", 1).over(w.base),
        "_close_lag4": F.lag("close", MOMENTUM_LAG).over(w.base),
        "_close_lag10": F.lag("close", ROC_LAG).over(w.base),
        "_tp": (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0),
    })


def add_rolling_raw(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Layer 2: trailing aggregates of raw columns (one Window operator)."""
    cols = {f"ma{n}": full(w, "close", n, F.avg) for n in MA_WINDOWS}
    cols.update({
        "_sd20": full(w, "close", BB_WINDOW, F.stddev_samp),
        "_low_min": full(w, "low", STOCH_WINDOW, F.min),
        "_high_max": full(w, "high", STOCH_WINDOW, F.max),
        "_ma_tp": full(w, "_tp", CCI_WINDOW, F.avg),
        "_tp_list": rolling_list(w, "_tp", CCI_WINDOW),
    })
    return df.withColumns(cols)


def add_row_derived(df: DataFrame) -> DataFrame:
    """Layer 3: per-row expressions over layers 1-2."""
    c, prev = F.col("close"), F.col("_prev_close")
    delta = c - prev
    rng = F.col("_high_max") - F.col("_low_min")
    return df.withColumns({
        "_gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "_loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                          F.abs(F.col("low") - prev)),
        "_signed_vol": F.coalesce(F.signum(delta) * F.col("volume"), F.lit(0.0)),
        "daily_return": safe_div(c, prev) - F.lit(1.0),
        "bb_middle": F.col("ma20"),
        "bb_upper": F.col("ma20") + F.lit(BB_WIDTH) * F.col("_sd20"),
        "bb_lower": F.col("ma20") - F.lit(BB_WIDTH) * F.col("_sd20"),
        "stoch_k": F.lit(100.0) * safe_div(c - F.col("_low_min"), rng),
        "williams_r": F.lit(-100.0) * safe_div(F.col("_high_max") - c, rng) + F.lit(0.0),
        "roc": (safe_div(c, F.col("_close_lag10")) - F.lit(1.0)) * F.lit(100.0),
        "momentum": c - F.col("_close_lag4"),
        "_tp_mean": list_mean(F.col("_tp_list"), CCI_WINDOW),
    })


def add_rolling_derived(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Layer 4: trailing aggregates of layer-3 columns."""
    return df.withColumns({
        "_avg_gain": full(w, "_gain", RSI_WINDOW, F.avg),
        "_avg_loss": full(w, "_loss", RSI_WINDOW, F.avg),
        "atr": full(w, "_tr", ATR_WINDOW, F.avg),
        "volatility": full(w, "daily_return", VOL_WINDOW, F.stddev_samp)
        * F.lit(math.sqrt(ANNUALISATION)),
        "stoch_d": full(w, "stoch_k", STOCH_SMOOTH, F.avg),
        "_mad": list_mad(F.col("_tp_list"), F.col("_tp_mean"), CCI_WINDOW),
    })


def add_ratio_indicators(df: DataFrame) -> DataFrame:
    """Layer 5: RSI (simple means; 0/0 -> NULL, x/0 -> 100) and CCI."""
    g, l_ = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = F.when(l_ == 0, F.when(g > 0, F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_div(g, l_)))
    cci = safe_div(F.col("_tp") - F.col("_ma_tp"), F.lit(CCI_CONSTANT) * F.col("_mad"))
    return df.withColumns({"rsi": rsi, "cci": cci})


def add_macd(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """EMA12, EMA26, MACD, signal (EMA9 of MACD) and histogram."""
    df = add_emas(df, w, "close", {"ema12": EMA_FAST, "ema26": EMA_SLOW})
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = add_ema(df, w, "macd", "macd_signal", EMA_SIGNAL)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def add_indicators(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """All W1-W20 columns; OBV is left as the per-row signed volume ``_signed_vol``
    (its running sum is taken by the plan, which knows the layout)."""
    df = add_lags(df, w)
    df = add_rolling_raw(df, w)
    df = add_row_derived(df)
    df = add_rolling_derived(df, w)
    df = add_ratio_indicators(df)
    df = add_macd(df, w)
    return df


def add_signal_flags(df: DataFrame) -> DataFrame:
    """Overbought / oversold flags against the fixed reference levels."""
    def flag(x, upper, lower):
        return (F.when(F.col(x) >= upper, F.lit("overbought"))
                .when(F.col(x) <= lower, F.lit("oversold"))
                .when(F.col(x).isNotNull(), F.lit("neutral")))
    return df.withColumns({
        "rsi_zone": flag("rsi", RSI_UPPER, RSI_LOWER),
        "stoch_zone": flag("stoch_k", STOCH_UPPER, STOCH_LOWER),
    })
