"""Next-bar prediction record and report (M20, P12-P15), chart tables.

The latest bar of every series is a test row of the chronological split, so
its prediction comes from the same scoring pass as the hold-out.  Champions
are picked per (symbol, target) from hold-out metrics (lowest MSE / highest
accuracy, ties to declared order), not hard-coded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report column names and decimals.
REPORT_NAMES = {
    "symbol": "Symbol", "current_date": "Current Date", "current_price": "Current Price ($)",
    "predicted_price": "Predicted Price ($)", "expected_change": "Expected Change ($)",
    "expected_change_pct": "Expected Change (%)", "direction": "Direction",
    "direction_probability": "Confidence (%)", "predicted_volatility": "Predicted Volatility",
}
REPORT_DECIMALS = {"current_price": 2, "predicted_price": 2, "expected_change": 2,
                   "expected_change_pct": 2, "direction_probability": 2, "predicted_volatility": 4}


def champion_predictions(pred: DataFrame, champions: DataFrame) -> DataFrame:
    """Keep each (symbol, target)'s champion model predictions."""
    return pred.join(champions, ["symbol", "target", "model"], "left_semi")


def next_bar_record(pred: DataFrame, latest: DataFrame) -> DataFrame:
    """One 9-field record per symbol from champion predictions on the latest
    row.  ``pred``: symbol, target, rn, p, prob_up; ``latest``: symbol, rn,
    date, close (one row per symbol)."""
    p = pred.join(latest.select("symbol", "rn"), ["symbol", "rn"])
    wide = p.groupBy("symbol").agg(
        F.max(F.when(F.col("target") == "price", F.col("p"))).alias("predicted_price"),
        F.max(F.when(F.col("target") == "direction", F.col("p"))).alias("_dir"),
        F.max(F.when(F.col("target") == "direction", F.col("prob_up"))).alias("_prob_up"),
        F.max(F.when(F.col("target") == "volatility", F.col("p"))).alias("predicted_volatility"))
    rec = latest.select("symbol", F.col("date").alias("current_date"),
                        F.col("close").alias("current_price")).join(wide, "symbol")
    change = F.col("predicted_price") - F.col("current_price")
    up = F.col("_dir") == 1
    return rec.select(
        "symbol", "current_date", "current_price", "predicted_price",
        change.alias("expected_change"),
        (F.try_divide(change, F.col("current_price")) * F.lit(100.0)).alias("expected_change_pct"),
        F.when(up, F.lit("UP")).otherwise(F.lit("DOWN")).alias("direction"),
        F.when(up, F.col("_prob_up")).otherwise(F.lit(1.0) - F.col("_prob_up")).alias("direction_probability"),
        "predicted_volatility")


def prediction_report(rec: DataFrame) -> DataFrame:
    """Display table: rounded (2/2/2/2/2/4 decimals, confidence x100), renamed."""
    cols = []
    for c in REPORT_NAMES:
        v = F.col(c)
        if c == "direction_probability":
            v = v * F.lit(100.0)
        if c in REPORT_DECIMALS:
            v = F.round(v, REPORT_DECIMALS[c])
        if c == "current_date":
            v = F.date_format(v, "yyyy-MM-dd")
        cols.append(v.alias(REPORT_NAMES[c]))
    return rec.select(*cols)


def chart_price_history(feat: DataFrame) -> DataFrame:
    return feat.select("symbol", "date", "close", "ma50", "ma200", "volume")


# Chart panels and their series.
PANELS = {
    "rsi": ("rsi",), "macd": ("macd", "macd_signal", "macd_hist"),
    "bollinger": ("close", "bb_upper", "bb_middle", "bb_lower"), "stochastic": ("stoch_k", "stoch_d"),
    "volatility": ("volatility",),
}


def chart_indicators(feat: DataFrame) -> DataFrame:
    """Long (symbol, date, panel, series, value) table behind the indicator panels."""
    entries = [F.struct(F.lit(p).alias("panel"), F.lit(s).alias("series"), F.col(s).alias("value"))
               for p, ss in PANELS.items() for s in ss]
    return feat.select("symbol", "date", F.explode(F.array(*entries)).alias("_e")).select(
        "symbol", "date", "_e.*")
