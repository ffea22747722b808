"""Report rounding: one decimal scale per output column.

Reports round their numeric columns so that values computed with different
(but equally valid) summation orders print identically.  Scales are chosen
per column: averages of 2-decimal prices over n rows are exact decimals with
at most 5 places, so they get 5 (never a half-way tie); values that carry
~1e-10 absolute float noise (EMA family, band edges) get 3-4; unit-scale
ratios get 6.  ``-0.0`` is normalised to ``0.0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Decimal places per column name.
SCALES = {
    "open": 2, "high": 2, "low": 2, "close": 2, "next_close": 2, "momentum": 2,
    "current_price": 2, "actual_close": 2,
    "ma5": 5, "ma10": 5, "ma20": 5, "ma50": 5, "ma200": 5, "bb_middle": 5, "atr": 5,
    "tp": 5, "ma_tp": 5, "mad": 5,
    "ema12": 3, "ema26": 3, "macd": 3, "macd_signal": 3, "macd_hist": 3,
    "bb_upper": 4, "bb_lower": 4,
    "rsi": 6, "stoch_k": 6, "stoch_d": 6, "williams_r": 6, "cci": 5,
    "roc": 6, "daily_return": 6, "next_return": 6, "volatility": 6, "next_volatility": 6,
}


F32 = "f32"  # relative rounding: ~7 significant digits via single precision


def round_expr(name: str, scale):
    if scale == F32:
        return (F.col(name).cast("float").cast("double") + F.lit(0.0)).alias(name)
    return (F.round(F.col(name), scale) + F.lit(0.0)).alias(name)


def round_report(df: DataFrame, scales: dict[str, int] | None = None) -> DataFrame:
    scales = SCALES if scales is None else scales
    return df.select(*[round_expr(c, scales[c]) if c in scales else F.col(c) for c in df.columns])


def sql_round(name: str, scales: dict[str, int] | None = None, src: str | None = None) -> str:
    """The same rounding as SQL text (for the DuckDB oracle)."""
    scales = SCALES if scales is None else scales
    src = src or name
    if scales.get(name) == F32:
        return f"CAST(CAST({src} AS FLOAT) AS DOUBLE) + 0.0 AS {name}"
    if name in scales:
        return f"round({src}, {scales[name]}) + 0.0 AS {name}"
    return f"{src} AS {name}"
