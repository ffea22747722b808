"""Frames and paths shared by the test modules."""

import datetime as dt

SF001 = "/root/testdata/sf0.001"


def bars_frame(spark, rows, symbol="S"):
    """rows: list of (date_str, open, high, low, close, volume)."""
    data = [(symbol, dt.date.fromisoformat(d), o, h, lo, c, v) for d, o, h, lo, c, v in rows]
    return spark.createDataFrame(
        data, "symbol string, date date, open double, high double, low double, close double, volume double")
