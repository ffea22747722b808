"""Filters, slices and data-quality tables.

Per-symbol quantities (last row index, last date) are grouped aggregations
joined back to the rows, so no operator sorts or gathers a whole series in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-back periods of the reports (days or months before the
# last bar of each series; 'max' keeps everything).
PERIODS = {"60d": ("days", 60), "1y": ("months", 12), "2y": ("months", 24),
           "5y": ("months", 60), "10y": ("months", 120), "max": None}
MIN_ROWS = 10


def filter_symbols(df: DataFrame, symbols: list[str]) -> DataFrame:
    return df.where(F.col("symbol").isin(list(symbols)))


def unknown_symbols(spark, df: DataFrame, symbols: list[str]) -> DataFrame:
    """Requested symbols that are not in the data (left-anti join)."""
    req = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    universe = df.select("symbol").distinct()
    return req.join(universe, "symbol", "left_anti")


def period_filter(df: DataFrame, period: str) -> DataFrame:
    """Rows after (last date of the series - period)."""
    spec = PERIODS[period]
    if spec is None:
        return df
    last = df.groupBy("symbol").agg(F.max("date").alias("_last"))
    unit, n = spec
    start = F.date_sub(F.col("_last"), n) if unit == "days" else F.add_months(F.col("_last"), -n)
    return df.join(last, "symbol").where(F.col("date") > start).drop("_last")


def latest_n(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of every series (by ``rn``)."""
    last = df.groupBy("symbol").agg(F.max("rn").alias("_last_rn"))
    return df.join(last, "symbol").where(F.col("rn") > F.col("_last_rn") - n).drop("_last_rn")


def quality_report(bars: DataFrame) -> DataFrame:
    """Per series: rows, zero opens, bars outside their own range, few-rows flag."""
    o, h, l_, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = (l_ > F.least(o, c)) | (h < F.greatest(o, c)) | (l_ > h)
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(o == 0, 1).otherwise(0)).alias("n_zero_open"),
        F.sum(F.when(bad, 1).otherwise(0)).alias("n_bad_range"),
    ).withColumn("few_rows", F.col("n_rows") < MIN_ROWS)


def series_profile(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"))


def direction_counts(feat: DataFrame) -> DataFrame:
    return feat.groupBy("symbol", "next_direction").agg(F.count(F.lit(1)).alias("n"))


def symbol_lookup(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach the symbol dimension (one row per symbol) to rows."""
    return df.join(dim, "symbol", "left")
