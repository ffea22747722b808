"""Bar sources: resample driver tables into OHLCV bars (S11), union series.

Bar schema used everywhere: symbol string, date (date or timestamp), open,
high, low, close, volume (double).  ``(symbol, date)`` is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLS = ("open", "high", "low", "close", "volume")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def resample_bars(df: DataFrame, symbol: str, ts: str, price: str, seq: str,
                  unit: str | None = None) -> DataFrame:
    """OHLCV bars per (symbol, period).

    open/close are the price of the first/last record by ``seq`` (a unique
    sequence key, so the choice is deterministic); volume is the record count.
    ``unit=None`` buckets by calendar day (``date`` is a DATE); otherwise by
    ``date_trunc(unit, ts)``.  The aggregation is partial (map-side) then
    final, so the shuffle carries one row per period per map task.
    """
    period = F.to_date(F.col(ts)) if unit is None else F.date_trunc(unit, F.col(ts))
    src = df.select(F.col(symbol).alias("symbol"), period.alias("date"),
                    F.col(seq).alias("_seq"), F.col(price).alias("_px"))
    return src.groupBy("symbol", "date").agg(
        F.min_by("_px", "_seq").alias("open"),
        F.max("_px").alias("high"),
        F.min("_px").alias("low"),
        F.max_by("_px", "_seq").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars_from_orders(spark: SparkSession, sf_dir: str, unit: str | None = None) -> DataFrame:
    """Bars of orders, daily unless ``unit`` says otherwise: one series per order
    priority, prices = order totals."""
    orders = read_table(spark, sf_dir, "orders")
    return resample_bars(orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", unit)


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars: one series per event type, prices = event values."""
    events = read_table(spark, sf_dir, "events")
    return resample_bars(events, "event_type", "ts", "value", "event_id", unit="hour")


def union_symbols(frames: list[DataFrame]) -> DataFrame:
    """Union per-symbol frames into one long bar table (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
