"""velas: a PySpark-native engine for market-bar analytics.

Bars (from files or resampled from event/order tables) become a table of
technical indicators and next-bar targets computed with window expressions,
then feed preparation, statistics, nearest-neighbour and ``pyspark.ml``
models, metrics, backtests and prediction reports.  Everything is a lazy
DataFrame plan; see README.md for the module map.
"""

from velas.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
