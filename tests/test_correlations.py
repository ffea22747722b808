"""Correlations across symbols from tiles, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from velas.operators import stats


def _bars(spark, n_symbols, n_days, seed, missing=0.2):
    rng = np.random.default_rng(seed)
    start = dt.date(2020, 11, 20)
    rows = []
    for s in range(n_symbols):
        close = 50 + rng.normal(size=n_days).cumsum()
        for d in range(n_days):
            if s == 0 or rng.random() > missing:
                rows.append((f"S{s:02d}", start + dt.timedelta(days=d), float(close[d])))
    return spark.createDataFrame(rows, "symbol string, date date, close double"), pd.DataFrame(
        rows, columns=["symbol", "date", "close"]).pivot(index="date", columns="symbol", values="close")


def _as_frame(df):
    return df.toPandas().pivot(index="a", columns="b", values="corr").astype(float)


@pytest.mark.parametrize("tile", [2, 3, 128])
def test_price_corr_in_tiles_equals_pandas(spark, tile):
    bars, wide = _bars(spark, 7, 300, 4)
    symbols = stats.symbol_list(bars)
    values = stats.close_matrix(bars, symbols).withColumnRenamed("close", "v")
    got = _as_frame(stats.pairwise_corr(values, symbols, tile))
    pd.testing.assert_frame_equal(got, wide.corr(), check_names=False, atol=1e-9)


def test_return_corr_equals_pandas(spark):
    bars, wide = _bars(spark, 5, 200, 5, missing=0.4)
    want = wide.ffill().pct_change(fill_method=None).dropna().corr()
    got = _as_frame(stats.return_corr(bars, stats.symbol_list(bars)))
    pd.testing.assert_frame_equal(got, want, check_names=False, atol=1e-9)


def test_flat_absent_and_single_series(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), float(i * i)) for i in range(5)]
    rows += [("flat", day + dt.timedelta(days=i), 0.1) for i in range(5)]
    rows += [("late", day + dt.timedelta(days=100 + i), float(i)) for i in range(5)]  # no date of the first symbol
    rows += [("once", day, 3.0), ("null", day, None)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    symbols = stats.symbol_list(bars)
    got = {(r.a, r.b): r["corr"] for r in stats.price_corr(bars, symbols).collect()}
    assert len(got) == 25
    assert got[("a", "a")] == pytest.approx(1.0)
    assert all(v is None for k, v in got.items() if k != ("a", "a"))
    assert stats.close_matrix(bars, symbols).count() == 25


def test_plan_does_not_grow_with_the_symbols(spark):
    """2,000 symbols: the plan compiles, and a sample of the pairs is right."""
    n = 2000
    bars = spark.range(n * 6).select(
        F.format_string("S%04d", (F.col("id") % n).cast("int")).alias("symbol"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.floor(F.col("id") / n).cast("int")).alias("date"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1.0).alias("close"))
    symbols = stats.symbol_list(bars)
    corr = stats.price_corr(bars, symbols)
    asked = ("S0000", "S0127", "S0128", "S1999")
    got = {(r.a, r.b): r["corr"] for r in corr.where(F.col("a").isin(*asked) & F.col("b").isin(*asked)).collect()}
    wide = bars.where(F.col("symbol").isin(*asked)).toPandas().pivot(index="date", columns="symbol", values="close").corr()
    assert len(got) == 16
    for (a, b), v in got.items():
        assert v == pytest.approx(wide.loc[a, b], abs=1e-9)
