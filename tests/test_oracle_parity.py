"""Registered queries against their DuckDB oracle at sf0.001 (the driver
repeats this at sf0.01 for every key; scripts/check_oracle.py runs all)."""

import pytest

import __spark_entry__ as E
from bars_cases import SF001
from velas.testing import compare, duck_connect

KEYS = ["build_bars", "features", "features_analysis", "ffill_post", "obv", "rolling_mad",
        "period_filter", "close_matrix", "return_corr", "return_histogram", "standard_scale",
        "backtest_summary", "unknown_symbols"]


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_parity(spark, con, key):
    res = compare(E.queries()[key](spark, SF001), E.oracle_sql()[key], con)
    assert res["rows_match"] and res["schema_match"] and res["values_match"], res


def test_every_sql_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "next_close" in df.columns
