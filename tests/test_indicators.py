"""Indicator and target semantics on hand-made series, checked against the
plain-numpy statement in ``numeric_model``."""

import datetime as dt
import math

import numpy as np
import pytest

from bars_cases import bars_frame
from numeric_model import features as np_features
from numeric_model import indicators as np_indicators
from velas.plans.features import features, indicator_table
from velas.operators.indicators import FEATURES


def _series(n, seed=0, start=100.0):
    rng = np.random.default_rng(seed)
    c = start + np.cumsum(rng.normal(0, 1.5, n))
    o = c + rng.normal(0, 0.5, n)
    h = np.maximum(o, c) + rng.uniform(0, 1, n)
    lo = np.minimum(o, c) - rng.uniform(0, 1, n)
    v = rng.integers(100, 1000, n).astype(float)
    return o, h, lo, c, v


def _frame(spark, o, h, lo, c, v, symbol="S"):
    d0 = dt.date(2000, 1, 3)
    rows = [((d0 + dt.timedelta(days=i)).isoformat(), *(None if np.isnan(x) else float(x)
            for x in (o[i], h[i], lo[i], c[i], v[i]))) for i in range(len(c))]
    return bars_frame(spark, rows, symbol)


def _close(a, b, rel=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert a.shape == b.shape
    both_nan = np.isnan(a) & np.isnan(b)
    ok = both_nan | np.isclose(a, b, rtol=rel, atol=1e-9)
    return ok.all(), np.nonzero(~ok)[0][:5]


def _collect(df, cols):
    pdf = df.orderBy("rn").toPandas()
    return {c: pdf[c].astype(float).to_numpy() for c in cols}, pdf


ALL = list(FEATURES) + ["daily_return", "next_close", "next_direction", "next_return", "next_volatility"]


def test_raw_indicators_match_numpy(spark):
    o, h, lo, c, v = _series(320)
    got, _ = _collect(indicator_table(_frame(spark, o, h, lo, c, v)), ALL)
    want = np_indicators(o, h, lo, c, v)
    for k in ALL:
        ok, bad = _close(got[k], want[k])
        assert ok, (k, bad, got[k][bad], want[k][bad])


def test_feature_table_rows_and_values(spark):
    # 163 bars, as the reference fixtures: canonical keeps 143, analysis 163
    o, h, lo, c, v = _series(163, seed=3)
    df = _frame(spark, o, h, lo, c, v)
    got, pdf = _collect(features(df), ALL)
    want, kept = np_features(o, h, lo, c, v)
    assert len(pdf) == 143 and list(pdf["rn"]) == list(kept)
    for k in ALL:
        ok, bad = _close(got[k], want[k])
        assert ok, (k, bad)
    assert features(df, variant="analysis").count() == 163
    # last bar keeps its predecessor's targets; its direction is 0
    last = pdf.iloc[-1]
    assert last["next_close"] == pdf.iloc[-2]["next_close"] and last["next_direction"] == 0
    # MA200 never fills on 163 bars
    assert pdf["ma200"].isna().all()


def test_strict_labels_drop_last_bar(spark):
    o, h, lo, c, v = _series(60, seed=4)
    df = _frame(spark, o, h, lo, c, v)
    ref = features(df, variant="analysis").count()
    strict = features(df, variant="analysis", label_mode="strict").count()
    assert strict == ref - 1


def test_null_inside_and_leading_are_filled(spark):
    o, h, lo, c, v = _series(80, seed=5)
    c = c.copy()
    c[0] = np.nan      # leading NULL stays NULL
    c[30:33] = np.nan  # inner NULLs are filled from row 29
    got, _ = _collect(indicator_table(_frame(spark, o, h, lo, c, v)), ["close", "ema12", "ma5"])
    want = np_indicators(o, h, lo, c, v)
    for k in ("close", "ema12", "ma5"):
        ok, bad = _close(got[k], want[k])
        assert ok, (k, bad, got[k][bad], want[k][bad])
    assert np.isnan(got["close"][0]) and got["close"][31] == got["close"][29]


def test_flat_and_rising_prices(spark):
    n = 40
    flat = np.full(n, 10.0)
    got, _ = _collect(indicator_table(_frame(spark, flat, flat, flat, flat, np.full(n, 5.0))),
                      ["rsi", "stoch_k", "williams_r", "cci", "obv", "volatility"])
    assert np.isnan(got["rsi"][20:]).all()          # 0/0
    assert np.isnan(got["stoch_k"][20:]).all()      # zero range
    assert np.isnan(got["cci"][25:]).all()          # zero deviation
    assert (got["obv"] == 0).all()
    assert (got["volatility"][21:] == 0).all()
    up = np.arange(1.0, n + 1)
    got, _ = _collect(indicator_table(_frame(spark, up, up + 0.5, up - 0.5, up, np.full(n, 5.0))),
                      ["rsi", "obv"])
    assert np.isnan(got["rsi"][:13]).all() and (got["rsi"][13:] == 100.0).all()
    assert got["obv"][-1] == 5.0 * (n - 1)


def test_short_series_and_single_row(spark):
    o, h, lo, c, v = _series(3, seed=6)
    got, pdf = _collect(indicator_table(_frame(spark, o, h, lo, c, v)), ["ma5", "ema12", "rsi"])
    assert len(pdf) == 3 and np.isnan(got["ma5"]).all() and not np.isnan(got["ema12"]).any()
    one = indicator_table(_frame(spark, o[:1], h[:1], lo[:1], c[:1], v[:1])).collect()
    assert len(one) == 1 and one[0]["ema12"] == pytest.approx(c[0]) and one[0]["next_close"] is None


def test_symbols_do_not_leak(spark):
    a = _series(120, seed=7)
    b = _series(120, seed=8, start=500.0)
    df = _frame(spark, *a, symbol="A").unionByName(_frame(spark, *b, symbol="B"))
    out = indicator_table(df).orderBy("symbol", "rn").toPandas()
    for sym, arrs in (("A", a), ("B", b)):
        want = np_indicators(*arrs)
        got = out[out.symbol == sym]
        for k in ("ma20", "ema26", "obv", "macd_signal", "next_close"):
            ok, bad = _close(got[k].astype(float).to_numpy(), want[k])
            assert ok, (sym, k, bad)


def test_properties(spark):
    o, h, lo, c, v = _series(400, seed=9)
    pdf = features(_frame(spark, o, h, lo, c, v)).orderBy("rn").toPandas()
    r = pdf["rsi"].dropna()
    assert ((r >= 0) & (r <= 100)).all()
    bb = pdf.dropna(subset=["bb_upper"])
    assert (bb.bb_lower <= bb.bb_middle).all() and (bb.bb_middle <= bb.bb_upper).all()
    k = pdf.dropna(subset=["stoch_k", "williams_r"])
    assert np.allclose(k.williams_r, k.stoch_k - 100, atol=1e-9)
    assert np.allclose(pdf.macd_hist, pdf.macd - pdf.macd_signal, atol=1e-12)
    steps = np.diff(pdf.obv.to_numpy())
    vol = pdf.volume.to_numpy()[1:]
    assert np.all(np.isclose(np.abs(steps), vol) | (steps == 0))


def test_no_look_ahead(spark):
    o, h, lo, c, v = _series(150, seed=10)
    short = indicator_table(_frame(spark, *(x[:100] for x in (o, h, lo, c, v)))).orderBy("rn").toPandas()
    full = indicator_table(_frame(spark, o, h, lo, c, v)).orderBy("rn").toPandas().iloc[:100]
    for k in FEATURES:
        a, b = short[k].astype(float).to_numpy(), full[k].astype(float).to_numpy()
        assert np.allclose(a, b, equal_nan=True, rtol=1e-12), k
