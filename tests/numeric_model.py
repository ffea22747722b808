"""Plain-numpy statement of the indicator definitions, used as a test oracle.

Written as explicit loops over one series (no window machinery), following
deviations, recursive EMA, simple-mean RSI, final forward fill, and the
essential-column drop.
"""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def _full(x, n, fn):
    out = np.full(len(x), NAN)
    for i in range(n - 1, len(x)):
        w = x[i - n + 1:i + 1]
        if not np.isnan(w).any():
            out[i] = fn(w)
    return out


def _lag(x, k):
    out = np.full(len(x), NAN)
    out[k:] = x[:-k] if k else x
    return out


def _ratio(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(b == 0, NAN, a / np.where(b == 0, 1, b))
    return r


def _ema(x, span):
    a = 2.0 / (span + 1)
    out = np.full(len(x), NAN)
    prev = None
    for i, v in enumerate(x):
        if np.isnan(v):
            continue
        prev = v if prev is None else a * v + (1 - a) * prev
        out[i] = prev
    return out


def indicators(o, h, lo, c, v):
    o, h, lo, c, v = (np.asarray(t, dtype=float) for t in (o, h, lo, c, v))
    # forward fill inputs
    for arr in (o, h, lo, c, v):
        for i in range(1, len(arr)):
            if np.isnan(arr[i]):
                arr[i] = arr[i - 1]
    f = {"open": o, "high": h, "low": lo, "close": c, "volume": v}
    for n in (5, 10, 20, 50, 200):
        f[f"ma{n}"] = _full(c, n, np.mean)
    f["ema12"], f["ema26"] = _ema(c, 12), _ema(c, 26)
    f["macd"] = f["ema12"] - f["ema26"]
    f["macd_signal"] = _ema(f["macd"], 9)
    f["macd_hist"] = f["macd"] - f["macd_signal"]
    prev = _lag(c, 1)
    delta = c - prev
    gain = np.where(delta > 0, delta, 0.0)
    loss = np.where(delta < 0, -delta, 0.0)
    ag, al = _full(gain, 14, np.mean), _full(loss, 14, np.mean)
    rsi = np.full(len(c), NAN)
    for i in range(len(c)):
        if np.isnan(al[i]):
            continue
        if al[i] == 0:
            rsi[i] = 100.0 if ag[i] > 0 else NAN
        else:
            rsi[i] = 100 - 100 / (1 + ag[i] / al[i])
    f["rsi"] = rsi
    sd20 = _full(c, 20, lambda w: np.std(w, ddof=1))
    f["bb_middle"] = f["ma20"]
    f["bb_upper"], f["bb_lower"] = f["ma20"] + 2 * sd20, f["ma20"] - 2 * sd20
    lmin, hmax = _full(lo, 14, np.min), _full(h, 14, np.max)
    f["stoch_k"] = 100 * _ratio(c - lmin, hmax - lmin)
    f["stoch_d"] = _full(f["stoch_k"], 3, np.mean)
    tr = np.nanmax(np.vstack([h - lo, np.abs(h - prev), np.abs(lo - prev)]), axis=0)
    f["atr"] = _full(tr, 14, np.mean)
    f["obv"] = np.cumsum(np.nan_to_num(np.sign(delta) * v, nan=0.0))
    f["roc"] = (_ratio(c, _lag(c, 10)) - 1) * 100
    f["williams_r"] = -100 * _ratio(hmax - c, hmax - lmin) + 0.0
    tp = (h + lo + c) / 3
    mtp = _full(tp, 20, np.mean)
    mad = _full(tp, 20, lambda w: np.mean(np.abs(w - w.mean())))
    f["cci"] = _ratio(tp - mtp, 0.015 * mad)
    f["momentum"] = c - _lag(c, 4)
    ret = _ratio(c, prev) - 1
    f["volatility"] = _full(ret, 21, lambda w: np.std(w, ddof=1)) * math.sqrt(252)
    f["daily_return"] = ret
    nxt = np.append(c[1:], NAN)
    f["next_close"] = nxt
    with np.errstate(invalid="ignore"):
        f["next_direction"] = np.where(np.isnan(nxt), 0, (nxt > c).astype(int)).astype(float)
    f["next_return"] = _ratio(nxt, c) - 1
    f["next_volatility"] = np.append(f["volatility"][1:], NAN)
    return f


def features(o, h, lo, c, v, essential=("close", "next_close", "next_direction", "next_volatility")):
    """Indicators, final forward fill of every column, then the drop."""
    f = indicators(o, h, lo, c, v)
    n = len(c)
    for k, arr in f.items():
        arr = arr.copy()
        for i in range(1, n):
            if np.isnan(arr[i]):
                arr[i] = arr[i - 1]
        f[k] = arr
    keep = np.ones(n, dtype=bool)
    for k in essential:
        keep &= ~np.isnan(f[k])
    return {k: arr[keep] for k, arr in f.items()}, np.nonzero(keep)[0]
