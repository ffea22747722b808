"""Independent DuckDB formulations of the engine's queries (the oracle).

Written directly in SQL over the driver's tables: plain windows partitioned
by symbol, a recursive CTE for the EMA family, explicit CASE guards for
division by zero.  Only the report rounding (``SCALES``) is shared with the
Spark side, so both engines print the same digits.
"""

from __future__ import annotations

import math

from velas.functions.rounding import SCALES
from velas.operators.indicators import (
    ATR_WINDOW, BB_WIDTH, BB_WINDOW, CCI_CONSTANT, CCI_WINDOW, EMA_FAST, EMA_SIGNAL,
    EMA_SLOW, MA_WINDOWS, MOMENTUM_LAG, ROC_LAG, RSI_WINDOW, STOCH_SMOOTH, STOCH_WINDOW,
    VOL_WINDOW, ANNUALISATION,
)


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def r(name: str, src: str | None = None) -> str:
    src = src or name
    if name in SCALES:
        return f"round({src}, {SCALES[name]}) + 0.0 AS {name}"
    return f"{src} AS {name}"


def full(x: str, n: int, agg: str) -> str:
    frame = f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


BARS_ORDERS = """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
       arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2
"""

BARS_MONTHLY = """
SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date,
       arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2
"""

BARS_EVENTS = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
       arg_min(value, event_id) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, event_id) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2
"""


def ctes_features(variant: str = "canonical", bars_sql: str = BARS_ORDERS) -> str:
    """WITH-list ending in a CTE ``feat`` = the feature table (unrounded)."""
    a = {s: 2.0 / (s + 1) for s in (EMA_FAST, EMA_SLOW, EMA_SIGNAL)}
    d = {s: 1.0 - a[s] for s in a}
    ma_cols = ",\n  ".join(f"{full('close', n, 'avg')} AS ma{n}" for n in MA_WINDOWS)
    rng = "(high_max - low_min)"
    sqrt252 = repr(math.sqrt(ANNUALISATION))
    fill_cols = ["open", "high", "low", "close", "volume"]
    ffill = ",\n  ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in fill_cols)
    targets = ["next_close", "next_direction", "next_return"]
    if variant == "canonical":
        targets.append("next_volatility")
    feat_cols = ["open", "high", "low", "close", "volume", "ma5", "ma10", "ma20", "ma50",
                 "ma200", "ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi",
                 "bb_upper", "bb_middle", "bb_lower", "stoch_k", "stoch_d", "atr", "obv", "roc",
                 "williams_r", "cci", "momentum", "volatility", "daily_return"] + targets
    post_fill = ",\n  ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in feat_cols if c != "obv")
    nvol = (",\n  lead(volatility) OVER (PARTITION BY symbol ORDER BY rn) AS next_volatility"
            if variant == "canonical" else "")
    essential = ["close", "next_close", "next_direction"] + (
        ["next_volatility"] if variant == "canonical" else [])
    return f"""
bars AS ({bars_sql}),
seq0 AS (
  SELECT symbol, date, {ffill}
  FROM bars),
seq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS BIGINT) AS rn
  FROM seq0),
ema(symbol, rn, ema12, ema26, macd_signal) AS (
  SELECT symbol, rn, close, close, close - close FROM seq WHERE rn = 0
  UNION ALL
  SELECT s.symbol, s.rn,
         {a[EMA_FAST]!r} * s.close + {d[EMA_FAST]!r} * e.ema12,
         {a[EMA_SLOW]!r} * s.close + {d[EMA_SLOW]!r} * e.ema26,
         {a[EMA_SIGNAL]!r} * (({a[EMA_FAST]!r} * s.close + {d[EMA_FAST]!r} * e.ema12)
                            - ({a[EMA_SLOW]!r} * s.close + {d[EMA_SLOW]!r} * e.ema26))
           + {d[EMA_SIGNAL]!r} * e.macd_signal
  FROM ema e JOIN seq s ON s.symbol = e.symbol AND s.rn = e.rn + 1),
l1 AS (
  SELECT s.*, e.ema12, e.ema26, e.ema12 - e.ema26 AS macd, e.macd_signal,
         (e.ema12 - e.ema26) - e.macd_signal AS macd_hist,
         lag(close, 1) OVER (PARTITION BY s.symbol ORDER BY s.rn) AS prev_close,
         lag(close, {MOMENTUM_LAG}) OVER (PARTITION BY s.symbol ORDER BY s.rn) AS lag_m,
         lag(close, {ROC_LAG}) OVER (PARTITION BY s.symbol ORDER BY s.rn) AS lag_r,
         (high + low + close) / 3.0::DOUBLE AS tp
  FROM seq s JOIN ema e ON s.symbol = e.symbol AND s.rn = e.rn),
l2 AS (
  SELECT *,
  {ma_cols},
  {full('close', BB_WINDOW, 'stddev_samp')} AS sd20,
  {full('low', STOCH_WINDOW, 'min')} AS low_min,
  {full('high', STOCH_WINDOW, 'max')} AS high_max,
  {full('tp', CCI_WINDOW, 'avg')} AS ma_tp,
  list(tp) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {CCI_WINDOW - 1} PRECEDING AND CURRENT ROW) AS tp_list
  FROM l1),
l3 AS (
  SELECT *,
  CASE WHEN close - prev_close > 0 THEN close - prev_close ELSE 0.0 END AS gain,
  CASE WHEN close - prev_close < 0 THEN prev_close - close ELSE 0.0 END AS loss,
  greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
  coalesce(sign(close - prev_close) * volume, 0.0) AS signed_vol,
  {div('close', 'prev_close')} - 1.0 AS daily_return,
  ma20 AS bb_middle,
  ma20 + {BB_WIDTH!r} * sd20 AS bb_upper,
  ma20 - {BB_WIDTH!r} * sd20 AS bb_lower,
  100.0 * {div('close - low_min', rng)} AS stoch_k,
  -100.0 * {div('high_max - close', rng)} + 0.0 AS williams_r,
  ({div('close', 'lag_r')} - 1.0) * 100.0 AS roc,
  close - lag_m AS momentum,
  list_reduce(tp_list, lambda x, y: x + y) / {float(CCI_WINDOW)!r} AS tp_mean
  FROM l2),
l4 AS (
  SELECT *,
  {full('gain', RSI_WINDOW, 'avg')} AS avg_gain,
  {full('loss', RSI_WINDOW, 'avg')} AS avg_loss,
  {full('tr', ATR_WINDOW, 'avg')} AS atr,
  ({full('daily_return', VOL_WINDOW, 'stddev_samp')}) * {sqrt252} AS volatility,
  {full('stoch_k', STOCH_SMOOTH, 'avg')} AS stoch_d,
  CASE WHEN len(tp_list) = {CCI_WINDOW} THEN
    list_reduce(list_transform(tp_list, lambda v: abs(v - tp_mean)), lambda x, y: x + y) / {float(CCI_WINDOW)!r}
  END AS mad,
  sum(coalesce(sign(close - prev_close) * volume, 0.0)) OVER (PARTITION BY symbol ORDER BY rn
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv
  FROM l3),
l5 AS (
  SELECT *,
  CASE WHEN avg_loss = 0 THEN (CASE WHEN avg_gain > 0 THEN 100.0 END)
       ELSE 100.0 - 100.0 / (1.0 + {div('avg_gain', 'avg_loss')}) END AS rsi,
  {div('tp - ma_tp', f'{CCI_CONSTANT!r} * mad')} AS cci,
  lead(close) OVER (PARTITION BY symbol ORDER BY rn) AS next_close,
  coalesce(CAST(lead(close) OVER (PARTITION BY symbol ORDER BY rn) > close AS INTEGER), 0) AS next_direction,
  {div('lead(close) OVER (PARTITION BY symbol ORDER BY rn)', 'close')} - 1.0 AS next_return{nvol}
  FROM l4),
filled AS (
  SELECT symbol, date, rn, obv,
  {post_fill}
  FROM l5),
feat AS (
  SELECT symbol, date, rn, {", ".join(feat_cols)}
  FROM filled
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in essential)})"""


def features_sql(variant: str = "canonical", bars_sql: str = BARS_ORDERS) -> str:
    cols = ["symbol", "date", "rn", "open", "high", "low", "close", "volume", "ma5", "ma10",
            "ma20", "ma50", "ma200", "ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi",
            "bb_upper", "bb_middle", "bb_lower", "stoch_k", "stoch_d", "atr", "obv", "roc",
            "williams_r", "cci", "momentum", "volatility", "daily_return", "next_close",
            "next_direction", "next_return"] + (
        ["next_volatility"] if variant == "canonical" else [])
    return f"WITH RECURSIVE {ctes_features(variant, bars_sql)}\nSELECT {', '.join(r(c) for c in cols)} FROM feat"


# ---------------------------------------------------------------------------
# Per-key oracle SQL
# ---------------------------------------------------------------------------
from velas.functions.rounding import F32  # noqa: E402
from velas.functions.rounding import sql_round as _sr  # noqa: E402
from velas.operators.indicators import FEATURES  # noqa: E402

REPORT = ["symbol", "date", "rn"]


def _w(variant="canonical", bars_sql=BARS_ORDERS):
    return f"WITH RECURSIVE {ctes_features(variant, bars_sql)}"


def _sel(cols, scales=None, src="l5", where=""):
    return f"SELECT {', '.join(_sr(c, scales) for c in cols)} FROM {src} {where}"


def split_cte(src="feat"):
    return f"""sp AS (
  SELECT f.*, f.rn - s.rn0 AS idx, s.n, (f.rn - s.rn0) < floor(s.n * CAST({1.0 - 0.2!r} AS DOUBLE)) AS is_train
  FROM {src} f JOIN (SELECT symbol, count(*) AS n, min(rn) AS rn0 FROM {src} GROUP BY symbol) s USING (symbol))"""


def prep_ctes(target: str, features=FEATURES, sfx: str = "", with_split: bool = True):
    fills = ", ".join(f"avg({f}) AS fill_{f}" for f in features)
    imp = ", ".join(f"coalesce(sp.{f}, fl{sfx}.fill_{f}) AS {f}" for f in features)
    sc = ", ".join(f"avg({f}) AS mean_{f}, stddev_pop({f}) AS sd_{f}" for f in features)
    scaled = ", ".join(
        f"coalesce((im{sfx}.{f} - sc{sfx}.mean_{f}) / (CASE WHEN sc{sfx}.sd_{f} = 0 THEN 1.0 ELSE sc{sfx}.sd_{f} END), 0.0) AS {f}"
        for f in features)
    head = f"{split_cte()},\n" if with_split else ""
    return f"""{head}fl{sfx} AS (SELECT symbol, {fills} FROM sp GROUP BY symbol),
im{sfx} AS (SELECT sp.symbol, sp.date, sp.rn, sp.idx, sp.n, sp.is_train, sp.{target} AS label, {imp}
       FROM sp JOIN fl{sfx} USING (symbol)),
sc{sfx} AS (SELECT symbol, {sc} FROM im{sfx} WHERE is_train GROUP BY symbol),
pr{sfx} AS (SELECT im{sfx}.symbol, im{sfx}.date, im{sfx}.rn, im{sfx}.idx, im{sfx}.n, im{sfx}.is_train,
       im{sfx}.label, {scaled}
       FROM im{sfx} JOIN sc{sfx} USING (symbol))"""


def prep_params_sql(scales):
    fills = ", ".join(f"avg({f}) AS fill_{f}" for f in FEATURES)
    imp = ", ".join(f"coalesce(sp.{f}, fl.fill_{f}) AS {f}" for f in FEATURES)
    sc = ", ".join(f"avg({f}) AS mean_{f}, stddev_pop({f}) AS sd_{f}" for f in FEATURES)
    parts = " UNION ALL ".join(
        f"SELECT fl.symbol, '{f}' AS feature, {i} AS ordinal, fl.fill_{f} AS fill_mean, "
        f"sc.mean_{f} AS mean, sc.sd_{f} AS sd_pop FROM fl JOIN sc USING (symbol)"
        for i, f in enumerate(FEATURES))
    return f"""{_w()},
{split_cte()},
fl AS (SELECT symbol, {fills} FROM sp GROUP BY symbol),
im AS (SELECT sp.symbol, sp.is_train, {imp} FROM sp JOIN fl USING (symbol)),
sc AS (SELECT symbol, {sc} FROM im WHERE is_train GROUP BY symbol),
pp AS ({parts})
SELECT symbol, feature, CAST(ordinal AS INTEGER) AS ordinal, {_sr('fill_mean', scales)},
       {_sr('mean', scales)}, {_sr('sd_pop', scales)}, fill_mean IS NULL AS dropped FROM pp"""


def knn_ctes(target: str, classify: bool, k: int = 5, sfx: str = "", with_split: bool = True,
             queries: str = "NOT q.is_train"):
    terms = ", ".join(f"(q.{f} - t.{f}) * (q.{f} - t.{f})" for f in FEATURES)
    # same left-to-right summation as the Spark side
    dist = f"sqrt(list_reduce([0.0::DOUBLE, {terms}], lambda a, b: a + b))"
    return f"""{prep_ctes(target, sfx=sfx, with_split=with_split)},
pairs{sfx} AS (
  SELECT q.symbol, q.rn, q.label AS y, t.rn AS t_rn, t.label AS t_label, {dist} AS dist
  FROM pr{sfx} q JOIN pr{sfx} t ON q.symbol = t.symbol AND {queries} AND t.is_train),
ranked{sfx} AS (SELECT *, row_number() OVER (PARTITION BY symbol, rn ORDER BY dist, t_rn) AS nn_rank
  FROM pairs{sfx}),
knn{sfx} AS (SELECT symbol, rn, any_value(y) AS y, avg(CAST(t_label AS DOUBLE)) AS share
        FROM ranked{sfx} WHERE nn_rank <= {k} GROUP BY symbol, rn)"""


def holdout_ctes():
    out = [_w()[len("WITH RECURSIVE "):], split_cte()]
    parts = []
    for target, col in (("price", "next_close"), ("direction", "next_direction"),
                        ("volatility", "next_volatility")):
        classify = target == "direction"
        out.append(knn_ctes(col, classify, sfx=f"_{target}", with_split=False))
        p = "CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END" if classify else "share"
        parts.append(f"SELECT symbol, '{target}' AS target, 'KNN' AS model, rn, CAST(y AS DOUBLE) AS y, "
                     f"CAST({p} AS DOUBLE) AS p FROM knn_{target}")
        if target == "price":
            pers = "CAST(next_close AS DOUBLE) AS y, close AS p"
        elif target == "direction":
            pers = ("CAST(next_direction AS DOUBLE) AS y, "
                    "CAST(CASE WHEN daily_return > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS p")
        else:
            pers = "CAST(next_volatility AS DOUBLE) AS y, volatility AS p"
        parts.append(f"SELECT symbol, '{target}' AS target, 'Persistence' AS model, rn, {pers} "
                     f"FROM sp WHERE NOT is_train")
    out.append("pred AS (" + " UNION ALL ".join(parts) + ")")
    return "WITH RECURSIVE " + ",\n".join(out)


def regression_metrics_select(src: str, keys="symbol, target, model"):
    return f"""SELECT {keys}, count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae,
  1.0 - (CASE WHEN var_pop(y) * count(*) = 0 THEN NULL
         ELSE sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END) AS r2
  FROM {src} GROUP BY {keys}"""


def class_report_select(src: str, keys="symbol, target, model"):
    c = {f"c{a}{b}": f"sum(CASE WHEN y = {a} AND p = {b} THEN 1 ELSE 0 END)" for a in (0, 1) for b in (0, 1)}

    def ratio(n, d):
        return f"(CASE WHEN ({d}) = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"
    prec = {0: ratio("c00", "c00 + c10"), 1: ratio("c11", "c11 + c01")}
    rec = {0: ratio("c00", "c00 + c01"), 1: ratio("c11", "c11 + c10")}
    return f"""cnt AS (SELECT {keys}, count(*) AS n, {', '.join(f'{v} AS {k}' for k, v in c.items())}
  FROM {src} GROUP BY {keys}),
pr1 AS (SELECT *, {prec[0]} AS precision_0, {rec[0]} AS recall_0, c00 + c01 AS support_0,
                  {prec[1]} AS precision_1, {rec[1]} AS recall_1, c11 + c10 AS support_1 FROM cnt),
pr2 AS (SELECT *,
  CASE WHEN precision_0 + recall_0 = 0 THEN 0.0 ELSE 2 * precision_0 * recall_0 / (precision_0 + recall_0) END AS f1_0,
  CASE WHEN precision_1 + recall_1 = 0 THEN 0.0 ELSE 2 * precision_1 * recall_1 / (precision_1 + recall_1) END AS f1_1
  FROM pr1),
rep AS (SELECT {keys}, n, precision_0, recall_0, support_0, precision_1, recall_1, support_1, f1_0, f1_1,
  CAST(c00 + c11 AS DOUBLE) / CAST(n AS DOUBLE) AS accuracy,
  (precision_0 + precision_1) / 2.0 AS macro_precision,
  (precision_0 * CAST(support_0 AS DOUBLE) + precision_1 * CAST(support_1 AS DOUBLE)) / CAST(n AS DOUBLE) AS weighted_precision,
  (recall_0 + recall_1) / 2.0 AS macro_recall,
  (recall_0 * CAST(support_0 AS DOUBLE) + recall_1 * CAST(support_1 AS DOUBLE)) / CAST(n AS DOUBLE) AS weighted_recall,
  (f1_0 + f1_1) / 2.0 AS macro_f1,
  (f1_0 * CAST(support_0 AS DOUBLE) + f1_1 * CAST(support_1 AS DOUBLE)) / CAST(n AS DOUBLE) AS weighted_f1
  FROM pr2)"""


MODEL_ORDER_SQL = """mo AS (SELECT * FROM (VALUES ('price', 'Persistence', 0), ('price', 'KNN', 1),
  ('direction', 'Persistence', 0), ('direction', 'KNN', 1), ('volatility', 'Persistence', 0),
  ('volatility', 'KNN', 1)) t(target, model, model_ordinal))"""


def metrics_long_ctes():
    return f"""{holdout_ctes()},
reg AS ({regression_metrics_select("pred WHERE target <> 'direction'")}),
cls AS (SELECT symbol, target, model, count(*) AS n,
        avg(CAST(y = p AS DOUBLE)) AS accuracy FROM pred WHERE target = 'direction'
        GROUP BY symbol, target, model),
ml AS (SELECT symbol, target, model, 'mse' AS metric, mse AS value FROM reg
  UNION ALL SELECT symbol, target, model, 'mae', mae FROM reg
  UNION ALL SELECT symbol, target, model, 'r2', r2 FROM reg
  UNION ALL SELECT symbol, target, model, 'accuracy', accuracy FROM cls),
{MODEL_ORDER_SQL},
ranked AS (SELECT ml.*, mo.model_ordinal, row_number() OVER (PARTITION BY symbol, ml.target ORDER BY
    (CASE WHEN metric = 'accuracy' THEN -value ELSE value END) ASC NULLS LAST, mo.model_ordinal) AS rank
  FROM ml JOIN mo ON ml.target = mo.target AND ml.model = mo.model
  WHERE metric IN ('mse', 'accuracy'))"""


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["build_bars"] = _sel(["symbol", "date", "open", "high", "low", "close", "volume"], src=f"({BARS_ORDERS})")
    q["build_bars_events"] = _sel(["symbol", "date", "open", "high", "low", "close", "volume"],
                                  src=f"({BARS_EVENTS})")
    q["coerce_numeric"] = ("SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value, "
                           "TRY_CAST(props AS DOUBLE) AS props_value FROM events")
    q["ffill"] = f"{_w()} " + _sel(REPORT + ["open", "high", "low", "close", "volume"], src="seq")
    raw = {
        "sma": ["ma5", "ma10", "ma20", "ma50", "ma200"], "ema": ["ema12", "ema26"],
        "macd": ["macd", "macd_signal", "macd_hist"], "rsi": ["rsi"],
        "bollinger": ["bb_upper", "bb_middle", "bb_lower"], "stochastic": ["stoch_k", "stoch_d"],
        "atr": ["atr"], "obv": ["obv"], "roc": ["roc"], "williams_r": ["williams_r"], "cci": ["cci"],
        "rolling_mad": ["tp", "ma_tp", "mad"], "momentum": ["momentum"],
        "volatility": ["volatility"], "daily_return": ["daily_return"],
        "targets": ["next_close", "next_direction", "next_return", "next_volatility"],
    }
    for key, cols in raw.items():
        q[key] = f"{_w()} " + _sel(REPORT + cols)
    q["features"] = features_sql("canonical")
    q["features_analysis"] = features_sql("analysis")
    fcols = ["symbol", "date", "rn"] + list(FEATURES) + [
        "daily_return", "next_close", "next_direction", "next_return", "next_volatility"]
    q["ffill_post"] = f"{_w()} " + _sel(fcols, src="filled")
    q["drop_incomplete"] = (f"{_w()} SELECT b.symbol, b.n_bars, f.n_kept, f.first_kept_rn FROM "
                            "(SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol) b LEFT JOIN "
                            "(SELECT symbol, count(*) AS n_kept, min(rn) AS first_kept_rn FROM feat GROUP BY symbol) f "
                            "USING (symbol)")
    q["quality_report"] = f"""SELECT symbol, count(*) AS n_rows,
  sum(CASE WHEN open = 0 THEN 1 ELSE 0 END) AS n_zero_open,
  sum(CASE WHEN low > least(open, close) OR high < greatest(open, close) OR low > high THEN 1 ELSE 0 END) AS n_bad_range,
  count(*) < 10 AS few_rows
FROM ({BARS_ORDERS}) GROUP BY symbol"""
    zone = ("CASE WHEN {x} >= {u} THEN 'overbought' WHEN {x} <= {l} THEN 'oversold' "
            "WHEN {x} IS NOT NULL THEN 'neutral' END")
    q["signal_flags"] = (f"{_w()} SELECT symbol, date, rn, {_sr('rsi')}, "
                         f"{zone.format(x='rsi', u='70.0', l='30.0')} AS rsi_zone, {_sr('stoch_k')}, "
                         f"{zone.format(x='stoch_k', u='80.0', l='20.0')} AS stoch_zone FROM feat")
    q["latest_n"] = (f"{_w()} " + _sel(REPORT + ["close", "rsi", "macd", "volatility"], src="feat",
                     where="QUALIFY rn > max(rn) OVER (PARTITION BY symbol) - 5"))
    q["period_filter"] = (f"WITH b AS ({BARS_ORDERS}) " + _sel(
        ["symbol", "date", "open", "high", "low", "close", "volume"], src="b",
        where="QUALIFY date > max(date) OVER (PARTITION BY symbol) - INTERVAL 12 MONTH"))
    q["filter_symbols"] = (f"WITH b AS ({BARS_ORDERS}) " + _sel(
        ["symbol", "date", "open", "high", "low", "close", "volume"], src="b",
        where="WHERE symbol IN ('1-URGENT', '3-MEDIUM')"))
    q["unknown_symbols"] = (f"SELECT symbol FROM (VALUES ('1-URGENT'), ('3-MEDIUM'), ('6-UNKNOWN'), ('ZZZ')) t(symbol) "
                            f"WHERE symbol NOT IN (SELECT DISTINCT o_orderpriority FROM orders)")
    q["feature_projection"] = f"{_w()} " + _sel(REPORT + list(FEATURES), src="feat")
    q["series_profile"] = (f"SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows "
                           f"FROM ({BARS_ORDERS}) GROUP BY symbol")
    q["symbol_lookup"] = (f"WITH b AS ({BARS_ORDERS}), p AS (SELECT symbol, min(date) AS first_date, "
                          f"max(date) AS last_date, count(*) AS n_rows FROM b GROUP BY symbol) "
                          f"SELECT b.symbol, b.date, {_sr('close', src='b.close')}, p.first_date, p.last_date, p.n_rows "
                          f"FROM b JOIN p ON b.symbol = p.symbol AND b.date = p.last_date")
    q["direction_counts"] = (f"{_w('analysis')} SELECT symbol, next_direction, count(*) AS n FROM feat "
                             f"GROUP BY symbol, next_direction")
    corr_cols = ["close", "volume", "rsi", "macd", "atr", "volatility", "obv", "roc", "cci", "momentum"]
    pairs = " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM feat GROUP BY symbol"
                               for a in corr_cols for b in corr_cols)
    q["indicator_corr"] = f"{_w('analysis')}, pc AS ({pairs}) " + _sel(["symbol", "a", "b", "corr"], {"corr": 6}, "pc")
    cm = f"""b AS ({BARS_ORDERS}),
syms AS (SELECT DISTINCT symbol FROM b),
first_dates AS (SELECT date FROM b WHERE symbol = (SELECT min(symbol) FROM b)),
cm AS (SELECT d.date, s.symbol, x.close FROM first_dates d CROSS JOIN syms s
       LEFT JOIN b x ON x.symbol = s.symbol AND x.date = d.date)"""
    q["close_matrix"] = f"WITH {cm} " + _sel(["date", "symbol", "close"], src="cm")
    q["price_corr"] = (f"WITH {cm}, pc AS (SELECT l.symbol AS a, r.symbol AS b, corr(l.close, r.close) AS corr "
                       f"FROM cm l JOIN cm r ON l.date = r.date GROUP BY l.symbol, r.symbol) "
                       + _sel(["a", "b", "corr"], {"corr": 6}, "pc"))
    q["return_corr"] = f"""WITH {cm},
pad AS (SELECT date, symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM cm),
ret AS (SELECT date, symbol, {div('c', 'lag(c) OVER (PARTITION BY symbol ORDER BY date)')} - 1.0 AS r FROM pad),
complete AS (SELECT date FROM ret GROUP BY date HAVING count(r) = count(*)),
rr AS (SELECT ret.* FROM ret JOIN complete USING (date)),
pc AS (SELECT l.symbol AS a, r.symbol AS b, corr(l.r, r.r) AS corr FROM rr l JOIN rr r ON l.date = r.date
       GROUP BY l.symbol, r.symbol)
""" + _sel(["a", "b", "corr"], {"corr": 6}, "pc")
    q["return_histogram"] = f"""{_w('analysis')},
rt AS (SELECT symbol, daily_return FROM feat WHERE daily_return IS NOT NULL),
rg AS (SELECT symbol, min(daily_return) AS lo, max(daily_return) AS hi FROM rt GROUP BY symbol),
bn AS (SELECT rt.symbol, least(floor((daily_return - lo) / (hi - lo) * 100.0), 99) + 1 AS bin
       FROM rt JOIN rg USING (symbol)),
cnt AS (SELECT symbol, bin, count(*) AS n FROM bn GROUP BY symbol, bin),
grid AS (SELECT symbol, lo, hi, CAST(g.bin AS BIGINT) AS bin FROM rg CROSS JOIN range(1, 101) g(bin))
SELECT grid.symbol, CAST(grid.bin AS INTEGER) AS bin,
  {_sr('bin_low', {'bin_low': 6}, 'lo + (grid.bin - 1) * ((hi - lo) / 100.0)')},
  {_sr('bin_high', {'bin_high': 6}, 'lo + grid.bin * ((hi - lo) / 100.0)')},
  coalesce(cnt.n, 0) AS n
FROM grid LEFT JOIN cnt ON grid.symbol = cnt.symbol AND grid.bin = cnt.bin"""
    q["return_density"] = f"""{_w('analysis')},
rt AS (SELECT symbol, daily_return FROM feat WHERE daily_return IS NOT NULL),
st0 AS (SELECT symbol, count(*) AS n, stddev_samp(daily_return) AS sd, min(daily_return) AS lo,
        max(daily_return) AS hi FROM rt GROUP BY symbol),
st AS (SELECT *, pow(CAST(n AS DOUBLE), -0.2) * sd AS bw FROM st0),
st2 AS (SELECT *, lo - 3.0 * bw AS g0, (hi - lo + 6.0 * bw) / 199.0 AS step FROM st),
pts AS (SELECT st2.symbol, g.point, g0 + g.point * step AS x, n, bw FROM st2 CROSS JOIN range(0, 200) g(point)),
dens AS (SELECT p.symbol, p.point, any_value(p.x) AS x,
         sum(exp(-0.5 * ((p.x - rt.daily_return) / p.bw) * ((p.x - rt.daily_return) / p.bw)))
           / (any_value(p.n) * any_value(p.bw) * {math.sqrt(2 * math.pi)!r}) AS density
         FROM pts p JOIN rt ON p.symbol = rt.symbol GROUP BY p.symbol, p.point)
SELECT symbol, CAST(point AS INTEGER) AS point, {_sr('x', {'x': 6})}, {_sr('density', {'density': 6})} FROM dens"""
    q["chrono_split"] = f"{_w()}, {split_cte()} SELECT symbol, date, rn, n, idx, is_train FROM sp"
    q["impute_mean"] = ("SELECT symbol, feature, ordinal, fill_mean, dropped FROM ("
                        + prep_params_sql({"fill_mean": 4, "mean": 4, "sd_pop": 4}) + ")")
    q["standard_scale"] = prep_params_sql({"fill_mean": 4, "mean": 4, "sd_pop": 4})
    ps = dict({f: 6 for f in FEATURES}, label=2)
    q["apply_prep"] = (f"{_w()}, {prep_ctes('next_close')} "
                       + _sel(["symbol", "rn", "idx", "n", "is_train", "label"] + list(FEATURES), ps, "pr"))
    q["feature_manifest"] = ("SELECT symbol, ordinal, feature FROM ("
                             + prep_params_sql({}) + ") WHERE NOT dropped")
    q["knn_regress"] = (f"{_w()}, {knn_ctes('next_close', False)} SELECT symbol, rn, "
                        f"{_sr('y', {'y': 2})}, {_sr('p', {'p': 4}, 'share')} FROM knn")
    monthly = _w(bars_sql=BARS_MONTHLY)
    q["apply_prep_monthly"] = (f"{monthly}, {prep_ctes('next_close')} "
                               + _sel(["symbol", "rn", "idx", "n", "is_train", "label"] + list(FEATURES), ps, "pr"))
    q["knn_monthly"] = (f"{monthly}, {knn_ctes('next_close', False)} SELECT symbol, rn, "
                        f"{_sr('y', {'y': 2})}, {_sr('p', {'p': 4}, 'share')} FROM knn")
    q["knn_classify"] = (f"{_w()}, {knn_ctes('next_direction', True)} SELECT symbol, rn, "
                         f"CAST(y AS DOUBLE) AS y, CAST(CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS p, "
                         f"{_sr('prob_up', {'prob_up': 6}, 'share')} FROM knn")
    bt = f"""{_w()}, {split_cte()},
btr AS (SELECT * FROM sp WHERE idx >= n - 60 AND idx < n - 1),
btp AS (
  SELECT symbol, rn, date, is_train AS in_sample, 'price' AS target, next_close AS y, close AS p FROM btr
  UNION ALL SELECT symbol, rn, date, is_train, 'direction', CAST(next_direction AS DOUBLE),
    CAST(CASE WHEN daily_return > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) FROM btr
  UNION ALL SELECT symbol, rn, date, is_train, 'volatility', next_volatility, volatility FROM btr)"""
    q["backtest_pairs"] = (bt + " SELECT symbol, rn, date, in_sample, target, "
                           f"{_sr('y', {'y': 6})}, {_sr('p', {'p': 6})}, 'persistence' AS model FROM btp")
    f32 = {c: F32 for c in ("price_mse", "price_mae", "price_r2", "direction_accuracy", "direction_precision",
                            "direction_recall", "direction_f1", "volatility_mse", "volatility_mae",
                            "volatility_r2")}
    def summary(head: str) -> str:
        return f"""{head},
reg AS ({regression_metrics_select("pred WHERE target <> 'direction'")}),
{class_report_select("pred WHERE target = 'direction'")}
SELECT pz.symbol, {_sr('price_mse', f32, 'pz.mse')}, {_sr('price_mae', f32, 'pz.mae')}, {_sr('price_r2', f32, 'pz.r2')},
  {_sr('direction_accuracy', f32, 'rep.accuracy')}, {_sr('direction_precision', f32, 'rep.weighted_precision')},
  {_sr('direction_recall', f32, 'rep.weighted_recall')}, {_sr('direction_f1', f32, 'rep.weighted_f1')},
  {_sr('volatility_mse', f32, 'vz.mse')}, {_sr('volatility_mae', f32, 'vz.mae')}, {_sr('volatility_r2', f32, 'vz.r2')}
FROM (SELECT * FROM reg WHERE target = 'price') pz
JOIN rep ON rep.symbol = pz.symbol
JOIN (SELECT * FROM reg WHERE target = 'volatility') vz ON vz.symbol = pz.symbol"""

    q["backtest_summary"] = summary(
        f"{bt}, pred AS (SELECT symbol, target, 'persistence' AS model, y, p FROM btp)")
    knns, picks = [], []
    for target, col in (("price", "next_close"), ("direction", "next_direction"), ("volatility", "next_volatility")):
        knns.append(knn_ctes(col, target == "direction", sfx=f"_{target}", with_split=False,
                             queries="q.idx >= q.n - 60 AND q.idx < q.n - 1"))
        p = "CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END" if target == "direction" else "share"
        picks.append(f"SELECT symbol, '{target}' AS target, 'KNN' AS model, CAST(y AS DOUBLE) AS y, "
                     f"CAST({p} AS DOUBLE) AS p FROM knn_{target}")
    q["backtest_summary_knn"] = summary(
        f"{_w()}, {split_cte()}, {', '.join(knns)}, pred AS ({' UNION ALL '.join(picks)})")
    models = [(t, m) for t in ("price", "volatility")
              for m in ("Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet")]
    models.append(("direction", "Logistic Regression"))
    values = ", ".join(f"('{t}', '{m}')" for t, m in models)
    q["score_loaded"] = (f"{_w()}, {split_cte()}, spec(target, model) AS (VALUES {values}) "
                         "SELECT symbol, target, model, count(*) AS n, count(*) AS n_same "
                         "FROM sp, spec WHERE NOT is_train GROUP BY symbol, target, model")
    q["model_roundtrip"] = (f"{_w()}, {split_cte()}, spec(target, model) AS (VALUES {values}) "
                            "SELECT symbol, model, count(*) AS n, count(*) AS n_same FROM sp, spec "
                            "WHERE NOT is_train AND target = 'price' GROUP BY symbol, model")
    ms = {"value": F32, "mse": F32, "mae": F32, "r2": F32, "accuracy": 6, "y": 6, "p": 6}
    q["union_targets"] = (holdout_ctes() + " " + _sel(["symbol", "target", "model", "rn", "y", "p"], ms, "pred"))
    q["regression_metrics"] = (holdout_ctes() + ", reg AS ("
                               + regression_metrics_select("pred WHERE target <> 'direction'") + ") "
                               + _sel(["symbol", "target", "model", "n", "mse", "mae", "r2"], ms, "reg"))
    q["classification_metrics"] = (holdout_ctes() + ", cls AS (SELECT symbol, target, model, count(*) AS n, "
                                   "avg(CAST(y = p AS DOUBLE)) AS accuracy FROM pred WHERE target = 'direction' "
                                   "GROUP BY symbol, target, model) "
                                   + _sel(["symbol", "target", "model", "n", "accuracy"], ms, "cls"))
    cm_cells = " UNION ALL ".join(
        f"SELECT symbol, target, model, {a} AS actual, {b} AS predicted, "
        f"CAST(sum(CASE WHEN y = {a} AND p = {b} THEN 1 ELSE 0 END) AS BIGINT) AS n "
        f"FROM pred WHERE target = 'direction' GROUP BY symbol, target, model"
        for a in (0, 1) for b in (0, 1))
    q["confusion_matrix"] = (holdout_ctes() + f", cmx AS ({cm_cells}) "
                             "SELECT symbol, target, model, CAST(actual AS INTEGER) AS actual, "
                             "CAST(predicted AS INTEGER) AS predicted, n FROM cmx")
    rep_cols = ["symbol", "target", "model", "n", "precision_0", "recall_0", "support_0", "precision_1",
                "recall_1", "support_1", "f1_0", "f1_1", "accuracy", "macro_precision", "weighted_precision",
                "macro_recall", "weighted_recall", "macro_f1", "weighted_f1"]
    rs = {c: 6 for c in rep_cols if c not in ("symbol", "target", "model", "n", "support_0", "support_1")}
    q["classification_report"] = (holdout_ctes() + ", "
                                  + class_report_select("pred WHERE target = 'direction'") + " "
                                  + _sel(rep_cols, rs, "rep"))
    q["metrics_pivot"] = (metrics_long_ctes() + " SELECT symbol, target, model, "
                          + ", ".join(_sr(m, ms, f"max(CASE WHEN metric = '{m}' THEN value END)")
                                      for m in ("mse", "mae", "r2", "accuracy"))
                          + " FROM ml GROUP BY symbol, target, model")
    q["best_model"] = (metrics_long_ctes() + " SELECT symbol, target, model AS best_model, metric, "
                       + _sr("value", ms) + " FROM ranked WHERE rank = 1")
    q["rank_models"] = (metrics_long_ctes() + " SELECT symbol, target, model, metric, "
                        + _sr("value", ms) + ", CAST(rank AS INTEGER) AS rank FROM ranked")
    q["champions"] = metrics_long_ctes() + " SELECT symbol, target, model FROM ranked WHERE rank = 1"
    return q


def oracle_queries_extra() -> dict[str, str]:
    """Connectors and chart tables (model fits have no SQL oracle)."""
    q: dict[str, str] = {}
    q["sink_features"] = features_sql("canonical")
    q["union_symbols"] = _sel(["symbol", "date", "open", "high", "low", "close", "volume"], src=f"({BARS_ORDERS})")
    q["scan_bars"] = _sel(["symbol", "date", "open", "high", "low", "close", "volume"], src=f"({BARS_ORDERS})")
    q["parse_event_props"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
    q["epoch_to_date"] = ("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, "
                          "CAST(ts AS DATE) AS date FROM events")
    q["chart_price_history"] = f"{_w('analysis')} " + _sel(
        ["symbol", "date", "close", "ma50", "ma200", "volume"], src="feat")
    panels = {"rsi": ("rsi",), "macd": ("macd", "macd_signal", "macd_hist"),
              "bollinger": ("close", "bb_upper", "bb_middle", "bb_lower"),
              "stochastic": ("stoch_k", "stoch_d"), "volatility": ("volatility",)}
    parts = " UNION ALL ".join(f"SELECT symbol, date, '{p}' AS panel, '{s}' AS series, {s} AS value FROM feat"
                               for p, ss in panels.items() for s in ss)
    q["chart_indicators"] = (f"{_w('analysis')}, ci AS ({parts}) "
                             + _sel(["symbol", "date", "panel", "series", "value"], {"value": F32}, "ci"))
    fitted = ("Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet", "Logistic Regression")
    models = ", ".join(f"('{m}')" for m in fitted)
    q["fit_optimality"] = (f"{_w()}, {split_cte()} SELECT symbol, model, CAST(count(*) AS BIGINT) AS n, "
                           f"CAST(0 AS BIGINT) AS n_violated FROM sp, (VALUES {models}) AS f(model) "
                           "WHERE is_train GROUP BY symbol, model")
    q["margin_optimality"] = (f"{_w()}, {split_cte()} SELECT symbol, CAST(count(*) AS BIGINT) AS n, "
                              "CAST(0 AS BIGINT) AS n_violated FROM sp WHERE is_train GROUP BY symbol")
    regress = ("Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet", "Random Forest",
               "Gradient Boosting", "SVR", "KNN", "XGBoost")
    classify = ("Logistic Regression", "Random Forest", "Gradient Boosting", "SVC", "KNN", "MLP", "XGBoost")
    pairs = ", ".join(f"('{t}', '{m}')" for t, ms in (("price", regress), ("volatility", regress), ("direction", classify))
                      for m in ms)
    q["bakeoff_coverage"] = (f"{_w()}, {split_cte()} SELECT symbol, target, model, CAST(count(*) AS BIGINT) AS n, "
                             "CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_finite "
                             f"FROM sp, (VALUES {pairs}) AS f(target, model) WHERE NOT is_train GROUP BY symbol, target, model")
    q["backtest_persistence"] = oracle_queries()["backtest_pairs"]
    return q
