"""Registered queries: one callable (spark, sf_dir) -> DataFrame per key.

Every query reads the driver's tables (bars are resampled from ``orders``,
hourly bars from ``events``) and runs over whole tables.  Report outputs are
rounded with ``velas.functions.rounding.SCALES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.functions.rounding import F32, round_report
from velas.operators import backtest, clean, knn, metrics, prep, stats
from velas.operators.indicators import FEATURES, add_signal_flags
from velas.plans import features as fplan
from velas.plans import layout
from velas.session import materialize
from velas.sources import bars as bsrc

# Fixed values used by the registered queries.
SELECTED_SYMBOLS = ["1-URGENT", "3-MEDIUM"]
REQUESTED_SYMBOLS = ["1-URGENT", "3-MEDIUM", "6-UNKNOWN", "ZZZ"]
PERIOD = "1y"
LATEST_ROWS = 5
REPORT_COLUMNS = ("symbol", "date", "rn")


def _bars(spark, sf):
    return bsrc.bars_from_orders(spark, sf)


def _bars_once(spark, sf):
    """Bars written once for queries that read them more than once, so the
    source table is scanned and aggregated a single time."""
    return materialize(_bars(spark, sf))


def _ind(spark, sf, variant="canonical", extra=()):
    return fplan.indicator_table(_bars(spark, sf), variant=variant, extra=extra)


def _feat(spark, sf, variant="canonical", **kw):
    return fplan.features(_bars(spark, sf), variant=variant, **kw)


def _cols(df, *cols):
    return round_report(df.select(*REPORT_COLUMNS, *cols))


def q_build_bars(spark, sf):
    return round_report(_bars(spark, sf))


def q_build_bars_events(spark, sf):
    return round_report(bsrc.bars_from_events(spark, sf))


def q_coerce_numeric(spark, sf):
    ev = bsrc.read_table(spark, sf, "events")
    text = ev.select("event_id", F.col("value").cast("string").alias("value"), F.col("props").alias("props_value"))
    return fplan.coerce_numeric(text, ("value", "props_value"))


def q_ffill(spark, sf):
    seq = layout.sequence(fplan.coerce_numeric(_bars_once(spark, sf)), fill_cols=list(bsrc.BAR_COLS))
    return round_report(seq.select("symbol", "date", "rn", *bsrc.BAR_COLS))


def _indicator_query(*cols, extra=()):
    def q(spark, sf):
        return _cols(fplan.indicator_columns(_bars(spark, sf), cols, extra=extra), *cols)
    return q


q_sma = _indicator_query("ma5", "ma10", "ma20", "ma50", "ma200")
q_ema = _indicator_query("ema12", "ema26")
q_macd = _indicator_query("macd", "macd_signal", "macd_hist")
q_rsi = _indicator_query("rsi")
q_bollinger = _indicator_query("bb_upper", "bb_middle", "bb_lower")
q_stochastic = _indicator_query("stoch_k", "stoch_d")
q_atr = _indicator_query("atr")
q_obv = _indicator_query("obv")
q_roc = _indicator_query("roc")
q_williams_r = _indicator_query("williams_r")
q_cci = _indicator_query("cci")
q_rolling_mad = _indicator_query("tp", "ma_tp", "mad", extra=("tp", "ma_tp", "mad"))
q_momentum = _indicator_query("momentum")
q_volatility = _indicator_query("volatility")
q_daily_return = _indicator_query("daily_return")
q_targets = _indicator_query("next_close", "next_direction", "next_return", "next_volatility")


def q_features(spark, sf):
    return round_report(_feat(spark, sf))


def q_features_analysis(spark, sf):
    return round_report(_feat(spark, sf, "analysis"))


def q_ffill_post(spark, sf):
    return round_report(_feat(spark, sf, drop_incomplete=False))


def q_drop_incomplete(spark, sf):
    bars = _bars_once(spark, sf)
    before = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    after = fplan.features(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_kept"),
                                                     F.min("rn").alias("first_kept_rn"))
    return before.join(after, "symbol", "left")


def q_quality_report(spark, sf):
    return clean.quality_report(_bars(spark, sf))


def q_signal_flags(spark, sf):
    df = add_signal_flags(_feat(spark, sf))
    return _cols(df, "rsi", "rsi_zone", "stoch_k", "stoch_zone")


def q_latest_n(spark, sf):
    return round_report(clean.latest_n(_feat(spark, sf), LATEST_ROWS)
                        .select(*REPORT_COLUMNS, "close", "rsi", "macd", "volatility"))


def q_period_filter(spark, sf):
    return round_report(clean.period_filter(_bars_once(spark, sf), PERIOD))


def q_filter_symbols(spark, sf):
    return round_report(clean.filter_symbols(_bars(spark, sf), SELECTED_SYMBOLS))


def q_unknown_symbols(spark, sf):
    return clean.unknown_symbols(spark, _bars(spark, sf), REQUESTED_SYMBOLS)


def q_feature_projection(spark, sf):
    return round_report(prep.feature_projection(_feat(spark, sf)))


def q_series_profile(spark, sf):
    return clean.series_profile(_bars(spark, sf))


def q_symbol_lookup(spark, sf):
    bars = _bars_once(spark, sf)
    latest = clean.latest_n(layout.sequence(bars), 1).select("symbol", "date", "close")
    return round_report(clean.symbol_lookup(latest, clean.series_profile(bars)))


def q_direction_counts(spark, sf):
    return clean.direction_counts(_feat(spark, sf, "analysis"))


def q_indicator_corr(spark, sf):
    return round_report(stats.indicator_corr(_feat(spark, sf, "analysis")), {"corr": 6})


def q_close_matrix(spark, sf):
    bars = _bars_once(spark, sf)
    return round_report(stats.close_matrix(bars, stats.symbol_list(bars)))


def q_price_corr(spark, sf):
    bars = _bars_once(spark, sf)
    return round_report(stats.price_corr(bars, stats.symbol_list(bars)), {"corr": 6})


def q_return_corr(spark, sf):
    bars = _bars_once(spark, sf)
    return round_report(stats.return_corr(bars, stats.symbol_list(bars)), {"corr": 6})


def q_return_histogram(spark, sf):
    return round_report(stats.return_histogram(_feat(spark, sf, "analysis")),
                        {"bin_low": 6, "bin_high": 6})


def q_return_density(spark, sf):
    return round_report(stats.return_density(_feat(spark, sf, "analysis")),
                        {"x": 6, "density": 6})


def q_chrono_split(spark, sf):
    return prep.split_flags(_feat(spark, sf).select("symbol", "date", "rn"))


def q_impute_mean(spark, sf):
    p = prep.prep_params(_feat(spark, sf))
    return round_report(p.select("symbol", "feature", "ordinal", "fill_mean", "dropped"),
                        {"fill_mean": 4})


def q_standard_scale(spark, sf):
    return round_report(prep.prep_params(_feat(spark, sf)),
                        {"fill_mean": 4, "mean": 4, "sd_pop": 4})


PREP_SCALES = {f: 6 for f in FEATURES}


def q_apply_prep(spark, sf):
    df = prep.prepare(_feat(spark, sf), "next_close")
    return round_report(df.select("symbol", "rn", "idx", "n", "is_train", "label", *FEATURES),
                        dict(PREP_SCALES, label=2))


def _monthly(spark, sf):
    """Monthly bars of all orders: series too short for MA200, which no row has."""
    return fplan.features(bsrc.bars_from_orders(spark, sf, "month"))


def q_apply_prep_monthly(spark, sf):
    df = prep.prepare(_monthly(spark, sf), "next_close")
    return round_report(df.select("symbol", "rn", "idx", "n", "is_train", "label", *FEATURES),
                        dict(PREP_SCALES, label=2))


def q_knn_monthly(spark, sf):
    prepared = prep.prepare(_monthly(spark, sf), "next_close")
    return round_report(knn.knn_predict(prepared, list(FEATURES)), {"y": 2, "p": 4})


def q_feature_manifest(spark, sf):
    return prep.feature_manifest(prep.prep_params(_feat(spark, sf)))


def _knn(spark, sf, target, classify):
    prepared = prep.prepare(_feat(spark, sf), target)
    return knn.knn_predict(prepared, list(FEATURES), classify=classify)


def q_knn_regress(spark, sf):
    return round_report(_knn(spark, sf, "next_close", False), {"y": 2, "p": 4})


def q_knn_classify(spark, sf):
    return round_report(_knn(spark, sf, "next_direction", True), {"prob_up": 6})


def _backtest_pred(spark, sf):
    return backtest.persistence_predictions(backtest.backtest_rows(materialize(_feat(spark, sf))))


def q_backtest_pairs(spark, sf):
    return round_report(_backtest_pred(spark, sf), {"y": 6, "p": 6})


def q_backtest_summary(spark, sf):
    return round_report(backtest.backtest_summary(_backtest_pred(spark, sf)), BACKTEST_SCALES)


BACKTEST_SCALES = {c: F32 for c in ("price_mse", "price_mae", "price_r2", "direction_accuracy",
                                    "direction_precision", "direction_recall", "direction_f1",
                                    "volatility_mse", "volatility_mae", "volatility_r2")}


# --- hold-out predictions of the relational models (KNN, persistence) ---
MODEL_ORDER = [("price", "Persistence", 0), ("price", "KNN", 1),
               ("direction", "Persistence", 0), ("direction", "KNN", 1),
               ("volatility", "Persistence", 0), ("volatility", "KNN", 1)]
TARGET_COLUMNS = {"price": "next_close", "direction": "next_direction",
                  "volatility": "next_volatility"}


def knn_all_targets(feat: DataFrame) -> DataFrame:
    """KNN hold-out predictions for every target from one prepared table and
    one neighbour search: (symbol, target, rn, y, p, prob_up)."""
    prepared = prep.prepare_multi(feat, TARGET_COLUMNS)
    labels = {f"y_{t}": t == "direction" for t in TARGET_COLUMNS}
    out = knn.knn_predict_multi(prepared, list(FEATURES), labels)
    return out.withColumn("target", F.substring(F.col("label"), 3, 100)).drop("label")


def holdout_predictions(spark, sf) -> DataFrame:
    """Long table (symbol, target, model, rn, y, p) on the test split."""
    feat = materialize(_feat(spark, sf))
    parts = [knn_all_targets(feat).select("symbol", "rn", "y", "p", "target")
             .withColumn("model", F.lit("KNN"))]
    test = prep.split_flags(feat).where(~F.col("is_train"))
    for target in TARGET_COLUMNS:
        if target == "price":
            pers = test.select("symbol", "rn", F.col("next_close").alias("y"), F.col("close").alias("p"))
        elif target == "direction":
            pers = test.select("symbol", "rn", F.col("next_direction").cast("double").alias("y"),
                               F.when(F.col("daily_return") > 0, 1.0).otherwise(0.0).alias("p"))
        else:
            pers = test.select("symbol", "rn", F.col("next_volatility").alias("y"),
                               F.col("volatility").alias("p"))
        parts.append(pers.withColumns({"target": F.lit(target), "model": F.lit("Persistence")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("symbol", "target", "model", "rn", F.col("y").cast("double").alias("y"), "p")


def model_order(spark) -> DataFrame:
    return spark.createDataFrame(MODEL_ORDER, "target string, model string, model_ordinal int")


def _metrics_long(spark, sf):
    pred = holdout_predictions(spark, sf)
    reg = metrics.regression_metrics(pred.where("target != 'direction'"))
    cls = metrics.classification_metrics(pred.where("target = 'direction'"))
    return metrics.metrics_long(reg, cls)


MSCALES = {"value": F32, "mse": F32, "mae": F32, "r2": F32, "accuracy": 6, "y": 6, "p": 6}


def q_union_targets(spark, sf):
    return round_report(holdout_predictions(spark, sf), MSCALES)


def q_regression_metrics(spark, sf):
    pred = holdout_predictions(spark, sf)
    return round_report(metrics.regression_metrics(pred.where("target != 'direction'")), MSCALES)


def q_classification_metrics(spark, sf):
    pred = holdout_predictions(spark, sf)
    return round_report(metrics.classification_metrics(pred.where("target = 'direction'")), MSCALES)


def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(holdout_predictions(spark, sf).where("target = 'direction'"))


def q_classification_report(spark, sf):
    rep = metrics.classification_report(holdout_predictions(spark, sf).where("target = 'direction'"))
    return round_report(rep, {c: 6 for c in rep.columns if c not in
                              ("symbol", "target", "model", "n", "support_0", "support_1")})


def q_metrics_pivot(spark, sf):
    return round_report(metrics.metrics_pivot(_metrics_long(spark, sf)), MSCALES)


def q_best_model(spark, sf):
    return round_report(metrics.best_model(_metrics_long(spark, sf), model_order(spark)), MSCALES)


def q_rank_models(spark, sf):
    return round_report(metrics.rank_models(_metrics_long(spark, sf), model_order(spark)), MSCALES)


def q_champions(spark, sf):
    return (metrics.best_model(_metrics_long(spark, sf), model_order(spark))
            .select("symbol", "target", F.col("best_model").alias("model")))


QUERIES = {
    "build_bars": q_build_bars,
    "build_bars_events": q_build_bars_events,
    "coerce_numeric": q_coerce_numeric,
    "ffill": q_ffill,
    "sma": q_sma, "ema": q_ema, "macd": q_macd, "rsi": q_rsi, "bollinger": q_bollinger,
    "stochastic": q_stochastic, "atr": q_atr, "obv": q_obv, "roc": q_roc,
    "williams_r": q_williams_r, "cci": q_cci, "rolling_mad": q_rolling_mad,
    "momentum": q_momentum, "volatility": q_volatility, "daily_return": q_daily_return,
    "targets": q_targets,
    "features": q_features,
    "features_analysis": q_features_analysis,
    "ffill_post": q_ffill_post,
    "drop_incomplete": q_drop_incomplete,
    "quality_report": q_quality_report,
    "signal_flags": q_signal_flags,
    "latest_n": q_latest_n,
    "period_filter": q_period_filter,
    "filter_symbols": q_filter_symbols,
    "unknown_symbols": q_unknown_symbols,
    "feature_projection": q_feature_projection,
    "series_profile": q_series_profile,
    "symbol_lookup": q_symbol_lookup,
    "direction_counts": q_direction_counts,
    "indicator_corr": q_indicator_corr,
    "close_matrix": q_close_matrix,
    "price_corr": q_price_corr,
    "return_corr": q_return_corr,
    "return_histogram": q_return_histogram,
    "return_density": q_return_density,
    "chrono_split": q_chrono_split,
    "impute_mean": q_impute_mean,
    "standard_scale": q_standard_scale,
    "apply_prep": q_apply_prep,
    "apply_prep_monthly": q_apply_prep_monthly,
    "knn_monthly": q_knn_monthly,
    "feature_manifest": q_feature_manifest,
    "knn_regress": q_knn_regress,
    "knn_classify": q_knn_classify,
    "backtest_pairs": q_backtest_pairs,
    "backtest_summary": q_backtest_summary,
    "union_targets": q_union_targets,
    "regression_metrics": q_regression_metrics,
    "classification_metrics": q_classification_metrics,
    "confusion_matrix": q_confusion_matrix,
    "classification_report": q_classification_report,
    "metrics_pivot": q_metrics_pivot,
    "best_model": q_best_model,
    "rank_models": q_rank_models,
    "champions": q_champions,
}
