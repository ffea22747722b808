"""Model preparation: feature projection, mean imputation, chronological split,
standard scaling (P6, A1-A3, J4, S10).

Per-symbol statistics are grouped aggregations (partial then final, one row
per symbol) joined back to the rows, never whole-series windows, so a symbol
holding a large share of the rows still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.operators.indicators import FEATURES
from velas.session import materialize

TEST_SIZE = 0.2


def feature_projection(feat: DataFrame, features=FEATURES, keep=("symbol", "date", "rn")) -> DataFrame:
    return feat.select(*keep, *features)


def split_flags(feat: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Add ``idx`` (0-based position in the symbol's kept rows), ``n`` and
    ``is_train`` (first floor(n * (1 - test_size)) rows).

    Kept rows of a series are contiguous in ``rn`` (only leading rows are
    ever dropped), so idx = rn - min(rn)."""
    stats = feat.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("_rn0"))
    df = feat.join(stats, "symbol")
    idx = F.col("rn") - F.col("_rn0")
    cut = F.floor(F.col("n") * F.lit(1.0 - test_size))
    return df.withColumns({"idx": idx, "is_train": idx < cut}).drop("_rn0")


def fit_imputer(df: DataFrame, features=FEATURES, scope: str = "all") -> DataFrame:
    """Per-symbol fill means; a feature with no value at all is marked dropped.

    scope='all' fits on every row (as the reference does, before the split);
    scope='train' fits on training rows only."""
    src = df if scope == "all" else df.where("is_train")
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"_fill_{f}")]
    return src.groupBy("symbol").agg(*aggs)


def apply_imputer(df: DataFrame, fills: DataFrame, features=FEATURES) -> DataFrame:
    out = df.join(fills, "symbol")
    out = out.withColumns({f: F.coalesce(F.col(f), F.col(f"_fill_{f}")) for f in features})
    return out.drop(*[f"_fill_{f}" for f in features])


def usable_features(fills: DataFrame, features=FEATURES) -> DataFrame:
    """(symbol, usable, n_usable): the features a symbol's models use, in order.
    A feature without any value has no fill mean and is left out."""
    names = F.array_compact(F.array(*[F.when(F.col(f"_fill_{f}").isNotNull(), F.lit(f)) for f in features]))
    return fills.select("symbol", names.alias("usable"), F.size(names).alias("n_usable"))


def fit_scaler(imputed: DataFrame, features=FEATURES) -> DataFrame:
    """Mean and population standard deviation over training rows."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"_mean_{f}"), F.stddev_pop(f).alias(f"_sd_{f}")]
    return imputed.where("is_train").groupBy("symbol").agg(*aggs)


def apply_scaler(imputed: DataFrame, scaler: DataFrame, features=FEATURES) -> DataFrame:
    out = imputed.join(scaler, "symbol")
    scaled = {}
    for f in features:
        sd = F.col(f"_sd_{f}")
        # a feature left out (no value at all) is 0 on every row: it then adds nothing
        # to a distance, and any least-squares or penalised fit gives it weight 0
        scaled[f] = F.coalesce((F.col(f) - F.col(f"_mean_{f}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd),
                               F.lit(0.0))
    out = out.withColumns(scaled)
    return out.drop(*[f"_{k}_{f}" for f in features for k in ("mean", "sd")])


def prepare(feat: DataFrame, target: str, features=FEATURES, test_size: float = TEST_SIZE,
            impute_scope: str = "all", checkpoint: bool = True) -> DataFrame:
    """Rows of (symbol, date, rn, idx, n, is_train, label, scaled features).

    A feature that is NULL on every row of a symbol is left out of its models
    (see ``apply_scaler``); ``usable_features`` reports which remain.
    """
    df = split_flags(feat.select("symbol", "date", "rn", *features, F.col(target).alias("label")),
                     test_size)
    if checkpoint:  # the rows feed three passes; read them once
        df = materialize(df)
    imputed = apply_imputer(df, fit_imputer(df, features, impute_scope), features)
    out = apply_scaler(imputed, fit_scaler(imputed, features), features)
    return materialize(out) if checkpoint else out


def prepare_multi(feat: DataFrame, labels: dict[str, str], features=FEATURES,
                  test_size: float = TEST_SIZE, impute_scope: str = "all") -> DataFrame:
    """Like ``prepare`` with several label columns ``y_<name>`` (one per
    target): the rows, imputation and scaling do not depend on the target,
    so every target's models share one prepared table."""
    df = split_flags(feat.select("symbol", "date", "rn", *features,
                                 *[F.col(c).alias(f"y_{n}") for n, c in labels.items()]), test_size)
    df = materialize(df)
    imputed = apply_imputer(df, fit_imputer(df, features, impute_scope), features)
    return materialize(apply_scaler(imputed, fit_scaler(imputed, features), features))


def prep_params(feat: DataFrame, features=FEATURES, test_size: float = TEST_SIZE,
                impute_scope: str = "all", checkpoint: bool = True) -> DataFrame:
    """Long table (symbol, feature, ordinal, fill_mean, mean, sd_pop, dropped)."""
    df = split_flags(feat.select("symbol", "rn", *features), test_size)
    if checkpoint:
        df = materialize(df)
    fills = fit_imputer(df, features, impute_scope)
    scaler = fit_scaler(apply_imputer(df, fills, features), features)
    wide = fills.join(scaler, "symbol")
    entries = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ordinal"),
                        F.col(f"_fill_{f}").alias("fill_mean"), F.col(f"_mean_{f}").alias("mean"),
                        F.col(f"_sd_{f}").alias("sd_pop"))
               for i, f in enumerate(features)]
    long = wide.select("symbol", F.explode(F.array(*entries)).alias("p")).select("symbol", "p.*")
    return long.withColumn("dropped", F.col("fill_mean").isNull())


def feature_manifest(params: DataFrame) -> DataFrame:
    """Ordered list of the features a symbol's models use."""
    return (params.where(~F.col("dropped"))
            .select("symbol", "ordinal", "feature"))
