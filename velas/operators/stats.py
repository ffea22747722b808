"""Correlations, return distribution and the cross-symbol close matrix
(A13-A17, J1).

The list of symbols is a small dimension, but no plan has a column or an
expression per symbol: the close matrix stays in long rows, and correlations
across symbols come from tiles of symbols x symbols over chunks of dates.
Date-ordered steps use month buckets plus a small carry table, so no single
task holds all dates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The indicator set of the correlation report, histogram bins,
# density grid size and tail cut (in bandwidths).
CORR_COLUMNS = ("close", "volume", "rsi", "macd", "atr", "volatility", "obv", "roc", "cci",
                "momentum")
HIST_BINS = 100
DENSITY_GRID = 200
DENSITY_CUT = 3.0
CORR_TILE = 128  # symbols in a tile of a correlation matrix
CORR_DAYS = 128  # days in a chunk of dates


def _long_pairs(wide: DataFrame, keys: list[str], names: list[str], prefix: str) -> DataFrame:
    """Full matrix in long form from the upper triangle (corr is symmetric)."""
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                        F.col(f"{prefix}{min(i, j)}_{max(i, j)}").alias("corr"))
               for i, a in enumerate(names) for j, b in enumerate(names)]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_p")).select(*keys, "_p.*")


def indicator_corr(feat: DataFrame, columns=CORR_COLUMNS) -> DataFrame:
    """Pearson correlation of every indicator pair per symbol (pairwise complete)."""
    cols = list(columns)
    aggs = [F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)
            if i <= j]
    wide = feat.groupBy("symbol").agg(*aggs)
    return _long_pairs(wide, ["symbol"], cols, "c")


def symbol_list(bars: DataFrame) -> list[str]:
    """The symbol universe (a small dimension, collected as metadata)."""
    return sorted(r[0] for r in bars.select("symbol").distinct().collect())


def close_matrix(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """(date, symbol, close) for every date of the first symbol and every
    symbol, NULL where that symbol has no bar: a left join on the first
    symbol's dates, as the reference's column assignment does.  Rows stay
    long, so the plan has the same size for any number of symbols."""
    dates = bars.where(F.col("symbol") == symbols[0]).select("date")
    cells = dates.select("date", F.explode(F.lit(symbols)).alias("symbol"))
    closes = bars.groupBy("date", "symbol").agg(F.first("close").alias("close"))
    return cells.join(closes, ["date", "symbol"], "left")


def _pair_sums(values: DataFrame, size: int, tile: int) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over the dates on which both series
    i <= j have a value, from long rows (date, i, v).

    Series are cut into tiles and dates into chunks of ``CORR_DAYS`` days; each row goes to
    all tile pairs of its tile, and a task holds two tiles of one chunk."""
    n_tiles = -(-size // tile)
    own = F.floor(F.col("i") / tile).cast("int")
    rows = values.where("v is not null").select(
        F.floor(F.unix_date(F.to_date("date")) / CORR_DAYS).alias("chunk"), "date", "i", "v",
        own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("other"))
    rows = rows.select("chunk", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"),
                       "date", "i", "v")

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, ti, tj = key
        day = np.unique(pdf["date"].to_numpy(), return_inverse=True)[1]
        i, v = pdf["i"].to_numpy(), pdf["v"].to_numpy()

        def block(t: int) -> tuple[np.ndarray, np.ndarray]:
            width = min(tile, size - t * tile)
            x, m = np.zeros((day.max() + 1, width)), np.zeros((day.max() + 1, width))
            mine = i // tile == t
            x[day[mine], i[mine] - t * tile] = v[mine]
            m[day[mine], i[mine] - t * tile] = 1.0
            return x, m

        (x, mx), (y, my) = block(ti), block(tj)
        out = {"n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y),
               "sxy": x.T @ y}
        a, b = np.nonzero(out["n"])
        keep = a + ti * tile <= b + tj * tile
        a, b = a[keep], b[keep]
        return pd.DataFrame({"i": a + ti * tile, "j": b + tj * tile, **{k: m[a, b] for k, m in out.items()}})

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = rows.groupBy("chunk", "ti", "tj").applyInPandas(
        sums, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])


def pairwise_corr(values: DataFrame, symbols: list[str], tile: int = CORR_TILE) -> DataFrame:
    """(a, b, corr) for all ordered pairs of symbols from long rows (date,
    symbol, v), one per date and symbol: Pearson over the dates that both have,
    NULL with fewer than two or without variance.

    Sums are taken of each series' distance from its smallest value, which
    leaves the correlation as it is and a flat series exactly zero."""
    spark, size = values.sparkSession, len(symbols)
    index = F.broadcast(spark.createDataFrame([(i, s) for i, s in enumerate(symbols)], "i int, symbol string"))
    low = values.groupBy("symbol").agg(F.min("v").alias("low"))
    moved = values.join(low, "symbol").join(index, "symbol").select("date", "i", (F.col("v") - F.col("low")).alias("v"))
    sums = _pair_sums(moved, size, tile)
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    root = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
    corr = sums.select("i", "j", F.when(F.col("n") >= 2, F.try_divide(cov, root)).alias("corr"))
    grid = spark.range(size * size).select((F.col("id") / size).cast("int").alias("p"),
                                           (F.col("id") % size).cast("int").alias("q"))
    grid = grid.select("p", "q", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    named = F.lit(symbols)
    return grid.join(corr, ["i", "j"], "left").select(
        F.get(named, F.col("p")).alias("a"), F.get(named, F.col("q")).alias("b"), "corr")


def price_corr(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Pairwise-complete correlation of closes on the first symbol's dates."""
    return pairwise_corr(close_matrix(bars, symbols).withColumnRenamed("close", "v"), symbols)


def padded_returns(matrix: DataFrame) -> DataFrame:
    """(date, symbol, v): percent change after forward fill along each symbol's
    dates, from the long close matrix.

    Two levels: fill and lag inside (symbol, month) buckets, and a per-bucket
    table carrying each symbol's last value into its next bucket."""
    df = matrix.withColumn("_tb", F.date_trunc("month", F.col("date")))
    w = Window.partitionBy("symbol", "_tb").orderBy("date")
    df = df.withColumn("_f", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_p", F.lag("_f").over(w))
    last = df.groupBy("symbol", "_tb").agg(F.max_by("_f", "date").alias("_l"))
    earlier = Window.partitionBy("symbol").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("symbol", "_tb", F.last("_l", ignorenulls=True).over(earlier).alias("_c"))
    df = df.join(carry, ["symbol", "_tb"])
    return df.select("date", "symbol",
                     (F.try_divide(F.coalesce("_f", "_c"), F.coalesce("_p", "_c")) - F.lit(1.0)).alias("v"))


def return_corr(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Correlation of padded percent changes after dropping any incomplete date."""
    rets = padded_returns(close_matrix(bars, symbols))
    whole = rets.groupBy("date").agg(F.count("v").alias("n")).where(F.col("n") == len(symbols)).select("date")
    return pairwise_corr(rets.join(whole, "date", "left_semi"), symbols)


def return_histogram(feat: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of daily returns per symbol (right edge in last bin)."""
    r = feat.where(F.col("daily_return").isNotNull()).select("symbol", "daily_return")
    rng = r.groupBy("symbol").agg(F.min("daily_return").alias("lo"), F.max("daily_return").alias("hi"))
    # a flat series has no width: widen its range by half a unit on both sides
    flat = F.col("hi") == F.col("lo")
    rng = rng.select("symbol", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    pos = F.try_divide(F.col("daily_return") - F.col("lo"), F.col("hi") - F.col("lo")) * F.lit(float(bins))
    binned = r.join(rng, "symbol").withColumn(
        "bin", F.least(F.floor(pos), F.lit(bins - 1)) + 1)
    counts = binned.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("symbol", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    out = grid.join(counts, ["symbol", "bin"], "left").select(
        "symbol", F.col("bin").cast("int").alias("bin"),
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_low"),
        (F.col("lo") + F.col("bin") * width).alias("bin_high"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    return out


def return_density(feat: DataFrame, grid: int = DENSITY_GRID, cut: float = DENSITY_CUT) -> DataFrame:
    """Gaussian kernel density of daily returns on an evenly spaced grid.

    Bandwidth by Scott's rule (n^(-1/5) times the sample standard
    deviation); the grid spans [min - cut*bw, max + cut*bw].  Every return
    adds its kernel to the sums of all grid points."""
    r = feat.where(F.col("daily_return").isNotNull()).select("symbol", "daily_return")
    st = r.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("daily_return").alias("sd"),
        F.min("daily_return").alias("lo"), F.max("daily_return").alias("hi"))
    st = st.withColumn("bw", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd"))
    st = st.withColumns({"g0": F.col("lo") - F.lit(cut) * F.col("bw"),
                         "step": (F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("bw"))
                         / F.lit(float(grid - 1))})
    near = r.join(st, "symbol").select("symbol", "daily_return", "g0", "step", "bw")

    def kernel_sums(batches):
        """One row of grid sums per symbol and batch, so no return is copied per grid point."""
        for pdf in batches:
            for symbol, one in pdf.groupby("symbol", sort=False):
                g0, step, bw = (float(one[c].iloc[0]) for c in ("g0", "step", "bw"))
                if bw > 0:  # no bandwidth (flat series): NULL density
                    u = (g0 + step * np.arange(grid)[None, :] - one["daily_return"].to_numpy()[:, None]) / bw
                    yield pd.DataFrame({"symbol": [symbol], "sums": [np.exp(-0.5 * u * u).sum(axis=0)]})

    sums = (near.mapInPandas(kernel_sums, "symbol string, sums array<double>")
            .select("symbol", F.posexplode("sums").alias("point", "_v"))
            .groupBy("symbol", "point").agg(F.sum("_v").alias("_s")))
    points = st.select("symbol", "n", "bw", "g0", "step", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    dens = points.join(sums, ["symbol", "point"], "left")
    norm = F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))
    return dens.select("symbol", F.col("point").cast("int").alias("point"),
                       (F.col("g0") + F.col("point") * F.col("step")).alias("x"),
                       F.try_divide(F.col("_s"), norm).alias("density"))
