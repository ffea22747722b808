"""Recursive exponential moving average without a sequential loop.

The recursive form is y0 = x0, y_t = a*x_t + d*y_{t-1} with a = 2/(span+1)
and d = 1 - a.  It is evaluated with window sums in three steps:

1. rows are cut into sub-blocks of S rows (k = row offset from the first
   valid value, sb = k div S, p = k mod S);
2. inside a sub-block, L_k = d^p * sum_{j<=k} t_j * d^(-p_j) where t_0 = x_0
   and t_j = a*x_j otherwise (a running window sum over (partition, sb));
   d^(-p) stays below 1e17 because S is small;
3. the value at the end of the previous sub-block is carried in:
   y_k = L_k + d^(p+1) * C,  C = y at the end of sub-block sb-1.  C is
   E_{sb-1} + d^S*E_{sb-2} + d^2S*E_{sb-3} ..., read with ``last(...)`` over
   earlier rows; terms are added until d^(mS) < 1e-17, so the truncation is
   below double precision.

Everything is a window expression over the caller's partition (the series
or one halo block of it), so a long series is not forced into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velas.functions.windows import SeriesWindow

SUB_BLOCK = 176  # rows per sub-block; d^-(S-1) < 1e17 for every span >= 9


def ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def carry_terms(span: int, sub: int = SUB_BLOCK) -> int:
    """How many earlier sub-block ends are needed for 1e-17 precision."""
    d = 1.0 - ema_alpha(span)
    per = sub * -math.log(d)
    return max(1, math.ceil(17 * math.log(10) / per))


def add_emas(df: DataFrame, w: SeriesWindow, x: str, spans: dict[str, int],
             q: str = "_q", sub: int = SUB_BLOCK) -> DataFrame:
    """Append one column per ``{out: span}`` = recursive EMA of ``x`` along ``w``.

    EMAs of the same input share the offsets, sub-blocks and window layers;
    per-row terms are inlined, so the plan has one layer per window step
    (first valid row, sub-block sums, each carry term).
    ``q`` must be the 0-based row offset inside the partition (consecutive).
    Leading NULLs of x give NULL; x must have no inner NULLs (forward-filled).
    """
    fv = "_" + "_".join(spans) + "_fv"
    # running minimum: equals the first valid offset on every row at or after
    # it (and is NULL before it), without buffering the whole partition
    df = df.withColumn(fv, F.min(F.when(F.col(x).isNotNull(), F.col(q))).over(w.running()))
    k = F.col(q) - F.col(fv)
    sb = F.when(k >= 0, F.floor(k / sub))
    p = F.when(k >= 0, k % sub)
    decay = {out: 1.0 - ema_alpha(span) for out, span in spans.items()}
    run_sub = Window.partitionBy(*w.partition, sb).orderBy(w.order).rowsBetween(
        Window.unboundedPreceding, 0)
    sums = {}
    for out, span in spans.items():
        t = F.when(k == 0, F.col(x)).otherwise(F.lit(ema_alpha(span)) * F.col(x))
        sums[f"_{out}_lsum"] = F.sum(t * F.pow(F.lit(decay[out]), -p)).over(run_sub)
    df = df.withColumns(sums)
    local = {out: F.pow(F.lit(decay[out]), p) * F.col(f"_{out}_lsum") for out in spans}
    # carry: value at the end of the previous sub-block, refined term by term
    is_end = p == sub - 1
    terms = {out: carry_terms(span, sub) for out, span in spans.items()}
    carry = {out: F.lit(0.0) for out in spans}
    for i in range(max(terms.values())):
        layer = {}
        for out in spans:
            if i >= terms[out]:
                continue
            end_value = local[out] + F.lit(decay[out] ** sub) * carry[out]
            layer[f"_{out}_c{i}"] = F.coalesce(
                F.last(F.when(is_end, end_value), ignorenulls=True).over(w.before()), F.lit(0.0))
        df = df.withColumns(layer)
        carry.update({out: F.col(f"_{out}_c{i}") for out in spans if i < terms[out]})
    values = {out: F.when(k >= 0, local[out] + F.pow(F.lit(decay[out]), p + 1) * carry[out])
              for out in spans}
    drop = [fv] + [f"_{out}_lsum" for out in spans]
    drop += [f"_{out}_c{i}" for out in spans for i in range(terms[out])]
    keep = [c for c in df.columns if c not in set(drop) and c not in values]
    return df.select(*keep, *[v.alias(o) for o, v in values.items()])


def add_ema(df: DataFrame, w: SeriesWindow, x: str, out: str, span: int,
            q: str = "_q", sub: int = SUB_BLOCK) -> DataFrame:
    """Append column ``out`` = recursive EMA of ``x`` along ``w``."""
    return add_emas(df, w, x, {out: span}, q, sub)
