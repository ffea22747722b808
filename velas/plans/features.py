"""The feature table (W25 canonical, W26 analysis) as one lazy plan.

bars -> sequence (rn, forward fill; P1/P2) -> halo blocks -> indicators
-> targets -> home rows -> final forward fill + OBV running sum (P3, W12)
-> drop incomplete rows (P4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.functions.windows import SeriesWindow
from velas.operators.indicators import FEATURES, add_indicators
from velas.operators.targets import ESSENTIAL, TARGETS, add_targets
from velas.plans import layout
from velas.session import materialize
from velas.sources.bars import BAR_COLS

# Column order of the feature table.
OUTPUT = ("symbol", "date", "rn") + FEATURES + ("daily_return",) + TARGETS


def coerce_numeric(rows: DataFrame, columns: tuple[str, ...] = BAR_COLS) -> DataFrame:
    """The columns (the five of a bar) as double; unparsable text becomes NULL, NaN too."""
    out = {}
    for c in columns:
        v = F.expr(f"try_cast(`{c}` as double)")
        out[c] = F.when(~F.isnan(v), v)
    return rows.withColumns(out)


def output_columns(variant: str) -> list[str]:
    cols = list(OUTPUT)
    if variant != "canonical":
        cols.remove("next_volatility")
    return cols


def _indicator_rows(bars: DataFrame, variant: str, block_rows: int, halo: int,
                    extra: tuple[str, ...] = (), hold: bool = True) -> DataFrame:
    """Home rows with raw indicators and targets; OBV still block-local.
    ``extra`` keeps intermediate columns (tp, ma_tp, mad) for inspection."""
    # the bars (far smaller than the tables they come from) are written once:
    # the numbering reads them twice (per-bucket counts and the rows);
    # ``hold=False`` keeps the plan lazy and reads them twice instead
    bars = coerce_numeric(bars)
    seq = layout.sequence(materialize(bars) if hold else bars, fill_cols=list(BAR_COLS))
    blocks = layout.halo_blocks(seq, block_rows=block_rows, back=halo)
    w = SeriesWindow(("symbol", "blk"), "rn")
    df = add_indicators(blocks, w)
    df = add_targets(df, w, variant)
    keep = [c for c in output_columns(variant) if c != "obv"] + ["_signed_vol", "blk", "home"]
    keep += [F.col(f"_{c}").alias(c) for c in extra]
    return df.where(layout.is_home()).select(*keep)


def _finish(df: DataFrame, fill: list[str]) -> DataFrame:
    """Block-local running values (fills, OBV), then the block carry.

    The indicator rows are written once (reliable checkpoint in the shared
    folder): the carry reads them twice (per-block summary and join back),
    and re-running ~40 window operators for the second read costs more than
    the write."""
    df = materialize(df)
    run = SeriesWindow(("symbol", "blk"), "rn").running()
    local = {c: F.last(F.col(c), ignorenulls=True).over(run) for c in fill}
    local["obv"] = F.sum("_signed_vol").over(run)
    return layout.carry_forward(df.withColumns(local), fill, ["obv"])


def indicator_table(bars: DataFrame, variant: str = "canonical",
                    block_rows: int = layout.BLOCK_ROWS, halo: int = layout.HALO_ROWS,
                    extra: tuple[str, ...] = ()) -> DataFrame:
    """Every bar with its raw indicators and targets (no final fill, no drop)."""
    df = _finish(_indicator_rows(bars, variant, block_rows, halo, extra), [])
    return df.select(*output_columns(variant), *extra)


def indicator_columns(bars: DataFrame, columns, variant: str = "canonical",
                      block_rows: int = layout.BLOCK_ROWS, halo: int = layout.HALO_ROWS,
                      extra: tuple[str, ...] = ()) -> DataFrame:
    """Some raw indicators of every bar as one lazy plan: the windows that the
    columns do not need are pruned, and nothing runs while it is built.  Only
    OBV needs the block carry, and with it the written indicator rows."""
    if "obv" in columns:
        return indicator_table(bars, variant, block_rows, halo, extra).select("symbol", "date", "rn", *columns)
    return _indicator_rows(bars, variant, block_rows, halo, extra, hold=False).select(
        "symbol", "date", "rn", *columns)


def features(bars: DataFrame, variant: str = "canonical", label_mode: str = "reference",
             block_rows: int = layout.BLOCK_ROWS, halo: int = layout.HALO_ROWS,
             drop_incomplete: bool = True) -> DataFrame:
    """Indicator and target table, one row per kept bar.

    variant: 'canonical' (with next_volatility) or 'analysis' (without).
    label_mode: 'reference' fills every column forward after the targets,
    so the last bar keeps its predecessor's targets; 'strict' fills only
    the indicators, so the last bar has no targets and is dropped.
    """
    cols = output_columns(variant)
    fill = [c for c in cols if c not in ("symbol", "date", "rn", "obv")]
    if label_mode == "strict":
        fill = [c for c in fill if c not in TARGETS]
    df = _finish(_indicator_rows(bars, variant, block_rows, halo), fill)
    if drop_incomplete:
        df = df.dropna(subset=list(ESSENTIAL[variant]))
    return df.select(*cols)
