"""Next-bar targets (W21-W24) and the essential-column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velas.functions.windows import SeriesWindow, safe_div

TARGETS = ("next_close", "next_direction", "next_return", "next_volatility")

# Rows missing any of these after the final fill are dropped.
ESSENTIAL = {
    "canonical": ("close", "next_close", "next_direction", "next_volatility"),
    "analysis": ("close", "next_close", "next_direction"),
}


def add_targets(df: DataFrame, w: SeriesWindow, variant: str = "canonical") -> DataFrame:
    """One-row leads.  The direction is computed before any fill, so a missing
    next close gives 0 (a missing comparison counts as 'not up')."""
    nxt = F.lead("close", 1).over(w.base)
    cols = {
        "next_close": nxt,
        "next_direction": F.coalesce((nxt > F.col("close")).cast("int"), F.lit(0)),
        "next_return": safe_div(nxt, F.col("close")) - F.lit(1.0),
    }
    if variant == "canonical":
        cols["next_volatility"] = F.lead("volatility", 1).over(w.base)
    return df.withColumns(cols)
