"""Window-expression helpers shared by the indicator operators.

All series logic is row-offset based (ROWS frames): bars are ordered by their
row index ``rn`` inside a partition.  A partition is either a whole series
(``symbol``) or one block of a long series plus its halo rows
(``symbol, blk``); see ``velas.plans.layout``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesWindow:
    """Partition and order columns of one series layout."""

    partition: tuple[str, ...] = ("symbol",)
    order: str = "rn"

    @property
    def base(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(self.order)

    def trailing(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.base.rowsBetween(-(n - 1), 0)

    def running(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        """All earlier rows of the partition, excluding the current one."""
        return self.base.rowsBetween(Window.unboundedPreceding, -1)


def full(w: SeriesWindow, x: Column | str, n: int, agg: Callable[[Column], Column]) -> Column:
    """Aggregate over a trailing window of n rows, NULL unless all n are non-NULL.

    Mirrors a rolling window whose minimum number of observations equals its
    length.
    """
    x = F.col(x) if isinstance(x, str) else x
    frame = w.trailing(n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def rolling_list(w: SeriesWindow, x: str, n: int) -> Column:
    """The trailing n values as an array (bounded: at most n elements)."""
    return F.collect_list(F.col(x)).over(w.trailing(n))


def list_mean(vals: Column, n: int) -> Column:
    return F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(n))


def list_mad(vals: Column, mean: Column, n: int) -> Column:
    """Mean absolute deviation of a full n-element array around ``mean``.

    ``mean`` should be a plain column reference (computed in an earlier
    projection) so it is not re-evaluated per element.  JVM higher-order
    functions only; no Python runs per row.
    """
    dev = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean)) / F.lit(float(n))
    return F.when(F.size(vals) == n, dev)


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL instead of failing or producing inf/NaN."""
    return F.try_divide(a, b)
