"""Window expressions shared by the detectors, all on one specification so that one sort serves them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schema import KEYS


def series() -> WindowSpec:
    """Rows of a series in time order."""
    return Window.partitionBy(*KEYS).orderBy("ts")


def trailing(n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return series().rowsBetween(-(n - 1), 0)


def past(n: int) -> WindowSpec:
    """The n rows before this one."""
    return series().rowsBetween(-n, -1)


def ahead(n: int, include_now: bool = False) -> WindowSpec:
    return series().rowsBetween(0 if include_now else 1, n)


def upto() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def guarded(agg: Column, x: Column, over: WindowSpec, least: int) -> Column:
    """An aggregate that is null unless the frame holds ``least`` values that are not null."""
    return F.when(F.count(x).over(over) >= least, agg.over(over))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(series())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(x, n).over(series())


def true_range() -> Column:
    previous = F.coalesce(lag("close"), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def atr(n: int, least: int = 1) -> Column:
    return guarded(F.avg("true_range"), F.col("true_range"), trailing(n), least)


def log_return() -> Column:
    return F.ln(F.try_divide(F.col("close"), lag("close")))


def direction(n: int) -> Column:
    return F.signum(F.col("close") - lag("close", n))


def quantile(x: str, q: float, window: int, least: int) -> Column:
    """The linearly interpolated quantile of the rows before this one."""
    return guarded(F.percentile(F.col(x), F.lit(q)), F.col(x), past(window), least)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def from_margin(margin: Column) -> Column:
    return 0.5 + 0.5 * clip01(F.coalesce(margin, F.lit(0.0)))
