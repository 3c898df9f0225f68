"""Timeframes, series identity and the checks that every input passes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds of each timeframe; weeks begin on a Monday.
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800}
WEEK_ORIGIN = 4 * 86400
UNKNOWN = "INCONNU"
KEYS = ["asset", "timeframe"]
PRICES = ["open", "high", "low", "close"]
VOLUMES = ["volume", "bid_volume", "ask_volume"]
IDENTITY = ["source", "price_side", "adjustment", "calendar"]


class InputError(ValueError):
    """An input that breaks its contract."""


@dataclass(frozen=True)
class SeriesMeta:
    """What is known of a series beside its rows; carried along, never read from the rows."""

    asset: str | None = None
    timeframe: str | None = None
    price_side: str | None = None
    source: str | None = None
    source_type: str | None = None
    calendar: str | None = None
    timestamp_convention: str = "close"
    source_timezone: str = "UTC"
    fill_seconds: int | None = None

    def with_(self, **changes: object) -> SeriesMeta:
        return replace(self, **changes)


@dataclass(frozen=True)
class BarFrame:
    """Bars with their series' description."""

    df: DataFrame
    meta: SeriesMeta


def seconds(timeframe: str) -> int:
    if timeframe not in TIMEFRAMES:
        raise InputError(f"unknown timeframe {timeframe!r}; known: {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[timeframe]


def origin(timeframe: str) -> int:
    return WEEK_ORIGIN if timeframe == "W1" else 0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bar_end(ts: Column, timeframe: str, closed: str) -> Column:
    """The close label of the bar that an instant falls in: [T-p, T) if closed left, (T-p, T] if right."""
    step, base = seconds(timeframe) * 1_000_000, origin(timeframe) * 1_000_000
    shifted = micros(ts) - F.lit(base)
    into = F.pmod(shifted, F.lit(step)) if closed == "left" else F.pmod(shifted - 1, F.lit(step)) + 1
    return F.timestamp_micros(shifted - into + step + base)


def unaligned(ts: Column, timeframe: str) -> Column:
    """Whether a label lies off its timeframe's grid."""
    return F.pmod(micros(ts) - F.lit(origin(timeframe) * 1_000_000), F.lit(seconds(timeframe) * 1_000_000)) != 0


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"missing columns: {', '.join(missing)}")


def finite(x: Column) -> Column:
    """Null for NaN and infinities; null is the only missing value within the library."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
