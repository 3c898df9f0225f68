"""Ticks to bars on a stream: a bar is published once the watermark has passed its close."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import price
from tidemark.schema import InputError, origin, seconds
from tidemark.session import ship

#: Late ticks are dropped once the watermark has passed their bar.
LATENESS = "10 minutes"


def from_ticks(ticks: DataFrame, timeframe: str, *, side: str = "bid", lateness: str = LATENESS) -> DataFrame:
    """Closed bars of a stream of ticks; the last, open bar of each asset waits."""
    order = F.struct("ts", "seq")
    span = F.window("ts", f"{seconds(timeframe)} seconds", None, f"{origin(timeframe) % seconds(timeframe)} seconds")
    rows = ticks.withWatermark("ts", lateness).withColumn("price", price(side)).withColumn("spread", F.col("ask_price") - F.col("bid_price"))
    out = rows.groupBy("asset", span.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        (F.sum("bid_volume") + F.sum("ask_volume")).alias("volume"), F.sum("bid_volume").alias("bid_volume"), F.sum("ask_volume").alias("ask_volume"),
        F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"), F.max_by("spread", order).alias("spread_close"), F.count("*").alias("tick_count"),
    )
    return out.select("asset", F.lit(timeframe).alias("timeframe"), F.col("w.end").alias("ts"), *out.columns[2:])


#: What a trailing measure makes of the last bars of a series, oldest first, with the new one last.
Measure = Callable[[dict[str, np.ndarray]], float]


def trailing(bars: DataFrame, columns: list[str], window: int, measure: Measure, name: str) -> DataFrame:
    """keys, ts and a measure of the last ``window`` bars at each bar, published at its close.

    State is those bars' columns, so it is bounded; bars of a batch are taken in time order, and one
    that isn't later than the series' last is ignored.
    """
    if window < 1:
        raise InputError("a window has a row at least")

    def step(held: dict, x: dict[str, float]) -> dict[str, float | None]:
        for c in columns:
            held[c] = [*held[c], x[c]][-window:]
        return {name: float(measure({c: np.array(held[c]) for c in columns})) if len(held[columns[0]]) == window else None}

    return recurrence(bars, columns, lambda: {c: [] for c in columns}, step, [name])


def recurrence(bars: DataFrame, columns: list[str], begin: Callable[[], dict], step: Callable[[dict, dict[str, float]], dict[str, float | None]], writes: list[str]) -> DataFrame:
    """keys, ts and ``writes`` of a recurrence over each series, published at each bar's close.

    ``step`` takes the state that ``begin`` made, which must stay of bounded size, and a bar's columns; it
    changes the state and gives the bar's measures. Bars of a batch are taken in time order, and one
    that isn't later than the series' last is ignored. State is read and written once a batch.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, held = (state.get[0], pickle.loads(state.get[1])) if state.exists else (-(2**63), begin())
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for ts, *values in rows[["ts", *columns]].itertuples(index=False):
            if ts.value > last:
                last = ts.value
                made = step(held, dict(zip(columns, map(float, values), strict=True)))
                out.append((*key, ts, *(made.get(c) for c in writes)))
        state.update((last, pickle.dumps(held)))
        yield pd.DataFrame(out, columns=["asset", "timeframe", "ts", *writes]).astype(dict.fromkeys(writes, "Float64"))

    ship(bars.sparkSession)
    keyed = bars.select("asset", "timeframe", "ts", *columns).groupBy("asset", "timeframe")
    return keyed.applyInPandasWithState(run, "asset string, timeframe string, ts timestamp, " + ", ".join(f"{c} double" for c in writes), "last long, held binary", "append", "NoTimeout")


def vpin(bars: DataFrame, size: float, window: int) -> DataFrame:
    """vpin_value: the mean imbalance of the last ``window`` full buckets. State is those buckets and the one being filled."""

    def step(held: dict, x: dict[str, float]) -> dict[str, float | None]:
        total = x["ask_volume"] + x["bid_volume"]
        if not math.isfinite(total):
            raise InputError("volumes must be finite")
        units, ratio = total / size, abs(x["ask_volume"] - x["bid_volume"]) / total if total > 0 else 0.0
        while units > 0:
            # many whole buckets of one bar all have its ratio
            if not held["fill"] and units >= window:
                held["closed"], units = [ratio] * window, units - math.floor(units)
                held["closed"] = held["closed"][-window:]
                continue
            part = min(units, 1 - held["fill"])
            held["fill"], held["sum"], units = held["fill"] + part, held["sum"] + part * ratio, units - part
            if 1 - held["fill"] <= 8 * np.finfo(float).eps:
                held["closed"] = [*held["closed"], min(held["sum"], 1.0)][-window:]
                held["fill"] = held["sum"] = 0.0
        return {"vpin_value": sum(held["closed"]) / window if len(held["closed"]) == window else None}

    return recurrence(bars, ["ask_volume", "bid_volume"], lambda: {"closed": [], "fill": 0.0, "sum": 0.0}, step, ["vpin_value"])


def confirmed_pivots(bars: DataFrame, n: int) -> DataFrame:
    """pivot (1 a high, -1 a low, else null) and its value, at the bar that confirms it, ``n`` bars after it. State is 2 n + 1 bars."""

    def step(held: dict, x: dict[str, float]) -> dict[str, float | None]:
        held["high"], held["low"] = [*held["high"], x["high"]][-2 * n - 1 :], [*held["low"], x["low"]][-2 * n - 1 :]
        if len(held["high"]) <= 2 * n:
            return {}
        high, low = held["high"][n], held["low"][n]
        top = high > max(held["high"][:n] + held["high"][n + 1 :])
        bottom = low < min(held["low"][:n] + held["low"][n + 1 :])
        return {"pivot": 1.0 if top else -1.0, "value": high if top else low} if top != bottom else {}

    return recurrence(bars, ["high", "low"], lambda: {"high": [], "low": []}, step, ["pivot", "value"])


def hidden_states(bars: DataFrame, model: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray, columns: list[str]) -> DataFrame:
    """state and probability of a fitted model, filtered forwards. State is one probability for each hidden state."""

    def step(held: dict, x: dict[str, float]) -> dict[str, float | None]:
        row = (np.array([x[c] for c in columns]) - mean) / spread
        if not np.isfinite(row).all():
            return {}
        dense = -0.5 * ((row - model["mean"]) ** 2 / model["var"] + np.log(2 * np.pi * model["var"])).sum(axis=1)
        before = model["start"] if held["p"] is None else np.asarray(held["p"]) @ model["move"]
        level = np.log(np.maximum(before, 1e-300)) + dense
        p = np.exp(level - level.max())
        held["p"] = (p / p.sum()).tolist()
        return {"state": float(np.argmax(held["p"])), "probability": max(held["p"])}

    return recurrence(bars, columns, lambda: {"p": None}, step, ["state", "probability"])


def imbalance(x: dict[str, np.ndarray]) -> float:
    """The mean of the bars' quote imbalance."""
    total = x["ask_volume"] + x["bid_volume"]
    ok = total > 0
    return float(((x["ask_volume"] - x["bid_volume"])[ok] / total[ok]).mean()) if ok.any() else float("nan")


def efficiency(x: dict[str, np.ndarray]) -> float:
    """Net movement over path of the closes."""
    path = np.abs(np.diff(x["close"])).sum()
    return float(abs(x["close"][-1] - x["close"][0]) / path) if path > 0 else float("nan")
