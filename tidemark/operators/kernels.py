"""Grouped kernels for recurrences and very long frames: one series at a time, in time order.

Each kernel gets a series as an Arrow table, reads some columns as arrays and adds its results as
columns; the others pass through as they are, so that nothing is joined back.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.schema import KEYS, InputError
from tidemark.session import arrow_groups


def _by_series(df: DataFrame, reads: list[str], writes: dict[str, str], f: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with the columns that ``f`` makes of each series; NaN counts as missing."""
    rest = df.drop(*writes)
    made = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in writes.items()))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        for name, values in f(table.select([*reads, "ts"]).to_pandas()).items():
            if writes[name] == "double":
                values = np.asarray(values, float)
                column = pa.array(values, pa.float64(), mask=~np.isfinite(values))
            else:
                column = pa.array(list(values), {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[writes[name]])
            table = table.append_column(name, column)
        return table

    return arrow_groups(rest, KEYS, run, StructType([*rest.schema.fields, *made.fields]))


def trailing_quantiles(df: DataFrame, x: str, window: int, least: int, quantiles: dict[str, float]) -> DataFrame:
    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        past = part[x].astype(float).shift(1).rolling(window, min_periods=least)
        return {name: past.quantile(q).to_numpy() for name, q in quantiles.items()}

    return _by_series(df, [x], dict.fromkeys(quantiles, "double"), f)


def _wilder(values: np.ndarray, n: int) -> np.ndarray:
    """The mean of n values, then each step a share 1/n of the way to the next; a gap begins anew."""
    out = np.full(len(values), np.nan)
    seen: list[float] = []
    level = math.nan
    for k, v in enumerate(values.tolist()):
        if not math.isfinite(v):
            seen = []
            continue
        if len(seen) < n:
            seen.append(v)
            if len(seen) < n:
                continue
            level = math.fsum(seen) / n
        else:
            level += (v - level) / n
        out[k] = level
    return out


def _summed(values: np.ndarray, n: int) -> np.ndarray:
    """From row n on: the decayed sum that begins with rows 1 to n-1."""
    out = np.full(len(values), np.nan)
    if len(values) > n:
        level = float(values[1:n].sum())
        for k in range(n, len(values)):
            level += values[k] - level / n
            out[k] = level
    return out


def adx_columns(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> dict[str, np.ndarray]:
    before = np.r_[close[:1], close[:-1]]
    true = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    up, down = np.r_[0, np.diff(high)], np.r_[0, -np.diff(low)]
    plus = _summed(np.where((up > down) & (up > 0), up, 0.0), n)
    minus = _summed(np.where((down > up) & (down > 0), down, 0.0), n)
    span = _summed(true, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = (np.where(np.isnan(span), np.nan, np.where(span > 0, 100 * x / span, 0.0)) for x in (plus, minus))
        dx = np.where(np.isnan(p), np.nan, np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), 0.0))
    return {"plus_di": p, "minus_di": m, "adx": _wilder(dx, n)}


def adx(df: DataFrame, n: int) -> DataFrame:
    return _by_series(df, ["high", "low", "close"], dict.fromkeys(("plus_di", "minus_di", "adx"), "double"), lambda part: adx_columns(*(part[c].to_numpy(float) for c in ("high", "low", "close")), n))


def entropy(df: DataFrame, window: int, bins: int) -> DataFrame:
    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        r = part["ret"].to_numpy(float)
        out = np.full(len(r), np.nan)
        for t in range(window - 1, len(r)):
            w = r[t - window + 1 : t + 1]
            w = w[~np.isnan(w)]
            if len(w) < max(1, window // 2):
                continue
            lo, hi = w.min(), w.max()
            if (hi - lo) / max(abs(lo), abs(hi), 1e-12) < 1e-9:
                out[t] = 0.0
                continue
            share = np.bincount(np.minimum(((w - lo) / (hi - lo) * bins).astype(int), bins - 1)) / len(w)
            share = share[share > 0]
            out[t] = -(share * np.log(share)).sum() / math.log(bins)
        return {"shannon_value": out}

    return _by_series(df, ["ret"], {"shannon_value": "double"}, f)


def bucket_scores(total: np.ndarray, imbalance: np.ndarray, size: float, window: int) -> np.ndarray:
    """The mean imbalance of the last ``window`` full buckets at each row.

    Cumulative imbalance is a piecewise linear function of cumulative volume, both in buckets, so the
    sum over buckets is the difference of its values at two bucket edges. Sums are of extended
    precision, and a bucket that lacks under 8 units of rounding is full. Edges that lie in one row
    give that row's own ratio, which spares the difference of two large numbers.
    """
    out = np.full(len(total), np.nan)
    if not len(total):
        return out
    wide = np.longdouble
    units = total.astype(wide) / wide(size)
    if not np.isfinite(total).all() or not np.isfinite(units.astype(float)).all():
        raise InputError("volumes, in buckets too, must be finite")
    ratio = np.divide(imbalance.astype(wide), total.astype(wide), out=np.zeros(len(total), wide), where=total > 0)
    volume, held = np.r_[wide(0), np.cumsum(units)], np.r_[wide(0), np.cumsum(units * ratio)]
    slack = 8 * np.finfo(float).eps
    full = np.floor(volume[1:] + slack)
    ready = full >= window
    hi, lo = full[ready], full[ready] - window
    end, begin = np.searchsorted(volume, hi - slack, "left"), np.searchsorted(volume, lo + slack, "left")

    def at(edge: np.ndarray, row: np.ndarray) -> np.ndarray:
        row = np.clip(row, 1, len(total))
        return held[row - 1] + np.clip(edge - volume[row - 1], 0, units[row - 1]) * ratio[row - 1]

    score = np.where(end == begin, ratio[np.clip(end, 1, len(total)) - 1], (at(hi, end) - at(lo, begin)) / window)
    out[ready] = np.clip(score.astype(float), 0, 1)
    return out


def vpin(df: DataFrame, size: float, window: int) -> DataFrame:
    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        ask, bid = part["ask_volume"].to_numpy(float), part["bid_volume"].to_numpy(float)
        return {"vpin_value": bucket_scores(ask + bid, np.abs(ask - bid), size, window)}

    return _by_series(df, ["ask_volume", "bid_volume"], {"vpin_value": "double"}, f)


def area(high: np.ndarray, low: np.ndarray, volume: np.ndarray, bins: int, lower: float, upper: float) -> tuple[float, float]:
    """Lower edge of the first bin at which the volume reaches one share, upper edge of that of the other."""
    lo, hi = low.min(), high.max()
    if not hi > lo:
        return math.nan, math.nan
    edges = np.linspace(lo, hi, bins + 1)
    flat = high <= low
    first = np.where(flat, np.searchsorted(edges, low, "right"), np.searchsorted(edges, low, "left")) - 1
    last = np.where(flat, first, np.searchsorted(edges, high, "left") - 1)
    first, last = np.clip(first, 0, bins - 1), np.clip(last, 0, bins - 1)
    part = np.where(volume > 0, volume, 0.0) / (last - first + 1)
    step = np.zeros(bins + 1)
    np.add.at(step, first, part)
    np.add.at(step, last + 1, -part)
    held = np.cumsum(step[:-1])
    if held.sum() <= 0:
        return math.nan, math.nan
    share = np.cumsum(held) / held.sum()
    at = [min(int(np.searchsorted(share, q - 1e-12)), bins - 1) for q in (lower, upper)]
    return float(edges[at[0]]), float(edges[at[1] + 1])


def value_area(df: DataFrame, window: int, bins: int, lower: float, upper: float) -> DataFrame:
    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        high, low, volume = (part[c].to_numpy(float) for c in ("high", "low", "volume"))
        out = np.full((len(part), 2), np.nan)
        for t in range(window - 1, len(part)):
            w = slice(t - window + 1, t + 1)
            out[t] = area(high[w], low[w], volume[w], bins, lower, upper)
        return {"va_low": out[:, 0], "va_high": out[:, 1]}

    return _by_series(df, ["high", "low", "volume"], {"va_low": "double", "va_high": "double"}, f)


FEATURES = ["log_return", "vol_realisee", "range_norm", "close_position"]
#: Likelihood gained in a round below which a model has settled.
HMM_TOLERANCE = 1e-4


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - mean[None]
    return -0.5 * (d * d / var + np.log(2 * np.pi * var)).sum(axis=2)


def _sum_exp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def hmm_fit(x: np.ndarray, states: int, rounds: int, seed: int, tol: float = HMM_TOLERANCE) -> dict[str, np.ndarray]:
    """A Gaussian model of diagonal covariance by expectation-maximisation, begun from seeded quantile groups."""
    rng = np.random.default_rng(seed)
    rank = np.argsort(np.argsort(x[:, 1] + 1e-9 * rng.standard_normal(len(x)), kind="stable"), kind="stable")
    group = rank * states // len(x)
    mean = np.array([x[group == k].mean(axis=0) for k in range(states)])
    var = np.array([x[group == k].var(axis=0) for k in range(states)]) + 1e-3
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    history: list[float] = []
    for _ in range(rounds):
        dense, step = _log_density(x, mean, var), np.log(move)
        fwd, bwd = np.empty_like(dense), np.zeros_like(dense)
        fwd[0] = np.log(start) + dense[0]
        for t in range(1, len(x)):
            fwd[t] = _sum_exp(fwd[t - 1][:, None] + step, 0) + dense[t]
        for t in range(len(x) - 2, -1, -1):
            bwd[t] = _sum_exp(step + (dense[t + 1] + bwd[t + 1])[None], 1)
        likelihood = float(_sum_exp(fwd[-1], 0))
        held = np.exp(fwd + bwd - likelihood)
        both = np.exp(fwd[:-1, :, None] + step[None] + (dense[1:] + bwd[1:])[:, None] - likelihood).sum(axis=0)
        weight = held.sum(axis=0)
        start = np.maximum(held[0], 1e-12) / np.maximum(held[0], 1e-12).sum()
        move = (both + 1e-12) / (both + 1e-12).sum(axis=1, keepdims=True)
        mean = held.T @ x / weight[:, None]
        var = np.maximum(held.T @ (x * x) / weight[:, None] - mean**2, 1e-3)
        history.append(likelihood)
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
    return {"start": start, "move": move, "mean": mean, "var": var, "history": np.array(history), "posterior": held}


def hmm_filter(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities of the states at each row given the rows up to it."""
    dense, step = _log_density(x, model["mean"], model["var"]), np.log(model["move"])
    out = np.empty_like(dense)
    level = np.log(model["start"]) + dense[0]
    out[0] = level - _sum_exp(level, 0)
    for t in range(1, len(x)):
        level = _sum_exp(out[t - 1][:, None] + step, 0) + dense[t]
        out[t] = level - _sum_exp(level, 0)
    return np.exp(out)


def _viterbi(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    dense, step = _log_density(x, model["mean"], model["var"]), np.log(model["move"])
    best, back = np.log(model["start"]) + dense[0], np.zeros((len(x), len(step)), int)
    for t in range(1, len(x)):
        ways = best[:, None] + step
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + dense[t]
    path = np.empty(len(x), int)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _confidence(p: np.ndarray, states: int) -> np.ndarray:
    return np.ones(len(p)) if states == 1 else 0.5 + 0.5 * np.clip((p - 1 / states) / (1 - 1 / states), 0, 1)


def hmm(df: DataFrame, states: int, rounds: int, seed: int) -> DataFrame:
    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        x = part[FEATURES].to_numpy(float)
        ok = np.isfinite(x).all(axis=1)
        regime, score = np.full(len(x), "INCONNU", object), np.zeros(len(x))
        if ok.sum() >= 10 * states:
            z = (x[ok] - x[ok].mean(axis=0)) / np.where(x[ok].std(axis=0) > 0, x[ok].std(axis=0), 1)
            model = hmm_fit(z, states, rounds, seed)
            regime[ok] = [f"STATE_{k}" for k in _viterbi(z, model)]
            score[ok] = _confidence(model["posterior"].max(axis=1), states)
        return {"regime": regime, "confidence": score}

    return _by_series(df, FEATURES, {"regime": "string", "confidence": "double"}, f)


def hmm_causal(df: DataFrame, states: int, rounds: int, seed: int, train: int) -> DataFrame:
    """States of a model of the first ``train`` bars, filtered forwards; all bars must be usable, and the rows that train are warm-up."""

    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        x, n = part[FEATURES].to_numpy(float), len(part)
        regime, score, warm, note = np.full(n, "INCONNU", object), np.zeros(n), np.ones(n, bool), np.full(n, "", object)
        out = {"regime": regime, "confidence": score, "is_warmup": warm, "hmm_diagnostics": note}
        if n <= train:
            return out
        if not part["__usable"].to_numpy(bool).all():
            raise InputError("a causal model of hidden states needs valid, closed bars throughout")
        seen = np.flatnonzero(np.isfinite(x).all(axis=1))
        lead = x[seen[seen < train]]
        if len(lead) < max(2, 2 * states):
            raise InputError("too few training rows are left after the features' warm-up")
        mean, spread = lead.mean(axis=0), lead.std(axis=0, ddof=1)
        spread = np.where(spread > 0, spread, 1.0)
        model = hmm_fit((lead - mean) / spread, states, rounds, seed)
        if not np.allclose(model["move"].sum(axis=1), 1):
            raise InputError("the model's transitions are no probabilities")
        order = np.argsort(model["mean"][:, 0], kind="stable")
        p = hmm_filter((x[seen] - mean) / spread, model)[:, order]
        if not np.isfinite(p).all():
            raise InputError("the filtered probabilities aren't finite")
        live = seen >= train
        at, history = seen[live], model["history"]
        regime[at] = [f"STATE_{k}" for k in p[live].argmax(axis=1)]
        score[at] = p[live].max(axis=1)
        warm[at] = False
        note[at] = json.dumps({
            "train_end": part["ts"].iloc[train - 1].isoformat(), "train_rows": len(lead), "iterations": len(history), "converged": bool(len(history) > 1 and 0 <= history[-1] - history[-2] < HMM_TOLERANCE),
            "log_likelihood": history.tolist(), "feature_names": FEATURES, "normalization_mean": mean.tolist(), "normalization_scale": spread.tolist(),
            "state_means": (model["mean"][order] * spread + mean).tolist(), "transition_matrix": model["move"][order][:, order].tolist(),
        })
        return out

    return _by_series(df, [*FEATURES, "__usable"], {"regime": "string", "confidence": "double", "is_warmup": "boolean", "hmm_diagnostics": "string"}, f)


def pelt(signal: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5, model: str = "l2") -> list[int]:
    """Ends of the segments of least penalised cost, among places that are multiples of ``jump``, and the length."""
    x = np.asarray(signal, float)
    n = len(x)
    one, two = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    gram = None
    if model == "rbf":
        d = (x[:, None] - x[None]) ** 2
        middle = np.median(d[np.triu_indices(n, 1)]) if n > 1 else 1.0
        k = np.exp(-np.clip(d / (middle or 1.0), 1e-2, 1e2))
        gram = np.zeros((n + 1, n + 1))
        gram[1:, 1:] = k.cumsum(0).cumsum(1)
        own = np.r_[0, np.cumsum(np.diag(k))]

    def cost(a: int, b: int) -> float:
        size = b - a
        if model == "rbf":
            return float(own[b] - own[a] - (gram[b, b] - gram[a, b] - gram[b, a] + gram[a, a]) / size)
        spread = two[b] - two[a] - (one[b] - one[a]) ** 2 / size
        return float(size * math.log(max(spread / size, 0) + 1e-6)) if model == "normal" else float(max(spread, 0))

    best: dict[int, float] = {0: 0.0}
    before: dict[int, int] = {}
    live = [0]
    for end in [*(e for e in range(0, n, jump) if e >= min_size), n]:
        ways = [(best[a] + cost(a, end) + penalty, a) for a in live if end - a >= min_size]
        if not ways:
            continue
        best[end], before[end] = min(ways)
        live = [a for w, a in ways if w <= best[end] + penalty] + [a for a in live if end - a < min_size] + [end]
    out, at = [], n
    while at:
        out.append(at)
        at = before[at]
    return out[::-1]


def segment(df: DataFrame, column: str, penalty: float, min_size: int, model: str = "l2") -> DataFrame:
    """``df`` with segment_id of the penalised segmentation of ln(column) in each series."""

    def f(part: pd.DataFrame) -> dict[str, np.ndarray]:
        x = np.log(part[column].to_numpy(float))
        if len(x) < 2 * min_size:
            return {"segment_id": np.zeros(len(x), np.int32)}
        ends = pelt(x, penalty, min_size, model=model)
        return {"segment_id": np.repeat(np.arange(len(ends)), np.diff([0, *ends])).astype(np.int32)}

    return _by_series(df, [column], {"segment_id": "int"}, f)
