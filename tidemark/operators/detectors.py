"""Regime detectors: bars in, a label, a confidence and measures for each bar out.

Each detector is a function of columns on one window specification where a closed form exists, and
a grouped Arrow kernel where a recurrence or a very long frame demands one. ``register`` adds one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import kernels
from tidemark.schema import KEYS, PRICES, UNKNOWN, VOLUMES, InputError, require, unaligned

FLAGS, COUNTS = ("is_partial", "is_warmup", "is_valid"), ("coverage", "source_count", "expected_count")
UP, DOWN, RANGE, CHOP, NEUTRAL = "TENDANCE_HAUSSIERE", "TENDANCE_BAISSIERE", "RANGE", "CHOP", "NEUTRE"
TREND = (UP, DOWN, RANGE, CHOP)
#: Quantile frames longer than this go to the kernel: Spark sorts each frame anew.
NATIVE_FRAME = 256


@dataclass(frozen=True)
class Detector:
    """What a detector publishes, and how it is computed."""

    name: str
    labels: tuple[str, ...]
    build: Callable[[DataFrame, dict[str, Any]], DataFrame]
    defaults: dict[str, Any]
    measures: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    availability: str = "bar_close"
    dimension: str = "trend"
    description: str = ""
    rules: tuple[Callable[[dict], str | None], ...] = field(default=())
    confidence_kind: str = "heuristic"

    def labels_of(self, **given: Any) -> tuple[str, ...]:
        """The labels under some parameters: a model of hidden states has one for each state."""
        states = self.parameters(given).get("n_states")
        return self.labels if states is None else tuple(f"STATE_{k}" for k in range(states))

    def ids(self, **given: Any) -> dict[str, int]:
        return {label: k for k, label in enumerate((*self.labels_of(**given), UNKNOWN))}

    @property
    def regime_ids(self) -> dict[str, int]:
        return self.ids()

    def parameters(self, given: dict[str, Any]) -> dict[str, Any]:
        unknown = sorted(set(given) - set(self.defaults))
        if unknown:
            raise InputError(f"{self.name} has no parameters {', '.join(unknown)}")
        out = {**self.defaults, **given}
        for name, value in out.items():
            if isinstance(self.defaults[name], int) and not isinstance(self.defaults[name], bool) and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise InputError(f"{self.name}: {name} must be a whole number above 0, not {value!r}")
            if isinstance(self.defaults[name], float):
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                    raise InputError(f"{self.name}: {name} must be a finite number, not {value!r}")
                if name.startswith(("q_", "pct_")) and not 0 <= value <= 1:
                    raise InputError(f"{self.name}: {name} must lie between 0 and 1, not {value!r}")
        for rule in self.rules:
            if said := rule(out):
                raise InputError(f"{self.name}: {said}")
        return out

    def detect(self, bars: DataFrame, timeframe: str | None = None, *, allow_lookahead: bool = False, **given: Any) -> DataFrame:
        """keys, ts, regime, confidence and measures of each bar."""
        if self.availability == "retrospective" and not allow_lookahead:
            raise InputError(f"{self.name} looks ahead; allow it by allow_lookahead=True")
        require(bars, ["asset", "timeframe", "ts", *PRICES, *self.needs])
        values = self.parameters(given)
        checked = guarded_bars(bars, self.needs, timeframe)
        # a detector's own flags are joined with those of its bars
        own = {c: f"__own_{c}" for c in FLAGS if c in bars.columns}
        made = self.build(checked.withColumns({v: F.col(c) for c, v in own.items()}), values)
        for c, v in own.items():
            made = made.withColumn(c, F.coalesce(c, F.lit(False)) & F.coalesce(v, F.lit(False)) if c == "is_valid" else F.coalesce(c, F.lit(True)) | F.coalesce(v, F.lit(True)))
        return published(made, list(self.measures), timeframe).select(*KEYS, "ts", "regime", "confidence", *self.measures, *(c for c in (*FLAGS, *COUNTS) if c in made.columns))


def guarded_bars(bars: DataFrame, needs: tuple[str, ...] = (), timeframe: str | None = None) -> DataFrame:
    """``bars``, with an error in place of the first value that breaks their contract, raised with its time.

    Prices are finite, above 0 and within low and high; volumes are not below 0, and not missing
    where a detector needs them. No further pass over the bars is made for this.
    """
    infinite = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    wrong = [(F.col("ts").isNull(), "a bar has no time"), (F.col("high") < F.greatest("open", "close", "low"), "a high lies below another price"), (F.col("low") > F.least("open", "close", "high"), "a low lies above another price")]
    for c in PRICES:
        wrong.append((F.col(c).isNull() | infinite(c) | (F.col(c) <= 0), f"{c} must be finite and above 0"))
    for c in VOLUMES:
        if c in bars.columns:
            wrong.append((F.col(c).isNotNull() & (infinite(c) | (F.col(c) < 0)), f"{c} must be finite and not below 0"))
            if c in needs:
                wrong.append((F.col(c).isNull(), f"{c} is needed on each bar"))
    if timeframe:
        wrong.append((F.col("timeframe") != timeframe, f"bars must be of {timeframe}"))
    said = F.lit(None).cast("string")
    for when, text in reversed(wrong):
        said = F.when(F.coalesce(when, F.lit(False)), text).otherwise(said)
    return bars.withColumn("ts", F.when(said.isNull(), F.col("ts")).otherwise(F.raise_error(said).cast("timestamp")))


REGISTRY: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    if not detector.labels or len(set(detector.labels)) != len(detector.labels) or UNKNOWN in detector.labels:
        raise InputError(f"{detector.name}: labels must be distinct, and not {UNKNOWN}")
    if detector.name in REGISTRY:
        raise InputError(f"{detector.name} is registered already")
    REGISTRY[detector.name] = detector
    return detector


def published(df: DataFrame, measures: list[str], timeframe: str | None) -> DataFrame:
    """Partial bars, or else bars off the grid, publish nothing."""
    if "is_partial" in df.columns:
        hidden = F.coalesce(F.col("is_partial"), F.lit(True))
    elif timeframe:
        hidden = unaligned(F.col("ts"), timeframe)
    else:
        return df
    out = df.withColumn("regime", F.when(hidden, UNKNOWN).otherwise(F.col("regime"))).withColumn("confidence", F.when(hidden, 0.0).otherwise(F.col("confidence")))
    for m in measures:
        out = out.withColumn(m, F.when(~hidden, F.col(m)))
    return out


def validity(df: DataFrame) -> Column:
    """Whether a published row counts: not partial, not warming up, valid, and labelled."""
    ok = F.col("regime").isNotNull() & (F.col("regime") != UNKNOWN) if "regime" in df.columns else F.lit(True)
    for c, default, wanted in (("is_partial", True, False), ("is_warmup", True, False), ("is_valid", False, True)):
        if c in df.columns:
            ok = ok & (F.coalesce(F.col(c), F.lit(default)) == F.lit(wanted))
    return ok


def thresholds(df: DataFrame, x: str, window: int, least: int, **quantiles: float) -> DataFrame:
    """Trailing quantiles of the rows before each, natively for short frames and by kernel for long ones; names get an underscore."""
    if window <= NATIVE_FRAME:
        for name, q in quantiles.items():
            df = df.withColumn(f"{name}_", W.quantile(x, q, window, least))
        return df
    return kernels.trailing_quantiles(df, x, window, least, {f"{k}_": q for k, q in quantiles.items()})


def _scored(df: DataFrame, cases: list[tuple[Column, str, Column | float]]) -> DataFrame:
    """The first case that holds gives label and confidence."""
    label, score = F.lit(UNKNOWN), F.lit(0.0)
    for when, name, confidence in reversed(cases):
        label = F.when(when, name).otherwise(label)
        score = F.when(when, confidence if isinstance(confidence, Column) else F.lit(float(confidence))).otherwise(score)
    return df.withColumn("regime", label).withColumn("confidence", score.cast("double"))


def _least(p: dict, window: str = "fenetre") -> int:
    return p.get("min_periods") or max(1, p[window] // 2)


def _atr(df: DataFrame, p: dict) -> DataFrame:
    df = df.withColumn("true_range", W.true_range()).withColumn("atr", W.atr(p["n_atr"])).withColumn("dir", W.direction(p["n_direction"]))
    df = thresholds(df, "atr", p["fenetre"], _least(p), low=p["q_bas"], high=p["q_haut"])
    x, lo, hi = F.col("atr"), F.col("low_"), F.col("high_")
    ready = lo.isNotNull() & hi.isNotNull() & x.isNotNull()
    rise = W.from_margin(F.try_divide(x - hi, hi))
    return _scored(df, [(ready & (x >= hi) & (F.col("dir") > 0), UP, rise), (ready & (x >= hi) & (F.col("dir") < 0), DOWN, rise), (ready & (x <= lo), RANGE, W.from_margin(F.try_divide(lo - x, lo))), (ready, CHOP, 0.5)])


def _er(df: DataFrame, p: dict) -> DataFrame:
    n = p["n_er"]
    df = df.withColumn("step", F.abs(F.col("close") - W.lag("close"))).withColumn("dir", W.direction(n))
    path = W.guarded(F.sum("step"), F.col("step"), W.trailing(n), n)
    df = df.withColumn("er", W.clip01(F.try_divide(F.abs(F.col("close") - W.lag("close", n)), F.when(path > 0, path))))
    df = df.withColumn("er", F.when(W.lag("close", n).isNotNull() & (path > 0), F.col("er")))
    df = thresholds(df, "er", p["fenetre"], _least(p), low=p["q_chop"], high=p["q_tendance"])
    x, lo, hi = F.col("er"), F.col("low_"), F.col("high_")
    ready = lo.isNotNull() & hi.isNotNull() & x.isNotNull()
    rise = W.from_margin(F.try_divide(x - hi, 1 - hi))
    return _scored(df, [(ready & (x >= hi) & (F.col("dir") > 0), UP, rise), (ready & (x >= hi) & (F.col("dir") < 0), DOWN, rise), (ready & (x >= hi), CHOP, 0.5), (ready & (x <= lo), CHOP, W.from_margin(F.try_divide(lo - x, lo))), (ready, RANGE, 0.5)])


def _adx(df: DataFrame, p: dict) -> DataFrame:
    df = kernels.adx(df, p["n_adx"])
    x, lo, hi = F.col("adx"), F.lit(float(p["seuil_range"])), F.lit(float(p["seuil_tendance"]))
    ready, rise = x.isNotNull(), W.from_margin(F.try_divide(x - hi, 100 - hi))
    return _scored(df, [(ready & (x < lo), RANGE, W.from_margin(F.try_divide(lo - x, lo))), (ready & (x >= hi) & (F.col("plus_di") > F.col("minus_di")), UP, rise), (ready & (x >= hi) & (F.col("plus_di") < F.col("minus_di")), DOWN, rise), (ready, CHOP, 0.5)])


def shannon_entropy(values: Column, bins: int) -> Column:
    """Entropy of an array's histogram of equal bins over its range, as a share of the largest possible."""
    lo, hi = F.array_min(values), F.array_max(values)
    scale = F.greatest(F.abs(lo), F.abs(hi), F.lit(1e-12))
    at = lambda x: F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda x: at(x) == b)) / F.size(values))
    sum_ = F.aggregate(share, F.lit(0.0), lambda a, q: a - F.when(q > 0, q * F.ln(q)).otherwise(F.lit(0.0)))
    return F.when((hi - lo) / scale < 1e-9, F.lit(0.0)).otherwise(sum_ / F.ln(F.lit(float(bins))))


def _shannon(df: DataFrame, p: dict) -> DataFrame:
    f, bins = p["fenetre"], p["n_bins"]
    df = df.withColumn("ret", W.log_return())
    if f <= NATIVE_FRAME:
        df = df.withColumn("seen", F.collect_list("ret").over(W.trailing(f))).withColumn("rows", F.count("*").over(W.trailing(f)))
        df = df.withColumn("shannon_value", F.when((F.col("rows") == f) & (F.size("seen") >= max(1, f // 2)), shannon_entropy(F.col("seen"), bins)))
    else:
        df = kernels.entropy(df, f, bins)
    x, lo, hi = F.col("shannon_value"), F.lit(float(p["seuil_bas"])), F.lit(float(p["seuil_haut"]))
    return _scored(df, [(x < lo, "ORDONNE", W.from_margin(1 - F.try_divide(x, lo))), (x > hi, "DESORDRE", W.from_margin(F.try_divide(x - hi, 1 - hi))), (x.isNotNull(), NEUTRAL, 0.5)])


def _minkowski(df: DataFrame, p: dict) -> DataFrame:
    df = df.withColumn("ret", W.log_return()).withColumn("size", F.abs("ret"))
    df = thresholds(df, "size", p["fenetre_c"], _least(p, "fenetre_c"), c=p["q_c"])
    c, r = F.col("c_"), F.col("ret")
    ready = c.isNotNull() & (c > 0) & r.isNotNull()
    df = df.withColumn("minkowski_ds2", F.when(ready, c * c - r * r)).withColumn("minkowski_beta", F.when(ready, F.try_divide(F.abs(r), c)))
    d = F.col("minkowski_ds2")
    far = W.from_margin(F.try_divide(F.abs(d), c * c))
    return _scored(df, [(ready & (F.abs(d) <= p["seuil"] * c * c), "LIGHTLIKE", 0.5), (ready & (d > 0), "TIMELIKE", far), (ready, "SPACELIKE", far)])


def _pca(df: DataFrame, p: dict) -> DataFrame:
    f = p["fenetre"]
    df = df.withColumn("time", F.row_number().over(W.series()).cast("double")).withColumn("lp", F.ln("close"))
    over = W.past(f)
    spread = F.stddev_pop("time").over(over) * F.stddev_pop("lp").over(over)
    flat = F.max("lp").over(over) == F.min("lp").over(over)
    df = df.withColumn("full", F.count("lp").over(over) == f).withColumn("flat", flat).withColumn("r", F.try_divide(F.covar_pop("time", "lp").over(over), spread))
    ready = F.col("full")
    r = F.when(F.col("flat"), 0.0).otherwise(F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(1.0)))
    ratio = F.when(F.col("flat"), 1.0).otherwise((1 + F.abs(r)) / 2)
    df = df.withColumn("pca_direction", F.when(ready, r)).withColumn("pca_eigen_ratio", F.when(ready, ratio)).withColumn("pca_variance_ratio", F.when(ready, ratio))
    d, e = F.col("pca_direction"), F.col("pca_eigen_ratio")
    s = float(p["seuil_direction"])
    strong = W.from_margin((F.abs(d) - s) / (1 - s))
    return _scored(df, [(ready & (e > p["seuil_eigen"]) & (d > s), "HAUSSIER", strong), (ready & (e > p["seuil_eigen"]) & (d < -s), "BAISSIER", strong), (ready, NEUTRAL, 0.5)])


def fractals(df: DataFrame, n: int) -> DataFrame:
    """peak and trough: strictly beyond all of the n rows on either side."""
    before, after = W.past(n), W.ahead(n)
    full = (F.count("*").over(before) == n) & (F.count("*").over(after) == n)
    peak = full & (F.col("high") > F.greatest(F.max("high").over(before), F.max("high").over(after)))
    trough = full & (F.col("low") < F.least(F.min("low").over(before), F.min("low").over(after)))
    return df.withColumn("peak", F.coalesce(peak, F.lit(False))).withColumn("trough", F.coalesce(trough, F.lit(False)))


def pivots(df: DataFrame, n: int) -> DataFrame:
    """keys, ts, kind (S or C), value, k: alternating pivots; of a run of one kind the first most extreme stays."""
    marks = fractals(df, n).select(*KEYS, "ts", F.explode(F.filter(F.array(F.when(F.col("peak"), F.struct(F.lit(0).alias("o"), F.lit("S").alias("kind"), F.col("high").alias("value"))), F.when(F.col("trough"), F.struct(F.lit(1).alias("o"), F.lit("C").alias("kind"), F.col("low").alias("value")))), lambda x: x.isNotNull())).alias("m")).select(*KEYS, "ts", "m.*")
    order = Window.partitionBy(*KEYS).orderBy("ts", "o")
    new = F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1))
    run = marks.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    beyond = F.when(F.col("kind") == "S", -F.col("value")).otherwise(F.col("value"))
    best = Window.partitionBy(*KEYS, "run").orderBy(beyond, "ts", "o")
    return run.withColumn("best", F.row_number().over(best)).filter("best = 1").select(*KEYS, "ts", "o", "kind", "value", F.col("run").alias("k"))


def _pairs(found: DataFrame) -> DataFrame:
    """Pivots with the last two values of each kind, s1, s2, c1 and c2, known at each."""
    order = Window.partitionBy(*KEYS).orderBy("ts", "o")
    own = F.lag("value", 2).over(order)
    other, other2 = F.lag("value", 1).over(order), F.lag("value", 3).over(order)
    high = F.col("kind") == "S"
    return found.withColumn("s1", F.when(high, F.col("value")).otherwise(other)).withColumn("s2", F.when(high, own).otherwise(other2)).withColumn("c1", F.when(high, other).otherwise(F.col("value"))).withColumn("c2", F.when(high, other2).otherwise(own))


def _structure(df: DataFrame, k_atr: float, atr: str) -> DataFrame:
    """label and score of two highs and two lows, against a tolerance of so many ATR."""
    tol = F.coalesce(F.lit(float(k_atr)) * F.col(atr), F.lit(0.0005))
    df = df.withColumn("tol", F.when(tol <= 0, 1e-12).otherwise(tol)).withColumn("ds", F.col("s1") - F.col("s2")).withColumn("dc", F.col("c1") - F.col("c2"))
    ds, dc, t = F.col("ds"), F.col("dc"), F.col("tol")
    known = ds.isNotNull() & dc.isNotNull()
    away = lambda sign: W.from_margin((F.least(sign * ds, sign * dc) - t) / t)
    flat = 0.5 + 0.5 * (1 - W.clip01(F.greatest(F.abs(ds), F.abs(dc)) / t))
    label, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for when, name, confidence in ((known, CHOP, F.lit(0.5)), (known & (F.abs(ds) <= t) & (F.abs(dc) <= t), RANGE, flat), (known & (ds < -t) & (dc < -t), DOWN, away(-1.0)), (known & (ds > t) & (dc > t), UP, away(1.0))):
        label, score = F.when(when, name).otherwise(label), F.when(when, confidence).otherwise(score)
    return df.withColumn("label", label).withColumn("score", score)


def _carried(df: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns of the last mark at or before each row."""
    last = marks.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS, "ts").orderBy(F.desc("o")))).filter("r = 1").select(*KEYS, "ts", *(F.col(c).alias(f"__{c}") for c in columns))
    out = df.join(last, [*KEYS, "ts"], "left")
    for c in columns:
        out = out.withColumn(c, F.last(f"__{c}", True).over(W.upto())).drop(f"__{c}")
    return out


def _price_action(df: DataFrame, p: dict) -> DataFrame:
    df = df.withColumn("true_range", W.true_range()).withColumn("tol_atr", W.atr(p["n_atr_tol"]))
    marks = _pairs(pivots(df, p["n_fractale"])).join(df.select(*KEYS, "ts", "tol_atr"), [*KEYS, "ts"])
    marks = _structure(marks, p["k_atr"], "tol_atr").filter("label is not null")
    out = _carried(df, marks, ["label", "score"])
    return out.withColumn("regime", F.coalesce("label", F.lit(UNKNOWN))).withColumn("confidence", F.coalesce("score", F.lit(0.0)))


def _price_action_causal(df: DataFrame, p: dict) -> DataFrame:
    """Pivots are known n rows after they stand, when their whole window is valid."""
    n = p["n_fractale"]
    good = F.when(validity(df), 1).otherwise(0)
    df = df.withColumn("true_range", W.true_range()).withColumn("tol_atr", W.atr(p["n_atr_tol"])).withColumn("good", good)
    window = W.series().rowsBetween(-2 * n, 0)
    other = lambda f, c: F.greatest(F.max(c).over(W.series().rowsBetween(-2 * n, -n - 1)), F.max(c).over(W.series().rowsBetween(-n + 1, 0))) if f == "max" else F.least(F.min(c).over(W.series().rowsBetween(-2 * n, -n - 1)), F.min(c).over(W.series().rowsBetween(-n + 1, 0)))
    df = df.withColumn("full", F.sum("good").over(window) == 2 * n + 1).withColumn("ch", W.lag("high", n)).withColumn("cl", W.lag("low", n)).withColumn("seen_at", W.lag("ts", n))
    df = df.withColumn("p", F.coalesce(F.col("full") & (F.col("ch") > other("max", "high")), F.lit(False))).withColumn("t", F.coalesce(F.col("full") & (F.col("cl") < other("min", "low")), F.lit(False)))
    marks = df.filter(F.col("p") != F.col("t")).select(*KEYS, "ts", "seen_at", "tol_atr", F.when(F.col("p"), "S").otherwise("C").alias("kind"), F.when(F.col("p"), F.col("ch")).otherwise(F.col("cl")).alias("value"))
    order = Window.partitionBy(*KEYS).orderBy("ts")
    marks = marks.withColumn("run", F.sum(F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sign = F.when(F.col("kind") == "S", 1.0).otherwise(-1.0)
    inside = Window.partitionBy(*KEYS, "run").orderBy("ts")
    marks = marks.withColumn("x", sign * F.col("value")).withColumn("before", F.max("x").over(inside.rowsBetween(Window.unboundedPreceding, -1))).filter("before is null or x > before")
    finals = marks.groupBy(*KEYS, "run").agg((F.max("x") * F.first(sign)).alias("final"))
    line = Window.partitionBy(*KEYS).orderBy("run")
    finals = finals.select(*KEYS, "run", *(F.lag("final", k).over(line).alias(f"f{k}") for k in (1, 2, 3)))
    marks = marks.join(finals, [*KEYS, "run"])
    high = F.col("kind") == "S"
    marks = marks.withColumn("s1", F.when(high, F.col("value")).otherwise(F.col("f1"))).withColumn("s2", F.when(high, F.col("f2")).otherwise(F.col("f3"))).withColumn("c1", F.when(high, F.col("f1")).otherwise(F.col("value"))).withColumn("c2", F.when(high, F.col("f3")).otherwise(F.col("f2")))
    marks = _structure(marks, p["k_atr"], "tol_atr").withColumn("label", F.coalesce("label", F.lit(UNKNOWN))).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("replaces", F.col("before").isNotNull()).withColumn("o", F.lit(0))
    out = _carried(df, marks, ["label", "score"]).join(marks.select(*KEYS, "ts", F.col("seen_at").alias("pivot_observed_at"), F.col("ts").alias("pivot_confirmed_at"), F.col("kind").alias("pivot_kind"), F.col("replaces").alias("pivot_replaces_previous")), [*KEYS, "ts"], "left")
    live = F.col("good") == 1
    return out.withColumn("regime", F.when(live, F.coalesce("label", F.lit(UNKNOWN))).otherwise(UNKNOWN)).withColumn("confidence", F.when(live, F.coalesce("score", F.lit(0.0))).otherwise(0.0)).withColumn("pivot_kind", F.coalesce("pivot_kind", F.lit(""))).withColumn("pivot_replaces_previous", F.coalesce("pivot_replaces_previous", F.lit(False)))


def _breakout(df: DataFrame, p: dict) -> DataFrame:
    marks = _pairs(pivots(df, p["n_fractale"]))
    out = _carried(df, marks.filter("s1 is not null and s2 is not null and c1 is not null and c2 is not null"), ["s1", "s2", "c1", "c2"])
    s1, s2, c1, c2, x = (F.col(c) for c in ("s1", "s2", "c1", "c2", "close"))
    known, up, down = s2.isNotNull() & c2.isNotNull(), (s1 > s2) & (c1 > c2), (s1 < s2) & (c1 < c2)
    return _scored(out, [(known & up & (x < c2), "MSS_BAISSIER", 0.8), (known & up & (x < c1), "CHOCH_BAISSIER", 0.6), (known & down & (x > s2), "MSS_HAUSSIER", 0.8), (known & down & (x > s1), "CHOCH_HAUSSIER", 0.6), (known, NEUTRAL, 0.5)])


def _ofi(df: DataFrame, p: dict) -> DataFrame:
    total = F.col("ask_volume") + F.col("bid_volume")
    df = df.withColumn("imbalance", F.try_divide(F.col("ask_volume") - F.col("bid_volume"), F.when(total > 0, total)))
    df = df.withColumn("ofi_value", W.guarded(F.avg("imbalance"), F.col("imbalance"), W.trailing(p["fenetre"]), max(1, p["fenetre"] // 2)))
    x, s = F.col("ofi_value"), float(p["seuil"])
    strong = W.from_margin((F.abs(x) - s) / (1 - s))
    return _scored(df, [(x > s, "PRESSION_ACHETEUSE", strong), (x < -s, "PRESSION_VENDEUSE", strong), (x.isNotNull(), "EQUILIBRE", 0.5)])


def _vpin(df: DataFrame, p: dict) -> DataFrame:
    df = kernels.vpin(df, float(p["bucket_volume"]), p["n_buckets"])
    x, lo, hi = F.col("vpin_value"), float(p["seuil_bas"]), float(p["seuil_haut"])
    return _scored(df, [(x < lo, "CALME", W.from_margin((lo - x) / lo)), (x > hi, "TOXIQUE", W.from_margin((x - hi) / (1 - hi))), (x.isNotNull(), "NORMAL", 0.5)])


def _profile(df: DataFrame, p: dict) -> DataFrame:
    df = kernels.value_area(df, p["fenetre"], p["n_bins"], p["pct_bas"], p["pct_haut"])
    x, lo, hi = F.col("close"), F.col("va_low"), F.col("va_high")
    ready = lo.isNotNull() & hi.isNotNull()
    away = F.when(x < lo, x - lo).when(x > hi, x - hi).otherwise(0.0)
    df = df.withColumn("distance_va", F.when(ready, away))
    far = W.from_margin(F.try_divide(F.abs(F.col("distance_va")), F.when(hi > lo, hi - lo)))
    return _scored(df, [(ready & (x < lo), "HORS_ZONE_BASSE", far), (ready & (x > hi), "HORS_ZONE_HAUTE", far), (ready, "DANS_ZONE_VALEUR", 0.5)])


def _divergence(df: DataFrame, p: dict) -> DataFrame:
    m, e = p["fenetre_median_vol"], p["fenetre_extreme"]
    usual = W.guarded(F.percentile("volume", F.lit(0.5)), F.col("volume"), W.past(m), max(1, m // 2))
    top, bottom = (W.guarded(f("close"), F.col("close"), W.past(e), max(1, e // 2)) for f in (F.max, F.min))
    df = df.withColumn("usual", usual).withColumn("top", top).withColumn("bottom", bottom)
    df = df.withColumn("volume_rel", F.try_divide(F.col("volume"), F.when(F.col("usual") > 0, F.col("usual"))))
    df = df.withColumn("is_new_high", F.coalesce(F.col("close") > F.col("top"), F.lit(False))).withColumn("is_new_low", F.coalesce(F.col("close") < F.col("bottom"), F.lit(False)))
    ready = F.col("volume_rel").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull()
    strong = F.col("volume_rel") > float(p["ratio_volume_fort"])
    low, high = ready & F.col("is_new_low"), ready & F.col("is_new_high")
    return _scored(df, [(low & ~strong, "DIVERGENCE_BAISSIERE", 0.7), (high & ~strong, "DIVERGENCE_HAUSSIERE", 0.7), (low, "CONFIRMATION_BAISSIERE", 0.6), (high, "CONFIRMATION_HAUSSIERE", 0.6), (ready, NEUTRAL, 0.5)])


def _renamed(base: Callable[[DataFrame, dict], DataFrame], labels: dict[str, str], measures: dict[str, str] | None = None) -> Callable[[DataFrame, dict], DataFrame]:
    """The same detector under other labels and measures."""

    def build(df: DataFrame, p: dict) -> DataFrame:
        out = base(df, p)
        table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        return out.withColumn("regime", F.coalesce(F.try_element_at(table, F.col("regime")), F.col("regime"))).withColumnsRenamed(measures or {})

    return build


def _hmm(df: DataFrame, p: dict) -> DataFrame:
    return kernels.hmm(hmm_features(df), p["n_states"], p["n_iter"], p["seed"])


def _hmm_causal(df: DataFrame, p: dict) -> DataFrame:
    return kernels.hmm_causal(hmm_features(df.withColumn("__usable", validity(df.drop("regime")))), p["n_states"], p["n_iter"], p["seed"], p["train_size"])


def hmm_features(df: DataFrame) -> DataFrame:
    """Return, its deviation over 20 bars, range over ATR, and the close's place in the range."""
    df = df.withColumn("true_range", W.true_range()).withColumn("log_return", W.log_return())
    df = df.withColumn("vol_realisee", W.guarded(F.stddev_samp("log_return"), F.col("log_return"), W.trailing(20), 20)).withColumn("atr14", W.atr(14, 14))
    span = F.col("high") - F.col("low")
    return df.withColumn("range_norm", F.try_divide(span, F.when(F.col("atr14") > 0, F.col("atr14")))).withColumn("close_position", F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.when(span > 0, span)), F.lit(0.5)))


def _ordered(lo: str, hi: str) -> Callable[[dict], str | None]:
    return lambda p: None if p[lo] <= p[hi] else f"{lo} must not exceed {hi}"


register(Detector("atr_volatility", TREND, _atr, {"n_atr": 14, "fenetre": 500, "n_direction": 20, "q_bas": 0.33, "q_haut": 0.67, "min_periods": None}, rules=(_ordered("q_bas", "q_haut"),), dimension="volatility"))
register(Detector("er_kaufman", TREND, _er, {"n_er": 20, "fenetre": 700, "q_chop": 0.4, "q_tendance": 0.6, "min_periods": None}, rules=(_ordered("q_chop", "q_tendance"),), dimension="efficiency"))
register(Detector("adx", TREND, _adx, {"n_adx": 14, "seuil_range": 20.0, "seuil_tendance": 25.0}, rules=(_ordered("seuil_range", "seuil_tendance"),), dimension="trend_strength"))
register(Detector("shannon", ("ORDONNE", NEUTRAL, "DESORDRE"), _shannon, {"fenetre": 100, "n_bins": 10, "seuil_bas": 0.65, "seuil_haut": 0.78}, ("shannon_value",), rules=(_ordered("seuil_bas", "seuil_haut"),), dimension="entropy"))
register(Detector("minkowski_causal", ("TIMELIKE", "SPACELIKE", "LIGHTLIKE"), _minkowski, {"fenetre_c": 500, "q_c": 0.9, "seuil": 0.01, "min_periods": None}, ("minkowski_ds2", "minkowski_beta"), dimension="shock"))
register(Detector("pca_axis", ("HAUSSIER", "BAISSIER", NEUTRAL), _pca, {"fenetre": 100, "seuil_direction": 0.3, "seuil_eigen": 0.65}, ("pca_direction", "pca_eigen_ratio", "pca_variance_ratio"), dimension="geometry"))
_PA = {"n_fractale": 5, "k_atr": 0.5, "n_atr_tol": 14}
register(Detector("price_action", TREND, _price_action, _PA, availability="retrospective", dimension="structure"))
register(Detector("price_action_causal", TREND, _price_action_causal, _PA, ("pivot_observed_at", "pivot_confirmed_at", "pivot_kind", "pivot_replaces_previous"), dimension="structure"))
_BREAK = ("MSS_HAUSSIER", "MSS_BAISSIER", "CHOCH_HAUSSIER", "CHOCH_BAISSIER", NEUTRAL)
_CASSURES = dict(zip(_BREAK, ("CASSURE_HAUTE_ANCIENNE", "CASSURE_BASSE_ANCIENNE", "CASSURE_HAUTE_RECENTE", "CASSURE_BASSE_RECENTE", NEUTRAL), strict=True))
register(Detector("mss_choch", _BREAK, _breakout, {"n_fractale": 5}, availability="retrospective", dimension="breakout_event"))
register(Detector("retrospective_pivot_breakout", tuple(_CASSURES.values()), _renamed(_breakout, _CASSURES), {"n_fractale": 5}, availability="retrospective", dimension="breakout_event"))
_HMM = {"n_states": 2, "n_iter": 100, "seed": 42}
register(Detector("hmm_gaussian", ("STATE_0", "STATE_1"), _hmm, _HMM, availability="retrospective", dimension="latent_state"))
register(Detector("hmm_causal", ("STATE_0", "STATE_1"), _hmm_causal, {**_HMM, "train_size": 500}, ("hmm_diagnostics",), dimension="latent_state", rules=(lambda p: None if p["train_size"] >= 25 else "train_size must be 25 or more",), confidence_kind="filtered_state_probability"))
_SIDES = {"PRESSION_ACHETEUSE": "TAILLE_ASK_DOMINANTE", "PRESSION_VENDEUSE": "TAILLE_BID_DOMINANTE", "EQUILIBRE": "EQUILIBRE"}
register(Detector("ofi", tuple(_SIDES), _ofi, {"fenetre": 20, "seuil": 0.1}, ("ofi_value",), ("bid_volume", "ask_volume"), dimension="imbalance"))
register(Detector("quote_size_imbalance", tuple(_SIDES.values()), _renamed(_ofi, _SIDES, {"ofi_value": "quote_imbalance"}), {"fenetre": 20, "seuil": 0.1}, ("quote_imbalance",), ("bid_volume", "ask_volume"), dimension="imbalance"))
_BUCKETS = {"CALME": "DESEQUILIBRE_FAIBLE", "NORMAL": "DESEQUILIBRE_MOYEN", "TOXIQUE": "DESEQUILIBRE_ELEVE"}
_VPIN = {"bucket_volume": 10000.0, "n_buckets": 50, "seuil_bas": 0.2, "seuil_haut": 0.4}
register(Detector("vpin", tuple(_BUCKETS), _vpin, _VPIN, ("vpin_value",), ("bid_volume", "ask_volume"), rules=(_ordered("seuil_bas", "seuil_haut"),), dimension="toxicity"))
register(Detector("quote_absolute_imbalance_buckets", tuple(_BUCKETS.values()), _renamed(_vpin, _BUCKETS, {"vpin_value": "quote_absolute_imbalance"}), _VPIN, ("quote_absolute_imbalance",), ("bid_volume", "ask_volume"), dimension="toxicity"))
register(Detector("volume_profile", ("HORS_ZONE_BASSE", "DANS_ZONE_VALEUR", "HORS_ZONE_HAUTE"), _profile, {"fenetre": 100, "n_bins": 40, "pct_bas": 0.2, "pct_haut": 0.8}, ("va_low", "va_high", "distance_va"), ("volume",), rules=(_ordered("pct_bas", "pct_haut"),), dimension="value_area"))
register(Detector("divergence_pv", ("CONFIRMATION_HAUSSIERE", "CONFIRMATION_BAISSIERE", "DIVERGENCE_HAUSSIERE", "DIVERGENCE_BAISSIERE", NEUTRAL), _divergence, {"fenetre_median_vol": 50, "fenetre_extreme": 20, "ratio_volume_fort": 1.5}, ("volume_rel", "is_new_high", "is_new_low"), ("volume",), dimension="volume"))
