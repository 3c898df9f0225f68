"""Labels against forward targets: feature tables, splits, rank correlation, tests, episodes, bootstrap."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import statistics as S
from tidemark.operators import report, targets
from tidemark.operators.context import episodes
from tidemark.operators.detectors import validity
from tidemark.schema import KEYS, InputError, finite, seconds
from tidemark.session import materialize, ship
from tidemark.sources import tables as T
from tidemark.sources.tables import content_hash

LEAST_ROWS = 10


def causal_only(long: DataFrame) -> DataFrame:
    """Rows known at their bar's close: bar_close methods whose available_at isn't later than the bar."""
    return long.filter((F.col("availability") == "bar_close") & F.col("available_at").isNotNull() & (F.col("available_at") <= F.col("ts")))


def features(long: DataFrame, methods: list[str], columns: tuple[str, ...] = ("regime",)) -> DataFrame:
    """keys, ts and <method>__<column> for the methods named; rows that don't count are null."""
    ok, kinds = validity(long), dict(long.dtypes)
    held = long.filter(F.col("method").isin(methods)).select(*KEYS, "ts", "method", *(F.when(ok, finite(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in columns))
    one = held.groupBy(*KEYS, "ts")
    wide = [F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}__{c}") for m in methods for c in columns]
    return one.agg(*wide)


def exclusions(long: DataFrame) -> DataFrame:
    """Per series and method: rows, and how many each rule leaves out."""
    n = lambda c, flag: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(flag)
    flags = [n(F.col("regime").isNull(), "no_label"), n(F.col("regime") == "INCONNU", "unknown")]
    for c, default in (("is_partial", True), ("is_warmup", True)):
        if c in long.columns:
            flags.append(n(F.coalesce(F.col(c), F.lit(default)), c))
    return long.groupBy(*KEYS, "method").agg(F.count("*").alias("n_rows"), *flags, n(validity(long), "n_valid"))


@dataclass(frozen=True)
class Fold:
    """Rows [train_lo, train_hi) and [test_lo, test_hi), counted from 0 in each series."""

    number: int
    train_lo: int
    train_hi: int
    test_lo: int
    test_hi: int


def folds(n: int, kind: str = "holdout", *, ratio: float = 0.7, embargo: int = 0, count: int = 5, anchored: bool = False) -> list[Fold]:
    """The folds of n rows: in_sample, holdout or walk_forward."""
    if n < 2 or not 0 < ratio < 1 or embargo < 0:
        raise InputError("a split needs two rows, a ratio between 0 and 1 and no negative embargo")
    if kind == "in_sample":
        return [Fold(0, 0, n, 0, n)]
    if kind == "holdout":
        cut = min(max(int(n * ratio), 1), n - 1)
        if cut + embargo >= n:
            raise InputError("the embargo leaves no test rows")
        return [Fold(0, 0, cut, cut + embargo, n)]
    if kind != "walk_forward":
        raise InputError(f"unknown split {kind!r}")
    test = int((n - embargo) / (count + ratio / (1 - ratio)))
    train = max(1, round(test * ratio / (1 - ratio)))
    if test < 1:
        raise InputError("too few rows for so many folds")
    out = []
    for k in range(count):
        lo = train + embargo + k * test
        out.append(Fold(k, 0 if anchored else k * test, train + k * test, lo, min(lo + test, n)))
    return [f for f in out if f.test_lo < f.test_hi]


def split(rows: DataFrame, parts: list[Fold], target: str | None = None) -> DataFrame:
    """Each fold's rows with ``fold`` and ``part``; training rows whose target ends at the test's start or later are purged."""
    spark = rows.sparkSession
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ts")) - 1)
    table = spark.createDataFrame([(f.number, f.train_lo, f.train_hi, f.test_lo, f.test_hi) for f in parts], "fold int, train_lo long, train_hi long, test_lo long, test_hi long")
    n = F.col("__n")
    met = numbered.join(F.broadcast(table), ((n >= F.col("train_lo")) & (n < F.col("train_hi"))) | ((n >= F.col("test_lo")) & (n < F.col("test_hi"))))  # a few folds
    both = met.withColumn("__train", (n >= F.col("train_lo")) & (n < F.col("train_hi"))).withColumn("__test", (n >= F.col("test_lo")) & (n < F.col("test_hi")))
    out = both.withColumn("part", F.explode(F.filter(F.array(F.when(F.col("__train"), "train"), F.when(F.col("__test"), "test")), lambda x: x.isNotNull())))
    if target and f"{target}_end" in rows.columns:
        begin = F.min(F.when(F.col("__test"), F.col("ts"))).over(Window.partitionBy(*KEYS, "fold"))
        apart = F.col("train_hi") <= F.col("test_lo")
        keep = (F.col("part") == "test") | ~apart | (F.col(f"{target}_end") < begin)
        out = out.withColumn("__keep", F.coalesce(keep, F.lit(False))).filter("__keep").drop("__keep")
    return out.drop("__n", "__train", "__test", "train_lo", "train_hi", "test_lo", "test_hi")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def rank_correlation(rows: DataFrame, feature: str, target: str, by: list[str]) -> DataFrame:
    """n, Spearman's rho (null for a constant or under 10 rows) and constant, per group, with average ranks."""
    held = rows.filter(_finite(feature) & _finite(target)).select(*by, F.col(feature).cast("double").alias("x"), F.col(target).cast("double").alias("y"))
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    ranked = held.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), (F.stddev_pop("rx") * F.stddev_pop("ry")).alias("s"))
    return out.select(*by, "n", F.when((F.col("n") >= LEAST_ROWS) & (F.col("s") > 0), F.col("c") / F.col("s")).alias("ic"), (F.col("s") == 0).alias("constant"))


def hit_rate(rows: DataFrame, feature: str, target: str, by: list[str]) -> DataFrame:
    """How often a directional feature has the sign of a return; 0 abstains, and a return of 0 is a miss."""
    held = rows.filter(_finite(feature) & _finite(target) & (F.col(feature) != 0))
    out = held.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.signum(feature) == F.signum(target)).cast("double")).alias("h"))
    return out.select(*by, "n", F.when(F.col("n") >= LEAST_ROWS, F.col("h")).alias("hit_rate"))


def modality_statistics(rows: DataFrame, feature: str, target: str, by: list[str]) -> DataFrame:
    """Per value of a feature against the rest: counts, means, variances, rank sums, ties and successes.

    Of a group's rows only sums are formed; the rest of a value is the group less its own.
    """
    held = rows.filter(F.col(feature).isNotNull() & _finite(target)).select(*by, F.col(feature).cast("string").alias("value"), F.col(target).cast("double").alias("y"))
    whole = Window.partitionBy(*by)
    equal = F.count("*").over(Window.partitionBy(*by, "y"))
    ranked = held.withColumn("r", F.rank().over(whole.orderBy("y")) + (equal - 1) / 2).withColumn("t", (equal * equal - 1).cast("double")).withColumn("shift", F.avg("y").over(whole))
    centred = F.col("y") - F.col("shift")
    success = F.col("y") > (F.lit(0.0) if target.startswith("ret_") else F.col("mid"))
    ranked = ranked.withColumn("mid", F.percentile("y", F.lit(0.5)).over(whole)) if not target.startswith("ret_") else ranked
    own = ranked.groupBy(*by, "value").agg(F.count("*").alias("n"), F.sum(centred).alias("s"), F.sum(centred * centred).alias("q"), F.sum("r").alias("rank_sum"), F.sum("t").alias("t"), F.sum(success.cast("long")).alias("hits"), F.first("shift").alias("shift"), F.percentile("y", F.lit(0.5)).alias("median"))
    rest = lambda c: F.sum(c).over(whole) - F.col(c)
    mean = lambda s, n: F.try_divide(s, n)
    var = lambda q, s, n: F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    out = own.withColumn("n_rest", rest("n")).withColumn("s_rest", rest("s")).withColumn("q_rest", rest("q")).withColumn("hits_rest", rest("hits")).withColumn("ties", F.sum("t").over(whole))
    return out.select(
        *by, "value", "n", "n_rest", (F.col("shift") + mean(F.col("s"), F.col("n"))).alias("mean"), (F.col("shift") + mean(F.col("s_rest"), F.col("n_rest"))).alias("mean_rest"),
        var(F.col("q"), F.col("s"), F.col("n")).alias("var"), var(F.col("q_rest"), F.col("s_rest"), F.col("n_rest")).alias("var_rest"), "median", "rank_sum", "ties", "hits", "hits_rest",
    )


def modality_tests(statistics: list[dict], *, into: bool = False) -> list[dict]:
    """Welch, Mann-Whitney and proportion tests with Cliff's delta, adjusted over the whole family; ``into`` writes them into the rows given."""
    out = []
    for r in statistics:
        t, p_t = S.welch(r["n"], r["mean"], r["var"] or 0.0, r["n_rest"], r["mean_rest"] or 0.0, r["var_rest"] or 0.0)
        u, p_u = S.mann_whitney(r["n"], r["n_rest"], r["rank_sum"], r["ties"])
        z, p_z = S.two_proportions(r["hits"], r["n"], r["hits_rest"], r["n_rest"])
        delta = 2 * u / (r["n"] * r["n_rest"]) - 1 if r["n"] and r["n_rest"] else None
        made = {"welch": t, "p_welch": p_t, "u": u, "p_mann_whitney": p_u, "z": z, "p_proportions": p_z, "cliff": delta}
        if into:
            r.update(made)
        out.append(r if into else {**r, **made})
    for name in ("welch", "mann_whitney", "proportions"):
        for r, a in zip(out, S.benjamini_yekutieli([r[f"p_{name}"] for r in out]), strict=True):
            r[f"adjusted_{name}"] = a
            r[f"reject_{name}"] = None if a is None else a <= 0.05
    return out


def episode_counts(rows: DataFrame, feature: str, timeframe: str) -> DataFrame:
    """Per series and value of a feature: rows and episodes."""
    held = episodes(rows, feature, timeframe).filter(F.col(feature).isNotNull())
    return held.groupBy(*KEYS, feature).agg(F.count("*").alias("n"), F.countDistinct("episode").alias("n_episodes"))


def bootstrap(rows: DataFrame, feature: str, target: str, timeframe: str, *, block: int, rounds: int = 999, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Moving-block intervals of each value's effect, one task for each group and value; seeds follow from the names."""
    held = episodes(rows.withColumn("__one", F.when(F.col(feature).isNotNull() & _finite(target), F.lit(1))), "__one", timeframe).filter("__one = 1")
    groups = [*KEYS, *by]
    values = held.select(*groups, F.col(feature).cast("string").alias("value")).distinct()
    data = held.select(*groups, "ts", F.col(feature).cast("string").alias("own"), F.col(target).cast("double").alias("y"), F.col("episode").alias("segment")).join(values, groups)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        key = [part[g].iloc[0] for g in groups] + [part["value"].iloc[0]]
        got = S.block_bootstrap(part["y"].to_numpy(float), (part["own"] == key[-1]).to_numpy(bool), part["segment"].to_numpy(), block, rounds, S.seed_of(seed, *map(str, key)))
        return pd.DataFrame([[*key, *got.values()]], columns=[*groups, "value", *got])

    ship(rows.sparkSession)
    kinds = dict(data.dtypes)
    ddl = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", value string, estimate double, low double, high double, p double, valid int"
    return data.groupBy(*groups, "value").applyInPandas(run, ddl)


def block_sensitivity(rows: DataFrame, feature: str, target: str, timeframe: str, blocks: list[int], **options: object) -> list[dict]:
    """The bootstrap with each of several block sizes, adjusted as one family."""
    if len(set(blocks)) < 2:
        raise InputError("a sensitivity needs two block sizes at least")
    found = [{"block": b, **r.asDict()} for b in sorted(set(blocks)) for r in bootstrap(rows, feature, target, timeframe, block=b, **options).collect()]
    for r, a in zip(found, S.benjamini_yekutieli([r["p"] for r in found]), strict=True):
        r["adjusted"] = a
    return found


def stability(tests: DataFrame) -> DataFrame:
    """Per feature, target and value: folds present, estimable and sufficient, mean and bounds of the effect, signs and whether they agree."""
    up, down, none = (F.sum(c.cast("long")) for c in (F.col("effect") > 0, F.col("effect") < 0, F.col("effect") == 0))
    enough = F.sum((F.col("status") == "descriptive").cast("long"))
    out = tests.groupBy("feature", "target", "value").agg(F.count("*").alias("folds"), F.count("effect").alias("estimable"), enough.alias("sufficient"), F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("std"), F.min("effect").alias("min"), F.max("effect").alias("max"), *(F.coalesce(c, F.lit(0)).alias(n) for c, n in ((up, "n_up"), (down, "n_down"), (none, "n_zero"))))
    return out.withColumn("same_sign", F.greatest("n_up", "n_down") / F.when(F.col("estimable") > 0, F.col("estimable")))


def ic_stability(each: DataFrame, by: list[str]) -> DataFrame:
    """Per group the mean, deviation and bounds of the rank correlations of its folds, and the mean hit rate where there is one."""
    hits = [F.avg("hit_rate").alias("hit_mean")] if "hit_rate" in each.columns else []
    return each.groupBy(*by).agg(F.count("*").alias("folds"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"), *hits)


# Columns of the long table that may be features, by kind; the rest of KNOWN describe a row.
FEATURE_KINDS = {
    "categorical": ("regime", "ctx_session", "ctx_event_type"),
    "numeric": ("confidence", "ctx_hour_ny", "ctx_hour_utc", "ctx_day_of_week"),
    "boolean": ("ctx_is_rollover", "ctx_is_holiday", "ctx_in_event"),
}
KNOWN = (
    "ts", "regime_id", "method", "timeframe", "asset", "params_hash", "is_partial", "is_valid", "is_warmup", "coverage", "source_count", "expected_count", "source", "price_side", "adjustment", "calendar",
    "timestamp_convention", "availability", "available_at", "regime_dimension", "regime_description", "regime_scale", "revises_history", "confidence_kind", "confidence_description", "confidence_calibrated",
    "indicator_name", "hmm_diagnostics", "pivot_observed_at", "pivot_confirmed_at", "pivot_kind", "pivot_replaces_previous",
)
FEATURE_TYPES = ("nominal", "ordinal", "continuous", "directional")


def list_features(long: DataFrame) -> dict[str, list[str]]:
    """The columns that may be features, by kind, each sorted; columns of no known kind are ``other``."""
    out = {kind: sorted(c for c in names if c in long.columns) for kind, names in FEATURE_KINDS.items()}
    taken = {*KNOWN, *(c for names in FEATURE_KINDS.values() for c in names)}
    return out | {"other": sorted(c for c in long.columns if c not in taken)}


def feature_type(name: str, kind: str, declared: str | None = None) -> str:
    """What a feature of a Spark type is: as declared, nominal for labels, context and truth values, or continuous. No direction is inferred."""
    if declared is not None:
        if declared not in FEATURE_TYPES:
            raise InputError(f"{declared!r} is no type of feature; known: {', '.join(FEATURE_TYPES)}")
        return declared
    own = name.split("__")[-1]
    if own == "regime" or own.startswith("ctx_") or kind in ("boolean", "string"):
        return "nominal"
    return "continuous" if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else "nominal"


@dataclass(frozen=True)
class Inference:
    """A moving-block bootstrap of every effect, with one correction over the whole family."""

    block: int
    rounds: int = 999
    seed: int = 0
    alpha: float = 0.05

    def __post_init__(self) -> None:
        if self.block < 1 or self.rounds < 1 or not 0 < self.alpha < 1:
            raise InputError("an inference needs a block and rounds of 1 or more, and alpha between 0 and 1")


@dataclass
class Study:
    """Features of long regimes against targets of bars, fold by fold.

    Features are ``columns`` of each method; targets count only where all features are known. Each fold
    gives rank correlations and hit rates of both parts, and tests and descriptions of the test part, by
    stratum too if one is named. ``run`` leaves small tables of rows in ``results`` and
    ``save`` publishes them with the targets' ends, the common support and a report.
    """

    long: DataFrame
    bars: DataFrame
    timeframe: str
    methods: list[str]
    targets: list[str]
    split: dict = field(default_factory=lambda: {"kind": "holdout"})
    stratum: str | None = None
    columns: tuple[str, ...] = ("regime",)
    feature_types: dict[str, str] = field(default_factory=dict)
    modality_tests: bool = True
    inference: Inference | None = None
    inputs: tuple[str, ...] = ()
    results: dict[str, list] | None = None

    def __post_init__(self) -> None:
        for name in self.targets:
            _, horizon = targets.parse(name)
            if self.inference and self.inference.block < horizon:
                raise InputError(f"a block must be as long as the horizon of {name}")
        if self.inference and not self.modality_tests:
            raise InputError("an inference needs the tests of each value")
        if self.stratum and not self.stratum.startswith("ctx_"):
            raise InputError("a stratum is one of the context columns")
        names = {*self.names, *(n.split("__")[-1] for n in self.names)}
        if odd := sorted(set(self.feature_types) - names):
            raise InputError(f"types are declared of features that there are none of: {', '.join(odd)}")
        for kind in self.feature_types.values():
            feature_type("x", "double", kind)

    @property
    def names(self) -> list[str]:
        return [f"{m}__{c}" for m in self.methods for c in self.columns]

    def table(self) -> DataFrame:
        """Features and targets of every bar; targets only where all features are known (common support)."""
        wide = features(causal_only(self.long), self.methods, self.columns)
        goal = targets.forward(self.bars, self.timeframe, self.targets)
        lost = wide.select(*KEYS, "ts").join(goal.select(*KEYS, "ts"), [*KEYS, "ts"], "left_anti")
        if not lost.isEmpty():
            raise InputError("some rows with features have no bar")
        whole = F.lit(True)
        for c in self.names:
            whole = whole & F.col(c).isNotNull()
        joined = wide.join(goal, [*KEYS, "ts"]).withColumn("__whole", whole)
        if self.stratum:
            place = F.when(F.col(self.stratum).cast("string") != "HORS_SESSION", F.col(self.stratum).cast("string"))
            joined = joined.join(self.bars.select(*KEYS, "ts", place.alias(self.stratum)), [*KEYS, "ts"], "left")
        own = [F.col(t).isNotNull().alias(f"__own_{t}") for t in self.targets]
        return joined.select(*KEYS, "ts", *self.names, *([self.stratum] if self.stratum else []), "__whole", *own, *(F.when(F.col("__whole"), F.col(t)).alias(t) for t in self.targets), *(f"{t}_end" for t in self.targets))

    def run(self) -> dict[str, list]:
        """Results by name, as rows of small tables."""
        rows = materialize(self.table(), "study")
        kinds = dict(rows.dtypes)
        types = {n: feature_type(n, kinds[n], self.feature_types.get(n, self.feature_types.get(n.split("__")[-1]))) for n in self.names}
        n = rows.groupBy(*KEYS).count().agg(F.min("count")).first()[0] or 0
        parts = folds(n, **self.split)
        purge = self.split.get("kind", "holdout") != "in_sample"
        found: dict[str, list] = {"results": [], "tests": [], "conditional": [], "stratified": [], "strata_coverage": []}
        for t in self.targets:
            dealt = materialize(split(rows, parts, t if purge else None), "dealt")
            before = {(r.asset, r.timeframe, r.fold): r["n"] for r in split(rows, parts).filter("part = 'train'").groupBy(*KEYS, "fold").agg(F.count("*").alias("n")).collect()} if purge else {}
            for f in self.names:
                found["results"] += self._measures(dealt, f, types[f], t, before)
                if self.modality_tests:
                    found["tests"] += self._tests(dealt.filter("part = 'test'"), f, t, [])
                for p in parts:
                    test = dealt.filter((F.col("part") == "test") & (F.col("fold") == p.number))
                    found["conditional"] += [{"fold": p.number, "feature": f, "target": t, **{k if k != f else "value": v if k != f else str(v) for k, v in r.asDict().items()}} for r in report.conditional(test, f, t, self.timeframe).collect()]
                if self.stratum:
                    held = dealt.filter(F.col("part") == "test")
                    inside = held.filter(F.col(self.stratum).isNotNull())
                    found["stratified"] += self._tests(inside, f, t, [self.stratum])
                    usable = F.sum((F.col(f).isNotNull() & _finite(t)).cast("long"))
                    found["strata_coverage"] += [{"feature": f, "target": t, **r.asDict()} for r in held.groupBy(*KEYS, "fold", self.stratum).agg(F.count("*").alias("n"), usable.alias("n_usable")).collect()]
        family = found["tests"] + found["stratified"]
        modality_tests(family, into=True)
        if self.inference:
            for r, a in zip(family, S.benjamini_yekutieli([r.get("p_bootstrap") for r in family]), strict=True):
                r["adjusted_bootstrap"], r["reject_bootstrap"] = a, None if a is None else a <= self.inference.alpha
        found["coverage"] = self._coverage(rows)
        found["stability"] = self._stability(found["tests"])
        self._rows, self.results = rows, found
        return found

    def _measures(self, dealt: DataFrame, f: str, kind: str, t: str, before: dict) -> list[dict]:
        by = [*KEYS, "fold", "part"]
        here = F.col(f).isNotNull() & _finite(t)
        counts = {tuple(r[k] for k in by): r for r in dealt.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(here.cast("long")).alias("n")).collect()}
        ic = {} if kind == "nominal" else {tuple(r[k] for k in by): r for r in rank_correlation(dealt, f, t, by).collect()}
        signed = kind == "directional" and t.startswith("ret_")
        hit = {tuple(r[k] for k in by): r for r in hit_rate(_signed(dealt, f), f, t, by).collect()} if signed else {}
        out: dict[tuple, dict] = {}
        for key, r in counts.items():
            row = out.setdefault(key[:3], {"asset": key[0], "timeframe": key[1], "fold": key[2], "feature": f, "target": t, "feature_type": kind})
            own, part, hits = ic.get(key), key[3], hit.get(key)
            row[f"n_{part}"] = r.n
            row[f"ic_{part}"] = own.ic if own else None
            row[f"pvalue_{part}"] = correlation_p(own.ic, own.n) if own else None
            row[f"ic_status_{part}"] = "not_applicable_nominal" if kind == "nominal" else "insufficient_samples" if r.n < LEAST_ROWS else "constant" if not own or own.ic is None else "ok"
            row[f"n_hit_{part}"] = hits.n if hits else 0
            row[f"hit_{part}"] = hits.hit_rate if hits else None
            row[f"hit_status_{part}"] = "not_applicable_non_directional" if kind != "directional" else "not_applicable_target" if not signed else "ok" if hits and hits.n >= LEAST_ROWS else "insufficient_samples"
            if part == "train":
                row["n_purge_train"] = before.get(key[:3], r["rows"]) - r["rows"]
        return list(out.values())

    def _tests(self, test: DataFrame, f: str, t: str, more: list[str]) -> list[dict]:
        by = [*KEYS, "fold", *more]
        own = [r.asDict() for r in modality_statistics(test, f, t, by).collect()]
        if not own:
            return []
        values = sorted({r["value"] for r in own})
        value, y = F.col(f).cast("string"), F.when(F.col(f).isNotNull() & _finite(t), F.col(t).cast("double"))
        ends = {tuple(r[k] for k in by): r for r in test.groupBy(*by).agg(*(F.percentile(F.when(value != v, y), F.lit(0.5)).alias(f"m{k}") for k, v in enumerate(values))).collect()}
        out = []
        for v_at, v in enumerate(values):
            flag = F.when(y.isNotNull(), F.when(value == v, F.lit("own")).otherwise(F.lit("rest")))
            each = test.withColumn("__side", flag)
            runs: dict[tuple, dict[str, int]] = {}
            for side in ("own", "rest"):
                held = each.withColumn("__s", F.when(F.col("__side") == side, F.lit(1)))
                if more:  # rows of other strata are masked, not closed up
                    held = held.withColumn("__s", F.when(F.col("__s").isNotNull(), F.col(more[0])))
                order = Window.partitionBy(*KEYS, "fold").orderBy("ts")
                joined = (F.lag("__s").over(order) == F.col("__s")) & (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order)) == seconds(self.timeframe))
                begun = held.withColumn("__new", F.col("__s").isNotNull() & ~F.coalesce(joined, F.lit(False))).filter("__new").groupBy(*by).count().collect()
                for r in begun:
                    runs.setdefault(tuple(r[k] for k in by), {})[side] = r["count"]
            for r in own:
                if r["value"] == v:
                    key = tuple(r[k] for k in by)
                    rest = ends[key][f"m{v_at}"]
                    a, b = runs.get(key, {}).get("own", 0), runs.get(key, {}).get("rest", 0)
                    few = min(r["n"], r["n_rest"]) < 2
                    both = r["n"] and r["n_rest"]
                    out.append({"feature": f, "target": t, **r, "n_episodes": a, "n_episodes_rest": b, "mean_diff": r["mean"] - r["mean_rest"] if both else None, "median_diff": r["median"] - rest if both else None, "status": "insufficient_samples" if few else "insufficient_episodes" if min(a, b) < 2 else "descriptive"})
        if self.inference:
            got = {(*(r[k] for k in by), r["value"]): r for r in bootstrap(test, f, t, self.timeframe, block=self.inference.block, rounds=self.inference.rounds, seed=self.inference.seed, by=("fold", *more)).collect()}
            for r in out:
                own_row = got.get((*(r[k] for k in by), r["value"]))
                r |= {"low": own_row.low if own_row else None, "high": own_row.high if own_row else None, "p_bootstrap": own_row.p if own_row else None, "n_valid_draws": own_row.valid if own_row else 0}
        return out

    def _coverage(self, rows: DataFrame) -> list[dict]:
        left_out = {(r.asset, r.timeframe, r.method): r.asDict() for r in exclusions(causal_only(self.long)).collect()}
        out = []
        for f in self.names:
            for t in self.targets:
                own = F.col(f).isNotNull() & F.col(f"__own_{t}")
                count = lambda c: F.sum(c.cast("long"))
                for r in rows.groupBy(*KEYS).agg(F.count("*").alias("n_total"), count(own).alias("n_own"), F.count(t).alias("n_common"), count(F.col(f).isNull()).alias("n_feature_invalid"), count(~F.col(f"__own_{t}")).alias("n_target_invalid")).collect():
                    more = left_out.get((r.asset, r.timeframe, f.split("__")[0]), {})
                    out.append({"feature": f, "target": t, **r.asDict(), "coverage_own": r.n_own / r.n_total, "coverage_common": r.n_common / r.n_total, **{k: v for k, v in more.items() if k not in (*KEYS, "method")}})
        return out

    def _stability(self, tests: list[dict]) -> list[dict]:
        groups: dict[tuple, list[dict]] = {}
        for r in tests:
            groups.setdefault((r["asset"], r["timeframe"], r["feature"], r["target"], r["value"]), []).append(r)
        out = []
        for key, held in sorted(groups.items()):
            effects = np.array([r["mean_diff"] for r in held if r["mean_diff"] is not None])
            up, down = int((effects > 0).sum()), int((effects < 0).sum())
            some = len(effects) > 0
            out.append({
                **dict(zip(("asset", "timeframe", "feature", "target", "value"), key, strict=True)), "folds": len(held), "estimable": len(effects), "sufficient": sum(r["status"] == "descriptive" for r in held),
                "mean": float(effects.mean()) if some else None, "std": float(effects.std(ddof=1)) if len(effects) > 1 else None, "min": float(effects.min()) if some else None, "max": float(effects.max()) if some else None,
                "n_up": up, "n_down": down, "n_zero": len(effects) - up - down, "same_sign": max(up, down) / len(effects) if some else None,
            })
        return out

    def report(self) -> str:
        """All small tables as Markdown."""
        if self.results is None:
            raise InputError("run the study first")
        titles = {"results": "Overview of all folds", "conditional": "Targets by value", "stability": "Stability of effects between folds", "tests": "Tests of each value against the rest", "coverage": "Coverage and common support", "strata_coverage": "Coverage by stratum", "stratified": "Tests within strata"}
        body = [report.markdown(title, self.results[k]) for k, title in titles.items() if self.results.get(k)]
        if not any(r["n_common"] for r in self.results["coverage"]):
            body.append("No estimate: the common support is empty.\n")
        return f"# Study of {', '.join(self.names)}\n\nFolds: {self.split.get('kind', 'holdout')}. Estimates of a target use the same rows for all features.\n\n" + "\n".join(body)

    def save(self, path: str) -> None:
        """Publish all tables, the report and a manifest under ``path``, or nothing."""
        if self.results is None:
            raise InputError("run the study first")
        T.refuse(path, self.inputs)
        spark = self.long.sparkSession
        tables = {f"study_{k}": _frame(spark, v) for k, v in self.results.items() if v}
        tables["study_target_ends"] = self._rows.select(*KEYS, "ts", *(f"{t}_end" for t in self.targets))
        tables["study_common_support"] = self._rows.select(*KEYS, "ts", *(F.col(t).isNotNull().alias(t) for t in self.targets))
        manifest = {"timeframe": self.timeframe, "features": self.names, "targets": self.targets, "split": self.split, "stratum": self.stratum, "inference": self.inference and self.inference.__dict__, "analysis": "exploratory" if self.split.get("kind") == "in_sample" else "held out", "rows": content_hash(self._rows), "inputs": list(self.inputs)}
        T.write_study(spark, tables, manifest, path, texts={"study_report.md": self.report()}, inputs=self.inputs)


def _signed(rows: DataFrame, feature: str) -> DataFrame:
    """A truth value as a sign: true is up and false is down."""
    if dict(rows.dtypes)[feature] != "boolean":
        return rows
    return rows.withColumn(feature, F.when(F.col(feature), 1.0).when(~F.col(feature), -1.0))


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of one shape as a table, each column of the type of its values."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kind = lambda c: next(({bool: "boolean", int: "long", float: "double"}.get(type(r[c]), "string") for r in rows if r.get(c) is not None), "string")
    kinds = {c: "string" if any(isinstance(r.get(c), str) for r in rows) else "double" if any(isinstance(r.get(c), float) for r in rows) else kind(c) for c in names}
    cast = {"double": float, "long": int, "boolean": bool, "string": str}
    data = [tuple(None if r.get(c) is None else cast[kinds[c]](r[c]) for c in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def correlation_p(ic: float | None, n: int) -> float | None:
    return None if ic is None or math.isnan(ic) else S.spearman_p(ic, n)


def rank_of(values: list[float]) -> np.ndarray:
    """Average ranks, largest first."""
    x = -np.asarray(values)
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x))
    rank[order] = np.arange(1, len(x) + 1)
    return np.array([rank[x == v].mean() for v in x])
