"""Scores by which detector parameters are chosen, and their search."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.statistics import kappa
from tidemark.operators.study import rank_correlation
from tidemark.schema import KEYS, micros, seconds

LEAST_STRATUM = 30


def contiguous(k: int, timeframe: str) -> Column:
    """Whether the row k ahead is exactly k bars ahead."""
    return micros(W.lead("ts", k)) - micros(F.col("ts")) == k * seconds(timeframe) * 1_000_000


def future_efficiency(bars: DataFrame, k: int, timeframe: str) -> DataFrame:
    """The share of the next k bars' path that is net movement; null across a hole or without a path."""
    out = bars.withColumn("__step", F.abs(F.col("close") - W.lag("close")))
    path = F.sum("__step").over(W.ahead(k))
    value = F.try_divide(F.abs(W.lead("close", k) - F.col("close")), F.when(path > 0, path))
    return out.withColumn("future_efficiency", F.when(contiguous(k, timeframe), value)).drop("__step")


def separation(rows: DataFrame, label: str, value: str, high: list[str], low: list[str]) -> DataFrame:
    """Per series the logarithm of the ratio of the medians of two groups of labels."""
    side = F.when(F.col(label).isin(high), "high").when(F.col(label).isin(low), "low")
    held = rows.withColumn("__side", side).filter(F.col("__side").isNotNull() & F.col(value).isNotNull())
    median = lambda s: F.percentile(F.when(F.col("__side") == s, F.col(value)), F.lit(0.5))
    out = held.groupBy(*KEYS).agg(median("high").alias("median_high"), median("low").alias("median_low"), F.count("*").alias("n"))
    ok = (F.col("median_high") > 0) & (F.col("median_low") > 0)
    return out.withColumn("score", F.when(ok, F.ln("median_high") - F.ln("median_low")))


def stratified_separation(rows: DataFrame, label: str, value: str, high: list[str], low: list[str], stratum: str, least: int = LEAST_STRATUM) -> DataFrame:
    """The same within each stratum, averaged by the smaller group's size; small strata are left out."""
    side = F.when(F.col(label).isin(high), "high").when(F.col(label).isin(low), "low")
    held = rows.withColumn("__side", side).filter(F.col("__side").isNotNull() & F.col(value).isNotNull())
    pick = lambda s, f: f(F.when(F.col("__side") == s, F.col(value)))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    each = held.groupBy(*KEYS, stratum).agg(pick("high", middle).alias("h"), pick("low", middle).alias("l"), pick("high", F.count).alias("nh"), pick("low", F.count).alias("nl"))
    each = each.withColumn("w", F.least("nh", "nl")).filter((F.col("w") >= least) & (F.col("h") > 0) & (F.col("l") > 0))
    return each.groupBy(*KEYS).agg((F.sum((F.ln("h") - F.ln("l")) * F.col("w")) / F.sum("w")).alias("score"), F.count("*").alias("n_strata"))


def clock_baseline(bars: DataFrame, hours: list[int], hour: str = "ctx_hour_ny") -> DataFrame:
    """A label from the hour alone."""
    return bars.withColumn("clock", F.when(F.col(hour).isin(hours), "HIGH").otherwise("LOW"))


def centred_volatility(bars: DataFrame, k: int) -> DataFrame:
    """Deviation of returns over the k bars on either side, and the same less its hour's median."""
    out = bars.withColumn("__ret", W.log_return())
    frame = W.series().rowsBetween(-k, k)
    out = out.withColumn("realised", F.when(F.count("__ret").over(frame) == 2 * k + 1, F.stddev_samp("__ret").over(frame)))
    hour = Window.partitionBy(*KEYS, F.hour("ts"))
    return out.withColumn("deseasonal", F.try_divide(F.col("realised"), F.percentile("realised", F.lit(0.5)).over(hour))).drop("__ret")


def terciles(rows: DataFrame, value: str, lower: float = 1 / 3, upper: float = 2 / 3) -> DataFrame:
    """Labels LOW, MIDDLE and HIGH by the series' exact quantiles."""
    cuts = rows.groupBy(*KEYS).agg(F.percentile(value, F.lit(lower)).alias("__lo"), F.percentile(value, F.lit(upper)).alias("__hi"))
    x = F.col(value)
    return rows.join(cuts, KEYS).withColumn("tercile", F.when(x <= F.col("__lo"), "LOW").when(x >= F.col("__hi"), "HIGH").when(x.isNotNull(), "MIDDLE")).drop("__lo", "__hi")


def agreement(rows: DataFrame, a: str, b: str) -> float:
    """Cohen's kappa of two labels, from their contingency table."""
    held = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count().collect()
    return kappa([tuple(r) for r in held])


def switches_per_day(rows: DataFrame, label: str) -> DataFrame:
    changed = (F.lag(label).over(W.series()) != F.col(label)).cast("long")
    held = rows.withColumn("__c", changed)
    return held.groupBy(*KEYS).agg((F.sum("__c") / F.countDistinct(F.to_date("ts"))).alias("switches_per_day"))


def quantile_thresholds(rows: DataFrame, value: str, lower: float, upper: float) -> DataFrame:
    """Exact in-sample quantiles of a measure, to be used out of sample."""
    return rows.groupBy(*KEYS).agg(F.percentile(value, F.lit(lower)).alias("low"), F.percentile(value, F.lit(upper)).alias("high"))


def directional_agreement(rows: DataFrame, label: str, up: str, down: str, k: int, timeframe: str) -> DataFrame:
    """How often the next k bars move as a trend label says."""
    move = F.signum(W.lead("close", k) - F.col("close"))
    held = rows.withColumn("__m", F.when(contiguous(k, timeframe), move)).filter(F.col(label).isin(up, down) & F.col("__m").isNotNull())
    right = F.when(F.col(label) == up, F.col("__m") > 0).otherwise(F.col("__m") < 0)
    return held.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("agreement"))


def fidelity(rows: DataFrame, label: str, reference: str, lags: list[int]) -> list[dict]:
    """Cohen's kappa of a label with a reference label, the reference taken so many bars later."""
    out = []
    for k in lags:
        shifted = rows.withColumn("__r", W.lead(reference, k) if k >= 0 else W.lag(reference, -k))
        out.append({"lag": k, "kappa": agreement(shifted, label, "__r")})
    return out


def lagged_correlation(rows: DataFrame, measure: str, reference: str, lags: list[int]) -> DataFrame:
    """Per series Spearman's rho at lag 0, the greatest over the lags and the lag that has it; the measure is taken so many bars earlier."""
    made = [F.struct(F.lit(k).alias("lag"), (W.lag(measure, k) if k else F.col(measure)).alias("x")) for k in lags]
    each = rows.withColumn("__lags", F.array(*made)).select(*KEYS, F.col(reference).alias("y"), F.explode("__lags").alias("l")).select(*KEYS, "l.lag", "l.x", "y")
    found = rank_correlation(each, "x", "y", [*KEYS, "lag"])
    best = F.max_by("lag", F.struct("ic", -F.col("lag")))
    return found.groupBy(*KEYS).agg(F.max(F.when(F.col("lag") == 0, F.col("ic"))).alias("rho_lag0"), F.max("ic").alias("rho_max"), best.alias("best_lag"))


def block_agreement(rows: DataFrame, a: str, b: str, block: Column) -> DataFrame:
    """Per series Cohen's kappa over all rows, and the least of its blocks, from contingency counts."""
    counts = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*KEYS, block.alias("block"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))

    def kappas(held: DataFrame, by: list[str]) -> DataFrame:
        whole = Window.partitionBy(*by)
        shared = held.withColumn("n_all", F.sum("n").over(whole)).withColumn("row", F.sum("n").over(Window.partitionBy(*by, "a"))).withColumn("col", F.sum("n").over(Window.partitionBy(*by, "b")))
        same = F.col("a") == F.col("b")
        # chance is the sum over labels of both shares; a label that never agrees has no cell of its own, so it comes from the margins
        left = held.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("l"))
        right = held.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("r"))
        chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("l") * F.col("r")).alias("chance"))
        agree = shared.groupBy(*by).agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agree"), F.first("n_all").alias("n"))
        both = agree.join(chance, by, "left").withColumn("c", F.coalesce(F.col("chance"), F.lit(0)) / (F.col("n") * F.col("n")))
        return both.select(*by, "n", F.when(F.col("c") == 1, 1.0).otherwise((F.col("agree") / F.col("n") - F.col("c")) / (1 - F.col("c"))).alias("kappa"))

    blocks = kappas(counts, [*KEYS, "block"]).groupBy(*KEYS).agg(F.min("kappa").alias("least_kappa"), F.count("*").alias("n_blocks"))
    return kappas(counts.groupBy(*KEYS, "a", "b").agg(F.sum("n").alias("n")), KEYS).join(blocks, KEYS)


def kappa_sweep(found: list[dict], parameter: str, tolerance: float) -> list[dict]:
    """For each value of a parameter its best kappa over all others, and whether it lies on the plateau."""
    best: dict = {}
    for p in found:
        if p["score"] is not None and p["score"] > best.get(p[parameter], (-2.0,))[0]:
            best[p[parameter]] = (p["score"], p)
    top = max((v[0] for v in best.values()), default=0.0)
    return [{parameter: k, "kappa": v[0], "plateau": top - v[0] <= tolerance, "best": v[1]} for k, v in sorted(best.items())]


def shares(rows: DataFrame, label: str) -> DataFrame:
    """Per series and label its share of the labelled bars."""
    out = rows.filter(F.col(label).isNotNull()).groupBy(*KEYS, label).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS)))


def plateau(found: list[dict], parameter: str, tolerance: float) -> list:
    """Values of a parameter whose best score comes within a tolerance of the best of all."""
    best = max(p["score"] for p in found if p["score"] is not None)
    return sorted({p[parameter] for p in found if p["score"] is not None and best - p["score"] <= tolerance})


def grid_search(grid: dict[str, list], score: Callable[..., float]) -> list[dict]:
    """All combinations by falling score; the first is the best."""
    found = [{**dict(zip(grid, x, strict=True))} for x in itertools.product(*grid.values())]
    for p in found:
        p["score"] = score(**p)
    return sorted(found, key=lambda p: (p["score"] is None, -(p["score"] or 0)))


def expanding_folds(months: list[str], test: int = 2) -> list[tuple[list[str], list[str]]]:
    """Growing training months, each with the ``test`` months after them."""
    return [(months[:k], months[k : k + test]) for k in range(test, len(months) - test + 1, test)]


def validated_search(grid: dict[str, list], score: Callable[..., float | None], folds: list[tuple]) -> list[dict]:
    """Per fold (train, test): the choice by the training score, its test score, its rank among all, and its regret.

    ``score(part, **parameters)`` gives the score on a part of the data; a score that can't be had is
    the worst, and equal scores share their average rank.
    """
    choices = [dict(zip(grid, x, strict=True)) for x in itertools.product(*grid.values())]
    worst = lambda x: -float("inf") if x is None else x
    out = []
    for train, test in folds:
        trained, tested = [score(train, **c) for c in choices], [score(test, **c) for c in choices]
        at = max(range(len(choices)), key=lambda k: worst(trained[k]))
        own, best = tested[at], max(tested, key=worst)
        above, equal = sum(worst(x) > worst(own) for x in tested), sum(worst(x) == worst(own) for x in tested)
        out.append({"train": train, "test": test, **choices[at], "train_score": trained[at], "test_score": own, "test_rank": above + (equal + 1) / 2, "regret": None if own is None or best is None else best - own, "best_of_test": choices[tested.index(best)]})
    return out


def protocol_measures(rows: DataFrame, label: str, timeframe: str, orientation: dict[str, int] | None = None) -> DataFrame:
    """Per episode: bars, net move, path, regularity, amplitude and the greatest move against the net one.

    With ``orientation``, the sign that each label declares, declared_net and declared_opposite measure
    the move along the declared direction and the greatest against it; they are null where none is declared.
    """
    from tidemark.operators.context import episodes

    held = episodes(rows, label, timeframe).filter(F.col("episode").isNotNull())
    own = Window.partitionBy(*KEYS, "episode").orderBy("ts")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__step", F.coalesce(F.abs(F.col("close") - F.lag("close").over(own)), F.lit(0.0))).withColumn("__draw", F.max("close").over(upto) - F.col("close")).withColumn("__rise", F.col("close") - F.min("close").over(upto))
    out = held.groupBy(*KEYS, label, "episode").agg(F.min("ts").alias("debut"), F.max("ts").alias("fin"), F.count("*").alias("bars"), F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"), F.sum("__step").alias("path"), (F.max("close") - F.min("close")).alias("amplitude"), F.max("__draw").alias("draw"), F.max("__rise").alias("rise"))
    net = F.col("last") - F.col("first")
    shown = [net.alias("net"), "path", "amplitude", F.try_divide(F.abs(net), F.when(F.col("path") > 0, F.col("path"))).alias("regularity"), F.when(net >= 0, F.col("draw")).otherwise(F.col("rise")).alias("opposite")]
    if orientation:
        sign = F.try_element_at(F.create_map(*[F.lit(x) for pair in orientation.items() for x in pair]), F.col(label))
        shown += [(sign * net).alias("declared_net"), F.when(sign > 0, F.col("draw")).when(sign < 0, F.col("rise")).alias("declared_opposite")]
    return out.select(*KEYS, label, "episode", "debut", "fin", "bars", *shown)


def protocol_rates(rows: DataFrame, label: str, timeframe: str) -> DataFrame:
    """Per series and label: episodes in 100 hours of labelled bars, and the share of those bars that the label occupies."""
    from tidemark.operators.context import episodes

    held = episodes(rows, label, timeframe).filter(F.col("episode").isNotNull())
    each = held.groupBy(*KEYS, label).agg(F.countDistinct("episode").alias("n_episodes"), F.count("*").alias("bars"))
    all_ = F.sum("bars").over(Window.partitionBy(*KEYS))
    return each.select(*KEYS, label, "n_episodes", "bars", (100 * F.col("n_episodes") * 3600 / (all_ * seconds(timeframe))).alias("per_100_hours"), (F.col("bars") / all_).alias("occupancy"))
