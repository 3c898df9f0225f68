"""Descriptive statistics of labels: states, persistence, transitions, confidence, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.context import episodes
from tidemark.schema import KEYS, UNKNOWN, micros, seconds


def states(rows: DataFrame, label: str = "regime", measures: tuple[str, ...] = ("vol", "ret", "range", "close_pos")) -> DataFrame:
    """Per series and label: rows, share in percent, and means of the measures (with the deviation of ret)."""
    held = [m for m in measures if m in rows.columns]
    aggregates = [F.count("*").alias("n"), *(F.avg(m).alias(f"mean_{m}") for m in held)]
    if "ret" in held:
        aggregates.append(F.stddev_samp("ret").alias("std_ret"))
    out = rows.filter(F.col(label).isNotNull()).groupBy(*KEYS, label).agg(*aggregates)
    return out.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS)))


def persistence(rows: DataFrame, timeframe: str, label: str = "regime") -> DataFrame:
    """Per series and label: number and lengths of episodes, in bars."""
    runs = episodes(rows, label, timeframe).filter(F.col(label).isNotNull()).groupBy(*KEYS, label, "episode").agg(F.count("*").alias("bars"))
    exact = lambda q: F.percentile("bars", F.lit(q))
    return runs.groupBy(*KEYS, label).agg(F.count("*").alias("n_episodes"), F.avg("bars").alias("mean_bars"), exact(0.5).alias("median_bars"), F.max("bars").alias("max_bars"), exact(0.25).alias("p25_bars"), exact(0.75).alias("p75_bars"))


def transitions(rows: DataFrame, timeframe: str, label: str = "regime") -> DataFrame:
    """Counts and shares of label pairs on adjacent bars."""
    order = Window.partitionBy(*KEYS).orderBy("ts")
    step = seconds(timeframe) * 1_000_000
    pairs = rows.withColumn("to_state", F.lead(label).over(order)).withColumn("gap", micros(F.lead("ts").over(order)) - micros(F.col("ts")))
    pairs = pairs.filter((F.col("gap") == step) & F.col(label).isNotNull() & F.col("to_state").isNotNull())
    out = pairs.groupBy(*KEYS, F.col(label).alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    return out.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS, "from_state")))


def confidence(rows: DataFrame, label: str = "regime") -> DataFrame:
    """Per series and label: count, mean, deviation and bounds of the confidence."""
    return rows.groupBy(*KEYS, label).agg(F.count("confidence").alias("n"), F.avg("confidence").alias("mean"), F.stddev_samp("confidence").alias("std"), F.min("confidence").alias("min"), F.max("confidence").alias("max"))


def monthly(rows: DataFrame, label: str = "regime", least_days: int = 18) -> DataFrame:
    """Per month and label the share in percent; the first and last months, and months of few days, are left out."""
    dated = rows.withColumn("month", F.date_format("ts", "yyyy-MM"))
    months = dated.groupBy(*KEYS, "month").agg(F.countDistinct(F.to_date("ts")).alias("days"))
    whole = Window.partitionBy(*KEYS)
    months = months.withColumn("first", F.min("month").over(whole)).withColumn("last", F.max("month").over(whole)).filter((F.col("month") != F.col("first")) & (F.col("month") != F.col("last")) & (F.col("days") >= least_days))
    out = dated.filter(F.col(label).isNotNull()).join(months.select(*KEYS, "month"), [*KEYS, "month"]).groupBy(*KEYS, "month", label).agg(F.count("*").alias("n"))
    return out.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS, "month")))


def conditional(rows: DataFrame, feature: str, target: str, timeframe: str) -> DataFrame:
    """Per value of a feature: rows, episodes and the target's distribution."""
    held = episodes(rows.withColumn("__f", F.when(F.col(target).isNotNull(), F.col(feature))), "__f", timeframe).filter(F.col("__f").isNotNull())
    return held.groupBy(*KEYS, F.col("__f").alias(feature)).agg(F.count("*").alias("n"), F.countDistinct("episode").alias("n_episodes"), F.avg(target).alias("mean"), F.percentile(target, F.lit(0.5)).alias("median"), F.stddev_samp(target).alias("std"), F.min(target).alias("min"), F.max(target).alias("max"))


def text(spark_rows: dict[str, list]) -> str:
    """A plain report of collected tables, one section each."""
    out = []
    for title, rows in spark_rows.items():
        out += [title, "-" * len(title)]
        out += [", ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) for r in rows] or ["(none)"]
        out.append("")
    return "\n".join(out)


def markdown(title: str, rows: list) -> str:
    """A Markdown table of collected rows or mappings; a column that a row lacks is empty there."""
    if not rows:
        return f"## {title}\n\n(none)\n"
    held = [r if isinstance(r, dict) else r.asDict() for r in rows]
    names = list(dict.fromkeys(k for r in held for k in r))
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(shown(r.get(k)) for k in names) + " |" for r in held]
    return "\n".join([f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body, ""])


def full(long: DataFrame) -> str:
    """A text report of a long table of labels, six sections for each method and timeframe that it has."""
    out = []
    for method, timeframe in sorted((r[0], r[1]) for r in long.select("method", "timeframe").distinct().collect()):
        rows = long.filter((F.col("method") == method) & (F.col("timeframe") == timeframe))
        rows = rows.withColumn("regime", F.when(F.col("regime") != UNKNOWN, F.col("regime")))
        known = rows.filter("regime is not null")
        span = rows.groupBy(*KEYS).agg(F.count("*").alias("bars"), F.count("regime").alias("labelled"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        tables = {"1. Series": span, "2. States": states(rows), "3. Persistence": persistence(rows, timeframe), "4. Transitions": transitions(rows, timeframe), "5. Confidence": confidence(known), "6. Shares by month": monthly(rows)}
        out.append(f"{method} {timeframe}\n{'=' * (len(method) + len(timeframe) + 1)}\n" + text({k: v.orderBy(*[c for c in v.columns if c in (*KEYS, "month", "regime", "from_state", "to_state")]).collect() for k, v in tables.items()}))
    return "\n".join(out)
