"""Quote ticks to bars, bars to longer bars, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detectors import validity
from tidemark.schema import InputError, bar_end, micros, require, seconds

TICK = ["asset", "ts", "seq", "bid_price", "ask_price", "bid_volume", "ask_volume"]


def price(side: str) -> Column:
    """The price that bars are made of."""
    if side == "bid":
        return F.col("bid_price")
    if side == "ask":
        return F.col("ask_price")
    if side == "mid":
        return (F.col("bid_price") + F.col("ask_price")) / 2
    raise InputError(f"price side must be bid, ask or mid, not {side!r}")


def tick_violations(ticks: DataFrame) -> DataFrame:
    """One row of counts: missing times, values that aren't finite, prices not above 0, negative volumes, crossed quotes."""
    require(ticks, TICK)
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    any_ = lambda f: F.coalesce(F.sum(F.when(f, 1).otherwise(0)), F.lit(0)).cast("long")
    return ticks.agg(
        F.count("*").alias("n_rows"),
        any_(F.col("ts").isNull()).alias("no_time"),
        any_(odd("bid_price") | odd("ask_price") | odd("bid_volume") | odd("ask_volume")).alias("not_finite"),
        any_((F.col("bid_price") <= 0) | (F.col("ask_price") <= 0)).alias("price_not_positive"),
        any_((F.col("bid_volume") < 0) | (F.col("ask_volume") < 0)).alias("volume_negative"),
        any_(F.col("ask_price") < F.col("bid_price")).alias("crossed"),
    )


def check_ticks(ticks: DataFrame) -> DataFrame:
    """``ticks``, or an error that says what is wrong with them."""
    found = tick_violations(ticks).first().asDict()
    wrong = {k: v for k, v in found.items() if k != "n_rows" and v}
    if wrong:
        raise InputError(f"ticks break their contract: {wrong}")
    return ticks


def normalize_ticks(ticks: DataFrame, start: str, end: str, *, drop_crossed: bool = False) -> DataFrame:
    """Checked ticks of [start, end), both in UTC; crossed quotes are an error, or dropped. Ticks of one time all stay."""
    ts = lambda x: F.lit(x).cast("timestamp")
    held = ticks.filter((F.col("ts") >= ts(start)) & (F.col("ts") < ts(end)))
    if drop_crossed:
        held = held.filter(~F.coalesce(F.col("ask_price") < F.col("bid_price"), F.lit(False)))
    return check_ticks(held)


def tick_jumps(ticks: DataFrame, *, threshold: float | None = None, relative: float | None = None) -> DataFrame:
    """(asset, day, n_jumps): per UTC day, ticks whose bid moved by more than one of the thresholds; days with some only."""
    if (threshold is None) == (relative is None):
        raise InputError("give either threshold or relative")
    limit = F.lit(threshold if threshold is not None else relative)

    def jumped(now: Column, before: Column) -> Column:
        move = F.abs(now - before)
        return (move if threshold is not None else F.try_divide(move, before)) > limit

    # a day of an asset is sorted in a task of its own; its first tick meets the last one of the day before
    dated = ticks.select("asset", F.to_date("ts").alias("day"), "ts", "seq", "bid_price")
    order = F.struct("ts", "seq")
    inside = dated.withColumn("before", F.lag("bid_price").over(Window.partitionBy("asset", "day").orderBy("ts", "seq")))
    days = dated.groupBy("asset", "day").agg(F.min_by("bid_price", order).alias("first"), F.max_by("bid_price", order).alias("last"))
    edges = days.withColumn("before", F.lag("last").over(Window.partitionBy("asset").orderBy("day")))
    both = inside.filter(jumped(F.col("bid_price"), F.col("before"))).select("asset", "day").unionByName(edges.filter(jumped(F.col("first"), F.col("before"))).select("asset", "day"))
    return both.groupBy("asset", "day").agg(F.count("*").alias("n_jumps"))


def from_ticks(ticks: DataFrame, timeframe: str, *, side: str = "bid", fill_seconds: int | None = None) -> DataFrame:
    """Enriched bars [T-p, T) of each asset; empty bars are left out, or filled flat in gaps up to ``fill_seconds``."""
    require(ticks, TICK)
    order = F.struct("ts", "seq")
    spread = F.col("ask_price") - F.col("bid_price")
    rows = ticks.select("asset", "ts", "seq", bar_end(F.col("ts"), timeframe, "left").alias("end"), price(side).alias("price"), spread.alias("spread"), "ask_price", "bid_volume", "ask_volume")
    bars = rows.groupBy("asset", "end").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        (F.sum("bid_volume") + F.sum("ask_volume")).alias("volume"),
        F.sum("bid_volume").alias("bid_volume"),
        F.sum("ask_volume").alias("ask_volume"),
        F.avg("spread").alias("spread_mean"),
        F.max("spread").alias("spread_max"),
        F.max_by("spread", order).alias("spread_close"),
        F.max_by("ask_price", order).alias("ask_close"),
        F.count("*").alias("tick_count"),
    )
    bars = bars.withColumnRenamed("end", "ts").withColumn("timeframe", F.lit(timeframe))
    if fill_seconds is not None:
        bars = fill_gaps(bars, timeframe, fill_seconds)
    return mark_ends(bars)


def mark_ends(bars: DataFrame) -> DataFrame:
    """is_partial for the first and the last bar of each series."""
    whole = Window.partitionBy("asset", "timeframe")
    return bars.withColumn("is_partial", (F.col("ts") == F.min("ts").over(whole)) | (F.col("ts") == F.max("ts").over(whole)))


def fill_gaps(bars: DataFrame, timeframe: str, fill_seconds: int) -> DataFrame:
    """Flat bars in each run of missing ones that is no longer than the threshold; longer runs stay empty."""
    step = seconds(timeframe)
    order = Window.partitionBy("asset", "timeframe").orderBy("ts")
    gap = (micros(F.lead("ts").over(order)) - micros(F.col("ts"))) / 1_000_000 - step
    known = bars.withColumn("__gap", gap)
    short = known.filter((F.col("__gap") > 0) & (F.col("__gap") <= fill_seconds))
    ends = F.transform(F.sequence(F.lit(1), (F.col("__gap") / step).cast("int")), lambda k: F.timestamp_micros(micros(F.col("ts")) + k.cast("long") * (step * 1_000_000)))
    flat = short.withColumn("__ends", ends).withColumn("__at", F.explode("__ends"))
    made = {"ts": "__at", "open": "close", "high": "close", "low": "close", "spread_mean": "spread_close", "spread_max": "spread_close"}
    zero = {"volume": "double", "bid_volume": "double", "ask_volume": "double", "tick_count": "long"}
    filled = flat.select(*[F.lit(0).cast(zero[c]).alias(c) if c in zero else F.col(made.get(c, c)).alias(c) for c in bars.columns])
    return bars.unionByName(filled)


def resample(bars: DataFrame, source: str, target: str, *, expected: DataFrame | None = None) -> DataFrame:
    """Bars (T-p, T] of a longer timeframe, with how many of the expected source bars each has.

    ``expected`` (asset, ts) lists the labels that a session calendar expects; without it every bar
    expects as many as fit.
    """
    small, large = seconds(source), seconds(target)
    if large < small or large % small:
        raise InputError(f"{target} can't be made of {source}")
    require(bars, ["asset", "ts", "open", "high", "low", "close"])
    order = F.col("ts")
    rows = bars.withColumn("__end", bar_end(F.col("ts"), target, "right"))
    aggregates = [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close")]
    if "volume" in bars.columns:
        aggregates.append(F.sum("volume").alias("volume"))
    for c in ("bid_volume", "ask_volume", "tick_count"):
        if c in bars.columns:
            aggregates.append(F.coalesce(F.sum(c), F.lit(0)).alias(c))
    last = {"spread_close": "spread_close", "ask_close": "ask_close"}
    if "spread_mean" in bars.columns:
        aggregates.append(F.avg("spread_mean").alias("spread_mean"))
    if "spread_max" in bars.columns:
        aggregates.append(F.max("spread_max").alias("spread_max"))
    aggregates += [F.max_by(c, order).alias(c) for c in last if c in bars.columns]
    doubtful = ~validity(bars)
    out = rows.groupBy("asset", "__end").agg(*aggregates, F.max(doubtful).alias("__doubt"), F.count("*").alias("source_count"))
    if expected is None:
        out = out.withColumn("expected_count", F.lit(large // small).cast("long"))
    else:
        wanted = expected.select("asset", bar_end(F.col("ts"), target, "right").alias("__end")).groupBy("asset", "__end").agg(F.count("*").alias("expected_count"))
        out = out.join(wanted, ["asset", "__end"], "left").withColumn("expected_count", F.coalesce("expected_count", F.lit(0).cast("long")))
    return (
        out.withColumn("is_partial", F.col("__doubt") | (F.col("source_count") != F.col("expected_count")))
        .withColumn("coverage", F.when(F.col("expected_count") > 0, F.col("source_count") / F.col("expected_count")))
        .withColumnRenamed("__end", "ts")
        .withColumn("timeframe", F.lit(target))
        .drop("__doubt")
    )


def expected_grid(bars: DataFrame, timeframe: str) -> DataFrame:
    """(asset, timeframe, ts): every label from a series' first to its last."""
    step = seconds(timeframe) * 1_000_000
    ends = bars.groupBy("asset", "timeframe").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return ends.select("asset", "timeframe", F.explode(F.sequence(micros(F.col("lo")), micros(F.col("hi")), F.lit(step))).alias("us")).select("asset", "timeframe", F.timestamp_micros("us").alias("ts"))


def on_grid(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars on the expected grid; a missing bar is a row of nulls with ``present`` false."""
    return expected_grid(bars, timeframe).join(bars.withColumn("present", F.lit(True)), ["asset", "timeframe", "ts"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
