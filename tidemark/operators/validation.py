"""Checks of bars, series and their agreement; each is one aggregation, whose counts the caller may keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.detectors import validity
from tidemark.schema import IDENTITY, KEYS, PRICES, TIMEFRAMES, UNKNOWN, VOLUMES, InputError, micros, require, seconds, unaligned


def _count(flag) -> object:
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)), F.lit(0)).cast("long")


def time_violations(rows: DataFrame, timeframe: str | None = None) -> DataFrame:
    """Per series: rows, missing times, repeated times and times off the grid."""
    order = Window.partitionBy(*KEYS).orderBy("ts")
    again = F.coalesce(F.lag("ts").over(order) == F.col("ts"), F.lit(False))
    marked = rows.select(*KEYS, "ts", again.alias("again"))
    off = unaligned(F.col("ts"), timeframe) if timeframe else F.lit(False)
    return marked.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), _count(F.col("ts").isNull()).alias("no_time"), _count(F.col("again")).alias("repeated"), _count(off).alias("off_grid"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """Per series: prices that are missing, not finite or not above 0; highs and lows that don't bound; volumes not finite or below 0."""
    require(bars, ["asset", "timeframe", "ts", *PRICES])
    infinite = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    bad, negative, odd = F.lit(False), F.lit(False), F.lit(False)
    for c in PRICES:
        bad, negative = bad | F.col(c).isNull() | infinite(c), negative | (F.col(c) <= 0)
    for c in VOLUMES:
        if c in bars.columns:
            odd = odd | (F.col(c).isNotNull() & (infinite(c) | (F.col(c) < 0)))
    high = F.col("high") < F.greatest("open", "close", "low")
    low = F.col("low") > F.least("open", "close", "high")
    return bars.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), _count(bad).alias("not_finite"), _count(negative).alias("not_positive"), _count(high).alias("high_too_low"), _count(low).alias("low_too_high"), _count(odd).alias("bad_volume"))


def check_bars(bars: DataFrame, timeframe: str | None = None) -> DataFrame:
    """``bars``, or an error that says what is wrong with them."""
    for found in (time_violations(bars, timeframe), bar_violations(bars)):
        for r in found.collect():  # a row for each series
            wrong = {k: v for k, v in r.asDict().items() if k not in (*KEYS, "n_rows", "off_grid") and v}
            if wrong:
                raise InputError(f"bars of {r.asset} {r.timeframe} break their contract: {wrong}")
    return bars


def aligned(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same bars."""
    keys = [*KEYS, "ts"]
    one, two = a.select(*keys), b.select(*keys)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def timeframe_of(bars: DataFrame, declared: str | None = None) -> str:
    """The declared timeframe, or the one that all steps between bars have."""
    if declared:
        seconds(declared)
        return declared
    order = Window.partitionBy(*KEYS).orderBy("ts")
    r = bars.select((micros(F.col("ts")) - micros(F.lag("ts").over(order))).alias("d")).agg(F.min("d"), F.max("d")).first()
    found = [t for t, s in TIMEFRAMES.items() if r[0] is not None and r[0] == r[1] == s * 1_000_000]
    if not found:
        raise InputError("no timeframe is declared, and the bars' steps don't tell one")
    return found[0]


def identity(rows: DataFrame) -> dict[str, str]:
    """The one asset, timeframe and, where there are such columns, source, price side, adjustment and calendar."""
    require(rows, KEYS)
    names = [*KEYS, *(c for c in IDENTITY if c in rows.columns)]
    r = rows.agg(*(F.countDistinct(c).alias(c) for c in names), *(_count(F.col(c).isNull()).alias(f"{c}_null") for c in names), *(F.first(c).alias(f"{c}_value") for c in names)).first()
    for c in names:
        if r[c] != 1 or r[f"{c}_null"]:
            raise InputError(f"rows need one {c}, and have {r[c]} with {r[f'{c}_null']} missing")
    return {c: r[f"{c}_value"] for c in names}


def prepare_regimes(long: DataFrame, method: str, params_hash: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Rows of one method and configuration with ``usable``, and their identity."""
    rows = long.filter(F.col("method") == method)
    if params_hash is not None:
        rows = rows.filter(F.col("params_hash") == params_hash)
    elif "params_hash" in rows.columns and rows.select("params_hash").distinct().limit(2).count() > 1:
        raise InputError(f"{method} has several configurations; name one")
    return rows.withColumn("usable", validity(rows)), identity(rows)


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """Per series: rows, usable and excluded ones, and how many are partial, warming up, invalid, unknown or without label; these may overlap."""
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(False)
    invalid = ~F.coalesce("is_valid", F.lit(False)) if "is_valid" in rows.columns else F.lit(False)
    named = {"n_partial": flag("is_partial", True), "n_warmup": flag("is_warmup", True), "n_invalid": invalid, "n_unknown": F.coalesce(F.col("regime") == UNKNOWN, F.lit(False)), "n_missing": F.col("regime").isNull()}
    ok = validity(rows)
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), _count(ok).alias("n_valid"), _count(~ok).alias("n_excluded"), *(_count(c).alias(n) for n, c in named.items()))


def prepare_prices(prices: DataFrame, regimes: DataFrame, source: str, target: str, *, expected: DataFrame | None = None) -> DataFrame:
    """Prices at the regimes' timeframe.

    Assets, and where both have them source, price side, adjustment and calendar, must be the
    regimes'; a labelled bar without a price is an error, and so is an ``expected`` grid with prices
    of another timeframe.
    """
    if expected is not None and source != target:
        raise InputError("with an expected grid, prices must be at the regimes' timeframe")
    shared = [c for c in ("asset", *IDENTITY) if c in prices.columns and c in regimes.columns]
    odd = regimes.select(*shared).distinct().join(prices.select(*shared).distinct(), shared, "left_anti").limit(1).collect()
    if odd:
        raise InputError(f"no prices are of {odd[0].asDict()}")
    out = prices if source == target else B.resample(prices, source, target)
    lost = regimes.select("asset", "ts").join(out.select("asset", "ts"), ["asset", "ts"], "left_anti")
    if not lost.isEmpty():
        raise InputError(f"{lost.count()} labelled bars have no price")
    return out


def state_number(label: str = "regime"):
    """The number of a STATE_n label, or -1."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(label, r"^STATE_(\d+)$", 1), F.lit("")), F.lit("999")).cast("int"), F.lit(-1))


def nominal_codes(rows: DataFrame, label: str = "regime") -> DataFrame:
    """``rows`` with code: the place of a usable label among the series' labels, or -1."""
    held = F.when(validity(rows), F.col(label))
    names = rows.select(*KEYS, held.alias("__l")).filter("__l is not null").distinct()
    names = names.withColumn("__code", F.row_number().over(Window.partitionBy(*KEYS).orderBy("__l")) - 1)
    return rows.withColumn("__l", held).join(names, [*KEYS, "__l"], "left").withColumn("code", F.coalesce("__code", F.lit(-1))).drop("__l", "__code")
