"""Calendar context of bars: sessions, local days, holidays, macro events; and session grids.

Context belongs to a bar's start, which is its label less its timeframe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import KEYS, InputError, micros, seconds
from tidemark.sources.tables import to_utc

NEW_YORK = "America/New_York"
NO_SESSION = "HORS_SESSION"


@dataclass(frozen=True)
class Session:
    """[start, end) in local hours and minutes; an end before the start is past midnight."""

    name: str
    start: str
    end: str


# Sessions in New York time, and minutes before and after each kind of event.
SESSIONS = [Session("ASIE", "19:00", "03:00"), Session("LONDRES", "03:00", "08:00"), Session("NEW_YORK", "08:00", "17:00")]
EVENT_WINDOWS = {"NFP": (5, 60), "CPI": (5, 60), "FOMC": (15, 120)}
OTHER_EVENT = (5, 60)
ROLLOVER = ("16:45", "18:15")


def _minutes(clock: str) -> int:
    h, m = clock.split(":")
    if not (0 <= int(h) < 24 and 0 <= int(m) < 60):
        raise InputError(f"{clock!r} is no time of day")
    return 60 * int(h) + int(m)


def bar_start(timeframe: str) -> Column:
    return F.timestamp_micros(micros(F.col("ts")) - F.lit(seconds(timeframe) * 1_000_000))


def _within(minute: Column, start: str, end: str) -> Column:
    a, b = _minutes(start), _minutes(end)
    return (minute >= a) & (minute < b) if a <= b else (minute >= a) | (minute < b)


def sessions(bars: DataFrame, timeframe: str, declared: list[Session] = SESSIONS, zone: str = NEW_YORK) -> DataFrame:
    """ctx_session (the last declared one that holds), ctx_hour_ny and ctx_hour_utc."""
    start = bar_start(timeframe)
    local = F.from_utc_timestamp(start, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    label = F.lit(NO_SESSION)
    for s in declared:
        label = F.when(_within(minute, s.start, s.end), s.name).otherwise(label)
    return bars.withColumn("ctx_session", label).withColumn("ctx_hour_ny", F.hour(F.from_utc_timestamp(start, NEW_YORK))).withColumn("ctx_hour_utc", F.hour(start))


def calendar(bars: DataFrame, timeframe: str, holidays: DataFrame, zone: str = NEW_YORK, rollover: tuple[str, str] = ROLLOVER) -> DataFrame:
    """ctx_day_of_week (0 is Monday, local), ctx_is_rollover (local) and ctx_is_holiday (UTC day); holidays are a row a day."""
    start = bar_start(timeframe)
    local = F.from_utc_timestamp(start, zone)
    days = holidays.select(F.col("holiday").alias("__day"), F.lit(True).alias("__holiday")).distinct()
    out = bars.withColumn("ctx_day_of_week", F.weekday(local)).withColumn("ctx_is_rollover", _within(F.hour(local) * 60 + F.minute(local), *rollover)).withColumn("__day", F.to_date(start))
    return out.join(days, "__day", "left").withColumn("ctx_is_holiday", F.coalesce("__holiday", F.lit(False))).drop("__day", "__holiday")


def events(bars: DataFrame, timeframe: str, table: DataFrame, windows: dict[str, tuple[int, int]] = EVENT_WINDOWS) -> DataFrame:
    """ctx_in_event and ctx_event_type of bars that start in [event - before, event + after); of several the last in the file names it.

    Events are exploded to the minutes' hours that they touch, so that bars meet them by an equal hour.
    """
    before, after = F.lit(OTHER_EVENT[0]), F.lit(OTHER_EVENT[1])
    for kind, (b, a) in windows.items():
        before, after = F.when(F.col("event_type") == kind, b).otherwise(before), F.when(F.col("event_type") == kind, a).otherwise(after)
    minute = F.lit(60_000_000).cast("long")
    lo, hi = micros(F.col("event_ts")) - before * minute, micros(F.col("event_ts")) + after * minute
    spans = table.select("event_type", "file_seq", lo.alias("__lo"), hi.alias("__hi"))
    hour = 3_600_000_000
    spans = spans.withColumn("__hour", F.explode(F.sequence(F.floor(F.col("__lo") / hour), F.floor((F.col("__hi") - 1) / hour))))
    keyed = bars.withColumn("__us", micros(bar_start(timeframe))).withColumn("__hour", F.floor(F.col("__us") / hour))
    hits = keyed.select(*KEYS, "ts", "__us", "__hour").join(spans, "__hour").filter("__us >= __lo and __us < __hi")
    named = hits.groupBy(*KEYS, "ts").agg(F.max_by("event_type", "file_seq").alias("ctx_event_type"))
    return bars.join(named, [*KEYS, "ts"], "left").withColumn("ctx_in_event", F.col("ctx_event_type").isNotNull()).withColumn("ctx_event_type", F.coalesce("ctx_event_type", F.lit("")))


def enrich(bars: DataFrame, timeframe: str, holidays: DataFrame, table: DataFrame) -> DataFrame:
    """All context columns."""
    return events(calendar(sessions(bars, timeframe), timeframe, holidays), timeframe, table)


def session_grid(spark: SparkSession, first: str, last: str, timeframe: str, start: str, end: str, *, zone: str = NEW_YORK, weekdays: tuple[int, ...] = (0, 1, 2, 3, 4), holidays: DataFrame | None = None) -> DataFrame:
    """Labels in (open, close] of the local sessions that begin on the days from first to last.

    A bound that the local clock skips or repeats, or that is off the grid, is an error.
    """
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day").filter(F.weekday("day").isin(*weekdays))
    if holidays is not None:
        days = days.join(holidays.select(F.col("holiday").alias("day")), "day", "left_anti")
    a, b = _minutes(start), _minutes(end)
    at = lambda minute, shift: F.to_timestamp(F.concat(F.date_add("day", shift).cast("string"), F.lit(f" {minute // 60:02d}:{minute % 60:02d}:00")))
    rows = days.select(to_utc(at(a, 0), zone).alias("o"), to_utc(at(b, int(b <= a)), zone).alias("c"))
    step = seconds(timeframe) * 1_000_000
    wrong = F.when(F.col("o").isNull() | F.col("c").isNull(), "a session bound is ambiguous or missing on the local clock").when((F.pmod(micros(F.col("o")), F.lit(step)) != 0) | (F.pmod(micros(F.col("c")), F.lit(step)) != 0), "a session bound is off the grid")
    rows = rows.withColumn("o", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("o")))
    return rows.select(F.explode(F.sequence(micros(F.col("o")) + step, micros(F.col("c")), F.lit(step))).alias("us")).select(F.timestamp_micros("us").alias("ts")).distinct()


def uniform(found: DataFrame, detector, *, params_hash: str = "", parameters: dict | None = None, **identity: str) -> DataFrame:
    """The long table's rows of one method: label, number, confidence and what they mean."""
    ids = detector.ids(**(parameters or {}))
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    number = F.try_element_at(table, F.col("regime"))
    out = found.withColumn("regime_id", F.when(number.isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col("regime")))).otherwise(number))
    score = F.coalesce("confidence", F.lit(1.0))
    out = out.withColumn("confidence", F.when(score.between(0, 1), score).otherwise(F.raise_error(F.lit("a confidence lies between 0 and 1")).cast("double"))).withColumn("method", F.lit(detector.name)).withColumn("params_hash", F.lit(params_hash))
    meaning = {"availability": detector.availability, "regime_dimension": detector.dimension, "regime_description": detector.description, "confidence_kind": detector.confidence_kind, "indicator_name": detector.name}
    for name, value in {**meaning, **identity}.items():
        out = out.withColumn(name, F.lit(value))
    out = out.withColumn("revises_history", F.lit(detector.availability == "retrospective")).withColumn("confidence_calibrated", F.lit(False))
    return out.withColumn("available_at", F.col("ts") if detector.availability == "bar_close" else F.lit(None).cast("timestamp"))


def episodes(rows: DataFrame, label: str, timeframe: str) -> DataFrame:
    """``rows`` with episode: the number of the run of one label on adjacent grid places; null labels have none."""
    order = Window.partitionBy(*KEYS).orderBy("ts")
    joined = (F.lag(label).over(order) == F.col(label)) & (micros(F.col("ts")) - micros(F.lag("ts").over(order)) == seconds(timeframe) * 1_000_000)
    out = rows.withColumn("__new", F.when(F.col(label).isNotNull(), F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).otherwise(0))
    return out.withColumn("episode", F.when(F.col(label).isNotNull(), F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__new")
