"""Queries over the driver's tables: the events table stands for quote ticks of five assets.

Times are epoch seconds and measures are rounded, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import calibration, context, projection, report, study, targets, validation
from tidemark.operators.detectors import REGISTRY
from tidemark.schema import KEYS, micros
from tidemark.sources import tables as T

DIGITS = 6
# Parameters that fit a month of hourly bars.
PARAMETERS = {
    "atr_volatility": {"fenetre": 50, "min_periods": 25},
    "er_kaufman": {"n_er": 10, "fenetre": 50, "min_periods": 25},
    "adx": {"n_adx": 7, "seuil_range": 20.0, "seuil_tendance": 25.0},
    "shannon": {"fenetre": 20, "n_bins": 5},
    "minkowski_causal": {"fenetre_c": 50, "q_c": 0.9, "min_periods": 25},
    "pca_axis": {"fenetre": 20},
    "price_action": {"n_fractale": 2},
    "price_action_causal": {"n_fractale": 2},
    "mss_choch": {"n_fractale": 2},
    "retrospective_pivot_breakout": {"n_fractale": 2},
    "hmm_gaussian": {"n_iter": 20},
    "hmm_causal": {"n_iter": 20, "train_size": 100},
    "ofi": {"fenetre": 5},
    "quote_size_imbalance": {"fenetre": 5},
    "vpin": {"bucket_volume": 50.0, "n_buckets": 5},
    "quote_absolute_imbalance_buckets": {"bucket_volume": 50.0, "n_buckets": 5},
    "volume_profile": {"fenetre": 20, "n_bins": 10},
    "divergence_pv": {"fenetre_median_vol": 10, "fenetre_extreme": 20, "ratio_volume_fort": 1.2},
}


def ticks(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    return T.stream_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), pooled=pooled)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_ticks(ticks(spark, sf_dir), "H1")


def pooled(spark: SparkSession, sf_dir: str, timeframe: str = "H1", **options: object) -> DataFrame:
    return B.from_ticks(ticks(spark, sf_dir, True), timeframe, **options)


def at(c: str = "ts") -> Column:
    return F.floor(micros(F.col(c)) / 1_000_000).alias(c)


def r(c: str | Column, name: str | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return (F.round(x, DIGITS) + F.lit(0.0)).alias(name or c)


def shown(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.select(*(at() if k == "ts" else F.col(k) for k in keys), *(r(m) for m in measures))


def labelled(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        detector = REGISTRY[name]
        bars = hourly(spark, sf_dir)
        # the causal model of hidden states accepts whole bars alone
        found = detector.detect(bars.filter("not is_partial") if name == "hmm_causal" else bars, "H1", allow_lookahead=True, **PARAMETERS[name])
        kinds = dict(found.dtypes)
        measures = [r(m) if kinds[m] == "double" else at(m) if kinds[m] == "timestamp" else F.col(m) for m in detector.measures]
        return found.select("asset", at(), "regime", r("confidence"), *measures)

    return query


def atr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the label of the volatility detector, null where it doesn't count."""
    bars = hourly(spark, sf_dir)
    found = REGISTRY["atr_volatility"].detect(bars, "H1", **PARAMETERS["atr_volatility"])
    label = F.when(F.col("regime") != "INCONNU", F.col("regime"))
    return bars.join(found.select(*KEYS, "ts", label.alias("regime"), "confidence"), [*KEYS, "ts"])


def bars_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    return b.select("asset", at(), *(r(c) for c in ("open", "high", "low", "close", "volume", "bid_volume", "ask_volume", "spread_mean", "spread_max", "spread_close", "ask_close")), "tick_count", "is_partial")


def bars_mid_m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pooled(spark, sf_dir, "M15", side="mid"), ["asset", "ts"], ["open", "high", "low", "close", "volume"])


def bars_ask_w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pooled(spark, sf_dir, "W1", side="ask"), ["asset", "ts"], ["open", "high", "low", "close", "volume"])


def bars_gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.from_ticks(ticks(spark, sf_dir), "H1", fill_seconds=2 * 3600)
    return b.select("asset", at(), *(r(c) for c in ("open", "high", "low", "close", "volume", "spread_mean")), "tick_count", "is_partial")


def tick_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tick_violations(ticks(spark, sf_dir))


def tick_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.tick_jumps(ticks(spark, sf_dir), relative=0.2)
    return found.select("asset", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_jumps")


def resampled_h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.resample(hourly(spark, sf_dir), "H1", "H4")
    return out.select("asset", at(), *(r(c) for c in ("open", "high", "low", "close", "volume", "spread_mean", "spread_max", "spread_close", "coverage")), "tick_count", "source_count", "expected_count", "is_partial")


def missing_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = B.on_grid(hourly(spark, sf_dir), "H1")
    return grid.groupBy("asset").agg(F.count("*").alias("expected"), F.sum((~F.col("present")).cast("long")).alias("missing"))


def validity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.detectors import validity

    found = REGISTRY["atr_volatility"].detect(hourly(spark, sf_dir), "H1", **PARAMETERS["atr_volatility"])
    return found.groupBy("asset").agg(F.count("*").alias("n"), F.sum(validity(found).cast("long")).alias("n_valid"))


def context_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.sessions(hourly(spark, sf_dir), "H1")
    return found.select("asset", at(), "ctx_session", "ctx_hour_ny", "ctx_hour_utc")


def _holidays(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT DATE'2024-01-01' AS holiday UNION ALL SELECT DATE'2024-01-15'")


def _events(spark: SparkSession) -> DataFrame:
    rows = [("2024-01-05 13:30:00", "NFP", 0), ("2024-01-11 13:30:00", "CPI", 1), ("2024-01-11 14:00:00", "OTHER", 2), ("2024-01-25 19:00:00", "FOMC", 3)]
    return spark.createDataFrame(rows, "t string, event_type string, file_seq long").select(F.to_timestamp("t").alias("event_ts"), "event_type", "file_seq")


def context_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.calendar(hourly(spark, sf_dir), "H1", _holidays(spark))
    return found.select("asset", at(), "ctx_day_of_week", "ctx_is_rollover", "ctx_is_holiday")


def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.events(pooled(spark, sf_dir, "M15"), "M15", _events(spark))
    return found.select("asset", at(), "ctx_in_event", "ctx_event_type")


def session_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.session_grid(spark, "2024-03-06", "2024-03-14", "H1", "09:00", "12:00", holidays=spark.sql("SELECT DATE'2024-03-12' AS holiday")).select(at())


def uniform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = REGISTRY["ofi"]
    out = context.uniform(d.detect(hourly(spark, sf_dir), "H1", **PARAMETERS["ofi"]), d)
    return out.groupBy("asset", "method", "regime", "regime_id", "availability").agg(F.count("*").alias("n"), r(F.avg("confidence"), "confidence"), F.count("available_at").alias("n_available"))


NAMES = ["ret_fwd_3", "vol_fwd_3", "close_min_fwd_3", "close_max_fwd_3", "mfe_long_fwd_3", "mae_long_fwd_3", "mfe_short_fwd_3", "mae_short_fwd_3", "time_mfe_long_fwd_3", "time_mae_long_fwd_3"]


def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.forward(hourly(spark, sf_dir), "H1", NAMES)
    return found.select("asset", at(), *(r(n) for n in NAMES), at("ret_fwd_3_end"))


def _study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = targets.forward(hourly(spark, sf_dir), "H1", ["ret_fwd_3"])
    rows = atr_rows(spark, sf_dir).join(goal, [*KEYS, "ts"])
    return rows.withColumn("range_now", F.col("high") - F.col("low"))


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.rank_correlation(_study_rows(spark, sf_dir), "range_now", "ret_fwd_3", ["asset"])
    return out.select("asset", "n", r("ic"))


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _study_rows(spark, sf_dir).withColumn("move", F.col("close") - F.col("open"))
    return study.hit_rate(rows, "move", "ret_fwd_3", ["asset"]).select("asset", "n", r("hit_rate"))


def modality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.modality_statistics(_study_rows(spark, sf_dir), "regime", "ret_fwd_3", ["asset"])
    return out.select("asset", "value", "n", "n_rest", r("mean"), r("mean_rest"), r("var"), r("var_rest"), r("median"), r("rank_sum"), r("ties"), "hits", "hits_rest")


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _study_rows(spark, sf_dir)
    dealt = study.split(rows, study.folds(300, "walk_forward", ratio=0.7, embargo=2, count=3), "ret_fwd_3")
    return dealt.groupBy("asset", "fold", "part").agg(F.count("*").alias("n"), F.min(F.unix_timestamp("ts")).alias("first_ts"), F.max(F.unix_timestamp("ts")).alias("last_ts"))


def episode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.episode_counts(atr_rows(spark, sf_dir), "regime", "H1").select("asset", "regime", "n", "n_episodes")


def state_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atr_rows(spark, sf_dir).withColumn("vol", F.col("volume")).withColumn("ret", F.col("close") - F.col("open")).withColumn("range", F.col("high") - F.col("low"))
    out = report.states(rows)
    return out.select("asset", "regime", "n", r("share"), r("mean_vol"), r("mean_ret"), r("std_ret"), r("mean_range"))


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.persistence(atr_rows(spark, sf_dir), "H1")
    return out.select("asset", "regime", "n_episodes", r("mean_bars"), r("median_bars"), "max_bars", r("p25_bars"), r("p75_bars"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.transitions(atr_rows(spark, sf_dir), "H1").select("asset", "from_state", "to_state", "n", r("probability"))


def confidence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atr_rows(spark, sf_dir).filter("regime is not null")
    return report.confidence(rows).select("asset", "regime", "n", r("mean"), r("std"), r("min"), r("max"))


def conditional_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.conditional(_study_rows(spark, sf_dir), "regime", "ret_fwd_3", "H1")
    return out.select("asset", "regime", "n", "n_episodes", r("mean"), r("median"), r("std"), r("min"), r("max"))


def daily_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months are too few in a month of data, so shares are by the monthly operator over years shifted by days."""
    rows = atr_rows(spark, sf_dir).withColumn("ts", F.timestamp_micros(micros(F.col("ts")) * 12))
    return report.monthly(rows, least_days=18).select("asset", "month", "regime", "n", r("share"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a day each."""
    return atr_rows(spark, sf_dir).withColumn("segment_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))


def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projection.characterise(_segments(spark, sf_dir), "H1")
    return out.select("asset", "segment_id", at("debut"), at("fin"), "n", "is_valid", *(r(c) for c in ("signe", "pente", "amplitude", "efficience", "vol", "pente_atr")))


def segment_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.purity(_segments(spark, sf_dir)).select("asset", "segment_id", "total", "dominant", r("purete"), "n_regimes")


def overall_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projection.overall_purity(projection.purity(_segments(spark, sf_dir)))
    return out.select("asset", r("purete"), r("regimes_moyens"), "n_segments")


def pelt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import kernels

    out = kernels.segment(hourly(spark, sf_dir).select(*KEYS, "ts", "close"), "close", 0.5, 5)
    return out.groupBy("asset", "segment_id").agg(F.min(F.unix_timestamp("ts")).alias("debut"), F.max(F.unix_timestamp("ts")).alias("fin"), F.count("*").alias("n"))


def future_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calibration.future_efficiency(hourly(spark, sf_dir), 4, "H1"), ["asset", "ts"], ["future_efficiency"])


def separation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atr_rows(spark, sf_dir).withColumn("span", F.col("high") - F.col("low"))
    out = calibration.separation(rows, "regime", "span", ["TENDANCE_HAUSSIERE", "TENDANCE_BAISSIERE"], ["RANGE"])
    return out.select("asset", "n", r("median_high"), r("median_low"), r("score"))


def stratified_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atr_rows(spark, sf_dir).withColumn("span", F.col("high") - F.col("low")).withColumn("quarter", F.floor(F.hour("ts") / 6))
    out = calibration.stratified_separation(rows, "regime", "span", ["TENDANCE_HAUSSIERE", "TENDANCE_BAISSIERE"], ["RANGE"], "quarter", 5)
    return out.select("asset", "n_strata", r("score"))


def centred_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calibration.centred_volatility(hourly(spark, sf_dir), 3), ["asset", "ts"], ["realised", "deseasonal"])


def directional_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.directional_agreement(atr_rows(spark, sf_dir), "regime", "TENDANCE_HAUSSIERE", "TENDANCE_BAISSIERE", 2, "H1")
    return out.select("asset", "n", r("agreement"))


def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.quantile_thresholds(hourly(spark, sf_dir), "volume", 0.25, 0.9)
    return out.select("asset", r("low"), r("high"))


def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.switches_per_day(atr_rows(spark, sf_dir), "regime").select("asset", r("switches_per_day"))


def protocol_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.protocol_measures(atr_rows(spark, sf_dir), "regime", "H1")
    return out.select("asset", "regime", at("debut"), at("fin"), "bars", *(r(c) for c in ("net", "path", "amplitude", "regularity", "opposite")))


def bootstrap_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four bars on the true grid, of the pooled quotes, whose hours have no holes."""
    bars = pooled(spark, sf_dir)
    found = REGISTRY["atr_volatility"].detect(bars, "H1", **PARAMETERS["atr_volatility"])
    goal = targets.forward(bars, "H1", ["ret_fwd_3"])
    rows = found.withColumn("regime", F.when(F.col("regime") != "INCONNU", F.col("regime"))).join(goal, [*KEYS, "ts"])
    return study.bootstrap(rows, "regime", "ret_fwd_3", "H1", block=4).select("asset", "value", r("estimate"), r("low"), r("high"), r("p"), "valid")


def ic_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rank correlations vary between the test parts of three folds."""
    rows = _study_rows(spark, sf_dir)
    dealt = study.split(rows, study.folds(300, "walk_forward", ratio=0.7, embargo=2, count=3), "ret_fwd_3").filter("part = 'test'")
    each = study.rank_correlation(dealt, "range_now", "ret_fwd_3", ["asset", "fold"])
    return study.ic_stability(each, ["asset"]).select("asset", "folds", r("ic_mean"), r("ic_std"), r("ic_min"), r("ic_max"))


def modality_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of each label's effect over three folds."""
    rows = _study_rows(spark, sf_dir)
    dealt = study.split(rows, study.folds(300, "walk_forward", ratio=0.7, embargo=2, count=3), "ret_fwd_3").filter("part = 'test'")
    each = study.modality_statistics(dealt, "regime", "ret_fwd_3", ["asset", "fold"])
    effects = each.select(F.col("asset").alias("feature"), F.lit("ret_fwd_3").alias("target"), "value", (F.col("mean") - F.col("mean_rest")).alias("effect"), F.lit("descriptive").alias("status"))
    out = study.stability(effects)
    return out.select(F.col("feature").alias("asset"), "value", "folds", "estimable", r("mean"), r("min"), r("max"), "n_up", "n_down", r("same_sign"))


def atr_volatility_long_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same detector with a frame beyond the native limit, through the kernel."""
    found = REGISTRY["atr_volatility"].detect(pooled(spark, sf_dir), "H1", fenetre=300, min_periods=100)
    return found.select("asset", at(), "regime", r("confidence"))


def bar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.bar_violations(hourly(spark, sf_dir)).drop("timeframe")


def time_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.time_violations(hourly(spark, sf_dir), "H4").drop("timeframe")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, long = hourly(spark, sf_dir), None
    for name in ("atr_volatility", "ofi"):
        rows = context.uniform(REGISTRY[name].detect(bars, "H1", **PARAMETERS[name]), REGISTRY[name])
        long = rows if long is None else long.unionByName(rows, allowMissingColumns=True)
    return study.features(study.causal_only(long), ["atr_volatility", "ofi"]).select("asset", at(), "atr_volatility__regime", "ofi__regime")


def nominal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = REGISTRY["atr_volatility"].detect(hourly(spark, sf_dir), "H1", **PARAMETERS["atr_volatility"])
    return validation.nominal_codes(rows).groupBy("asset", "regime", "code").agg(F.count("*").alias("n"))


def crossed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contingency table of two detectors' labels."""
    bars = hourly(spark, sf_dir)
    both = projection.cross({n: REGISTRY[n].detect(bars, "H1", **PARAMETERS[n]) for n in ("atr_volatility", "er_kaufman")})
    return projection.contingency(both, "atr_volatility_regime", "er_kaufman_regime")


def clock_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.clock_baseline(context.sessions(hourly(spark, sf_dir), "H1"), [8, 9, 10, 11])
    out = calibration.separation(rows.withColumn("span", F.col("high") - F.col("low")), "clock", "span", ["HIGH"], ["LOW"])
    return out.select("asset", "n", r("median_high"), r("median_low"), r("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bars_h1, bars_mid_m15, bars_ask_w1, bars_gap_filled, tick_checks, tick_jumps, resampled_h4, missing_bars, validity_mask, context_sessions, context_calendar, context_events,
        session_grid, uniform_rows, forward_targets, rank_correlation, hit_rate, modality_statistics, walk_forward, episode_counts, state_statistics, persistence, transitions,
        confidence_statistics, conditional_statistics, daily_shares, segment_features, segment_purity, overall_purity, pelt_segments, future_efficiency, separation_score,
        stratified_score, centred_volatility, directional_agreement, quantile_thresholds, switches, protocol_measures, bootstrap_effects, ic_stability, modality_stability, atr_volatility_long_frame,
        bar_checks, time_checks, feature_matrix, nominal_codes, crossed_labels, clock_baseline,
    )
} | {f"detector_{name}": labelled(name) for name in REGISTRY}

