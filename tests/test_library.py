"""Hand-computed numbers, contracts, and causality of the analytics library."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark import cli, config
from tidemark.functions import statistics as S
from tidemark.operators import bars as B
from tidemark.operators import validation as V
from tidemark.operators import calibration, context, kernels, projection, report, study, targets
from tidemark.operators.detectors import REGISTRY, pivots
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import PARAMETERS, QUERIES
from tidemark.schema import InputError
from tidemark.sources import tables as T
from tidemark.streaming import bars as stream

HOUR = 3600
START = 1_704_067_200


def make(spark, rows, asset="X", timeframe="H1", start=1_704_067_200, step=HOUR, more=()):
    """Bars from (open, high, low, close, volume, bid_volume, ask_volume)."""
    data = [(asset, timeframe, start + k * step, *map(float, r)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "asset string, timeframe string, s long, open double, high double, low double, close double, volume double, bid_volume double, ask_volume double")
    return df.selectExpr("asset", "timeframe", "timestamp_seconds(s) AS ts", "open", "high", "low", "close", "volume", "bid_volume", "ask_volume", *more)


def walk(n, seed=7):
    rng = random.Random(seed)
    rows, price = [], 100.0
    for _ in range(n):
        new = price * math.exp(rng.gauss(0, 0.01))
        rows.append((price, max(price, new) + rng.uniform(0.1, 2), min(price, new) - rng.uniform(0.1, 2), new, rng.randint(100, 999), rng.randint(1, 50), rng.randint(1, 50)))
        price = new
    return rows


def test_adx_by_hand():
    high, low, close = (np.array(x, float) for x in ([10, 12, 11, 14, 12, 15], [8, 9, 8, 10, 8, 11], [9, 11, 9, 13, 9, 14]))
    got = kernels.adx_columns(high, low, close, 2)
    assert got["plus_di"][2] == pytest.approx(200 / 9) and got["minus_di"][2] == pytest.approx(200 / 9)
    assert np.isnan(got["adx"][:3]).all() and got["adx"][3:5] == pytest.approx([37.5, 25])
    flat = np.full(10, 5.0)
    assert kernels.adx_columns(flat, flat, flat, 2)["adx"][3:] == pytest.approx(np.zeros(7))


@pytest.mark.parametrize(("total", "ratio", "size", "want"), [
    ([60, 150, 90, 0], [0, 1, 0, 0], 100, [None, 0.7, 0.55, 0.55]),
    ([200, 99, 1], [0, 1, 1], 100, [0, 0, 0.5]),
    ([0, 100, 0, 100, 0], [0.4] * 5, 100, [None, None, None, 0.4, 0.4]),
    ([0.03, 0.07, 0.1, 0.1], [0.4] * 4, 0.1, [None, None, 0.4, 0.4]),
    ([1e12], [0.6], 1, [0.6]),
])
def test_volume_buckets_by_hand(total, ratio, size, want):
    got = kernels.bucket_scores(np.array(total, float), np.array(total, float) * np.array(ratio), size, 2)
    assert [None if math.isnan(x) else round(x, 12) for x in got] == want


def test_value_area_by_hand():
    assert kernels.area(np.array([12.0, 12]), np.array([8.0, 8]), np.array([1.0, 1]), 4, 0.2, 0.8) == (8, 12)


def test_excursions_by_hand(spark):
    rows = [(100, 1000, 1, 100), (102, 110, 90, 102), (103, 120, 95, 103), (104, 120, 95, 104), (105, 120, 95, 105)]
    df = make(spark, [(*r, 1, 1, 1) for r in rows])
    names = [f"{p}{x}_fwd_2" for x in targets.EXCURSIONS for p in ("", "time_")]
    got = targets.forward(df, "H1", names).orderBy("ts").first()
    assert [round(got[n], 12) for n in names] == [0.2, 2, -0.1, 1, 0.1, 1, -0.2, 2]


def test_targets_never_span_a_hole(spark):
    df = make(spark, walk(10)).filter("ts <> timestamp'2024-01-01 05:00:00'")
    got = targets.forward(df, "H1", ["ret_fwd_2"]).orderBy("ts").collect()
    assert [r.ret_fwd_2 is None for r in got] == [False, False, False, True, True, False, False, True, True]
    for bad in ("ret_fwd_0", "vol_fwd_1", "x_fwd_2", "ret"):
        with pytest.raises(InputError):
            targets.parse(bad)


def test_targets_and_resampling_count_valid_bars_alone(spark):
    """By hand: partial ends take the targets that touch them, and a bar still warming up makes its longer bar partial."""
    df = make(spark, walk(10)).withColumn("is_partial", F.col("ts").isin(F.timestamp_seconds(F.lit(START)), F.timestamp_seconds(F.lit(START + 9 * 3600))))
    got = targets.forward(df, "H1", ["ret_fwd_3", "vol_fwd_3"]).orderBy("ts").collect()
    assert [r.ret_fwd_3 is not None for r in got] == [False, True, True, True, True, True, False, False, False, False]
    assert [r.vol_fwd_3 is None for r in got] == [r.ret_fwd_3 is None for r in got]
    four = B.resample(make(spark, walk(8), start=1704067200 + 3600).withColumn("is_warmup", F.col("ts") == F.timestamp_seconds(F.lit(1704067200 + 2 * 3600))), "H1", "H4").orderBy("ts").collect()
    assert [r.is_partial for r in four] == [True, False] and [r.source_count for r in four] == [4, 4]


def test_inputs_of_detectors_are_checked(spark):
    good = make(spark, walk(30))
    for column, value in (("close", "-1D"), ("high", "low / 2"), ("close", "double('NaN')"), ("bid_volume", "null"), ("ask_volume", "-2D")):
        bad = good.withColumn(column, F.when(F.hour("ts") == 3, F.expr(value)).otherwise(F.col(column)))
        with pytest.raises(Exception, match="must be|lies|needed"):
            REGISTRY["ofi"].detect(bad, "H1").collect()
    carried = REGISTRY["adx"].detect(B.resample(good, "H1", "H4"), "H4")
    assert {"coverage", "source_count", "expected_count"} <= set(carried.columns)
    for name, values in (("atr_volatility", {"q_bas": 1.5}), ("hmm_causal", {"train_size": 10}), ("vpin", {"bucket_volume": float("inf")})):
        with pytest.raises(InputError):
            REGISTRY[name].detect(good, "H1", **values)


def test_causal_hidden_states(spark):
    good = make(spark, walk(200))
    got = REGISTRY["hmm_causal"].detect(good, "H1", train_size=100, n_iter=20).orderBy("ts").collect()
    assert [r.is_warmup for r in got] == [True] * 100 + [False] * 100
    assert all(r.regime == "INCONNU" and r.hmm_diagnostics == "" for r in got[:100])
    assert all(0.5 <= r.confidence <= 1 and r.regime in ("STATE_0", "STATE_1") for r in got[100:])
    note = json.loads(got[150].hmm_diagnostics)
    assert note["train_rows"] == 80 and len(note["transition_matrix"]) == 2 and note["state_means"][0][0] <= note["state_means"][1][0]
    with pytest.raises(Exception, match="valid"):
        REGISTRY["hmm_causal"].detect(good.withColumn("is_partial", F.hour("ts") == 5), "H1", train_size=100).collect()
    assert REGISTRY["hmm_causal"].ids(n_states=3) == {"STATE_0": 0, "STATE_1": 1, "STATE_2": 2, "INCONNU": 3}


def test_ticks_are_normalised_and_jumps_cross_days(spark):
    rows = [("X", "2026-01-01 23:59:59", 0, 10.0, 10.1), ("X", "2026-01-02 00:00:01", 1, 20.0, 20.1), ("X", "2026-01-02 00:00:02", 2, 20.0, 19.0), ("X", "2026-01-02 00:00:02", 3, 20.1, 20.2), ("X", "2026-01-04 00:00:00", 4, 20.1, 20.2)]
    ticks = spark.createDataFrame(rows, "asset string, t string, seq long, bid_price double, ask_price double").selectExpr("asset", "to_timestamp(t) AS ts", "seq", "bid_price", "ask_price", "1D AS bid_volume", "1D AS ask_volume")
    with pytest.raises(InputError):
        B.normalize_ticks(ticks, "2026-01-01", "2026-01-03")
    assert [r.seq for r in B.normalize_ticks(ticks, "2026-01-01", "2026-01-04", drop_crossed=True).orderBy("seq").collect()] == [0, 1, 3]
    assert [(str(r.day), r.n_jumps) for r in B.tick_jumps(ticks, relative=0.5).collect()] == [("2026-01-02", 1)]


def test_segment_features_by_hand(spark):
    df = make(spark, [(10, 11, 9, 10, 1, 1, 1), (11, 12, 10, 11, 1, 1, 1), (12, 13, 11, 12, 1, 1, 1)], more=("0 AS segment_id",))
    r = projection.characterise(df, "H1").first()
    assert (r.n, r.pente, r.amplitude, r.efficience, r.pente_atr) == (3, 2, 4, 0.5, 1)


@pytest.fixture(scope="module")
def ticks(spark):
    data = [("X", f"2026-01-02 {t}", k, b, a, 0.1, 0.1) for k, (t, b, a) in enumerate([("01:00:10", 9.0, 10.0), ("01:00:20", 10.0, 12.0), ("01:00:20", 10.5, 12.5), ("01:00:40", 8.0, 9.0), ("01:01:00", 10.0, 11.0), ("01:01:20", 12.0, 13.0)])]
    return spark.createDataFrame(data, "asset string, t string, seq long, bid_price double, ask_price double, bid_volume double, ask_volume double").selectExpr("asset", "to_timestamp(t) AS ts", "seq", "bid_price", "ask_price", "bid_volume", "ask_volume")


def test_ticks_to_bars(spark, ticks):
    got = [(str(r.ts)[11:16], r.open, r.high, r.low, r.close, round(r.volume, 9), r.spread_max, r.tick_count, r.is_partial) for r in B.from_ticks(ticks, "M1").orderBy("ts").collect()]
    assert got == [("01:01", 9, 10.5, 8, 8, 0.8, 2, 4, True), ("01:02", 10, 12, 10, 12, 0.4, 1, 2, True)]
    assert B.from_ticks(ticks, "M1", side="mid").orderBy("ts").first().open == 9.5
    with pytest.raises(InputError):
        B.check_ticks(ticks.withColumn("bid_price", ticks.ask_price + 1))
    with pytest.raises(InputError):
        B.tick_jumps(ticks)
    assert B.tick_jumps(ticks, threshold=1.9).first().n_jumps == 3


def test_gaps_are_filled_whole_or_not_at_all(spark):
    data = [("X", f"2026-01-02 {t}", k, b, b + 0.01, 1.0, 1.0) for k, (t, b) in enumerate([("10:00:10", 1.10), ("10:00:50", 1.12), ("10:03:30", 1.15), ("12:00:05", 1.20)])]
    ticks = spark.createDataFrame(data, "asset string, t string, seq long, bid_price double, ask_price double, bid_volume double, ask_volume double").selectExpr("asset", "to_timestamp(t) AS ts", "seq", "bid_price", "ask_price", "bid_volume", "ask_volume")
    got = B.from_ticks(ticks, "M1", fill_seconds=300).orderBy("ts").collect()
    assert [(str(r.ts)[11:16], r.close, r.tick_count) for r in got] == [("10:01", 1.12, 2), ("10:02", 1.12, 0), ("10:03", 1.12, 0), ("10:04", 1.15, 1), ("12:01", 1.2, 1)]
    assert B.from_ticks(ticks, "M1", fill_seconds=60).count() == 3


def test_resampling_agrees_with_direct_bars(spark):
    ticks = T.stream_ticks(spark.read.parquet(f"{SMALL}/events.parquet"), pooled=True)
    columns = ["ts", "open", "high", "low", "close", "volume", "tick_count"]
    direct = B.from_ticks(ticks, "H4").select(*columns)
    twice = B.resample(B.from_ticks(ticks, "M15"), "M15", "H4").select(*columns)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, twice.collect()))
    with pytest.raises(InputError):
        B.resample(direct, "H4", "H1")
    with pytest.raises(InputError):
        B.resample(direct, "M30", "M15")


CAUSAL = [n for n, d in REGISTRY.items() if d.availability == "bar_close"]


@pytest.mark.parametrize("name", list(REGISTRY))
def test_past_labels_and_the_future(spark, name):
    """Causal detectors say of a prefix what they say of the whole; none needs a name of columns that it doesn't list."""
    bars = make(spark, walk(220), more=("'x' AS lo", "1 AS dir"))
    cut = "timestamp'2024-01-07 12:00:00'"
    d = REGISTRY[name]
    run = lambda df: {r.ts: (r.regime, None if r.confidence is None else round(r.confidence, 9)) for r in d.detect(df, "H1", allow_lookahead=True, **PARAMETERS[name]).collect()}
    whole, prefix = run(bars), run(bars.filter(f"ts <= {cut}"))
    assert len(whole) == 220 and set(r for r, _ in whole.values()) <= {*d.labels, "INCONNU"}
    assert all((r == "INCONNU") == (c == 0) and 0 <= c <= 1 for r, c in whole.values())
    if name in CAUSAL:
        assert all(whole[t] == v for t, v in prefix.items())
    else:
        with pytest.raises(InputError):
            d.detect(bars, "H1")


def test_partial_bars_publish_nothing(spark):
    bars = make(spark, walk(60), more=("ts = timestamp'2024-01-02 12:00:00' AS is_partial",))
    got = {str(r.ts): r for r in REGISTRY["ofi"].detect(bars, "H1", **PARAMETERS["ofi"]).collect()}
    r = got["2024-01-02 12:00:00"]
    assert (r.regime, r.confidence, r.ofi_value) == ("INCONNU", 0, None)
    assert REGISTRY["ofi"].detect(bars.limit(0), "H1").count() == 0
    for wrong in ({"fenetre": 0}, {"other": 1}, {"fenetre": True}):
        with pytest.raises(InputError):
            REGISTRY["ofi"].detect(bars, "H1", **wrong)


def test_long_frames_agree_with_short_ones(spark, monkeypatch):
    from tidemark.operators import detectors

    bars = make(spark, walk(150))
    for name in ("atr_volatility", "shannon", "minkowski_causal"):
        short = REGISTRY[name].detect(bars, "H1", **PARAMETERS[name]).orderBy("ts").collect()
        monkeypatch.setattr(detectors, "NATIVE_FRAME", 1)
        long = REGISTRY[name].detect(bars, "H1", **PARAMETERS[name]).orderBy("ts").collect()
        monkeypatch.undo()
        assert [(r.regime, round(r.confidence, 9)) for r in short] == [(r.regime, round(r.confidence, 9)) for r in long]


def test_pivots_alternate(spark):
    found = pivots(make(spark, walk(300)), 2).orderBy("ts", "o").collect()
    assert len(found) > 10 and all(a.kind != b.kind for a, b in zip(found, found[1:], strict=False))


def test_session_grid_over_a_clock_change(spark):
    days = spark.sql("SELECT DATE'2026-03-10' AS holiday")
    got = [str(r.ts) for r in context.session_grid(spark, "2026-03-06", "2026-03-10", "H1", "09:00", "12:00", holidays=days).orderBy("ts").collect()]
    assert got == ["2026-03-06 15:00:00", "2026-03-06 16:00:00", "2026-03-06 17:00:00", "2026-03-09 14:00:00", "2026-03-09 15:00:00", "2026-03-09 16:00:00"]
    with pytest.raises(Exception, match="ambiguous"):
        context.session_grid(spark, "2026-03-08", "2026-03-08", "H1", "02:30", "12:00", weekdays=(6,)).collect()


def test_sources(spark, tmp_path):
    assert [T.normal_name(x) for x in ("Bid Price", "askVolume", "Open", " high ", "tick-count")] == ["bid_price", "ask_volume", "open", "high", "tick_count"]
    with pytest.raises(InputError):
        T.normalise(spark.createDataFrame([(1, 2)], "`Bid Price` int, bid int"))
    path = f"{tmp_path}/EURUSD_m1.parquet"
    spark.sql("SELECT to_timestamp('2024-01-01 00:00:00') AS Timestamp, 1.0D AS Open, 2.0D AS High, 0.5D AS Low, 'NaN'::double AS Close, 3.0D AS volume").write.parquet(path)
    got = T.load(spark, path, timeframe="H1", convention="open", zone="America/New_York")
    r = got.df.first()
    assert (got.meta.asset, str(r.ts), r.close, r.high) == ("EURUSD", "2024-01-01 06:00:00", None, 2.0)
    with pytest.raises(InputError):
        T.load(spark, path, fill_seconds=60)
    (tmp_path / "e.csv").write_text("datetime_ny,event_type\n2024-01-05 08:30,NFP\n2024-03-10 02:30,CPI\n2024-11-03 01:30,CPI\n")
    assert [(str(r.event_ts), r.event_type) for r in T.events(spark, f"{tmp_path}/e.csv").collect()] == [("2024-01-05 13:30:00", "NFP")]
    (tmp_path / "h.csv").write_text("date,label\n2024-01-01,a\n2024-01-01,b\n")
    assert T.holidays(spark, f"{tmp_path}/h.csv").count() == 1
    df = spark.range(10)
    assert T.content_hash(df) == T.content_hash(df.orderBy(df.id.desc())) != T.content_hash(df.limit(9))
    T.write_study(spark, {"results": df}, {"seed": 1}, f"{tmp_path}/study")
    assert spark.read.parquet(f"{tmp_path}/study/results").count() == 10 and (tmp_path / "study/manifest.json").exists()


def test_statistics():
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert S.welch(5, 1.0, 0.0, 5, 1.0, 0.0) == (0.0, 1.0)
    assert S.welch(5, 2.0, 0.0, 5, 1.0, 0.0) == (math.inf, 0.0)
    assert S.mann_whitney(3, 3, 6.0, 0)[1] == pytest.approx(0.1)
    assert S.benjamini_yekutieli([0.01, None, 0.04]) == [pytest.approx(0.055), None, pytest.approx(0.11)]
    assert S.kappa([("a", "a", 5), ("b", "b", 5)]) == 1.0 and S.kappa([("a", "a", 1), ("a", "b", 1), ("b", "a", 1), ("b", "b", 1)]) == 0.0
    same = [("a", "x", 5), ("b", "y", 5)]
    assert projection.adjusted_scores(same) == {"ari": pytest.approx(1), "ami": pytest.approx(1)}
    rng = np.random.default_rng(0)
    noise = Counter(zip(rng.integers(0, 3, 600).tolist(), rng.integers(0, 3, 600).tolist(), strict=True))
    score = projection.adjusted_scores([(str(a), str(b), n) for (a, b), n in noise.items()])
    assert abs(score["ari"]) < 0.02 and abs(score["ami"]) < 0.02


def test_splits():
    whole = study.folds(100, "holdout", ratio=0.7, embargo=5)
    assert (whole[0].train_hi, whole[0].test_lo, whole[0].test_hi) == (70, 75, 100)
    for f in study.folds(200, "walk_forward", ratio=0.5, embargo=3, count=4):
        assert f.train_lo < f.train_hi <= f.test_lo - 3 < f.test_hi <= 200
    with pytest.raises(InputError):
        study.folds(10, "holdout", embargo=9)


def test_bootstrap_finds_a_planted_effect():
    rng = np.random.default_rng(3)
    own = np.repeat(np.tile([True, False], 40), 10)
    y = rng.normal(size=800) + own
    found = S.block_bootstrap(y, own, np.zeros(800), 10, 199, 1)
    assert found["p"] < 0.05 and found["low"] > 0
    assert found == S.block_bootstrap(y, own, np.zeros(800), 10, 199, 1)
    assert S.block_bootstrap(rng.normal(size=800), own, np.zeros(800), 10, 199, 1)["p"] > 0.05
    assert S.block_bootstrap(y, own, np.arange(800) // 5, 10, 199, 1)["estimate"] is None


def test_segmentation_finds_levels():
    x = np.repeat([0.0, 5.0, 1.0], [50, 60, 40]) + np.random.default_rng(0).normal(0, 0.2, 150)
    for model, penalty in (("l2", 5.0), ("normal", 20.0), ("rbf", 3.0)):
        assert kernels.pelt(x, penalty, 5, model=model) == [50, 110, 150]


def test_hidden_states():
    rng = np.random.default_rng(1)
    state = np.repeat([0, 1, 0, 1], 150)
    x = rng.normal(0, 1, (600, 4)) * np.where(state == 1, 3.0, 0.5)[:, None]
    model = kernels.hmm_fit(x, 2, 50, 42)
    assert (np.diff(model["history"]) > -1e-6).all() and model["move"].sum(axis=1) == pytest.approx(1)
    guess = kernels.hmm_filter(x, model).argmax(axis=1)
    assert max((guess == state).mean(), (guess != state).mean()) > 0.95
    prefix = kernels.hmm_filter(x[:200], model)
    assert np.allclose(prefix, kernels.hmm_filter(x, model)[:200])


def test_study(spark, tmp_path):
    bars = make(spark, walk(300)).cache()
    long = None
    for name in ("ofi", "adx"):
        rows = context.uniform(REGISTRY[name].detect(bars, "H1", **PARAMETERS[name]), REGISTRY[name])
        long = rows if long is None else long.unionByName(rows, allowMissingColumns=True)
    whole = study.Study(long, bars, "H1", ["ofi", "adx"], ["ret_fwd_3"], columns=("regime", "confidence"), inference=study.Inference(3, 49))
    found = whole.run()
    assert found["tests"] and all(0 <= r["p_welch"] <= 1 or math.isnan(r["p_welch"]) for r in found["tests"] if r["n"] > 1)
    assert all(r["n_common"] <= r["n_own"] <= r["n_total"] for r in found["coverage"]) and len(found["coverage"]) == 4
    assert {r["feature"]: r["ic_status_test"] for r in found["results"]} == {f"{m}__{c}": "not_applicable_nominal" if c == "regime" else "ok" for m in ("ofi", "adx") for c in ("regime", "confidence")}
    assert all(r["n_purge_train"] == 3 for r in found["results"])
    assert all(r["status"] != "descriptive" or min(r["n_episodes"], r["n_episodes_rest"]) > 1 for r in found["tests"])
    whole.save(f"{tmp_path}/study")
    saved = {p.name for p in (tmp_path / "study").iterdir() if not p.name.startswith(".")}
    assert {"study_results", "study_tests", "study_conditional", "study_coverage", "study_stability", "study_target_ends", "study_common_support", "study_report.md", "manifest.json"} <= saved
    assert spark.read.parquet(f"{tmp_path}/study/study_results").count() == len(found["results"])
    assert "# Study of" in (tmp_path / "study" / "study_report.md").read_text()
    with pytest.raises(InputError):
        study.Study(long, bars, "H1", ["ofi"], ["ret_fwd_3"], inputs=(f"{tmp_path}/study/x.parquet",), results={"coverage": []}).save(f"{tmp_path}/study")
    for bad in ({"inference": study.Inference(2)}, {"feature_types": {"nothing": "nominal"}}, {"stratum": "x"}, {"feature_types": {"regime": "odd"}}):
        with pytest.raises(InputError):
            study.Study(long, bars, "H1", ["ofi"], ["ret_fwd_3"], **bad)
    with_sessions = context.sessions(bars, "H1")
    by_session = study.Study(long, with_sessions, "H1", ["ofi"], ["ret_fwd_3"], stratum="ctx_session", split={"kind": "walk_forward", "count": 2}).run()
    assert by_session["stratified"] and by_session["strata_coverage"] and len({r["fold"] for r in by_session["results"]}) == 2
    assert study.list_features(long)["categorical"] == ["regime"] and "ofi_value" in study.list_features(long)["other"]
    assert [study.feature_type(*x) for x in (("a__regime", "string"), ("a__ctx_hour_ny", "int"), ("a__x", "double"), ("a__x", "double", "directional"), ("b", "boolean"))] == ["nominal", "nominal", "continuous", "directional", "nominal"]
    assert "2. States" in report.full(long)
    looking = context.uniform(REGISTRY["price_action"].detect(bars, "H1", allow_lookahead=True), REGISTRY["price_action"])
    assert study.causal_only(looking).count() == 0
    assert "## t" in report.markdown("t", study.exclusions(long).collect())
    tried = calibration.grid_search({"a": [1, 2], "b": [3]}, lambda a, b: a * b)
    assert tried[0] == {"a": 2, "b": 3, "score": 6} and calibration.plateau(tried, "a", 3) == [1, 2]
    ranked = calibration.terciles(bars, "close")
    assert [round(r["kappa"], 9) for r in calibration.fidelity(ranked, "tercile", "tercile", [0])] == [1.0]
    assert sum(r.share for r in calibration.shares(ranked, "tercile").collect()) == pytest.approx(1)
    goal = bars.join(targets.forward(bars, "H1", ["ret_fwd_1"]), ["asset", "timeframe", "ts"])
    rows = calibration.terciles(goal, "volume")
    found = study.block_sensitivity(rows, "tercile", "ret_fwd_1", "H1", [2, 4], rounds=49)
    assert len(found) == 6 and all(r["adjusted"] is None or r["adjusted"] >= r["p"] for r in found)


def test_calibration_measures(spark):
    bars = make(spark, walk(200)).cache()
    rows = calibration.terciles(calibration.terciles(bars, "volume").withColumnRenamed("tercile", "a"), "close").withColumnRenamed("tercile", "b")
    r = calibration.block_agreement(rows, "a", "b", F.dayofyear("ts")).first()
    assert r.kappa == pytest.approx(calibration.agreement(rows, "a", "b")) and r.least_kappa <= r.kappa and r.n_blocks == 9
    assert calibration.block_agreement(rows, "a", "a", F.lit(0)).first().kappa == pytest.approx(1)
    shifted = bars.withColumn("later", F.lag("close", 2).over(Window.partitionBy("asset").orderBy("ts")))
    r = calibration.lagged_correlation(shifted, "close", "later", [0, 1, 2, 3]).first()
    assert r.best_lag == 2 and r.rho_max == pytest.approx(1) and r.rho_lag0 < 1
    found = calibration.validated_search({"a": [1, 2, 3]}, lambda part, a: {("x", 1): 1.0, ("x", 2): 3.0, ("x", 3): 2.0, ("y", 1): 5.0, ("y", 2): 4.0, ("y", 3): None}[part, a], [("x", "y")])
    assert found[0]["a"] == 2 and found[0]["test_rank"] == 2 and found[0]["regret"] == 1 and found[0]["best_of_test"] == {"a": 1}
    swept = calibration.kappa_sweep([{"k": 1, "n": 1, "score": 0.5}, {"k": 1, "n": 2, "score": 0.6}, {"k": 2, "n": 1, "score": 0.4}], "k", 0.1)
    assert [(x["k"], x["kappa"], x["plateau"]) for x in swept] == [(1, 0.6, True), (2, 0.4, False)]
    rates = {r.tercile: r for r in calibration.protocol_rates(calibration.terciles(bars, "close"), "tercile", "H1").collect()}
    assert sum(r.occupancy for r in rates.values()) == pytest.approx(1) and sum(r.bars for r in rates.values()) == 200
    assert sum(r.per_100_hours for r in rates.values()) == pytest.approx(sum(r.n_episodes for r in rates.values()) / 2)
    measured = calibration.protocol_measures(calibration.terciles(bars, "close"), "tercile", "H1", {"HIGH": 1, "LOW": -1}).collect()
    assert all(r.declared_net == pytest.approx(-r.net) for r in measured if r.tercile == "LOW") and all(r.declared_net is None for r in measured if r.tercile == "MIDDLE")
    counts = V.exclusion_counts(REGISTRY["ofi"].detect(bars, "H1", fenetre=20)).first()
    assert counts.n_valid + counts.n_excluded == counts.n_rows == 200 and counts.n_unknown == counts.n_excluded == 9
    with pytest.raises(InputError):
        V.prepare_prices(make(spark, walk(10), asset="Y"), bars, "H1", "H1")


def test_streamed_recurrences_equal_batch(spark, tmp_path):
    from pyspark.sql.types import StructType

    whole = make(spark, walk(120, seed=9))
    for k in range(3):
        whole.orderBy("ts").offset(40 * k).limit(40).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(StructType(whole.schema.fields)).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")

    def streamed(name, f):
        q = f(read()).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).orderBy("ts").collect()

    got = [r.vpin_value for r in streamed("buckets", lambda b: stream.vpin(b, 30.0, 5))]
    want = [r.vpin_value for r in kernels.vpin(whole, 30.0, 5).orderBy("ts").collect()]
    assert [x is None for x in got] == [x is None for x in want] and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True) if a is not None)
    got = [(r.ts, r.pivot, r.value) for r in streamed("pivots", lambda b: stream.confirmed_pivots(b, 2)) if r.pivot is not None]
    rows = whole.orderBy("ts").collect()
    expected = []
    for k in range(2, 118):
        near = [rows[j] for j in (k - 2, k - 1, k + 1, k + 2)]
        top, bottom = rows[k].high > max(r.high for r in near), rows[k].low < min(r.low for r in near)
        if top != bottom:
            expected.append((rows[k + 2].ts, 1.0 if top else -1.0, rows[k].high if top else rows[k].low))
    assert got == expected and len(got) > 5
    x = np.array([[r.close, r.volume] for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    model = kernels.hmm_fit((x - mean) / spread, 2, 20, 1)
    got = streamed("states", lambda b: stream.hidden_states(b, model, mean, spread, ["close", "volume"]))
    assert np.allclose([r.probability for r in got], kernels.hmm_filter((x - mean) / spread, model).max(axis=1))


def test_purge_drops_targets_that_reach_the_test(spark):
    bars = make(spark, walk(60))
    rows = targets.forward(bars, "H1", ["ret_fwd_5"])
    dealt = study.split(rows, study.folds(60, "holdout", ratio=0.5), "ret_fwd_5").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in dealt} == {"train": 25, "test": 30}


def test_streamed_bars_and_measures_equal_batch(spark, tmp_path):
    source = T.stream_ticks(spark.read.parquet(f"{SMALL}/events.parquet"))
    source.repartition(3).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/ticks")
    live = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/ticks")
    run = stream.from_ticks(live, "H1").writeStream.format("parquet").option("path", f"{tmp_path}/bars").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/bars")
    want = B.from_ticks(source, "H1")
    columns = ["asset", "ts", "open", "high", "low", "close", "volume", "tick_count"]
    closed = {tuple(r) for r in got.select(*columns).collect()}
    every = {tuple(r) for r in want.select(*columns).collect()}
    assert closed < every and len(every) - len(closed) <= 5
    bars = spark.readStream.schema(got.schema).parquet(f"{tmp_path}/bars")
    out = stream.trailing(bars, ["ask_volume", "bid_volume"], 5, stream.imbalance, "ofi_value")
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/ofi").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    run.awaitTermination()
    live_ofi = {(r.asset, r.ts): round(r.ofi_value, 9) for r in spark.read.parquet(f"{tmp_path}/ofi").filter("ofi_value is not null").collect()}
    batch = {(r.asset, r.ts): round(r.ofi_value, 9) for r in REGISTRY["ofi"].detect(got, "H1", fenetre=5).filter("ofi_value is not null").collect()}
    assert live_ofi and all(batch[k] == v for k, v in live_ofi.items())


def test_validation(spark):
    from pyspark.sql import functions as F

    bars = make(spark, walk(20))
    assert V.check_bars(bars, "H1") is bars and V.timeframe_of(bars) == "H1" and V.aligned(bars, bars.orderBy("high"))
    assert not V.aligned(bars, bars.limit(3))
    for wrong in (bars.unionByName(bars.limit(1)), bars.withColumn("high", F.col("low") - 1), bars.withColumn("open", F.lit(float("nan"))), bars.withColumn("volume", F.lit(-1.0))):
        with pytest.raises(InputError):
            V.check_bars(wrong)
    with pytest.raises(InputError):
        V.timeframe_of(bars.filter("ts <> timestamp'2024-01-01 05:00:00'"))
    assert V.identity(bars) == {"asset": "X", "timeframe": "H1"}
    with pytest.raises(InputError):
        V.identity(bars.unionByName(bars.withColumn("asset", F.lit("Y"))))
    states = spark.createDataFrame([("STATE_3",), ("INCONNU",)], "regime string").select(V.state_number().alias("n")).collect()
    assert [r.n for r in states] == [3, -1]
    with pytest.raises(InputError):
        V.prepare_prices(bars.limit(2), bars, "H1", "H1")
    long = context.uniform(REGISTRY["ofi"].detect(bars, "H1", **PARAMETERS["ofi"]), REGISTRY["ofi"], params_hash="a")
    assert V.prepare_regimes(long, "ofi")[0].filter("usable").count() == 19
    with pytest.raises(InputError):
        V.prepare_regimes(long.unionByName(long.withColumn("params_hash", F.lit("b"))), "ofi")


def test_configuration(spark, tmp_path, capsys):
    values, origin = config.resolve("atr_volatility", "M5", config.load('{"methods": {"atr_volatility": {"n_atr": 7}}}'), q_bas=0.2)
    assert (values["fenetre"], values["n_atr"], values["q_bas"]) == (6000, 7, 0.2)
    assert (origin["fenetre"], origin["n_atr"], origin["q_bas"]) == ("default.M5", "profile", "explicit")
    for text in ('{"methods": {"nope": {}}}', '{"methods": {"ofi": {"x": 1}}}', '{"a": 1}', '{"methods": {"ofi": {"fenetre": 1, "fenetre": 2}}}'):
        with pytest.raises(InputError):
            config.load(text)
    pytest.importorskip("yaml")
    assert config.load("methods:\n  ofi:\n    fenetre: 3\n").methods == {"ofi": {"fenetre": 3}}
    for text in ("methods:\n  ofi: {fenetre: 1, fenetre: 2}\n", "1: 2\n", "a: &x {}\nmethods:\n  <<: *x\n"):
        with pytest.raises(InputError):
            config.load(text)
    assert cli.main(["--show-config", "--methods", "ofi"]) == 0 and "fenetre" in capsys.readouterr().out
    assert cli.main(["--timeframes", "H9"]) == 1 and cli.main([]) == 2


def test_command_line(spark, tmp_path):
    T.stream_ticks(spark.read.parquet(f"{SMALL}/events.parquet"), pooled=True).drop("asset").write.parquet(f"{tmp_path}/ALL_ticks.parquet")
    assert cli.main([f"{tmp_path}/ALL_ticks.parquet", f"{tmp_path}/out", "--timeframes", "H1", "H4", "--methods", "ofi", "divergence_pv"]) == 0
    out = spark.read.parquet(f"{tmp_path}/out/regimes.parquet")
    assert {(r.timeframe, r.method) for r in out.select("timeframe", "method").distinct().collect()} == {(t, m) for t in ("H1", "H4") for m in ("ofi", "divergence_pv")}
    assert (tmp_path / "out/run_meta.json").exists()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = duckdb.sql(ORACLES[name])
    own = QUERIES[name](spark, SMALL)
    columns = sorted(want.columns)
    assert columns == sorted(own.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, own.select(*columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)
