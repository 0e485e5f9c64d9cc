"""Inputs with known results."""

from __future__ import annotations

import math

import pytest
from helpers import bars, column
from pyspark.sql import functions as F

from tidegauge.config import Config, available_profiles, with_profile
from tidegauge.operators import analytics as A
from tidegauge.operators import backtest as B
from tidegauge.operators import features as X
from tidegauge.operators import folds
from tidegauge.operators import regimes as R
from tidegauge.schema import LO_BANDS, ReboundProfile
from tidegauge.sources import bars as S

near = lambda want: [None if v is None else pytest.approx(v, abs=1e-9) for v in want]


def test_average_true_range(spark):
    df = bars(spark, [10, 12, 13], [11, 13, 14], [9, 10, 13])
    assert column(folds.average_true_range(df, Config(atr_window=3)), "atr") == near([2, 7 / 3, 20 / 9])


def test_realized_variance(spark):
    df = bars(spark, [1, 1, 1, 1], log_return=[None, 0.01, -0.02, 0.03])
    got = column(df.withColumn("rv", X.realized_variance(2)), "rv")
    assert got[2:] == near([0.0005, 0.0013])


def test_short_history_has_no_percentile(spark):
    df = bars(spark, [1.0] * 10, volatility=[0.1] * 10)
    df = df.withColumn("volatility_percentile", X.volatility_percentile("volatility", 252)).withColumn("volatility_baseline", F.lit(None).cast("double"))
    assert set(column(df.withColumn("v", X.volatility_label(Config())), "v")) == {"Unknown"}


def test_memory_labels(spark):
    df = bars(spark, [1, 2, 3, 4], s=[0.5, 1.0, 2.0, None])
    assert column(df.withColumn("m", X.lo_label(F.col("s"), LO_BANDS[0.95])), "m") == ["Anti-Persistent", "Short-Memory", "Long-Memory", "Unknown"]
    df = bars(spark, [1, 2, 3, 4], h=["Trending", "Mean-Reverting", "Random", "Unknown"], m=["Short-Memory", "Anti-Persistent", "Long-Memory", "Unknown"])
    assert column(df.withColumn("c", X.confirmed_label(F.col("h"), F.col("m"))), "c") == ["Short-Memory", "Mean-Reverting", "Random", "Unknown"]


def test_conditional_value_at_risk(spark):
    df = bars(spark, [1, 2, 3, 4], log_return=[0.01, -0.05, 0.02, -0.10])
    df = df.withColumn("v", X.value_at_risk(4, 0.75)).withColumn("a", F.transform(X.sliding_array(F.col("log_return"), 4), lambda x: -x))
    df = df.withColumn("c", X.conditional_value_at_risk(F.col("a"), F.col("v")))
    assert column(df, "c")[-1] == pytest.approx(0.10) and column(df, "v")[-1] > 0


def test_survival_is_fragile_after_a_crash(spark):
    df = bars(spark, [100, 101, 100, 102, 101, 100, 101, 102, 101, 90])
    got = X.tail_features(df, Config(tail_window=5, hill_min=2))
    assert column(got, "survival_regime")[-1] in {"Fragile", "Unknown"} or column(got, "survival_score")[-1] >= 0


def test_fractal_filter(spark):
    df = bars(spark, [100, 105, 110], hurst=[0.0, 1.0, 1.0])
    assert column(df.withColumn("m", X.fractal_mask(F.col("hurst"), 0.55, 3)), "m") == [0, 1, 1]
    whole = X.fractal_features(bars(spark, [100, 105, 110], hurst=[0.8, 0.8, 0.8]), Config())
    assert column(whole, "fractal_price") == near([100, 105, 110])


def test_adaptive_labels(spark):
    df = bars(spark, [1, 2, 3, 4, 5], v=[0.0, 1.0, -1.0, 0.5, None])
    assert column(df.withColumn("a", R.adaptive_label(F.col("v"), F.lit(0.4), F.lit(-0.4))), "a") == ["Sideways", "Up", "Down", "Up", "Unknown"]
    flat = bars(spark, [1.0] * 150, v=[0.0] * 150)
    up, down = R.quantile_thresholds("v", 100, 0.7, 0.3, 0.5, 0.5)
    got = flat.withColumns({"u": up, "d": down})
    assert column(got, "u")[-1] == 0.5 and column(got, "d")[-1] == -0.5 and column(got, "u")[0] is None
    with pytest.raises(ValueError):
        R.quantile_thresholds("v", 10, 0.3, 0.7)


@pytest.mark.parametrize(
    "given, want, least",
    [
        ("LLLHLLL", "LLLLLLL", 3), ("LLLHHHLLL", "LLLHHHLLL", 3), ("LLLHHLLLHHHHHLL", "LLLLLLLLHHHHHHH", 3), ("UULLHLL", "UULLLLL", 3), ("UULLHHHH", "UULLHHHH", 3),
    ],
)
def test_min_dwell(spark, given, want, least):
    names = {"U": "Unknown", "L": "L", "H": "H"}
    df = bars(spark, [1.0] * len(given), label=[names[c] for c in given])
    assert column(R.min_dwell(df, "label", least), "regime_dwell") == [names[c] for c in want]


def test_quality_flags(spark):
    df = bars(spark, [1.0] * 5, trend_strength=[0.1] * 5, volatility=[0.1] * 5, volatility_percentile=[0.5] * 5, regime=["Unknown", "Up-LowVol", "Up-LowVol", "Up-LowVol", "Up-LowVol"])
    got = R.quality_flags(df, Config(), warmup=4)
    assert column(got, "valid_signal") == [False, False, False, True, True] and column(got, "calibration_observations") == [1, 2, 3, 4, 5]


def test_fuzzy(spark):
    df = bars(spark, [1.0, 1.0], trend_strength=[1.0, None], volatility=[0.01, 0.01], volatility_percentile=[0.9, 0.9])
    assert column(R.fuzzy_features(df, Config()), "fuzzy_primary_regime") == ["Up-LowVol", "Up-LowVol"]
    percentile = R.fuzzy_features(df, Config(fuzzy_source="percentile"))
    assert column(percentile, "fuzzy_primary_regime")[0] == "Up-HighVol" and column(percentile, "fuzzy_confidence")[1] == 0
    x = spark.createDataFrame([(-3.0, 0.0), (3.0, 0.5)], "t double, v double")
    got = x.select(*[m.alias(k) for k, m in R.memberships(F.col("t"), F.col("v"), Config()).items()]).collect()
    assert got[0]["Down-LowVol"] == 1 and got[1]["Up-HighVol"] == 1


def test_consensus_has_one_event(spark):
    run = [100.0] * 10 + [1.0] * 20
    p = [0.1] * 11 + [0.9] * 19
    got = folds.consensus(bars(spark, [1.0] * 30, bocpd_run_length=run, markov_prob_high=p), Config())
    assert [i for i, v in enumerate(column(got, "consensus_event")) if v] == [11]


NAMES = ["Bull Quiet", "Bear Quiet", "Bull Quiet", "Bear Quiet"]


def test_backtest(spark):
    df = bars(spark, [100, 110, 99, 108.9], regime_name=NAMES)
    daily = B.positions(df, B.exposure(F.col("regime_name")))
    assert column(daily, "position") == [0, 1, 0, 1] and column(daily, "strategy_return") == near([0, 0.10, 0, 0.10])
    assert B.backtest(df).first()["strategy_return"] == pytest.approx(0.21)
    costly = B.positions(df, B.exposure(F.col("regime_name")), cost_bps=10)
    assert column(costly, "turnover") == [0, 1, 1, 1] and column(costly, "cost") == near([0, 0.001, 0.001, 0.001])
    later = B.backtest(bars(spark, [100, 110, 121], regime_name=["Bull Quiet", "Bull Quiet", "Bear Quiet"]), start="2024-01-02").first()
    assert later["mean_exposure"] == 1 and later["strategy_return"] == pytest.approx(0.21)
    clipped = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "r string").select(B.exposure(F.col("r"), {"a": 1.5, "b": 0.5, "c": -0.5}))
    assert [r[0] for r in clipped.collect()] == [1, 0.5, 0, 0]
    with pytest.raises(ValueError):
        B.positions(df, F.lit(1.0), lag=-1)


def test_bullish_turn(spark):
    got = B.bullish_turn(bars(spark, [100, 90, 80, 88, 96], regime_name=["Bear Quiet"] * 4 + ["Bull Quiet"])).first()
    assert (str(got["trough_date"])[:10], str(got["first_bull_date"])[:10], got["lag_periods"]) == ("2024-01-03", "2024-01-05", 2)
    assert got["missed_return"] == pytest.approx(0.20)


def test_rebound_overlay(spark):
    df = bars(spark, [100, 90, 99, 108.9], regime_name=["Bear Quiet"] * 4)
    got = B.rebound_overlay(df, ReboundProfile(True, fast_window=1, drawdown_lookback=3, min_rebound=0.05, min_fast_return=0.05, require_above_fast_ma=False)).first()
    assert got["rebound_signal_count"] == 2 and got["strategy_return"] == pytest.approx(0.075)
    df = bars(spark, [100, 90, 99, 108.9, 98.01], regime_name=["Bear Quiet"] * 5)
    p = ReboundProfile(True, fast_window=1, drawdown_lookback=3, min_rebound=0.05, min_fast_return=0.05, require_above_fast_ma=False, max_holding=1, stop_loss=None)
    assert any(column(B.overlay_bars(df, p), "overlay_expired"))


def test_windows_and_alignment(spark):
    got = {r["window"]: (str(r["window_start"])[:10], str(r["window_end"])[:10]) for r in B.recent_windows(spark, "2024-04-30", (("a", 30, 0), ("b", 60, 31))).collect()}
    assert got == {"a": ("2024-03-31", "2024-04-30"), "b": ("2024-03-01", "2024-03-30")}
    rows = [("risk_on_rebound", "fully_invested"), ("risk_on_rebound", "defensive"), ("risk_off_selloff", "defensive"), ("choppy_or_rangebound", "selective")]
    scored = B.narrative_alignment(spark.createDataFrame(rows, "market_story string, strategy_posture string")).collect()
    assert [r["narrative_alignment_score"] for r in scored] == [1, 0, 1, 1]
    with pytest.raises(ValueError):
        B.recent_windows(spark, "2024-04-30", (("a", 1, 5),))


def test_evaluation(spark):
    df = bars(spark, [1.0] * 6, label=["A", None, "A", "A", None, "B"])
    assert A.stability(df, "label").first()["stability"] == pytest.approx(2 / 3)
    assert A.label_entropy(bars(spark, [1.0] * 100, label=["A", "B"] * 50), "label").first()["entropy"] == pytest.approx(1)
    assert A.information_ratio(bars(spark, [1.0] * 40, label=["A"] * 40), "label", 1).count() == 0


def test_cross_validation(spark):
    folds_ = A.cpcv_folds(spark, 300)
    assert A.cpcv_path_count(6, 2) == 15 == folds_.select("path_id").distinct().count()
    assert {r["count"] for r in folds_.where("role = 'test'").groupBy("rn").count().collect()} == {5}
    with pytest.raises(ValueError):
        A.cpcv_folds(spark, 300, 6, 6)
    make = lambda sign: spark.createDataFrame([(p, t, float(t), float(sign * t)) for p in range(10) for t in range(5)], "path int, trial int, is_sharpe double, oos_sharpe double")
    assert A.backtest_overfitting(make(-1)).first()["pbo"] == 1 and A.backtest_overfitting(make(1)).first()["pbo"] == 0


def test_empty_transitions(spark):
    df = bars(spark, [1.0] * 3, regime=["Unknown", None, "Unknown"])
    matrix = A.transition_matrix(df)
    assert matrix.count() == 0 and A.persistence(matrix).count() == 0 and A.stationary(matrix).count() == 0


def test_transition_algebra(spark):
    df = bars(spark, [1.0] * 9, regime=list("AABBAABBA"))
    matrix = A.transition_matrix(df)
    p = {(r[0], r[1]): r["p"] for r in matrix.collect()}
    assert p["A", "B"] == pytest.approx(0.5) and sum(r["share"] for r in A.stationary(matrix).collect()) == pytest.approx(1)
    passage = {(r[0], r[1]): r["steps"] for r in A.first_passage(matrix).collect()}
    assert passage["A", "B"] == pytest.approx(1 / p["A", "B"]) and passage["A", "A"] == 0


def test_segment_gaps(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0], regime=["A", "A", "Unknown", "A", "B"], log_return=[0.0] * 5, volatility=[0.1] * 5, trend_strength=[0.1] * 5)
    assert A.segments(df).count() == 3 and A.segments(df, gap="bridge").count() == 2


def test_symbol_routing(spark):
    given = ["AAPL", "^GSPC", "BRL=X", "GC=F", "BTC-USD", "BTCUSDT", "ETHUSDT"]
    df = spark.createDataFrame([(s,) for s in [*given, "EUR-USD"]], "s string")
    got = df.select(S.source_type(F.col("s")), S.normalise_symbol(F.col("s"))).collect()
    assert [r[0] for r in got][:7] == ["stock"] * 5 + ["crypto"] * 2 and got[7][1] == "EURUSD=X" and got[4][1] == "BTC-USD"


def test_configuration():
    assert "fx_daily" in available_profiles() and with_profile(Config(), "gold_h4").trend_window == 30
    assert Config.from_dict(Config().to_dict()) == Config() and Config.crypto().tail_window == 120
    for wrong in ({"trend_window": 0}, {"trend_up": -1.0}, {"volatility_method": "x"}, {"hill_min": 1}, {"fuzzy_trend_range": (1.0, 0.0)}):
        with pytest.raises(ValueError):
            Config(**wrong)
    with pytest.raises(ValueError):
        with_profile(Config(), "nope")


def test_sortino_without_losses(spark):
    got = spark.createDataFrame([(0.1,), (0.2,)], "r double").agg(A.sortino(F.col("r"))).first()[0]
    assert math.isinf(got)


def test_registered_exponents_judge_every_bar(spark):
    from tidegauge import catalog
    from tidegauge.functions import kernels as K

    sf = "/root/testdata/sf0.001"
    top = catalog.returns(spark, sf).groupBy("symbol").count().orderBy(F.desc("count"), "symbol").first()["symbol"]
    close = [r["close"] for r in catalog.returns(spark, sf).where(F.col("symbol") == top).orderBy("ts").select("close").collect()]
    for name, statistic in (("hurst_rolling", K.structure_exponent), ("hurst_rs_rolling", K.rescaled_range_exponent)):
        got = column(catalog.QUERIES[name](spark, sf).where(F.col("symbol") == top), "hurst")
        want = [None if math.isnan(v) else pytest.approx(v, abs=1e-7) for v in K.rolling(close, 100, 50, statistic)]
        assert len(close) > 100 and got == want
