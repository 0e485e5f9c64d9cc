"""Sliding windows against the same statistics of every window by itself."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from helpers import bars, column
from pyspark.sql import functions as F

from tidegauge.catalog import QUERIES
from tidegauge.config import Config
from tidegauge.functions import sliding as S
from tidegauge.functions.frames import rolling, sliding_array
from tidegauge.operators import features as X
from tidegauge.operators import regimes as R
from tidegauge.plans.analysis import crisp_labels, labelled


def noisy(n: int, seed: int, holes: float = 0.1) -> np.ndarray:
    g = np.random.default_rng(seed)
    x = np.round(g.normal(0, 0.05, n), 2)  # rounded, so that values tie
    x[g.random(n) < holes] = np.nan
    return x


def windows(x: np.ndarray, w: int):
    return [x[max(0, i - w + 1) : i + 1] for i in range(len(x))]


@pytest.mark.parametrize("w", [1, 2, 7, 60, 500])
def test_drawdowns(w):
    for x in (noisy(300, w), np.append(noisy(90, 1), [-1.0, 0.3, -2.0, 0.1] * 3), np.full(5, np.nan), np.empty(0)):
        want = []
        for part in windows(1 + np.nan_to_num(x), w):
            level, top, fall = 1.0, 0.0, 0.0
            for f in part:
                level *= f
                top = max(top, level)
                fall = min(fall, level / top - 1 if top > 0 else 0.0)
            want.append(fall)
        np.testing.assert_allclose(S.drawdowns(x, w), want, atol=1e-12)


@pytest.mark.parametrize("w", [3, 20, 400])
def test_ranks_and_quantiles(w):
    x = noisy(250, w)
    want = [np.nan if np.isfinite(p).sum() < 3 else 0.0 if np.isnan(p[-1]) else float(np.sum(p[np.isfinite(p)] < p[-1])) / len(p) for p in windows(x, w)]
    np.testing.assert_array_equal(S.lower_shares(x, w, 3), want)
    up, down = S.earlier_quantiles(x, w, (0.7, 0.3), 3)
    for got, share in ((up, 0.7), (down, 0.3)):
        parts = [x[max(0, i - w) : i] for i in range(len(x))]
        np.testing.assert_allclose(got, [np.nan if np.isfinite(p).sum() < 3 else np.quantile(p[np.isfinite(p)], share) for p in parts], atol=1e-12)


@pytest.mark.parametrize("w", [10, 60])
def test_tail(w):
    x = noisy(200, w)
    var, cvar, hill = S.tail_statistics(x, w, 8, 0.9, 0.8, 0.2, 3)
    for i, part in enumerate(windows(x, w)):
        losses = np.sort(-part[np.isfinite(part)])
        if len(losses) < 8:
            assert np.isnan([var[i], cvar[i], hill[i]]).all()
            continue
        assert var[i] == pytest.approx(np.quantile(losses, 0.9)) and cvar[i] == pytest.approx(losses[losses >= np.quantile(losses, 0.8) - 1e-15].mean())
        top = losses[losses > 0][::-1]
        top = top[: min(len(top), max(3, math.floor(len(top) * 0.2)))]
        spread = np.log(top / top[-1]).mean() if len(top) >= 3 else 0.0
        assert np.isnan(hill[i]) if spread <= 0 else hill[i] == pytest.approx(1 / spread)


def test_cost_does_not_follow_the_window():
    x = np.random.default_rng(0).normal(0, 0.01, 30_000)
    for run in (lambda w: S.drawdowns(x, w), lambda w: S.lower_shares(x, w, 20), lambda w: S.earlier_quantiles(x, w, (0.7, 0.3), 20), lambda w: S.tail_statistics(x, w, 20, 0.95, 0.95, 0.1, 5)):
        taken = []
        for w in (252, 2520):
            best = math.inf
            for _ in range(3):
                began = time.perf_counter()
                run(w)
                best = min(best, time.perf_counter() - began)
            taken.append(best)
        assert taken[1] < 5 * taken[0]  # ten times the window


def test_features_equal_the_expressions_of_one_frame(spark):
    cfg = Config(tail_window=30, cvar_alpha=0.9, hill_min=3)
    close = (100 * np.exp(np.cumsum(np.nan_to_num(noisy(120, 3))))).tolist()
    df = X.tail_features(bars(spark, close), cfg)
    frame = rolling(30)
    n = F.count("log_return").over(frame)
    df = df.withColumns({"_r": sliding_array(F.col("log_return"), 30), "_all": F.collect_list(F.coalesce("log_return", F.lit(0.0))).over(frame), "_v": X.value_at_risk(30, 0.95), "_c": X.value_at_risk(30, 0.9)})
    df = df.withColumn("_l", F.transform("_r", lambda x: -x))
    wanted = {"loss_var": F.col("_v"), "loss_cvar": X.conditional_value_at_risk(F.col("_l"), F.col("_c")), "tail_index": X.hill_index(F.col("_l"), 0.1, 3)}
    df = df.withColumns({f"{c}_of_frame": F.when(n >= 20, e) for c, e in wanted.items()}).withColumn("rolling_max_drawdown_of_frame", F.when(F.col("rn") >= 15, X.window_drawdown(F.col("_all"))))
    for c in (*wanted, "rolling_max_drawdown"):
        a, b = column(df, c), column(df, f"{c}_of_frame")
        assert [v is None for v in a] == [v is None for v in b] and [v for v in a if v is not None] == pytest.approx([v for v in b if v is not None], abs=1e-12)


def test_long_windows_take_the_fold(spark, monkeypatch):
    g = np.random.default_rng(5)
    df = bars(spark, [1.0] * 90, v=[None if i % 11 == 3 else round(float(x), 1) for i, x in enumerate(g.normal(0, 1, 90))])
    listed = column(X.with_volatility_percentile(df, "v", 40, "p"), "p")
    monkeypatch.setattr(X, "LISTED_ROWS", 10)
    assert column(X.with_volatility_percentile(df, "v", 40, "p"), "p") == listed and listed.count(None) == 21
    up, down = R.quantile_thresholds("v", 20, 0.7, 0.3, 0.5, 0.4)
    df = R.with_quantile_thresholds(df, "v", 20, 0.7, 0.3, 0.5, 0.4).withColumns({"u": up, "d": down})
    for a, b in (("adaptive_upper", "u"), ("adaptive_lower", "d")):
        x, y = column(df, a), column(df, b)
        assert [v is None for v in x] == [v is None for v in y] and [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None])


@pytest.mark.parametrize("w, least", [(1, 1), (2, 1), (7, 3), (60, 20), (252, 25), (500, 50)])
def test_lower_shares_of_many_symbols(w, least):
    parts = [noisy(n, n + w, holes) for n, holes in ((1, 0.0), (300, 0.1), (2, 1.0), (1, 1.0), (700, 0.6), (30, 0.0), (3, 0.3))]
    want = np.concatenate([S.lower_shares(x, w, least) for x in parts])
    assert np.array_equal(S.lower_shares_together(parts, w, least), want, equal_nan=True)
    assert len(S.lower_shares_together([], w, least)) == 0


@pytest.mark.parametrize(
    "cfg", [Config(), Config(volatility_window=9, percentile_lookback=30), Config(annualize=True), Config(volatility_method="realized"), Config(volatility_method="ewm"), Config(percentile_lookback=500)], ids=["default", "windows", "annual", "realized", "ewm", "long"]
)
def test_crisp_labels_alone(spark, cfg):
    closes = {"A": 100 * np.exp(np.cumsum(np.nan_to_num(noisy(330, 3)))), "B": 10 + np.abs(np.nan_to_num(noisy(90, 4))), "C": np.full(40, 5.0), "D": np.array([1.0])}
    closes["B"][[20, 21, 50]] = 0.0  # no price, so no return
    frames = [bars(spark, x.tolist(), symbol=s).drop("rn") for s, x in closes.items()]
    table = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    names = ["symbol", "ts", "trend_strength", "volatility", "volatility_percentile", "trend_regime", "volatility_regime", "regime", "regime_name"]
    found, want = ([tuple(r) for r in f(table, cfg).select(names).orderBy("symbol", "ts").collect()] for f in (crisp_labels, labelled))
    assert len(found) == 461 and found == want


def test_labels_of_many_symbols_list_no_windows(spark):
    plan = QUERIES["regime_mix_many"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "regr_slope" not in plan
    assert plan.count("Exchange hashpartitioning") == 4  # items by symbol and day, bars by symbol, labels twice: none for the fold
