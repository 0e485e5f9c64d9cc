"""Blocked scans against the same recurrences taken in one go."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import bars
from pyspark.sql import functions as F

from tidegauge.config import Config
from tidegauge.functions import kernels as K
from tidegauge.functions import recurrences as R
from tidegauge.operators import features, folds, scans
from tidegauge.sources.bars import with_returns

CFG = Config()


def series(n: int, seed: int, holes: float = 0.1) -> np.ndarray:
    g = np.random.default_rng(seed)
    x = g.normal(0.01, 1.0, n) * np.where(np.arange(n) // 50 % 2, 3.0, 0.5)
    x[g.random(n) < holes] = np.nan
    return x


CASES = {
    "mean": (R.Mean(0.1), 1, lambda x: K.ema(x, 0.1)),
    "adjusted": (R.Deviation(0.05, True, 5), 5, lambda x: K.ewm_std(x, 0.05, True, 5)),
    "plain": (R.Deviation(0.2, False), 5, lambda x: K.ewm_std(x, 0.2, False)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_one_pass(name, seed):
    made, width, whole = CASES[name]
    x = series(400, seed)
    x[: 30 * (seed % 2)] = np.nan  # blocks without a value, at the start too
    cuts = sorted(np.random.default_rng(seed).integers(0, 401, 25).tolist())  # some blocks are empty
    parts = np.split(x, cuts)
    states = R.starts(made, [made.summary(p) for p in parts], width)
    got = np.concatenate([made.run(None if np.isnan(s).any() else s, p)[0] for s, p in zip(states, parts, strict=True)])
    np.testing.assert_allclose(got, whole(x), rtol=1e-9, atol=1e-12)
    state, kept = None, []  # going on from the state that was left is the same to the last bit
    for p in parts:
        values, state = made.run(state, p)
        kept.append(values)
    np.testing.assert_array_equal(np.concatenate(kept), whole(x))


def test_forward_filter_equals_one_pass():
    x = series(700, 9, 0.0)
    means, variances, trans, start = [0.0, 0.1], [0.3, 8.0], np.array([[0.97, 0.03], [0.08, 0.92]]), np.array([0.6, 0.4])
    made = R.Forward(means, variances, trans.ravel(), start)
    logs = np.column_stack([K._log_density(x[:, None], np.array([m]), np.array([[v]])) for m, v in zip(means, variances, strict=True)])
    whole, _ = K._forward(np.exp(logs - logs.max(axis=1, keepdims=True)), trans, start)
    parts = np.split(x, [1, 2, 2, 100, 457])
    states = R.starts(made, [made.summary(p) for p in parts], 2)
    got = np.concatenate([made.run(None if np.isnan(s).any() else s, p)[0] for s, p in zip(states, parts, strict=True)])
    np.testing.assert_allclose(got, whole[:, 1], rtol=1e-9)


def long_and_short(spark):
    """One symbol with most bars, one with few, one with a single bar; some closes are missing or not positive."""
    rows = []
    for symbol, n in (("LONG", 900), ("S", 40), ("ONE", 1)):
        close = 100 * np.exp(np.cumsum(0.01 * np.nan_to_num(series(n, 3))))
        for i, c in enumerate(close):
            bad = None if i % 97 == 5 else -1.0 if i % 101 == 7 else float(c)
            rows.append((symbol, datetime(2024, 1, 1) + timedelta(minutes=i), float(c), float(c) * 1.01, float(c) * 0.99, bad, 1.0, i))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, extra int").repartition(3)


def test_blocks_equal_folds(spark):
    raw = long_and_short(spark)
    blocks = scans.blocked(raw, 64)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert sum(sizes) == 941 and len(sizes) >= 12 and max(sizes) <= 2 * np.median(sizes)
    out = scans.with_returns(blocks)
    for step in (scans.average_true_range, scans.ewm_volatility, scans.ewma_trend):
        out = step(out, CFG)
    whole = features.numbered(with_returns(raw))
    for step in (folds.average_true_range, folds.ewm_volatility, folds.ewma_trend):
        whole = step(whole, CFG)
    names = ["symbol", "ts", "extra", "rn", "atr", "atr_pct", "volatility", "trend_strength_ewma"]
    a, b = (df.select(*names).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for df in (out, whole))
    assert (a[names[:4]] == b[names[:4]]).all().all()
    for c in names[4:]:
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_markov_filter_of_the_fitted_model(spark):
    x = series(600, 5, 0.0) * 0.01
    df = bars(spark, (100 * np.exp(np.cumsum(x))).tolist())
    blocks = scans.with_returns(scans.blocked(df, 50))
    given = scans.markov_parameters(blocks)
    row = given.first()
    got = [r[0] for r in scans.markov_filter(blocks, given).orderBy("ts").select("markov_prob_high").collect()]
    returns = np.diff(np.cumsum(x))
    fit = K.fit_markov(returns[:, None])
    assert row["variances"][0] < row["variances"][1] and abs(sum(row["start"]) - 1) < 1e-9
    assert got[0] is None and np.abs(np.array(got[50:]) - fit.filtered[49:]).max() < 0.05  # the start differs, the rest does not
    few = scans.markov_parameters(blocks, fit_bars=30)
    assert few.count() == 0 and scans.markov_filter(blocks, few).where("markov_prob_high is not null").count() == 0


def test_no_bars(spark):
    none = scans.blocked(bars(spark, [1.0]).limit(0), 10)
    assert scans.average_true_range(none, CFG).count() == 0
    assert scans.ewma_trend(scans.with_returns(none), CFG).where(F.col("rn") > 0).count() == 0
