"""Recurrences against independent formulas and bounds on synthetic series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.functions import kernels as K


def crash(seed=0):
    g = np.random.default_rng(seed)
    a, b = g.normal(0.0005, 0.012, 260), g.normal(-0.0002, 0.0144, 239)
    return np.concatenate([a, [-10 * 0.012], b])


@given(st.lists(st.floats(-1, 1), min_size=3, max_size=40), st.floats(1, 60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_weighted_deviation_equals_pandas(values, halflife, adjust):
    want = pd.Series(values).ewm(halflife=halflife, adjust=adjust).std().to_numpy()
    got = K.ewm_std(np.array(values), K.halflife_alpha(halflife), adjust)
    assert np.allclose(got[1:], want[1:], atol=1e-7)


def test_missing_values_are_skipped():
    x = np.array([np.nan, 1.0, np.nan, 3.0])
    assert np.allclose(K.ema(x, 0.5), [np.nan, 1, np.nan, 2], equal_nan=True)


def test_lo_statistic():
    assert K.lo_statistic(np.arange(1.0, 6.0), 0, 5) == pytest.approx(3 / np.sqrt(10))


def test_exponents():
    g = np.random.default_rng(1)
    walk = np.cumsum(g.normal(size=2000))
    assert 0.35 < K.structure_exponent(walk) < 0.65 and 0.4 < K.rescaled_range_exponent(walk) < 0.7 and 0.4 < K.dfa_exponent(np.diff(walk)) < 0.6
    assert np.isnan(K.structure_exponent(np.ones(50))) and np.isnan(K.dfa_exponent(np.ones(5)))


def naive_bocpd(x, hazard):
    """The recursion with posteriors updated value by value."""
    import math

    runs = [(0.0, 1.0, 1.0, 1.0)]
    mass, out = np.ones(1), []
    for v in x:
        pred = []
        for mu, kappa, alpha, beta in runs:
            scale = beta * (kappa + 1) / (alpha * kappa)
            pred.append(math.exp(math.lgamma(alpha + 0.5) - math.lgamma(alpha)) / math.sqrt(2 * alpha * math.pi * scale) * (1 + (v - mu) ** 2 / scale / (2 * alpha)) ** (-alpha - 0.5))
        joint = mass * np.array(pred)
        mass = np.concatenate([[joint.sum() * hazard], joint * (1 - hazard)])
        mass /= mass.sum()
        runs = [(0.0, 1.0, 1.0, 1.0)] + [((k * m + v) / (k + 1), k + 1, a + 0.5, b + k * (v - m) ** 2 / (2 * (k + 1))) for m, k, a, b in runs]
        out.append(mass.argmax())
    return np.array(out, float)


def test_change_points_equal_the_naive_recursion():
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(0, 1, 60), g.normal(4, 1, 60)])
    run, change, recent = K.bocpd(x, 50.0)
    assert (run == naive_bocpd(x, 1 / 50)).all() and np.allclose(change, 1 / 50) and (recent >= change - 1e-12).all()
    assert run[-1] < 70


def test_robust_detector_on_a_crash():
    x = crash()
    run, _ = K.dsm_bocpd(x, 100.0, float(np.var(x, ddof=1)))
    assert run[260:262].min() < 10 and run[360] >= 50


@pytest.mark.parametrize("seed", range(5))
def test_robust_detector_on_a_quiet_series(seed):
    x = np.random.default_rng(seed).normal(0, 0.004, 600)
    run, _ = K.dsm_bocpd(x, 100.0, max(float(np.var(x, ddof=1)), 1e-8))
    assert (run[:-1] - run[1:] >= 30).sum() <= 3


def test_markov_states():
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(0, 0.005, 300), g.normal(0, 0.03, 200), g.normal(0, 0.005, 100)])
    fit = K.fit_markov(x[:, None])
    high = fit.smoothed > 0.5
    assert abs(int(np.flatnonzero(high)[0]) - 300) <= 10 and fit.transition[0, 0] > 0.95 and fit.transition[1, 1] > 0.95
    assert fit.covariances[0][0, 0] < fit.covariances[1][0, 0]
    iv = np.concatenate([g.normal(0.15, 0.01, 300), g.normal(0.40, 0.05, 200), g.normal(0.16, 0.01, 100)])
    two = K.fit_markov(np.column_stack([x, iv]))
    assert (two.filtered[310:490] > 0.9).all() and (two.filtered[:290] < 0.1).all()
    with pytest.raises(ValueError):
        K.fit_markov(x[:40, None])


def test_halflife_grid_needs_enough_values():
    assert K.halflife_scores(np.zeros(40), (5, 10)) == {}
    assert set(K.halflife_scores(crash(), (5, 10))) == {5.0, 10.0}


def test_cooldown():
    assert K.cooled_down(np.array([1, 5, 11, 30]), 10) == [1, 11, 30]


def guarded_bar_by_bar(signal, price, hold, stop):
    """The guard as a state machine, one bar at a time."""
    entry, age, out = None, 0, []
    for on, p in zip(signal, price, strict=True):
        stopped = entry is not None and stop is not None and p / entry - 1 <= stop
        expired = entry is not None and hold is not None and age >= hold
        active = bool(on) and not stopped and not expired
        entry, age = (entry if entry is not None else p, age + 1 if entry is not None else 1) if active else (None, 0)
        out.append((active, stopped, expired))
    return out


def test_guard_equals_the_state_machine():
    g = np.random.default_rng(0)
    for _ in range(500):
        n = int(g.integers(0, 40))
        signal, price = g.random(n) < g.random(), 100 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
        hold, stop = (None if g.random() < 0.3 else int(g.integers(1, 8))), (None if g.random() < 0.3 else -float(g.random()) * 0.05)
        assert list(zip(*(x.tolist() for x in K.risk_guard(signal, price, hold, stop)), strict=True)) == guarded_bar_by_bar(signal, price, hold, stop)
    held = K.risk_guard(np.array([True, True]), np.array([0.0, 1.0]), None, -0.1)[0]
    assert held.tolist() == [True, True]
    for bad in ((0, -0.1), (3, 0.1)):
        with pytest.raises(ValueError):
            K.risk_guard(np.array([True]), np.array([1.0]), *bad)


def test_blocks_of_windows_equal_single_windows():
    g = np.random.default_rng(1)
    x = 100 * np.exp(np.cumsum(g.normal(0, 0.01, 700)))
    x[300], x[400:460] = np.nan, 100.0
    r = np.diff(np.log(x))
    assert np.allclose(K.rolling_structure(x, 100, 50), K.rolling(x, 100, 50, K.structure_exponent), equal_nan=True, atol=1e-10)
    for lags in (None, 0, 7):
        assert np.allclose(K.rolling_lo(r, 100, 50, lags), K.rolling(r, 100, 50, lambda v, lags=lags: K.lo_statistic(v, lags)), equal_nan=True, atol=1e-10)


def test_robust_changes_of_many_series_are_those_of_each():
    """Series of any lengths that go step by step together give, bit for bit, what each gives by itself."""
    g = np.random.default_rng(11)
    series = [g.normal(0, 0.01 * (1 + i % 3), int(n)) for i, n in enumerate([130, 0, 7, 60, 130, 51, 1])] + [np.full(4, np.nan), np.zeros(70)]
    series[0][60:] *= 9
    series[3][::5] = np.nan
    levels = [1e-4 * (1 + i) for i in range(len(series))]
    for x, varx, found in zip(series, levels, K.dsm_bocpd_many(series, 100.0, levels), strict=True):
        want, state = [np.full(len(x), np.nan) for _ in range(2)], K.dsm_start((0.0, 1.0))
        for t in np.flatnonzero(np.isfinite(x)):
            want[0][t], want[1][t], state = K.dsm_step(float(x[t]), state, 1 / 100.0, varx, 1.0, 3.0, (0.0, 1.0), 50)
        np.testing.assert_array_equal(found, want)
    assert K.dsm_bocpd_many([], 100.0, []) == []


def test_robust_changes_of_many_symbols(spark, monkeypatch):
    """Symbols that share a call, a symbol longer than a call and one without a name, each in the order of its times."""
    from tidegauge.config import Config
    from tidegauge.functions import grouped
    from tidegauge.operators import folds

    g = np.random.default_rng(12)
    data = {s: g.normal(0, 0.01, n) for s, n in (("a", 3), ("b", 40), (None, 9), ("c", 170), ("d", 1), ("e", 12))}
    bars = [(s, t, float(v)) for s, x in data.items() for t, v in enumerate(x)]
    df = spark.createDataFrame([bars[i] for i in g.permutation(len(bars))], "symbol string, ts long, log_return double")
    monkeypatch.setattr(grouped, "TOGETHER_ROWS", 30)
    got = {(r["symbol"], r["ts"]): (r["bocpd_run_length"], r["bocpd_change_prob"]) for r in folds.dsm_bocpd(df, Config()).collect()}
    assert len(got) == len(bars)
    for s, x in data.items():
        want = K.dsm_bocpd(x, 100.0, max(float(np.var(x, ddof=1)), 1e-8) if len(x) > 1 else 1e-4)
        assert [got[s, t] for t in range(len(x))] == list(zip(*[c.tolist() for c in want], strict=True))
