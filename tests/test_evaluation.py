"""Purged folds of real bars, fold statistics, correlations of any columns, grouping sets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from helpers import bars
from pyspark.sql import functions as F

from tidegauge.operators import analytics as A


@pytest.mark.parametrize(("folds", "tests", "horizon", "embargo"), [(6, 2, 0, 0), (6, 2, 5, 3), (5, 3, 30, 25), (4, 1, 0, 90)])
def test_roles_equal_the_definition(spark, folds, tests, horizon, embargo):
    df = bars(spark, [1.0] * 83).unionByName(bars(spark, [1.0] * 3, symbol="SHORT"))
    got = {(r["path_id"], r["rn"] - 1, r["role"]) for r in A.cpcv_roles(df, folds, tests, horizon, embargo).collect()}
    assert got == {(r["path_id"], r["rn"], r["role"]) for r in A.cpcv_folds(spark, 83, folds, tests, horizon, embargo).collect()}
    with pytest.raises(ValueError):
        A.cpcv_roles(df, 6, 6)
    with pytest.raises(ValueError):
        A.fold_masks(df, 70)


def test_sharpes_equal_those_of_the_rows(spark):
    g = np.random.default_rng(1)
    x = [None if i % 17 == 2 else float(v) for i, v in enumerate(g.normal(0.001, 0.01, 75))]
    df = bars(spark, [1.0] * 75, x=x)
    trials = {"long": F.col("x"), "short": -F.col("x"), "flat": F.lit(0.01), "half": F.when(F.col("rn") % 2 == 0, F.col("x")), "none": F.lit(None).cast("double")}
    got = {(r["path"], r["trial"]): (r["is_sharpe"], r["oos_sharpe"]) for r in A.path_sharpes(df, trials, 5, 2, 4, 2).collect()}
    values = {"long": x, "short": [None if v is None else -v for v in x], "flat": [0.01] * 75, "half": [v if i % 2 else None for i, v in enumerate(x)]}
    assert {t for _, t in got} == set(values)
    roles = A.cpcv_folds(spark, 75, 5, 2, 4, 2).toPandas()
    for (path, trial), found in got.items():
        for side, sharpe in zip(("train", "test"), found, strict=True):
            rows = roles[(roles.path_id == path) & (roles.role == side)].rn
            v = np.array([values[trial][i] for i in rows if values[trial][i] is not None])
            spread = v.std(ddof=1)
            assert sharpe == pytest.approx(v.mean() / spread if spread > 1e-9 else 0.0, rel=1e-9)


def test_no_row_is_repeated_per_path(spark):
    plan = A.path_sharpes(bars(spark, [1.0] * 20, x=[0.5] * 20), {"a": F.col("x")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.rindex("Aggregate")  # the paths multiply sums, which lie below them in the plan


def test_overfitting_against_the_median(spark):
    """Of an odd number of trials the middle one is not below the median."""
    rows = [(0, t, float(t), {2: 1.0, 1: 0.0, 0: 2.0}[t]) for t in range(3)] + [(1, t, float(t), float(-t)) for t in range(3)]
    trials = spark.createDataFrame(rows, "path int, trial int, is_sharpe double, oos_sharpe double")
    assert A.backtest_overfitting(trials).first()["pbo"] == 0.5
    both = trials.withColumn("symbol", F.lit("A")).unionByName(trials.where("path = 1").withColumn("symbol", F.lit("B")))
    assert {r["symbol"]: r["pbo"] for r in A.backtest_overfitting(both, ("symbol",)).collect()} == {"A": 0.5, "B": 1.0}


def test_correlations(spark):
    g = np.random.default_rng(2)
    columns = {c: [None if g.random() < 0.2 else float(v) for v in g.normal(0, 1, 60)] for c in "abc"} | {"flat": [1.0] * 60, "gone": [None] * 60}
    got = A.correlations(bars(spark, [1.0] * 60, **columns), list(columns)).collect()
    assert [(r["first"], r["second"]) for r in got] == list(combinations(columns, 2))
    for r in got:
        both = [(x, y) for x, y in zip(columns[r["first"]], columns[r["second"]], strict=True) if x is not None and y is not None]
        assert r["n"] == len(both)
        if "flat" in (r["first"], r["second"]) or "gone" in (r["first"], r["second"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    with pytest.raises(ValueError):
        A.correlations(bars(spark, [1.0]), ["close", "close"])


def test_forward_statistics_by_grouping_sets(spark):
    df = bars(spark, [1.0, 2.0, 1.0, 3.0, 2.0, 4.0], regime=["Up", "Up", None, "Unknown", "Down", "Down"])
    stats = A.forward_stats(df, (1,))
    got = {r["regime"]: r["n"] if "n" in stats.columns else r["count"] for r in stats.collect()}
    assert got == {"Overall": 5, "Up": 2, "Down": 1}
    assert "Expand" in stats._jdf.queryExecution().optimizedPlan().toString()


def test_transition_summaries(spark):
    df = bars(spark, [1.0] * 9, regime=["Up", "Up", "Down", "Unknown", "Up", "Down", "Down", "Up", "Side"])
    row = A.transition_summary(df).first()
    # Up: Up 1, Down 2, Side 1; Down: Down 1, Up 1; Side: nothing follows
    assert (row["total_count"], row["unique_transitions"], row["n_transitions"], row["bars"]) == (4, 3, 2, 9)
    of = lambda *p: -sum(x * np.log(x) for x in p)
    assert row["overall_entropy"] == pytest.approx((of(0.25, 0.5, 0.25) + of(0.5, 0.5)) / 3) and row["transitions_per_period"] == pytest.approx(4 / 9)
    matrix = A.transition_matrix(df)
    assert [tuple(r)[:2] for r in A.likely_transitions(matrix, 0.3).collect()] == [("Down", "Up"), ("Up", "Down")]
    top = A.common_transitions(df, most=1).first()
    assert tuple(top) == ("Up", "Down", 2, 50.0)
    none = A.transition_summary(df.where("regime = 'Unknown'")).first()
    assert (none["total_count"], none["unique_transitions"], none["n_transitions"], none["overall_entropy"], none["transitions_per_period"]) == (0, 0, 0, None, 0.0)


def test_states_that_cannot_be_told_apart():
    from tidegauge.functions.kernels import StateAlignmentError, fit_markov

    with pytest.raises(StateAlignmentError):
        fit_markov(np.zeros((60, 1)))


def test_long_memory_outlook(spark):
    from tidegauge.operators import folds

    h = [0.7, 0.4, None]
    labels = {"hurst_regime": ["Trending", "Mean-Reverting", "Unknown"], "hurst_confirmed_regime": ["a", "b", "c"], "lo_memory_regime": ["x", "y", "z"]}
    df = bars(spark, [1.0] * 3, hurst=h, persistence_strength=[0.2, -0.1, None], **labels)
    last = folds.hurst_outlook(df).first()
    assert last["current"] is None and last["interpretation"] is None and last["current_regime"] == "Unknown" and last["share_trending"] == 0.5 and (last["min"], last["max"]) == (0.4, 0.7)
    before = folds.hurst_outlook(df.where("rn < 3")).first()
    assert before["interpretation"] == "moves revert (H = 0.400)" and before["current_confirmed_regime"] == "b" and before["current_persistence"] == -0.1
