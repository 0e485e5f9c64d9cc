"""As-of joins, the volatility channel through indices, and configuration by source."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import bars, column
from pyspark.sql import functions as F

from tidegauge.config import Config
from tidegauge.operators import channels
from tidegauge.plans.analysis import Engine, Overlays, by_source, labelled
from tidegauge.sources.bars import requested

DAY = datetime(2024, 1, 1)


def at(days: float) -> datetime:
    return DAY + timedelta(days=days)


def latest(rows, series, tolerance):
    """Every row's value by looking through the whole series."""
    out = []
    for key, when in rows:
        known = [(t, v) for k, t, v in series if k == key and t is not None and v is not None and t <= when] if key is not None and when is not None else []
        best = max(known, default=None)
        late = best is None or tolerance is not None and (when.date() - best[0].date()).days > tolerance
        out.append((key, when, None if late else best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance", [None, 0, 3])
def test_as_of(spark, tolerance):
    g = np.random.default_rng(4)
    keys = ["a", "b", "gone"]
    rows = [(keys[int(g.integers(3))], at(float(g.integers(0, 400)) / 10)) for _ in range(200)] + [(None, at(3)), ("a", None), ("a", at(5)), ("a", at(5))]
    series = [(keys[int(g.integers(2))], at(float(g.integers(0, 400)) / 10), float(g.integers(0, 9))) for _ in range(60)]
    series += [("a", at(5), 1.0), ("a", at(5), 7.0), ("a", at(6), None), (None, at(1), 5.0), ("b", None, 5.0), ("b", at(-50), 2.0)]
    left = spark.createDataFrame(rows, "k string, ts timestamp").withColumn("v", F.lit("replaced")).withColumn("extra", F.lit(1))
    right = spark.createDataFrame(series, "k string, since timestamp, v double")
    got = channels.as_of(left, right, ["k"], "ts", "since", "v", tolerance)
    assert got.columns == ["k", "ts", "extra", "v"]
    assert sorted(((r["k"], r["ts"], r["v"]) for r in got.collect()), key=str) == latest(rows, series, tolerance)
    assert channels.as_of(left.limit(0), right, ["k"], "ts", "since", "v").count() == 0
    assert channels.as_of(left, right.limit(0), ["k"], "ts", "since", "v").where("v is not null").count() == 0


def test_as_of_takes_one_exchange(spark):
    left = spark.range(10).select(F.lit("a").alias("k"), F.current_timestamp().alias("ts"))
    right = spark.range(10).select(F.lit("a").alias("k"), F.current_timestamp().alias("since"), F.rand().alias("v"))
    plan = channels.as_of(left, right, ["k"], "ts", "since", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Window") >= 1


def test_channel_of_each_symbol(spark):
    spy, gold = bars(spark, [1.0, 2.0, 3.0, 4.0], symbol="SPY"), bars(spark, [5.0, 6.0], symbol="GLD")
    both = spy.unionByName(gold).unionByName(bars(spark, [1.0], symbol="NONE"))
    quotes = bars(spark, [20.0, 22.0], symbol=" ^vix", start=datetime(2024, 1, 1, 15)).unionByName(bars(spark, [15.0], symbol="^GVZ", start=datetime(2024, 1, 2)))
    got = channels.implied_vol(both, quotes, 1)
    assert column(got.where("symbol = 'SPY'"), "implied_vol") == [0.2, 0.22, 0.22, None]
    assert column(got.where("symbol = 'GLD'"), "implied_vol") == [None, 0.15] and column(got.where("symbol = 'NONE'"), "implied_vol") == [None]
    assert column(channels.implied_vol(both, quotes).where("symbol = 'SPY'"), "implied_vol") == [0.2, 0.22, None, None]


def test_analysis_with_quotes(spark):
    g = np.random.default_rng(2)
    calm, wild = g.normal(0, 0.005, 120), g.normal(0, 0.03, 120)
    close = (100 * np.exp(np.cumsum(np.concatenate([calm, wild])))).tolist()
    quoted = np.concatenate([g.normal(15, 1, 120), g.normal(40, 3, 120)]).tolist()
    found = Engine(spark).analyse(bars(spark, close, symbol="SPY").unionByName(bars(spark, close, symbol="QQQ")), Overlays(False, markov=True), quotes=bars(spark, quoted, symbol="^VIX"))
    models = {r[0]: r[1] for r in found.groupBy("symbol").agg(F.max("markov_model")).collect()}
    assert models == {"SPY": "log_return+implied_vol", "QQQ": "log_return"}
    late = column(found.where("symbol = 'SPY'"), "markov_state")[130:]
    assert late.count("High") > 0.95 * len(late)
    with pytest.raises(ValueError):
        Engine(spark).analyse(bars(spark, close), Overlays(markov=True), implied=bars(spark, quoted), quotes=bars(spark, quoted))


def test_two_classes_in_one_table(spark):
    close = (100 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, 90)))).tolist()
    stock, coin = bars(spark, close, symbol="SPY"), bars(spark, close, symbol="BTCUSDT")
    got = by_source(stock.unionByName(coin), labelled)
    for alone, cfg in ((stock, Config()), (coin, Config.crypto())):
        symbol = alone.first()["symbol"]
        for c in ("slope", "volatility", "volatility_percentile", "regime"):
            assert column(got.where(F.col("symbol") == symbol), c) == column(labelled(alone, cfg), c)
    assert column(got.where("symbol = 'SPY'"), "slope") != column(got.where("symbol = 'BTCUSDT'"), "slope")


def test_requests():
    for fine in ((None, None, None), ("1y", None, None), (None, "2024-01-01", "2024-02-01")):
        requested(*fine)
    for bad in (("1y", "2024-01-01", None), ("1y", None, "2024-01-01"), (None, "2024-01-01", None), (None, None, "2024-01-01")):
        with pytest.raises(ValueError):
            requested(*bad)
