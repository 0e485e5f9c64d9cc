"""Summaries, insights, segment exponents, source errors, and bounded state."""

from __future__ import annotations

import math
import time
from datetime import datetime

import numpy as np
import pytest
from helpers import bars
from pyspark.sql import functions as F

from tidegauge.functions import kernels as K
from tidegauge.operators import analytics, folds, outlook
from tidegauge.operators.regimes import fuzzy_name
from tidegauge.plans.analysis import Engine
from tidegauge.schema import REGIMES
from tidegauge.sources import bars as S
from tidegauge.streaming import regimes as streaming


def test_market_summary(spark):
    df = bars(spark, [1.0, 2.0], hurst=[0.5, 0.6], **{fuzzy_name(r): [0.0, 0.7 if r == "Up-HighVol" else 0.06] for r in REGIMES})
    got = outlook.market_summary(df).first()
    assert (got["trend_phase"], got["volatility_phase"], got["memory_phase"]) == ("rising", "high", "persistent")
    assert got["summary"] == "trend rising, volatility high, moves persistent"
    assert outlook.market_summary(df.drop("hurst")).first()["summary"] == "trend rising, volatility high"


def test_insights(spark):
    n = 40
    vol = [0.1] * 20 + [0.3] * 20
    df = bars(spark, [100.0] * n, volatility=vol, hurst=[0.6] * 30 + [0.5] * 10, regime=["Up-LowVol"] * 30 + ["Down-LowVol"] * 10)
    got = {r["insight"]: r["value"] for r in outlook.insights(df).collect()}
    assert set(got) == {"mostly rising", "volatility above its mean", "persistent"}
    assert got["mostly rising"] == 0.75 and got["persistent"] == 0.75 and abs(got["volatility above its mean"] - 1.5) < 1e-12
    flat = bars(spark, [100.0] * n, volatility=[0.1] * n, regime=["Unknown"] * n)
    assert outlook.insights(flat).count() == 0


def test_forward_summary_orders_by_mean(spark):
    rows = [(5, "A", 0.1), (5, "B", 0.3), (5, "Overall", 0.2), (5, "C", 0.3), (10, "A", 9.0)]
    stats = spark.createDataFrame(rows, "horizon int, regime string, mean double")
    stats = stats.withColumns({c: F.lit(1.0) for c in ("count", "median", "std", "sharpe", "positive_pct", "min", "max")})
    assert [(r["place"], r["regime"]) for r in analytics.forward_summary(stats).orderBy("place").collect()] == [(1, "B"), (2, "C"), (3, "A")]


@pytest.mark.parametrize("method", ["rs", "dfa"])
def test_segment_hurst(spark, method):
    close = (100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 60)))).tolist()
    df = bars(spark, close, regime=["Up-LowVol"] * 40 + ["Unknown"] + ["Down-LowVol"] * 19)
    got = {r["seg"]: r for r in folds.segment_hurst(df, method).collect()}
    x = np.array(close[:40])
    want = K.rescaled_range_exponent(x) if method == "rs" else K.dfa_exponent(np.diff(np.log(x)))
    assert got[1]["length"] == 40 and math.isclose(got[1]["hurst"], want, rel_tol=1e-9)
    assert got[2]["length"] == 19 and got[2]["hurst"] is None
    with pytest.raises(ValueError, match="method"):
        folds.segment_hurst(df, "x")


def test_source_errors_and_periods(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars(spark, [float(i + 1) for i in range(40)]).drop("rn").write.parquet(path)
    engine = Engine(spark)
    with pytest.raises(S.InvalidSymbol, match="no such symbol"):
        engine.read(path, symbols=["X", "no such symbol"])
    with pytest.raises(S.NoData, match="SPY"):
        engine.read(path, required=True, symbols=["x", "SPY"])
    with pytest.raises(S.NoData):
        engine.read(path, required=True, start="2030-01-01")
    assert engine.read(path, required=True, symbols=["x"], end="2024-02-09", period="5d").count() == 6
    assert engine.read(path, end="2024-02-09", period="unheard of").count() == 40
    assert engine.read(path, period="1d").count() == 0


def test_bocpd_with_bounded_runs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(6, 1, 150)])
    full, few = K.bocpd(x, 100.0), K.bocpd(x, 100.0, least_mass=1e-9)
    assert (full[0] == few[0]).all() and np.allclose(full[1], few[1], atol=1e-6) and np.allclose(full[2], few[2], atol=1e-6)


def until(holds, seconds=30):
    """Waits; a query with timeouts never says that it has processed all (it goes on without data)."""
    end = time.monotonic() + seconds
    while not holds() and time.monotonic() < end:
        time.sleep(0.2)
    assert holds()


def test_stream_skips_bars_without_price_and_forgets(spark, tmp_path):
    df = bars(spark, [100.0, None, 0.0, 101.0, -1.0, 102.0, 103.0]).drop("rn").orderBy("ts")
    last = F.col("ts") == F.lit("2024-01-07").cast("timestamp")
    found = {}
    for name, forget in (("kept_now", None), ("forgotten_now", 1)):
        df.where(~last).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        q = streaming.nowcast(stream, forget_ms=forget).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
        try:
            until(lambda: spark.table(name).count() == 3)
            time.sleep(1)  # a trigger without data lets the state go
            df.where(last).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            until(lambda: spark.table(name).count() == 4)
        finally:
            q.stop()
        found[name] = {r["close"]: r["run_length"] for r in spark.table(name).collect()}
    assert set(found["kept_now"]) == set(found["forgotten_now"]) == {100.0, 101.0, 102.0, 103.0}
    assert found["kept_now"][103.0] is not None and found["forgotten_now"][103.0] is None


def test_stream_bars_order_ties(spark):
    t = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("a", t, v) for v in (3.0, 1.0, 2.0)], "event_type string, ts timestamp, value double")
    got = streaming.stream_bars(ticks).first()
    assert (got["open"], got["close"]) == (1.0, 3.0)
