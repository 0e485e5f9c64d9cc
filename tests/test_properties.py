"""Causality, plan shape, results against DuckDB at the smallest scale, sinks and streaming."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import bars
from pyspark.sql import functions as F

from tidegauge import catalog
from tidegauge.config import Config
from tidegauge.operators import backtest, folds, regimes
from tidegauge.plans.analysis import Engine, Overlays, labelled, run_analysis
from tidegauge.sources import bars as S
from tidegauge.sources import sinks
from tidegauge.streaming import regimes as streaming

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def prices(seed=0, n=330):
    g = np.random.default_rng(seed)
    r = np.concatenate([g.normal(0.0005, 0.012, n // 2), g.normal(-0.0002, 0.028, n - n // 2)])
    return [float(v) for v in 100 * np.exp(np.cumsum(r))]


def small():
    return Config(percentile_lookback=60, baseline_window=40, hurst_window=40, tail_window=40, adaptive_window=60)


def test_no_feature_looks_ahead(spark):
    close = prices()
    cut = 280
    poisoned = close[:cut] + [v * 3 for v in close[cut:]]
    overlays = Overlays(adaptive=True, ewma=True, bocpd="standard")
    rows = []
    for values in (close, poisoned):
        df = run_analysis(bars(spark, values, [v * 1.005 for v in values], [v * 0.995 for v in values]).drop("rn"), small(), overlays)
        rows.append(df.drop("fractal_efficiency").where(F.col("rn") <= cut).toPandas().sort_values("ts").reset_index(drop=True))
    pd.testing.assert_frame_equal(rows[0], rows[1], rtol=1e-9)


def test_one_exchange_by_symbol(spark):
    df = labelled(S.daily_bars(spark, SF), Config())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 1 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = S.daily_bars(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan and "l_comment" not in plan


def _rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("~" if pd.isna(v) else (f"{float(v):.6f}" if isinstance(v, (float, np.floating)) else str(v)) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    assert _rows(catalog.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(catalog.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_cleaning(spark):
    rows = [("X", "2024-01-01", 1.0), ("X", "2024-01-02", None), ("X", "2024-01-03", 3.0), ("X", "2024-01-03", 9.0), (None, "2024-01-04", 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    got = {fill: [r["close"] for r in S.clean(df, fill).orderBy("ts").collect()] for fill in ("ffill", "drop", "interpolate")}
    assert got == {"ffill": [1, 1, 3], "drop": [1, 3], "interpolate": [1, 2, 3]}


def test_walk_forward_shape(spark):
    df = bars(spark, prices(), symbol="AAA").unionByName(bars(spark, prices(1), symbol="BBB"))
    df = labelled(df.drop("rn"), small())
    got = backtest.walk_forward(df, backtest.recent_windows(spark, "2024-11-25", (("a", 60, 31), ("b", 30, 0))), {"indices": ("AAA",)}, cost_bps=5.0)
    assert got.count() == 8 and {r[0] for r in got.select("group").distinct().collect()} == {"indices", "other"}
    assert backtest.promotion(got, ("indices",), ("other",)).count() == 1


def test_promotion_reasons(spark):
    rows = [("w1", "A", "indices", "group_rebound", 10, False, -0.05, -0.1, "risk_on_rebound", "defensive", 0.0)]
    df = spark.createDataFrame(rows, "window string, symbol string, group string, variant string, observations int, improved_vs_current boolean, drawdown_delta_vs_current double, strategy_return_delta_vs_current double, market_story string, strategy_posture string, transaction_cost_bps double")
    got = backtest.research_promotion(df, ("indices",), ("crypto",)).first()
    assert not got["promote"] and "windows: too few tested" in got["reasons"] and "stability: no neighbours tested" in got["reasons"] and "drawdown: deeper than allowed" in got["reasons"]


def test_implied_vol_and_fallback(spark):
    df = S.with_returns(bars(spark, prices(2, 200)))
    vol = df.select(F.to_date("ts").alias("date"), F.lit(0.2).alias("implied_vol")).limit(10)
    got = folds.markov(folds.implied_vol(df, vol), second="implied_vol")
    assert {r[0] for r in got.select("markov_model").distinct().collect()} == {"log_return"} and got.count() == 200


def test_exports_and_report(spark, tmp_path):
    engine = Engine(spark, small())
    bars(spark, prices()).drop("rn").write.parquet(str(tmp_path / "bars"))
    df = engine.analyse(engine.read(str(tmp_path / "bars"), symbols=["x"]))
    tables = engine.summaries(df)
    sinks.export_all(tables, df, str(tmp_path / "out"), fuzzy=True)
    sinks.write_matrix(tables["transitions"], str(tmp_path / "wide"))
    assert "Strategy" in sinks.report(tables) and (tmp_path / "out/daily").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "out/daily")).count() == 330
    assert sinks.nowcast_json(regimes.fuzzy_nowcast(df)).count() == 1


def test_streaming_nowcast_equals_batch(spark, tmp_path):
    df = bars(spark, prices(4, 80)).drop("rn")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.nowcast(stream).writeStream.format("memory").queryName("now").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("now").toPandas().sort_values("ts")
    want = labelled(df).toPandas().sort_values("ts")
    assert np.allclose(got["trend_strength"].to_numpy(float), want["trend_strength"].to_numpy(float), equal_nan=True, atol=1e-8)
    assert list(got["trend_regime"]) == list(want["trend_regime"])


def test_streaming_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = streaming.stream_bars(stream).writeStream.format("memory").queryName("bars_now").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bars_now").count() > 0
