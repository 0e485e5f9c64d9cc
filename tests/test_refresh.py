"""Incremental refresh against one run over everything."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegauge.config import Config
from tidegauge.plans.refresh import Refresher, full
from tidegauge.schema import BARS

CFG = Config(trend_window=6, volatility_window=5, percentile_lookback=25, baseline_window=12)


def history(spark, n=90, seed=1):
    g, rows = np.random.default_rng(seed), []
    for s, symbol in enumerate(("A", "B", "LATER")):
        close = 50 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
        for i in range(40 if symbol == "LATER" else 0, n):
            c = None if i % 31 == 7 else float(close[i])
            rows.append((symbol, datetime(2024, 1, 1) + timedelta(days=i), float(close[i]), float(close[i]) * 1.02, float(close[i]) * 0.97, c, float(s)))
    return spark.createDataFrame(rows, BARS)


def same(a, b):
    a, b = (df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for df in (a, b))
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for c in a.columns:
        assert a[c].equals(b[c]), c  # to the last bit; nulls equal nulls


def test_batches_equal_one_run(spark, tmp_path):
    bars = history(spark)
    table = Refresher(spark, str(tmp_path / "labels"), CFG)
    with pytest.raises(ValueError):
        table.labels()
    for lo, hi in ((0, 50), (50, 51), (51, 90)):
        day = lambda n: (datetime(2024, 1, 1) + timedelta(days=n)).isoformat()
        table.apply(bars.where(f"ts >= '{day(lo)}' and ts < '{day(hi)}'"))
    same(table.labels(), full(bars, CFG))


def test_repeated_late_and_broken_batches(spark, tmp_path):
    bars = history(spark, 60)
    early, late = bars.where("ts < '2024-02-10'"), bars.where("ts >= '2024-02-10'")
    table = Refresher(spark, str(tmp_path / "labels"), CFG)
    table.batch(early, 0)
    table.batch(early, 0)  # replayed by the stream
    late.limit(3).write.parquet(str(tmp_path / "labels" / "labels" / "version=1"))  # left by an interrupted run
    assert table.labels().count() == early.count()
    table.batch(late.unionByName(early.limit(4)), 1)  # four bars come too late
    same(table.labels(), full(bars, CFG))
    with pytest.raises(ValueError):
        table.apply(late, -1)
    table.batch(late.limit(0), 2)
    assert table.labels().count() == bars.count() and table._versions() == [0, 1, 2]
    with pytest.raises(ValueError):
        Refresher(spark, "x", Config(volatility_method="ewm"))


def test_a_stream_of_bars(spark, tmp_path):
    bars = history(spark, 40)
    bars.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in" / "a"))
    table = Refresher(spark, str(tmp_path / "labels"), CFG)
    stream = spark.readStream.schema(BARS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = lambda: stream.writeStream.foreachBatch(table.batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    later = history(spark, 55).where("ts >= '2024-02-10'")
    later.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    run()
    same(table.labels(), full(bars.unionByName(later), CFG))
