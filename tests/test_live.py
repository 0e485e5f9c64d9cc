"""The stateful processor against the batch results of the same bars."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.config import Config
from tidegauge.functions import kernels as K
from tidegauge.operators import folds
from tidegauge.operators.features import numbered
from tidegauge.sources.bars import with_returns
from tidegauge.streaming.live import Steps, live

CFG = Config(volatility_window=6, atr_window=5, consensus_cooldown=4)
START = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, high double, low double, close double, raw_overlay boolean, consensus_anchor double"


def table(n=60, seed=3):
    g, rows = np.random.default_rng(seed), []
    for symbol in ("A", "B"):
        close = 20 * np.exp(np.cumsum(g.normal(0, 0.03, n)))
        for i, c in enumerate(close):
            anchor = float(i + 1 + g.integers(0, 3)) if g.random() < 0.3 else None
            rows.append((symbol, START + timedelta(hours=i), float(c) * 1.02, float(c) * 0.99, None if i % 23 == 9 else float(c), bool(g.random() < 0.7), anchor))
    return rows


@pytest.mark.parametrize(("hold", "stop"), [(None, None), (3, None), (None, -0.02), (4, -0.03), (1, 0.0)])
def test_guard_equals_whole_trades(hold, stop):
    g = np.random.default_rng(7)
    price, signal = 10 * np.exp(np.cumsum(g.normal(0, 0.03, 400))), g.random(400) < 0.8
    price[[50, 51, 200]] = np.nan
    steps, s = Steps(CFG, hold, stop), Steps.start()
    got = np.array([steps.guard(s, bool(a), float(p)) for a, p in zip(signal, price, strict=True)])
    np.testing.assert_array_equal(got.T, np.array(K.risk_guard(signal, price, hold, stop)))


def run(spark, tmp_path, batches, **options):
    """What comes out when the batches arrive as files, one per trigger."""
    home = tmp_path / "in"
    home.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(home))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(home / f"{i:03}.parquet")
        os.utime(home / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    name = f"live_{tmp_path.name}".replace("-", "_")
    q = live(stream, CFG, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def test_replayed_bars_equal_the_batch(spark, tmp_path):
    rows = table()
    end = [(s, START + timedelta(days=30), 1.0, 1.0, 1.0, False, None) for s in ("A", "B")]
    g = np.random.default_rng(0)
    shuffled = []
    for at in range(0, 120, 12):  # out of order by a few hours, and across symbols
        shuffled += [sorted(rows, key=lambda r: r[1])[at + i] for i in g.permutation(12)]
    late = [("A", START + timedelta(minutes=5), 9.0, 9.0, 9.0, True, 1.0)]
    batches = [shuffled[:50], shuffled[50:70], shuffled[70:], [], late, end, [(s, START + timedelta(days=40), 1.0, 1.0, 1.0, False, None) for s in ("A", "B")]]
    got = run(spark, tmp_path, [b for b in batches if b], late="12 hours", max_holding=4, stop_loss=-0.03)
    got = got.where(F.col("ts") < F.lit(START + timedelta(days=29))).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    df = numbered(with_returns(spark.createDataFrame(rows, SCHEMA)))
    df = folds.risk_guard(folds.ewm_volatility(folds.average_true_range(df, CFG), CFG), 4, -0.03)

    def fold(frame):
        kept = set(K.cooled_down(frame["consensus_anchor"].dropna().astype(int).to_numpy(), CFG.consensus_cooldown))
        return frame["rn"].isin(kept)

    want = df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want["consensus_event"] = want.groupby("symbol", group_keys=False)[["rn", "consensus_anchor"]].apply(fold)
    assert len(got) == len(want) == 120
    for c in ("rn", "overlay_active", "overlay_stop", "overlay_expired", "consensus_event"):
        assert got[c].tolist() == want[c].tolist(), c
    for c in ("atr", "volatility"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, err_msg=c)  # logarithms of two languages
    assert got["overlay_stop"].any() and got["overlay_expired"].any() and got["consensus_event"].any()


def test_silence_is_forgotten(spark, tmp_path):
    bar = lambda d: ("A", START + timedelta(days=d), 2.0, 1.0, 1.5, False, None)
    other = lambda d: ("Z", START + timedelta(days=d), 2.0, 1.0, 1.5, False, None)
    got = run(spark, tmp_path, [[bar(0), bar(1)], [other(5)], [other(20)], [other(21)], [bar(30), bar(31)], [other(40)], [other(41)]], forget_ms=7 * 86_400_000)
    assert [r["rn"] for r in got.where("symbol = 'A'").orderBy("ts").collect()] == [1, 2, 1, 2]
