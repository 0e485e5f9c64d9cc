"""Bars as a stream: tumbling bar building, and a stateful nowcast per symbol that reuses the batch kernels' recurrences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.config import Config
from tidegauge.functions.kernels import dsm_start, dsm_step

OUTPUT = "symbol string, ts timestamp, close double, trend_strength double, volatility double, trend_regime string, run_length double"
#: bars seen; last log price; window of (log price) values; change-point survivors (run, mean, precision, log mass).
STATE = "seen long, prices array<double>, runs array<double>, mean array<double>, prec array<double>, mass array<double>"


def stream_bars(ticks: DataFrame, price: str = "value", symbol: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of a tick stream; ticks later than the watermark are dropped. Of ticks at one time the smaller price comes first."""
    order = F.struct("ts", price)
    got = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return got.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_counts(ticks: DataFrame, user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user's ticks that end after a gap."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), user).agg(F.count("*").alias("n")).select(user, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def nowcast(bars: DataFrame, cfg: Config | None = None, varx: float = 1e-4, keep: int = 50, forget_ms: int | None = None) -> DataFrame:
    """Per bar: trend strength, volatility, label and the likeliest run length, from state that does not grow with the stream.

    A symbol's bars must arrive in order; within one trigger they are sorted. The state is a window of log prices and
    at most ``keep`` change-point hypotheses. Bars without a positive close are left out. With ``forget_ms`` a symbol
    without bars for that long (by the clock) loses its state and starts anew; without it states stay.
    """
    cfg = cfg or Config()
    w = max(cfg.trend_window, cfg.volatility_window)
    prior = (0.0, 1.0)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            seen, prices, *arrays = state.get
            prices, runs = list(prices), tuple(np.array(a, float) for a in arrays)
        else:
            seen, prices, runs = 0, [], dsm_start(prior)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, close in zip(rows["ts"], rows["close"], strict=True):
            if not (close is not None and close > 0):
                continue
            seen += 1
            prices = [*prices, math.log(close)][-(w + 1) :]
            returns = np.diff(prices)
            strength = vol = run = math.nan
            if len(returns):
                run, _, runs = dsm_step(float(returns[-1]), runs, 1 / cfg.bocpd_run_length, varx, cfg.dsm_omega, cfg.dsm_bandwidth, prior, keep)
            vr, tp = returns[-cfg.volatility_window :], np.array(prices[-cfg.trend_window :])
            if len(vr) >= max(2, cfg.volatility_window // 2):
                vol = float(np.std(vr, ddof=1))
            tr = returns[-cfg.trend_window :]
            if len(tp) >= max(2, cfg.trend_window // 2) and len(tr) >= max(2, cfg.trend_window // 2):
                t = np.arange(len(tp)) - (len(tp) - 1) / 2
                strength = float(t @ tp / (t @ t) / max(np.std(tr, ddof=1), 1e-8))
            label = "Unknown" if math.isnan(strength) else "Up" if strength > cfg.trend_up else "Down" if strength < cfg.trend_down else "Sideways"
            out.append((key[0], ts, close, *(None if math.isnan(v) else v for v in (strength, vol)), label, None if math.isnan(run) else run))
        state.update((seen, prices, *(a.tolist() for a in runs)))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "trend_strength", "volatility", "trend_regime", "run_length"])

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
