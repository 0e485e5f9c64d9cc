"""The recurrences of a symbol as a stateful processor in event time: each bar once, in order, whatever order it came in.

Bars wait in a list state until the watermark has passed them, which an event-time timer tells; then they go, by time,
through one step of each recurrence, whose state is one value. So the rows that come out are those of a batch over the
same bars. A bar is late, and left out, if the watermark had passed its time before it arrived, or if its symbol
already has a bar of that time; of bars waiting for the same time the first one stays. A symbol without bars for
``forget`` loses its state by a timer of its own, and begins anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.config import Config
from tidegauge.functions.recurrences import Deviation, Mean

BAR = "ts timestamp, high double, low double, close double, raw_overlay boolean, consensus_anchor double"
OUTPUT = "symbol string, ts timestamp, rn long, close double, atr double, volatility double, overlay_active boolean, overlay_stop boolean, overlay_expired boolean, consensus_event boolean"
#: bars seen and the last one's time and close; means; the open trade's entry (NaN: an entry without price) and age, 0
#: without one; the last accepted anchor and those whose bars are yet to come.
STATE = "rn long, last_us long, close double, log_price double, mean array<double>, spread array<double>, entry double, age long, kept long, coming array<long>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _us(ts: pd.Timestamp) -> int:
    return ts.value // 1000


class Steps:
    """One step of every recurrence, on plain values."""

    def __init__(self, cfg: Config, max_holding: int | None, stop_loss: float | None):
        self.mean, self.spread = Mean(1 / cfg.atr_window), Deviation(2 / (cfg.volatility_window + 1), True, max(2, cfg.volatility_window // 2))
        self.cooldown, self.max_holding, self.stop_loss = cfg.consensus_cooldown, max_holding, stop_loss

    @staticmethod
    def start() -> dict:
        return {"rn": 0, "last_us": None, "close": None, "log_price": None, "mean": None, "spread": None, "entry": None, "age": 0, "kept": None, "coming": []}

    def guard(self, s: dict, signal: bool, close: float) -> tuple[bool, bool, bool]:
        """A trade opens with a signal on a free bar, and closes without one, by its age, or at the stop."""
        held = s["age"] > 0
        stopped = held and self.stop_loss is not None and s["entry"] not in (None, 0.0) and not math.isnan(s["entry"]) and not math.isnan(close) and close / s["entry"] - 1 <= self.stop_loss
        expired = held and self.max_holding is not None and s["age"] >= self.max_holding
        # where the signal is gone, a stop or an age reached on that very bar is still told
        active = signal and not stopped and not expired
        s["entry"], s["age"] = (s["entry"] if held else close, s["age"] + 1) if active else (None, 0)
        return active, stopped, expired

    def cool(self, s: dict, anchor: float | None) -> bool:
        """Whether this bar is an accepted anchor; anchors may name a bar to come."""
        if anchor is not None and not math.isnan(anchor) and (s["kept"] is None or anchor - s["kept"] >= self.cooldown):
            s["kept"] = int(anchor)
            s["coming"] = [*s["coming"], int(anchor)]
        here = s["rn"] in s["coming"]
        s["coming"] = [a for a in s["coming"] if a > s["rn"]]
        return here

    def step(self, s: dict, bar: tuple) -> tuple:
        """(rn, close, atr, volatility, active, stopped, expired, event) of the next bar; ``s`` moves on."""
        ts, high, low, close, signal, anchor = bar
        high, low, close = (math.nan if v is None else float(v) for v in (high, low, close))
        parts = [high - low] + ([abs(high - s["close"]), abs(low - s["close"])] if s["close"] is not None else [])
        parts = [p for p in parts if not math.isnan(p)]
        price = math.log(close) if close > 0 else math.nan
        change = math.nan if s["log_price"] is None else price - s["log_price"]
        atr, s["mean"] = self.mean.run(s["mean"], np.array([max(parts, default=math.nan)]))
        vol, s["spread"] = self.spread.run(s["spread"], np.array([change]))
        s["rn"] += 1
        s["last_us"], s["close"], s["log_price"] = _us(ts), close, price
        guarded = self.guard(s, bool(signal), close)
        return (s["rn"], None if math.isnan(close) else close, *(None if math.isnan(v) else v for v in (atr[0], vol[0])), *guarded, self.cool(s, anchor))


class Live(StatefulProcessor):
    """``Steps`` over the bars of a symbol, in a value state and a list state with event-time timers."""

    def __init__(self, steps: Steps, forget_ms: int | None):
        self.steps, self.forget_ms = steps, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("steps", STATE)
        self.waiting = handle.getListState("waiting", BAR)

    def _load(self) -> dict:
        if not self.state.exists():
            return self.steps.start()
        s = dict(zip(self.steps.start(), self.state.get(), strict=True))
        for c in ("mean", "spread"):
            s[c] = None if s[c] is None else np.array(s[c], float)
        return s | {"coming": list(s["coming"] or [])}

    def _save(self, s: dict) -> None:
        plain = [v.tolist() if isinstance(v, np.ndarray) else v for v in s.values()]
        self.state.update(tuple(plain))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self._load()["last_us"]
        seen, new = {_us(pd.Timestamp(b[0])) for b in self.waiting.get()}, []
        for frame in rows:
            for bar in frame[["ts", "high", "low", "close", "raw_overlay", "consensus_anchor"]].itertuples(index=False, name=None):
                at = _us(bar[0])
                if at not in seen and (last is None or at > last):
                    seen.add(at)
                    new.append(tuple(None if v is None or v != v else v for v in bar))
        if new:
            self.waiting.appendList(new)
            for ms in {-(-_us(pd.Timestamp(b[0])) // 1000) for b in new} - set(self.handle.listTimers()):
                self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        bars = sorted(self.waiting.get(), key=lambda b: b[0])
        due, rest = [b for b in bars if _us(pd.Timestamp(b[0])) <= now], [b for b in bars if _us(pd.Timestamp(b[0])) > now]
        s = self._load()
        if not due:
            if self.forget_ms is not None and not rest and s["last_us"] is not None and now - s["last_us"] >= self.forget_ms * 1000:
                self.state.clear()
            return
        out = []
        for bar in due:
            ts = pd.Timestamp(bar[0])
            out.append((key[0], ts, *self.steps.step(s, (ts, *bar[1:]))))
        self._save(s)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if self.forget_ms is not None:
            self.handle.registerTimer(-(-s["last_us"] // 1000) + self.forget_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def live(bars: DataFrame, cfg: Config | None = None, late: str = "0 seconds", max_holding: int | None = None, stop_loss: float | None = None, forget_ms: int | None = None) -> DataFrame:
    """atr, volatility (exponentially weighted), guarded overlay trades and accepted consensus anchors of a stream of bars.

    ``bars`` has symbol, ts, high, low, close, and may have raw_overlay (null: no signal) and consensus_anchor (the
    number of a bar of the symbol, this one or a later one). ``late`` is how long the watermark waits for bars that come
    out of order. A bar comes out once a later bar has moved the watermark to its time.
    """
    spark = bars.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    optional = {"raw_overlay": "boolean", "consensus_anchor": "double"}
    named = [F.col(c).cast(t).alias(c) if c in bars.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    ready = bars.where("symbol is not null and ts is not null").select("symbol", "ts", "high", "low", "close", *named).withWatermark("ts", late)
    processor = Live(Steps(cfg or Config(), max_holding, stop_loss), forget_ms)
    return ready.groupBy("symbol").transformWithStateInPandas(processor, OUTPUT, "append", "eventTime")
