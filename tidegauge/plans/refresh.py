"""Append-only refresh: new bars extend a labelled table without reading its history again.

Beside the labels lies a versioned table of states, one row per symbol: the last bars that any frame still looks at, how
many bars there were, and the recurrences where they were left. A batch of new bars reads those states, computes its own
rows over the kept bars and itself, appends them, and writes the states of the next version. Frames see the same rows in
the same order and recurrences take the same steps as in a run over everything, so the results are equal bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidegauge.config import Config
from tidegauge.functions import recurrences as R
from tidegauge.functions.frames import half
from tidegauge.operators.features import true_range
from tidegauge.plans.analysis import labelled
from tidegauge.schema import BARS

_BAR = "struct<ts:timestamp,open:double,high:double,low:double,close:double,volume:double,rn:int>"
STATE = f"symbol string, last_ts timestamp, kept array<{_BAR}>, atr array<double>, spread array<double>"


def _recurrences(cfg: Config) -> dict[str, tuple[str, object, str]]:
    """Name of the state -> (input column, recurrence, output column)."""
    return {"atr": ("_tr", R.Mean(1 / cfg.atr_window), "atr"), "spread": ("log_return", R.Deviation(2 / (cfg.volatility_window + 1), True, half(cfg.volatility_window)), "ewm_volatility")}


def kept_bars(cfg: Config) -> int:
    """How many of the last bars the labels of the next one look at: nested frames add up, and a lag looks one further."""
    return max(cfg.trend_window, max(cfg.percentile_lookback, cfg.baseline_window, 20) + cfg.volatility_window) + cfg.volatility_window + 2


class Refresher:
    """A labelled table under ``path``, and the states to go on from."""

    def __init__(self, spark: SparkSession, path: str, cfg: Config | None = None):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg or Config()
        if self.cfg.volatility_method == "ewm":
            raise ValueError("the volatility of the labels must be a frame's; the weighted one is a column of its own here")

    def _versions(self) -> list[int]:
        """Versions whose states are whole; a version is written last of all, so its labels are whole too."""
        jvm = self.spark.sparkContext._jvm
        home = jvm.org.apache.hadoop.fs.Path(f"{self.path}/states")
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def labels(self) -> DataFrame:
        """The labels of all whole versions."""
        versions = self._versions()
        if not versions:
            raise ValueError(f"no labels under {self.path} yet")
        return self.spark.read.option("basePath", f"{self.path}/labels").parquet(*[f"{self.path}/labels/version={v}" for v in versions]).drop("version")

    def apply(self, bars: DataFrame, version: int | None = None) -> int:
        """Labels a batch of bars as ``version`` (default: the next one) and gives its number.

        Bars must be unique by symbol and time. Those not after their symbol's last bar are late and left out: what
        followed them is already labelled. A version that is whole is not written again, so a repeated batch changes
        nothing; one that was interrupted is overwritten.
        """
        have = self._versions()
        version = (have[-1] + 1 if have else 0) if version is None else version
        if version in have:
            return version
        if have and version < have[-1]:
            raise ValueError(f"version {version} lies before version {have[-1]}")
        before = self.spark.read.schema(STATE).parquet(f"{self.path}/states/version={have[-1]}") if have else self.spark.createDataFrame([], STATE)
        names = [f.name for f in BARS.fields]
        fresh = bars.select(*names).where("symbol is not null and ts is not null")
        fresh = fresh.join(before.select("symbol", "last_ts"), "symbol", "left").where("last_ts is null or ts > last_ts").drop("last_ts")
        old = before.select("symbol", F.explode("kept").alias("_b")).select("symbol", "_b.*").withColumn("_new", F.lit(False))
        both = old.unionByName(fresh.withColumns({"rn": F.lit(None).cast("int"), "_new": F.lit(True)}))
        in_order = W.partitionBy("symbol").orderBy("ts")
        first = F.coalesce(F.first("rn").over(in_order.rowsBetween(W.unboundedPreceding, 0)), F.lit(1))
        both = both.withColumn("rn", (first + F.row_number().over(in_order) - 1).cast("int"))
        rows = labelled(both, self.cfg).withColumn("_tr", true_range()).where("_new").drop("_new")
        made = {out: "double" for _, _, out in _recurrences(self.cfg).values()}
        schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in made]])
        states = before.select(F.col("symbol").alias("_symbol"), "atr", "spread")
        out = rows.groupBy("symbol").cogroup(states.groupBy("_symbol")).applyInArrow(self._going_on(list(schema.names), True), schema).drop("_tr")
        out.write.mode("overwrite").parquet(f"{self.path}/labels/version={version}")
        ends = rows.select("symbol", "ts", "_tr", "log_return").groupBy("symbol").cogroup(states.groupBy("_symbol")).applyInArrow(self._going_on([], False), "symbol string, atr array<double>, spread array<double>")
        bar = F.struct(*[F.col(c).alias(c) for c in ("ts", "open", "high", "low", "close", "volume", "rn")])
        last = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts"))) <= kept_bars(self.cfg)
        kept = both.withColumn("_last", last).where("_last").groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.sort_array(F.collect_list(bar)).alias("kept"))
        gone_on = kept.join(ends.withColumnsRenamed({"atr": "_atr", "spread": "_spread"}), "symbol", "left").join(before.select("symbol", "atr", "spread"), "symbol", "left")
        gone_on = gone_on.select("symbol", "last_ts", "kept", F.coalesce("_atr", "atr").alias("atr"), F.coalesce("_spread", "spread").alias("spread"))
        gone_on.write.mode("overwrite").parquet(f"{self.path}/states/version={version}")
        return version

    def _going_on(self, names: list[str], rows_out: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """A cogroup function that takes a symbol's new rows on from its state: to its rows, or to its next state."""
        folds = _recurrences(self.cfg)

        def go(rows: pa.Table, side: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("ts", "ascending")]))
            state, found = {}, {}
            for name, (needs, recurrence, out) in folds.items():
                known = side.column(name)[0].as_py() if side.num_rows else None
                found[out], state[name] = recurrence.run(None if known is None else np.array(known), rows.column(needs).to_numpy().astype(float))
            if rows_out:
                for out, values in found.items():
                    rows = rows.append_column(out, pa.array(values, pa.float64(), from_pandas=True))
                return rows.select(names)
            kind = pa.list_(pa.float64())
            ends = {n: pa.array([None if s is None else s.tolist()], kind) for n, s in state.items()}
            none = {n: pa.array([], kind) for n in state}
            return pa.table({"symbol": rows.column("symbol").slice(0, 1), **ends} if rows.num_rows else {"symbol": pa.array([], pa.string()), **none})

        return go

    def batch(self, bars: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch`` of a stream of bars: the batch's number is the version, so a replayed batch changes nothing."""
        self.apply(bars, batch_id)


def full(bars: DataFrame, cfg: Config | None = None) -> DataFrame:
    """What ``Refresher`` adds up to, from all bars at once."""
    cfg = cfg or Config()
    df = labelled(bars, cfg).withColumn("_tr", true_range())
    made = {out: (needs, recurrence) for needs, recurrence, out in _recurrences(cfg).values()}

    def fold(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        return {out: recurrence.run(None, rows[needs].to_numpy(float))[0] for out, (needs, recurrence) in made.items()}

    from tidegauge.functions.grouped import doubles

    return doubles(df, list(made), fold, ["_tr", "log_return"]).drop("_tr")
