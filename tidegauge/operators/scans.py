"""Recurrences and frames of symbols too long for one task, over blocks of their bars.

``blocked`` deals the bars into ranges of (symbol, ts) of about equal size, whatever a symbol's share of the rows. A
recurrence then takes three steps: every block is folded to a few numbers, those are scanned per symbol (one row a
block), and every block is replayed from the state before it. Frames of a fixed number of rows look at the rows that
a block borrows from the one before it. Results equal those of ``folds``, which keeps a symbol in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidegauge.config import Config
from tidegauge.functions import recurrences as R
from tidegauge.functions.durable import written
from tidegauge.functions.frames import half, ratio
from tidegauge.functions.kernels import fit_markov, halflife_alpha
from tidegauge.operators.features import trend_strength

#: Bars of a block by default.
BLOCK_BARS = 65_536
KEYS = ["symbol", "_block"]


def blocked(df: DataFrame, bars: int = BLOCK_BARS, least: int = 1) -> DataFrame:
    """The table with _block and rn, written once; blocks of a symbol ascend in time and hold ``bars`` rows or fewer,
    give or take what sampling of the ranges misses. There are ``least`` ranges or more. ``(symbol, ts)`` must be unique."""
    parts = max(least, -(-df.count() // bars))
    ranged = df.drop("rn", "_block").repartitionByRange(parts, "symbol", "ts").sortWithinPartitions("symbol", "ts")
    blocks = written(ranged.withColumn("_block", F.spark_partition_id()), "blocks")
    inside = F.row_number().over(W.partitionBy(*KEYS).orderBy("ts"))
    return blocks.join(_earlier(blocks.groupBy(*KEYS).agg(F.count("*").alias("_n")), "_n"), KEYS).withColumn("rn", F.coalesce("_before", F.lit(0)) + inside).drop("_before")


def _earlier(stats: DataFrame, counted: str) -> DataFrame:
    """(symbol, _block, _before): the sum over a symbol's earlier blocks."""
    return stats.select(*KEYS, F.sum(counted).over(W.partitionBy("symbol").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))


def lagged(blocks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds each column of the row before, by name (source -> result); a block's first row looks at the block before."""
    last = blocks.groupBy(*KEYS).agg(*[F.max_by(F.col(c), "ts").alias(f"_last_{c}") for c in columns])
    carried = last.select(*KEYS, *[F.lag(f"_last_{c}").over(W.partitionBy("symbol").orderBy("_block")).alias(f"_carried_{c}") for c in columns])
    inside = W.partitionBy(*KEYS).orderBy("ts")
    joined = blocks.join(carried, KEYS)
    first = F.row_number().over(inside) == 1
    return joined.withColumns({out: F.when(first, F.col(f"_carried_{c}")).otherwise(F.lag(c).over(inside)) for c, out in columns.items()}).drop(*[f"_carried_{c}" for c in columns])


def framed(blocks: DataFrame, rows: int, make: Callable[[W], dict[str, Column]]) -> DataFrame:
    """Adds ``make(frame)`` for the frame of a row and the rows - 1 before it.

    The last rows of every block are lent to the symbol's next one. Blocks between others must hold rows - 1 or more.
    """
    inside = W.partitionBy(*KEYS)
    following = blocks.select(*KEYS).distinct().withColumn("_to", F.lead("_block").over(W.partitionBy("symbol").orderBy("_block"))).where("_to is not null")
    lent = blocks.withColumn("_back", F.row_number().over(inside.orderBy(F.desc("ts")))).where(F.col("_back") < rows).drop("_back").join(following, KEYS)
    lent = lent.withColumn("_block", F.col("_to")).drop("_to").withColumn("_lent", F.lit(True))
    both = blocks.withColumn("_lent", F.lit(False)).unionByName(lent)
    return both.withColumns(make(inside.orderBy("ts").rowsBetween(-(rows - 1), 0))).where("not _lent").drop("_lent")


def scan(blocks: DataFrame, needs: str, out: str, recurrence: Callable[[dict], object], width: int, given: DataFrame | None = None) -> DataFrame:
    """Adds ``out``, the recurrence over the column ``needs`` of each symbol in time order.

    ``recurrence`` makes one from a symbol's row of ``given`` (or from an empty dict); its states hold ``width`` numbers.
    A symbol without a row of ``given`` has nulls.
    """
    # keys of the side tables have names of their own, as both sides of a cogroup come from the same blocks
    side_keys = ["_symbol", "_at"]
    plan = blocks.select(F.col("symbol").alias("_symbol"), F.col("_block").alias("_at")).distinct()
    if given is not None:
        plan = plan.join(given.withColumnRenamed("symbol", "_symbol"), "_symbol")
    names = [c for c in plan.columns if c not in side_keys]
    schema = T.StructType([*blocks.schema.fields, T.StructField(out, T.DoubleType())])

    def known(side: pa.Table) -> dict:
        return side.select(names).slice(0, 1).to_pylist()[0]

    def ordered(rows: pa.Table) -> pa.Table:
        return rows.take(pc.sort_indices(rows, sort_keys=[("ts", "ascending")]))

    def values(rows: pa.Table) -> np.ndarray:
        return rows.column(needs).to_numpy().astype(float)

    def fold(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows or not side.num_rows:
            return pa.table({"_symbol": pa.array([], pa.string()), "_at": pa.array([], pa.int32()), "summary": pa.array([], pa.list_(pa.float64()))})
        found = recurrence(known(side)).summary(values(ordered(rows)))
        return pa.table({"_symbol": rows.column("symbol").slice(0, 1), "_at": rows.column("_block").slice(0, 1), "summary": pa.array([found.tolist()], pa.list_(pa.float64()))})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        made = recurrence(rows[names].iloc[0].to_dict())
        return rows.assign(state=[s.tolist() for s in R.starts(made, [np.asarray(s) for s in rows["summary"]], width)]).drop(columns="summary")

    def replay(rows: pa.Table, side: pa.Table) -> pa.Table:
        rows = ordered(rows)
        found = np.full(rows.num_rows, np.nan)
        if side.num_rows and rows.num_rows:
            state = np.array(side.column("state")[0].as_py(), float)
            found = recurrence(known(side)).run(None if np.isnan(state).any() else state, values(rows))[0]
        return rows.append_column(out, pa.array(found, pa.float64(), from_pandas=True))

    narrow = blocks.select(*KEYS, "ts", needs)
    summaries = narrow.groupBy(*KEYS).cogroup(plan.groupBy(*side_keys)).applyInArrow(fold, "_symbol string, _at int, summary array<double>")
    before = T.StructType([*plan.schema.fields, T.StructField("state", T.ArrayType(T.DoubleType()))])
    # written, so that one recurrence over the result of another does not compute that twice more
    states = written(plan.join(summaries, side_keys).groupBy("_symbol").applyInPandas(chain, before), "states")
    return blocks.groupBy(*KEYS).cogroup(states.groupBy(*side_keys)).applyInArrow(replay, schema)


def with_returns(blocks: DataFrame) -> DataFrame:
    """log_price and log_return of the close."""
    blocks = blocks.withColumn("log_price", F.when(F.col("close") > 0, F.log("close")))
    return lagged(blocks, {"log_price": "_earlier"}).withColumn("log_return", F.col("log_price") - F.col("_earlier")).drop("_earlier")


def average_true_range(blocks: DataFrame, cfg: Config) -> DataFrame:
    """atr and atr_pct."""
    blocks = lagged(blocks, {"close": "_before"})
    widest = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))
    found = scan(blocks.withColumn("_tr", widest).drop("_before"), "_tr", "atr", lambda _: R.Mean(1 / cfg.atr_window), 1)
    return found.withColumn("atr_pct", ratio(F.col("atr"), F.col("close"))).drop("_tr")


def ewm_volatility(blocks: DataFrame, cfg: Config) -> DataFrame:
    """volatility of log_return by exponential weights of the given span."""
    alpha, least = 2 / (cfg.volatility_window + 1), half(cfg.volatility_window)
    return scan(blocks, "log_return", "volatility", lambda _: R.Deviation(alpha, True, least), 5)


def ewma_trend(blocks: DataFrame, cfg: Config, out: str = "trend_strength_ewma") -> DataFrame:
    """Slope of log_price per unit of exponentially weighted volatility."""
    alpha, w = halflife_alpha(cfg.ewma_halflife), cfg.trend_window
    blocks = scan(blocks, "log_return", "_ewm", lambda _: R.Deviation(alpha, False), 5)

    def slope(frame) -> dict[str, Column]:
        return {"_slope": F.when(F.count("log_price").over(frame) >= half(w), F.regr_slope(F.col("log_price"), F.col("rn").cast("double")).over(frame))}

    return framed(blocks, w, slope).withColumn(out, trend_strength(F.col("_slope"), F.col("_ewm"))).drop("_ewm", "_slope")


def markov_parameters(blocks: DataFrame, fit_bars: int = BLOCK_BARS) -> DataFrame:
    """(symbol, means, variances, transition, start): a two-state model of each symbol's last ``fit_bars`` log returns,
    the calmer state first. Symbols with fewer than 50 have none."""
    last = blocks.groupBy("symbol").agg(F.max("rn").alias("_most"))
    recent = blocks.select("symbol", "ts", "rn", "log_return").join(last, "symbol").where(F.col("rn") > F.col("_most") - fit_bars)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("rn")["log_return"].to_numpy(float)
        try:
            found = fit_markov(x[np.isfinite(x)][:, None])
        except ValueError:
            return pd.DataFrame(columns=["symbol", "means", "variances", "transition", "start"])
        share = np.linalg.matrix_power(found.transition, 1 << 20)[0]
        row = [rows["symbol"].iloc[0], found.means[:, 0].tolist(), found.covariances[:, 0, 0].tolist(), found.transition.ravel().tolist(), share.tolist()]
        return pd.DataFrame([row], columns=["symbol", "means", "variances", "transition", "start"])

    kind = "symbol string, means array<double>, variances array<double>, transition array<double>, start array<double>"
    return recent.drop("_most").groupBy("symbol").applyInPandas(fit, kind)


def markov_filter(blocks: DataFrame, parameters: DataFrame) -> DataFrame:
    """markov_prob_high: the probability of the wilder state given the log returns so far, under (means, variances,
    transition row by row, start) of each symbol. The chain's start is where the symbol's returns begin."""
    return scan(blocks, "log_return", "markov_prob_high", lambda g: R.Forward(g["means"], g["variances"], g["transition"], g["start"]), 2, parameters)
