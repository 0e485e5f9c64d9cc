"""Small fixed tables as column expressions: defaults by asset class, volatility indices by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import Config
from tidegauge.functions.frames import lookup, order
from tidegauge.operators import folds
from tidegauge.schema import HALFLIFE, RUN_LENGTH, VOL_INDEX


def default_halflife(asset_class: Column) -> Column:
    """Half-life in bars; null for an unknown class."""
    return lookup(F.lower(F.trim(asset_class)), HALFLIFE)


def default_run_length(asset_class: Column) -> Column:
    """Expected bars between change points; null for an unknown class."""
    return lookup(F.lower(F.trim(asset_class)), RUN_LENGTH)


def vol_channel(symbol: Column) -> Column:
    """Implied-volatility index of a symbol; null without one."""
    return lookup(F.upper(F.trim(symbol)), VOL_INDEX)


def robustness_weight(x: Column, centre: Column, bandwidth: float) -> Column:
    """Gaussian weight of a value's distance from the centre."""
    return F.exp(-F.pow(x - centre, F.lit(2.0)) / (2 * bandwidth**2))


def resets(run_length: str, drop: float = 30.0) -> Column:
    """Aggregate: how often the run length of a symbol's bars falls by at least ``drop``; needs ``{run_length}_before``."""
    return F.count_if(F.col(f"{run_length}_before") - F.col(run_length) >= drop)


def detector_report(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Per symbol: bars, deviation, largest move in deviations, and resets and last run length of both change-point detectors."""
    cfg = cfg or Config()
    both = folds.bocpd(df, cfg).withColumnRenamed("bocpd_run_length", "std_run").drop("bocpd_change_prob", "bocpd_recent_prob")
    both = folds.dsm_bocpd(both, cfg).withColumnRenamed("bocpd_run_length", "dsm_run").where("log_return is not null")
    both = both.withColumns({f"{c}_before": F.lag(c).over(order()) for c in ("std_run", "dsm_run")})
    r = F.col("log_return")
    return both.groupBy("symbol").agg(
        F.count("*").alias("observations"), F.stddev_samp(r).alias("sigma"), F.try_divide(F.max(F.abs(r)), F.stddev_samp(r)).alias("max_abs_sigma"),
        *[x for c in ("std", "dsm") for x in (resets(f"{c}_run").alias(f"{c}_resets"), F.max_by(f"{c}_run", "ts").alias(f"{c}_last_run"))],
    )
