"""Rolling trend, volatility and tail-risk features as window expressions over (symbol, ts)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidegauge.config import Config
from tidegauge.functions import sliding
from tidegauge.functions.frames import order, past, whole, finite, gated, half, ratio, rolling, sliding_array  # noqa: F401
from tidegauge.functions.grouped import doubles, doubles_together
from tidegauge.schema import UNKNOWN
from tidegauge.sources.bars import with_returns


def numbered(df: DataFrame) -> DataFrame:
    """Adds rn, the 1-based place of a bar in its symbol's history."""
    return df if "rn" in df.columns else df.withColumn("rn", F.row_number().over(order()))


def _ready(df: DataFrame) -> DataFrame:
    return numbered(df if "log_return" in df.columns else with_returns(df))


# --- trend -------------------------------------------------------------------------------------------------------


def ols_slope(value: str, window: int) -> Column:
    """Least-squares slope on the row number over the window, from half a window of values on."""
    frame = rolling(window)
    return gated(F.regr_slope(F.col(value), F.col("rn").cast("double")).over(frame), F.col(value), half(window), frame)


def trend_strength(slope: Column, deviation: Column) -> Column:
    """Slope per unit of volatility; null while either is."""
    return finite(F.when(deviation.isNotNull(), slope / F.greatest(deviation, F.lit(1e-8))))


def trend_label(strength: Column, up: float, down: float) -> Column:
    return F.when(strength.isNull(), UNKNOWN).when(strength > up, "Up").when(strength < down, "Down").otherwise("Sideways")


def trend_features(df: DataFrame, cfg: Config) -> DataFrame:
    """slope, trend_strength, trend_regime, trend_strength_ma, trend_acceleration, trend_consistency."""
    w = cfg.trend_window
    frame = rolling(w)
    df = _ready(df)
    df = df.withColumns({"slope": ols_slope("log_price", w), "_dev": gated(F.stddev_samp("log_return").over(frame), F.col("log_return"), half(w), frame)})
    df = df.withColumn("trend_strength", trend_strength(F.col("slope"), F.col("_dev"))).drop("_dev")
    df = df.withColumn("trend_regime", trend_label(F.col("trend_strength"), cfg.trend_up, cfg.trend_down))
    code = F.when(F.col("trend_regime") != UNKNOWN, F.col("trend_regime"))
    df = df.withColumn("_codes", F.collect_list(code).over(frame))
    same = F.size(F.filter("_codes", lambda x: x == F.element_at("_codes", -1)))
    return df.withColumns(
        {
            "trend_strength_ma": F.avg("trend_strength").over(rolling(5)),
            "trend_acceleration": F.col("slope") - F.lag("slope").over(order()),
            "trend_consistency": F.when(F.size("_codes") > 0, same / F.size("_codes")),
        }
    ).drop("_codes")


def trend_summary(df: DataFrame) -> DataFrame:
    """Per symbol: moments of the trend strength, its last value and the shares of the labels."""
    known = F.col("trend_regime") != UNKNOWN
    share = lambda label: F.coalesce(F.try_divide(F.count_if(F.col("trend_regime") == label), F.count_if(known)), F.lit(0.0)).alias(f"share_{label.lower()}")
    s = F.col("trend_strength")
    return df.groupBy("symbol").agg(
        F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.max_by(s, F.when(s.isNotNull(), F.col("ts"))).alias("current"), *[share(x) for x in ("Up", "Down", "Sideways")]
    )


# --- volatility --------------------------------------------------------------------------------------------------


def realized_variance(window: int) -> Column:
    frame = rolling(window)
    return gated(F.sum(F.col("log_return") * F.col("log_return")).over(frame), F.col("log_return"), half(window), frame)


def parkinson(window: int) -> Column:
    """Range-based volatility from highs and lows."""
    frame = rolling(window)
    span = F.pow(F.log(ratio(F.col("high"), F.col("low"))), 2)
    return gated(F.sqrt(F.avg(span).over(frame) / (4 * F.log(F.lit(2.0)))), span, half(window), frame)


def volatility(cfg: Config, periods: int = 252) -> Column:
    """By standard deviation, realised variance or price range; the ``ewm`` method is a fold (see folds)."""
    w, frame = cfg.volatility_window, rolling(cfg.volatility_window)
    value = {
        "std": gated(F.stddev_samp("log_return").over(frame), F.col("log_return"), half(w), frame),
        "parkinson": parkinson(w),
        "realized": F.sqrt(realized_variance(w)),
    }[cfg.volatility_method]
    return value * periods**0.5 if cfg.annualize else value


def true_range() -> Column:
    """The widest of high-low and the gaps from the close before; missing parts are skipped."""
    before = F.lag("close").over(order())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def volatility_percentile(value: str, lookback: int) -> Column:
    """Share of the window's rows, missing ones included, with a lower value."""
    frame = rolling(lookback)
    least = min(lookback, max(20, lookback // 10))
    lower = F.size(F.filter(F.collect_list(value).over(frame), lambda x: x < F.col(value)))
    return gated(F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(lower / F.count(F.lit(1)).over(frame)), F.col(value), least, frame)


#: Up to so many rows a window's values are compared as a list in the JVM; longer windows are kept sorted in a fold.
LISTED_ROWS = 400


def with_volatility_percentile(df: DataFrame, value: str, lookback: int, out: str = "volatility_percentile") -> DataFrame:
    """Adds ``volatility_percentile``, at about the same cost for any lookback."""
    if lookback <= LISTED_ROWS:
        return df.withColumn(out, volatility_percentile(value, lookback))
    least = min(lookback, max(20, lookback // 10))
    return doubles(df, [out], lambda r: {out: sliding.lower_shares(r[value].to_numpy(float), lookback, least)}, [value])


def _lower_shares(parts: list[np.ndarray], lookback: int) -> np.ndarray:
    least = min(lookback, max(20, lookback // 10))
    if lookback <= LISTED_ROWS:
        return sliding.lower_shares_together(parts, lookback, least)
    return np.concatenate([sliding.lower_shares(x, lookback, least) for x in parts])


def volatility_percentile_alone(df: DataFrame, value: str, lookback: int, out: str = "volatility_percentile") -> DataFrame:
    """``with_volatility_percentile`` as one fold over many symbols at once.

    All columns of ``df`` pass through it, used or not, so it pays where few are left; a frame's list takes each value of
    the window for each row.
    """
    return doubles_together(df, [out], lambda parts: {out: _lower_shares(parts, lookback)}, value, timeless_first=True)


def strength_and_volatility(bars: DataFrame, cfg: Config) -> DataFrame:
    """symbol, ts, trend_strength, volatility (by standard deviation) and its percentile: one fold of the log prices.

    The frames' sums are taken in the frames' order, so that every value is that of ``trend_features`` and ``volatility``.
    """
    w, v, look = cfg.trend_window, cfg.volatility_window, cfg.percentile_lookback

    def fold(prices: list[np.ndarray]) -> dict[str, np.ndarray]:
        returns = [np.diff(x, prepend=np.nan) for x in prices]
        deviation = sliding.deviations_together(returns, w, half(w))
        level = deviation if v == w else sliding.deviations_together(returns, v, half(v))
        level = level * 252**0.5 if cfg.annualize else level
        levels = np.split(level, np.cumsum([len(x) for x in prices])[:-1])
        return {"slope": sliding.slopes_together(prices, w, half(w)), "_dev": deviation, "volatility": level, "volatility_percentile": _lower_shares(levels, look)}

    df = bars.select("symbol", "ts", F.when(F.col("close") > 0, F.log("close")).alias("log_price"))
    df = doubles_together(df, ["slope", "_dev", "volatility", "volatility_percentile"], fold, "log_price", timeless_first=True)
    return df.select("symbol", "ts", trend_strength(F.col("slope"), F.col("_dev")).alias("trend_strength"), "volatility", "volatility_percentile")


def volatility_label(cfg: Config, method: str = "percentile") -> Column:
    """Low, High or Unknown by percentile, by level, or against the baseline."""
    v, p, b = F.col("volatility"), F.col("volatility_percentile"), F.col("volatility_baseline")
    if method == "percentile":
        return F.when(p.isNull(), UNKNOWN).when(p > cfg.volatility_percentile, "High").otherwise("Low")
    high = v > cfg.volatility_percentile if method == "absolute" else v > b * (1 + cfg.volatility_percentile - 0.5)
    return F.when(F.coalesce(high, F.lit(False)), "High").otherwise("Low")


def volatility_features(df: DataFrame, cfg: Config) -> DataFrame:
    """Realised variance and volatility, percentile, baseline, label, vol-of-vol, change and z-score."""
    df = _ready(df)
    look, base = cfg.percentile_lookback, cfg.baseline_window
    df = df.withColumn("realized_variance", realized_variance(cfg.volatility_window))
    if cfg.volatility_method != "ewm":
        df = df.withColumn("volatility", volatility(cfg))
    df = with_volatility_percentile(df, "volatility", look)
    frame, long = rolling(base), rolling(look)
    df = df.withColumns(
        {
            "realized_volatility": F.sqrt("realized_variance"),
            "volatility_baseline": gated(F.avg("volatility").over(frame), F.col("volatility"), min(base, max(20, base // 5)), frame),
            "vol_of_vol": gated(F.stddev_samp("volatility").over(rolling(cfg.volatility_window)), F.col("volatility"), half(cfg.volatility_window), rolling(cfg.volatility_window)),
            "volatility_change": F.try_divide(F.col("volatility"), F.lag("volatility").over(order())) - 1,
            "_mean": gated(F.avg("volatility").over(long), F.col("volatility"), min(look, 20), long),
            "_dev": gated(F.stddev_samp("volatility").over(long), F.col("volatility"), min(look, 20), long),
        }
    )
    return df.withColumns({"volatility_regime": volatility_label(cfg), "volatility_zscore": F.try_divide(F.col("volatility") - F.col("_mean"), F.col("_dev"))}).drop("_mean", "_dev")


def volatility_summary(df: DataFrame) -> DataFrame:
    v, known = F.col("volatility"), F.col("volatility_regime") != UNKNOWN
    return df.groupBy("symbol").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.max_by(v, F.when(v.isNotNull(), F.col("ts"))).alias("current"),
        F.avg("vol_of_vol").alias("mean_vol_of_vol"), F.coalesce(F.try_divide(F.count_if(F.col("volatility_regime") == "High"), F.count_if(known)), F.lit(0.0)).alias("share_high"),
    )


def volatility_clusters(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Runs of bars whose volatility percentile exceeds the threshold."""
    high = F.coalesce(F.col("volatility_percentile") > threshold, F.lit(False))
    df = df.withColumn("_high", high).withColumn("_run", F.sum(F.when(F.col("_high") != F.coalesce(F.lag("_high").over(order()), ~F.col("_high")), 1).otherwise(0)).over(past()))
    return df.where("_high").groupBy("symbol", "_run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("length"), F.avg("volatility").alias("mean_volatility"), F.max("volatility").alias("max_volatility"),
        F.min("volatility").alias("min_volatility"), F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"),
    ).drop("_run")


# --- tail risk ---------------------------------------------------------------------------------------------------


# Of one frame as expressions; ``tail_features`` takes them over sliding windows.


def value_at_risk(window: int, alpha: float) -> Column:
    """Linearly interpolated quantile of the losses in the window."""
    return F.percentile(-F.col("log_return"), F.lit(alpha)).over(rolling(window))


def conditional_value_at_risk(losses: Column, limit: Column) -> Column:
    """Mean of the losses at or beyond the limit."""
    tail = F.filter(losses, lambda x: x >= limit)
    return F.when(F.size(tail) > 0, F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail))


def hill_index(losses: Column, fraction: float, least: int) -> Column:
    """Hill's tail index of the positive losses; null with too few of them or an empty spread."""
    positive = F.sort_array(F.filter(losses, lambda x: x > 0), asc=False)
    n = F.size(positive)
    k = F.least(n, F.greatest(F.lit(least), F.floor(n * F.lit(fraction)).cast("int")))
    top = F.slice(positive, F.lit(1), F.greatest(k, F.lit(1)))
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + F.log(x / F.element_at(top, -1))) / F.size(top)
    return F.when((n >= least) & (mean > 0), 1 / mean)


def window_drawdown(returns: Column) -> Column:
    """Deepest fall of the compounded returns from their running top, inside the window."""
    start = F.struct(F.lit(1.0).alias("e"), F.lit(0.0).alias("p"), F.lit(0.0).alias("d"))

    def step(s: Column, x: Column) -> Column:
        e = s["e"] * (1 + F.coalesce(x, F.lit(0.0)))
        p = F.greatest(s["p"], e)
        return F.struct(e.alias("e"), p.alias("p"), F.least(s["d"], e / p - 1).alias("d"))

    return F.aggregate(returns, start, step, lambda s: s["d"])


def excess_kurtosis(value: str, window: int, least: int) -> Column:
    """Bias-corrected excess kurtosis over the window, from four values on."""
    frame = rolling(window)
    n = F.count(value).over(frame).cast("double")
    g = F.kurtosis(value).over(frame)
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(n >= max(least, 4), corrected)


def survival_label(cfg: Config) -> Column:
    cvar, tail, fall = F.col("loss_cvar"), F.col("tail_index"), F.col("rolling_max_drawdown")
    no = lambda c: F.coalesce(c, F.lit(False))
    fragile = no(cvar >= cfg.fragile_cvar) | no(tail <= cfg.fragile_tail) | no(fall <= cfg.fragile_drawdown)
    stressed = no(cvar >= cfg.stressed_cvar) | no(tail <= cfg.stressed_tail) | no(fall <= cfg.stressed_drawdown)
    return F.when(cvar.isNull() & tail.isNull() & fall.isNull(), UNKNOWN).when(fragile, "Fragile").when(stressed, "Stressed").otherwise("Resilient")


def survival_score(cfg: Config) -> Column:
    """Mean of the known components, each the distance to its fragile level, clipped to [0, 1]."""
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    parts = [clip(F.col("loss_cvar") / cfg.fragile_cvar), clip(F.try_divide(F.lit(cfg.fragile_tail), F.col("tail_index"))), clip(F.col("rolling_max_drawdown") / cfg.fragile_drawdown)]
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), known)


def tail_features(df: DataFrame, cfg: Config) -> DataFrame:
    """loss_var, loss_cvar, tail_index, excess_kurtosis, rolling_max_drawdown, drawdown, survival_regime, survival_score.

    The order statistics and the drawdown of the window are one fold, which costs about the same for any window.
    """
    df = _ready(df)
    w = cfg.tail_window
    least = min(w, max(20, w // 2))

    def fold(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows["log_return"].to_numpy(float)
        var, cvar, hill = sliding.tail_statistics(x, w, least, cfg.var_alpha, cfg.cvar_alpha, cfg.hill_fraction, cfg.hill_min)
        fall = sliding.drawdowns(x, w)
        fall[: min(w, max(5, w // 2)) - 1] = np.nan
        return {"loss_var": var, "loss_cvar": cvar, "tail_index": hill, "rolling_max_drawdown": fall}

    df = doubles(df, ["loss_var", "loss_cvar", "tail_index", "rolling_max_drawdown"], fold, ["log_return"])
    df = df.withColumns({"excess_kurtosis": excess_kurtosis("log_return", w, least), "drawdown": F.try_divide(F.col("close"), F.max("close").over(past())) - 1})
    return df.withColumns({"survival_regime": survival_label(cfg), "survival_score": survival_score(cfg)})


# --- fractal filter ----------------------------------------------------------------------------------------------


def hurst_label(hurst: Column, low: float = 0.45, high: float = 0.55) -> Column:
    return F.when(hurst.isNull(), UNKNOWN).when(hurst > high, "Trending").when(hurst < low, "Mean-Reverting").otherwise("Random")


def lo_label(statistic: Column, bands: tuple[float, float]) -> Column:
    return F.when(statistic.isNull(), UNKNOWN).when(statistic > bands[1], "Long-Memory").when(statistic < bands[0], "Anti-Persistent").otherwise("Short-Memory")


def confirmed_label(hurst: Column, memory: Column) -> Column:
    """A trend needs long memory and mean reversion needs anti-persistence; otherwise the memory is short."""
    return (
        F.when((hurst == UNKNOWN) | (memory == UNKNOWN), UNKNOWN)
        .when(hurst == "Random", "Random")
        .when((hurst == "Trending") & (memory == "Long-Memory"), "Trending")
        .when((hurst == "Mean-Reverting") & (memory == "Anti-Persistent"), "Mean-Reverting")
        .otherwise("Short-Memory")
    )


def fractal_mask(hurst: Column, threshold: float, smooth: int = 5) -> Column:
    """1 where the exponent exceeds the threshold, smoothed by the majority of the last rows."""
    raw = F.when(F.coalesce(hurst > threshold, F.lit(False)), 1.0).otherwise(0.0)
    return raw if smooth <= 1 else F.when(F.avg(raw).over(rolling(smooth)) >= 0.5, 1.0).otherwise(0.0)


def fractal_price(mask: Column, hurst: Column, method: str = "accumulate") -> Column:
    """The first positive price carried on by the returns of masked bars (or weighted ones), or prices held while unmasked."""
    first = F.first(F.when(F.col("close") > 0, F.col("close")), True).over(order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    move = F.coalesce("log_return", F.lit(0.0))
    if method == "hold":
        return F.last(F.when((mask == 1) | (F.col("rn") == 1), F.col("close")), True).over(past())
    weight = mask if method == "accumulate" else F.least(F.greatest(F.coalesce(hurst, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return first * F.exp(F.sum(weight * move).over(past()))


def fractal_features(df: DataFrame, cfg: Config) -> DataFrame:
    """Mask, filtered price and returns, filtered strength and volatility, and efficiency, from a hurst column."""
    df = _ready(df).withColumn("fractal_mask", fractal_mask(F.col("hurst"), cfg.hurst_threshold))
    df = df.withColumn("fractal_price", fractal_price(F.col("fractal_mask"), F.col("hurst"), cfg.fractal_method)).withColumn("fractal_returns", F.col("fractal_mask") * F.col("log_return"))
    extra = {"cumulative_fractal_returns": F.sum("fractal_returns").over(past())}
    if "trend_strength" in df.columns:
        extra["fractal_trend_strength"] = F.col("trend_strength") * F.col("fractal_mask")
    if "volatility" in df.columns:
        extra["fractal_volatility"] = F.nullif(F.col("volatility") * F.col("fractal_mask"), F.lit(0.0))
    extra["fractal_efficiency"] = F.coalesce(F.try_divide(F.sum("fractal_returns").over(whole()), F.sum("log_return").over(whole())), F.lit(0.0))
    return df.withColumns(extra)


def fractal_segments(df: DataFrame, threshold: float = 0.55, least: int = 5) -> DataFrame:
    """Runs of at least ``least`` bars with an exponent above the threshold."""
    on = F.coalesce(F.col("hurst") > threshold, F.lit(False))
    df = _ready(df).withColumn("_on", on).withColumn("_run", F.sum(F.when(F.col("_on") != F.coalesce(F.lag("_on").over(order()), ~F.col("_on")), 1).otherwise(0)).over(past()))
    made = df.where("_on").groupBy("symbol", "_run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("length"), F.avg("hurst").alias("avg_hurst"), F.min("hurst").alias("min_hurst"), F.max("hurst").alias("max_hurst"),
        (F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("price_change"),
    )
    return made.where(F.col("length") >= least).drop("_run")


def fractal_summary(df: DataFrame) -> DataFrame:
    r = F.nullif("fractal_returns", F.lit(0.0))
    return df.groupBy("symbol").agg(
        F.avg("fractal_mask").alias("coverage"), F.sum("fractal_returns").alias("fractal_return"), F.sum("log_return").alias("total_return"),
        F.try_divide(F.avg(r), F.stddev_samp(r)).alias("sharpe"),
    )
