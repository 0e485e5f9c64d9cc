"""Per-symbol recurrences: each takes a symbol's bars in time order as one Arrow group and adds columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import Config
from tidegauge.functions import kernels as K
from tidegauge.functions.frames import order, half, ratio
from tidegauge.functions.grouped import doubles, doubles_together, per_symbol
from tidegauge.operators.analytics import with_segments
from tidegauge.operators.features import numbered, ols_slope, trend_strength, true_range
from tidegauge.operators.regimes import consensus_anchors
from tidegauge.schema import HALFLIFE_GRID, UNKNOWN


def average_true_range(df: DataFrame, cfg: Config) -> DataFrame:
    """atr (Wilder's mean of the true range) and atr_pct."""
    df = df.withColumn("_tr", true_range())
    out = doubles(df, ["atr"], lambda r: {"atr": K.ema(r["_tr"].to_numpy(), 1 / cfg.atr_window)}, ["_tr"])
    return out.withColumn("atr_pct", ratio(F.col("atr"), F.col("close"))).drop("_tr")


def ewm_volatility(df: DataFrame, cfg: Config) -> DataFrame:
    """volatility by exponential weights of the given span."""
    alpha = 2 / (cfg.volatility_window + 1)
    return doubles(df, ["volatility"], lambda r: {"volatility": K.ewm_std(r["log_return"].to_numpy(), alpha, True, half(cfg.volatility_window))}, ["log_return"])


def ewma_trend(df: DataFrame, cfg: Config, out: str = "trend_strength_ewma") -> DataFrame:
    """Slope per unit of exponentially weighted volatility."""
    alpha = K.halflife_alpha(cfg.ewma_halflife)
    df = numbered(df)
    df = doubles(df, ["_ewm"], lambda r: {"_ewm": K.ewm_std(r["log_return"].to_numpy(), alpha, False)}, ["log_return"])
    return df.withColumn(out, trend_strength(ols_slope("log_price", cfg.trend_window), F.col("_ewm"))).drop("_ewm")


def halflife_grid(df: DataFrame, grid: tuple[float, ...] = HALFLIFE_GRID, warmup: int = 30) -> DataFrame:
    """(symbol, halflife, mse, best): the first of the lowest errors is best; symbols with too few bars are absent."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        scores = K.halflife_scores(rows.sort_values("ts", kind="stable")["log_return"].to_numpy(), grid, warmup)
        low = min(scores, key=scores.get) if scores else None
        return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]] * len(scores), "halflife": list(scores), "mse": list(scores.values()), "best": [h == low for h in scores]})

    return df.select("symbol", "ts", "log_return").groupBy("symbol").applyInPandas(run, "symbol string, halflife double, mse double, best boolean")


def hurst(df: DataFrame, cfg: Config) -> DataFrame:
    """hurst, by structure function or R/S of prices or by detrended fluctuation of their log changes."""
    w = cfg.hurst_window
    dfa = lambda x: K.dfa_exponent(np.diff(np.log(x[np.isfinite(x) & (x > 0)])))
    statistic = {"structure": K.structure_exponent, "rs": K.rescaled_range_exponent, "dfa": dfa}[cfg.hurst_method]

    def fold(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows["close"].to_numpy(float)
        if cfg.hurst_step == 1 and cfg.hurst_method == "structure":
            return {"hurst": K.rolling_structure(x, w, max(20, w // 2))}
        return {"hurst": K.stepped(x, w, cfg.hurst_step, statistic) if cfg.hurst_step > 1 else K.rolling(x, w, max(20, w // 2), statistic)}

    return doubles(df, ["hurst"], fold, ["close"])


def segment_hurst(df: DataFrame, method: str = "rs", least: int = 20, regime: str = "regime", gap: str = "close") -> DataFrame:
    """(symbol, seg, regime, length, hurst) per segment: R/S of its closes or detrended fluctuation of their log changes.

    Segments of fewer than ``least`` bars have no exponent.
    """
    if method not in ("rs", "dfa"):
        raise ValueError(f"method is {method!r}, but segments are judged by 'rs' or 'dfa'")

    def exponent(x: np.ndarray) -> float | None:
        if len(x) < least:
            return None
        found = K.rescaled_range_exponent(x) if method == "rs" else K.dfa_exponent(np.diff(np.log(x[np.isfinite(x) & (x > 0)])))
        return found if np.isfinite(found) else None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(rows["symbol"].iloc[0], seg, g["label"].iloc[0], len(g), exponent(g["close"].to_numpy(float))) for seg, g in rows.sort_values("ts", kind="stable").groupby("seg")]
        return pd.DataFrame(found, columns=["symbol", "seg", "regime", "length", "hurst"])

    marked = with_segments(df, regime, gap).where("seg is not null").select("symbol", "ts", "seg", F.col(regime).alias("label"), "close")
    return marked.groupBy("symbol").applyInPandas(run, "symbol string, seg long, regime string, length long, hurst double")


def lo_rescaled_range(df: DataFrame, cfg: Config) -> DataFrame:
    """lo_modified_rs of the log returns."""
    w = cfg.hurst_window
    return doubles(df, ["lo_modified_rs"], lambda r: {"lo_modified_rs": K.rolling_lo(r["log_return"].to_numpy(), w, max(20, w // 2), cfg.lo_lags)}, ["log_return"])


def bocpd(df: DataFrame, cfg: Config) -> DataFrame:
    """bocpd_run_length, bocpd_change_prob and bocpd_recent_prob (mass on runs of at most five bars)."""
    names = ["bocpd_run_length", "bocpd_change_prob", "bocpd_recent_prob"]
    return doubles(df, names, lambda r: dict(zip(names, K.bocpd(r["log_return"].to_numpy(), cfg.bocpd_run_length, df_cap=cfg.bocpd_df_cap, least_mass=cfg.bocpd_least_mass), strict=True)), ["log_return"])


def dsm_bocpd(df: DataFrame, cfg: Config) -> DataFrame:
    """bocpd_run_length and bocpd_change_prob by the robust detector.

    Its noise level is given, or the variance of the whole series, or (``causal_varx``) that of the first 50 bars.
    """

    def level(x: np.ndarray) -> float:
        seen = x[np.isfinite(x)][: 50 if cfg.causal_varx else None]
        return cfg.dsm_varx or max(float(np.var(seen, ddof=1)) if len(seen) > 1 else 1e-4, 1e-8)

    def fold(series: list[np.ndarray]) -> dict[str, np.ndarray]:
        found = K.dsm_bocpd_many(series, cfg.bocpd_run_length, [level(x) for x in series], cfg.dsm_omega, cfg.dsm_bandwidth)
        return {name: np.concatenate(column) for name, column in zip(("bocpd_run_length", "bocpd_change_prob"), zip(*found, strict=True), strict=True)}

    return doubles_together(df, ["bocpd_run_length", "bocpd_change_prob"], fold, "log_return")


def markov(df: DataFrame, threshold: float = 0.5, second: str | None = None) -> DataFrame:
    """markov_prob_high (filtered), markov_prob_smooth, markov_state and markov_model; with ``second`` a two-column model.

    A two-column fit that fails falls back to returns alone; a symbol without a fit has nulls and Unknown.
    """

    def fold(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        n = len(rows)
        for names in ([["log_return", second]] if second else []) + [["log_return"]]:
            x = rows[names].to_numpy(float)
            at = np.flatnonzero(np.isfinite(x).all(axis=1))
            try:
                fit = K.fit_markov(x[at])
            except (ValueError, np.linalg.LinAlgError):
                continue
            high, smooth = np.full(n, np.nan), np.full(n, np.nan)
            high[at], smooth[at] = fit.filtered, fit.smoothed
            return {"markov_prob_high": high, "markov_prob_smooth": smooth, "markov_model": np.array(["+".join(names)] * n)}
        return {"markov_prob_high": np.full(n, np.nan), "markov_prob_smooth": np.full(n, np.nan), "markov_model": np.array([None] * n)}

    made = {"markov_prob_high": "double", "markov_prob_smooth": "double", "markov_model": "string"}
    out = per_symbol(df, made, fold, ["log_return", *([second] if second else [])])
    p = F.col("markov_prob_high")
    return out.withColumn("markov_state", F.when(p.isNull(), UNKNOWN).when(p > threshold, "High").otherwise("Low"))


def markov_parameters(df: DataFrame) -> DataFrame:
    """Per symbol: variances, transition probabilities, likelihood and criteria of the fit."""
    schema = "symbol string, variance_low double, variance_high double, stay_low double, stay_high double, loglik double, aic double, bic double, converged boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("ts", kind="stable")[["log_return"]].to_numpy(float)
        try:
            fit = K.fit_markov(x[np.isfinite(x).all(axis=1)])
        except ValueError:
            return pd.DataFrame(columns=names)
        aic, bic = fit.criteria()
        return pd.DataFrame([[rows["symbol"].iloc[0], fit.covariances[0][0, 0], fit.covariances[1][0, 0], fit.transition[0, 0], fit.transition[1, 1], fit.loglik, aic, bic, fit.converged]], columns=names)

    return df.select("symbol", "ts", "log_return").groupBy("symbol").applyInPandas(run, schema)


#: Rows of a volatility table that are broadcast at most: a few thousand instruments over decades.
MOST_VOL_ROWS = 1_000_000


def implied_vol(df: DataFrame, vol: DataFrame, as_of_days: int = 0) -> DataFrame:
    """Adds implied_vol of the bar's date from (symbol, date, implied_vol) or (date, implied_vol).

    A bar without a value on its date takes the latest one of the ``as_of_days`` days before. The table is broadcast
    if its rows are few (they are counted), so that bars stay dealt by symbol; of repeated keys the largest value counts.
    """
    keys = ["symbol", "date"] if "symbol" in vol.columns else ["date"]
    day = F.explode(F.sequence(F.lit(0), F.lit(as_of_days))) if as_of_days else F.lit(0)
    seen = vol.where(F.col("implied_vol").isNotNull()).select(*keys, "implied_vol", day.alias("age")).withColumn("date", F.date_add("date", F.col("age")))
    seen = seen.groupBy(*keys).agg(F.max_by("implied_vol", F.struct(-F.col("age"), F.col("implied_vol"))).alias("implied_vol"))
    seen = F.broadcast(seen) if vol.count() * (as_of_days + 1) <= MOST_VOL_ROWS else seen
    return df.withColumn("date", F.to_date("ts")).join(seen, keys, "left").drop("date")


def consensus(df: DataFrame, cfg: Config) -> DataFrame:
    """consensus_event: anchors of agreeing change-point and Markov fires, at least the cooldown apart."""
    df = consensus_anchors(df, cfg)

    def fold(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        anchors = rows["consensus_anchor"].to_numpy(float)
        kept = set(K.cooled_down(anchors[np.isfinite(anchors)].astype(np.int64), cfg.consensus_cooldown))
        return {"consensus_event": rows["rn"].isin(kept).to_numpy()}

    return per_symbol(df, {"consensus_event": "boolean"}, fold, ["rn", "consensus_anchor"]).drop("consensus_anchor", "bocpd_fire", "markov_fire")


def risk_guard(df: DataFrame, max_holding: int | str | None, stop_loss: float | str | None, signal: str = "raw_overlay") -> DataFrame:
    """overlay_active, overlay_stop, overlay_expired of trades on a signal column.

    The limits are numbers, or names of columns that hold one value per symbol (null for no limit).
    """
    named = [c for c in (max_holding, stop_loss) if isinstance(c, str)]

    def fold(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        limit = lambda c: c if not isinstance(c, str) else None if pd.isna(rows[c].iloc[0]) else float(rows[c].iloc[0])
        hold = limit(max_holding)
        found = K.risk_guard(rows[signal].fillna(False).to_numpy(bool), rows["close"].to_numpy(float), None if hold is None else int(hold), limit(stop_loss))
        return dict(zip(("overlay_active", "overlay_stop", "overlay_expired"), found, strict=True))

    return per_symbol(df, dict.fromkeys(("overlay_active", "overlay_stop", "overlay_expired"), "boolean"), fold, [signal, "close", *named])


def hurst_features(df: DataFrame, cfg: Config) -> DataFrame:
    """hurst with its label, Lo's statistic with its label, the confirmed label, and changes of hurst."""
    from tidegauge.functions.frames import rolling
    from tidegauge.operators.features import confirmed_label, hurst_label, lo_label
    from tidegauge.schema import LO_BANDS

    df = lo_rescaled_range(hurst(df, cfg), cfg)
    df = df.withColumns({"hurst_regime": hurst_label(F.col("hurst"), *cfg.hurst_range), "lo_memory_regime": lo_label(F.col("lo_modified_rs"), LO_BANDS[cfg.lo_confidence])})
    return df.withColumns(
        {
            "hurst_confirmed_regime": confirmed_label(F.col("hurst_regime"), F.col("lo_memory_regime")),
            "hurst_deviation": F.abs(F.col("hurst") - 0.5),
            "hurst_change": F.col("hurst") - F.lag("hurst").over(order()),
            "hurst_ma": F.avg("hurst").over(rolling(20)),
            "persistence_strength": F.col("hurst") - 0.5,
        }
    )


def hurst_summary(df: DataFrame) -> DataFrame:
    h, known = F.col("hurst"), F.col("hurst_regime") != UNKNOWN
    share = lambda label, name: F.coalesce(F.try_divide(F.count_if(F.col("hurst_regime") == label), F.count_if(known)), F.lit(0.0)).alias(name)
    return df.groupBy("symbol").agg(F.avg(h).alias("mean"), F.stddev_samp(h).alias("std"), F.max_by(h, F.when(h.isNotNull(), F.col("ts"))).alias("current"), share("Trending", "share_trending"), share("Mean-Reverting", "share_reverting"))


def hurst_outlook(df: DataFrame, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Per symbol: extremes of hurst, the shares of all known labels, the last labels and persistence, and their reading.

    The last row counts, whether its exponent is known or not; without one there is no reading.
    """
    h, known = F.col("hurst"), F.col("hurst_regime") != UNKNOWN
    share = lambda label, name: F.coalesce(F.try_divide(F.count_if(F.col("hurst_regime") == label), F.count_if(known)), F.lit(0.0)).alias(name)
    last = lambda c: F.max_by(c, "ts")
    found = df.groupBy("symbol").agg(
        F.min(h).alias("min"), F.max(h).alias("max"), last("hurst").alias("current"), share("Trending", "share_trending"), share("Mean-Reverting", "share_reverting"), share("Random", "share_random"),
        last("hurst_regime").alias("current_regime"), last("hurst_confirmed_regime").alias("current_confirmed_regime"), last("lo_memory_regime").alias("current_memory_regime"),
        F.avg("persistence_strength").alias("average_persistence"), last("persistence_strength").alias("current_persistence"),
    )
    now = F.col("current")
    reading = F.when(now > high, "trends persist").when(now < low, "moves revert").when(now.isNotNull(), "close to a random walk")
    return found.withColumn("interpretation", F.when(reading.isNotNull(), F.format_string("%s (H = %.3f)", reading, now)))
