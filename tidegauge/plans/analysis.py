"""The whole analysis of all symbols of a bar table as one lazy chain, and the tables that follow from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import Config
from tidegauge.operators import analytics, backtest, channels, features, folds, outlook, regimes
from tidegauge.schema import WALK_FORWARD_WINDOWS
from tidegauge.sources.bars import clean, read_bars, require_rows, source_type, with_returns


@dataclass(frozen=True)
class Overlays:
    """Which optional overlays to add; the consensus needs, and brings, the change points and the Markov model."""

    fuzzy: bool = True
    adaptive: bool = False
    ewma: bool = False
    markov: bool = False
    bocpd: str | None = None
    consensus: bool = False


def labelled(bars: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Bars with trend, volatility and crisp labels: window expressions only."""
    cfg = cfg or Config()
    df = features.trend_features(with_returns(bars), cfg)
    if cfg.volatility_method == "ewm":
        df = folds.ewm_volatility(df, cfg)
    return regimes.classify(features.volatility_features(df, cfg), cfg)


def crisp_labels(bars: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The crisp labels of ``labelled`` with the strength, volatility and percentile they follow from, and no other column.

    For tables of very many bars of which only the labels are wanted: what takes a window of rows for every bar is a fold.
    """
    cfg = cfg or Config()
    if cfg.volatility_method == "std":
        return regimes.classify(features.strength_and_volatility(bars, cfg), cfg)
    df = features.trend_features(with_returns(bars), cfg)
    df = folds.ewm_volatility(df, cfg) if cfg.volatility_method == "ewm" else df.withColumn("volatility", features.volatility(cfg))
    df = df.select("symbol", "ts", "trend_strength", "volatility")
    return regimes.classify(features.volatility_percentile_alone(df, "volatility", cfg.percentile_lookback), cfg)


def run_features(bars: DataFrame, cfg: Config | None = None) -> DataFrame:
    """All features: trend, volatility, range, long memory, fractal filter, tail risk."""
    cfg = cfg or Config()
    df = folds.average_true_range(labelled(bars, cfg), cfg)
    df = features.fractal_features(folds.hurst_features(df, cfg), cfg)
    return features.tail_features(df, cfg)


def run_analysis(bars: DataFrame, cfg: Config | None = None, overlays: Overlays | None = None, implied: DataFrame | None = None, quotes: DataFrame | None = None, tolerance_days: int = 0) -> DataFrame:
    """Features, labels, memberships, overlays in their fixed order (adaptive, weighted, Markov, change points, consensus) and flags."""
    if implied is not None and quotes is not None:
        raise ValueError("give implied volatility or quotes of indices, not both")
    cfg, o = cfg or Config(), overlays or Overlays()
    df = run_features(bars, cfg)
    if o.fuzzy:
        df = regimes.fuzzy_features(df, cfg)
    if o.adaptive:
        df = regimes.adaptive_regime(df, cfg)
        if cfg.min_dwell > 1:
            df = regimes.min_dwell(df, "regime_adaptive", cfg.min_dwell)
    if o.ewma:
        df = folds.ewma_trend(df, cfg)
    if o.markov or o.consensus:
        if implied is not None:
            df = folds.implied_vol(df, implied)
        if quotes is not None:
            df = channels.implied_vol(df, quotes, tolerance_days)
        df = folds.markov(df, second="implied_vol" if "implied_vol" in df.columns else None)
    if o.bocpd or o.consensus:
        df = folds.dsm_bocpd(df, cfg) if o.bocpd == "dsm" else folds.bocpd(df, cfg)
    if o.consensus:
        df = folds.consensus(df, cfg)
    return regimes.quality_flags(df, cfg)


def by_source(bars: DataFrame, make: Callable[[DataFrame, Config], DataFrame], stock: Config | None = None, crypto: Config | None = None) -> DataFrame:
    """``make`` over the bars of stocks and over those of crypto pairs, each under its own configuration, in one table.

    The class follows from the symbol (see ``source_type``; without a symbol: stock). Every row goes through one of two
    plans, which filter before any exchange, so that neither computes the other's frames.
    """
    is_crypto = F.coalesce(source_type(F.col("symbol")) == "crypto", F.lit(False))
    return make(bars.where(~is_crypto), stock or Config()).unionByName(make(bars.where(is_crypto), crypto or Config.crypto()))


def summaries(df: DataFrame, cfg: Config | None = None) -> dict[str, DataFrame]:
    """The tables of a report, each lazy."""
    cfg = cfg or Config()
    found = analytics.segments(df)
    matrix = analytics.transition_matrix(df)
    stats = analytics.forward_stats(df, cfg.horizons)
    return {
        "segments": found,
        "insights": outlook.insights(df),
        **({"market_summary": outlook.market_summary(df)} if "fuzzy_primary_regime" in df.columns else {}),
        "segment_statistics": analytics.segment_statistics(found),
        "transitions": matrix,
        "persistence": analytics.persistence(matrix),
        "cycles": analytics.cycles(matrix),
        "forward_stats": stats,
        "best_and_worst": analytics.best_and_worst(stats),
        "backtest": backtest.narrative(backtest.backtest(df)),
    }


class Engine:
    """Stateless entry point: a session and a configuration; every method takes and gives DataFrames."""

    def __init__(self, spark: SparkSession, cfg: Config | None = None):
        self.spark, self.cfg = spark, cfg or Config()

    def read(self, path: str, required: bool = False, **limits) -> DataFrame:
        """Clean bars within the limits of read_bars; with ``required`` a request without bars raises NoData now, not later."""
        found = read_bars(self.spark, path, **limits)
        return clean(require_rows(found, limits.get("symbols")) if required else found, self.cfg.fill)

    def analyse(self, bars: DataFrame, overlays: Overlays | None = None, implied: DataFrame | None = None, quotes: DataFrame | None = None, tolerance_days: int = 0) -> DataFrame:
        """``implied`` gives implied volatility by date (and symbol); or ``quotes`` are bars of volatility indices, which
        reach a symbol through its own index, ``tolerance_days`` late at most."""
        return run_analysis(bars, self.cfg, overlays, implied, quotes, tolerance_days)

    def analyse_by_source(self, bars: DataFrame, crypto: Config | None = None, overlays: Overlays | None = None, **channel) -> DataFrame:
        """Stocks under this engine's configuration and crypto pairs under ``crypto``, in one table."""
        return by_source(bars, lambda df, cfg: run_analysis(df, cfg, overlays, **channel), self.cfg, crypto)

    def summaries(self, analysed: DataFrame) -> dict[str, DataFrame]:
        return summaries(analysed, self.cfg)

    def walk_forward(self, analysed: DataFrame, end: str, groups: dict[str, tuple[str, ...]], cost_bps: float = 5.0, specs: tuple = WALK_FORWARD_WINDOWS) -> DataFrame:
        return backtest.walk_forward(analysed, backtest.recent_windows(self.spark, end, specs), groups, cost_bps=cost_bps)
