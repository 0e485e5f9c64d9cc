"""Long-only regime strategies: exposures, costs, metrics, narratives, rebound overlays and their promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.functions.frames import order, finite, lookup, rolling
from tidegauge.operators import folds
from tidegauge.operators.features import numbered
from tidegauge.schema import BETTER_BY, DEFAULT_EXPOSURE, EXPOSURE_MAPS, NARRATIVE_FIT, REBOUND_PROFILES, UNKNOWN, ReboundProfile

OVERLAY = "Rebound Overlay"


def exposure(regime: Column, weights: dict[str, float] | None = None) -> Column:
    """Weight of a label, 0 for unknown ones, clipped to [0, 1]."""
    weight = lookup(regime, DEFAULT_EXPOSURE if weights is None else weights, 0.0)
    return F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))


def positions(df: DataFrame, target: Column, lag: int = 1, cost_bps: float = 0.0) -> DataFrame:
    """asset_return, target_exposure, position, gross_return, turnover, cost, strategy_return of every bar."""
    if lag < 0 or cost_bps < 0:
        raise ValueError("lag and cost must not be negative")
    df = df.withColumn("asset_return", F.coalesce(finite(F.try_divide(F.col("close"), F.lag("close").over(order())) - 1), F.lit(0.0))).withColumn("target_exposure", target)
    df = df.withColumn("position", F.coalesce(F.lag("target_exposure", lag).over(order()), F.lit(0.0)) if lag else F.col("target_exposure"))
    df = df.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(order()), F.lit(0.0))))
    df = df.withColumns({"gross_return": F.col("position") * F.col("asset_return"), "cost": F.col("turnover") * (cost_bps / 10_000)})
    return df.withColumn("strategy_return", F.col("gross_return") - F.col("cost"))


def story(buy_hold: Column) -> Column:
    return F.when(buy_hold >= 0.05, "risk_on_rebound").when(buy_hold <= -0.05, "risk_off_selloff").otherwise("choppy_or_rangebound")


def posture(mean_exposure: Column) -> Column:
    return F.when(mean_exposure < 0.33, "defensive").when(mean_exposure > 0.66, "fully_invested").otherwise("selective")


def relative(excess: Column) -> Column:
    return F.when(excess > 0.01, "outperformed").when(excess < -0.01, "lagged").otherwise("matched")


def metrics(daily: DataFrame, regime: str, keys: tuple[str, ...] = ("symbol",), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: returns, costs, exposure, drawdowns, label shares and the words for them.

    ``daily`` holds the bars of the evaluation, each with its position from the full history. A drawdown's top starts
    at the first evaluated bar.
    """
    w = W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    grown = lambda c: F.product(1 + F.col(c)).over(w)
    df = daily.withColumns({"_es": grown("strategy_return"), "_eb": grown("asset_return")})
    df = df.withColumns({"_ds": F.col("_es") / F.max("_es").over(w) - 1, "_db": F.col("_eb") / F.max("_eb").over(w) - 1})
    label = F.col(regime)
    known = F.count(label)
    share = lambda *words: F.coalesce(F.try_divide(100.0 * F.count_if(F.coalesce(_any(label, words), F.lit(False))), known), F.lit(0.0))
    compound = lambda c: F.product(1 + F.col(c)) - 1
    out = df.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), compound("strategy_return").alias("strategy_return"),
        compound("gross_return").alias("gross_strategy_return"), compound("asset_return").alias("buy_hold_return"), F.sum("cost").alias("total_transaction_cost"), F.sum("turnover").alias("turnover"),
        F.avg("position").alias("mean_exposure"), F.coalesce(F.max_by(label, "ts"), F.lit(UNKNOWN)).alias("latest_regime"), F.max_by("position", "ts").alias("latest_position"),
        F.min("_ds").alias("max_drawdown_strategy"), F.min("_db").alias("max_drawdown_buy_hold"), share("Bull", "Up").alias("bull_share"), share("Bear", "Down").alias("bear_share"),
        share("Sideways").alias("sideways_share"), share("Volatile", "HighVol").alias("high_vol_share"), share("Quiet", "LowVol").alias("low_vol_share"), *[c.alias(n) for n, c in (extra or {}).items()],
    )
    out = out.withColumn("excess_return", F.col("strategy_return") - F.col("buy_hold_return"))
    return out.withColumns({"market_story": story(F.col("buy_hold_return")), "strategy_posture": posture(F.col("mean_exposure")), "relative_result": relative(F.col("excess_return"))})


def _any(label: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | (label.endswith(word) if word in {"Volatile", "HighVol", "Quiet", "LowVol"} else label.startswith(word))
    return test


def evaluated(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The bars from start to end, both included."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col("ts") <= F.lit(end).cast("timestamp"))


def backtest(df: DataFrame, regime: str = "regime_name", weights: dict[str, float] | None = None, lag: int = 1, cost_bps: float = 0.0, start: str | None = None, end: str | None = None) -> DataFrame:
    """Metrics per symbol of the regime strategy; positions use the full history, metrics the window."""
    daily = positions(df, exposure(F.col(regime), weights), lag, cost_bps)
    return metrics(evaluated(daily, start, end), regime).withColumn("transaction_cost_bps", F.lit(float(cost_bps)))


def regime_mix(df: DataFrame, regime: str = "regime_name") -> DataFrame:
    """Share of each label among the labelled bars of a symbol, in per cent with one decimal."""
    counts = df.where(F.col(regime).isNotNull()).groupBy("symbol", F.col(regime).alias("regime_name")).agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("symbol")), 1))


#: What story and posture together suggest: fixed texts of this engine.
READINGS = {
    ("risk_on_rebound", "defensive"): "late or over-cautious: upside was left to passive holders",
    ("risk_on_rebound", "selective"): "part of the rebound was taken, the rest treated as unconfirmed",
    ("risk_on_rebound", "fully_invested"): "trend participation: high exposure met a broad advance",
    ("risk_off_selloff", "defensive"): "capital preservation: low exposure met a falling market",
    ("risk_off_selloff", "fully_invested"): "slow to de-risk: exposure stayed high into the selloff",
    ("choppy_or_rangebound", "defensive"): "risk control in a mixed market, at the price of mild gains",
}


def narrative(found: DataFrame) -> DataFrame:
    """headline, interpretation and evidence (array) for each row of metrics."""
    pct = lambda c: F.coalesce(F.format_string("%.2f%%", 100 * F.col(c)), F.lit("n/a"))
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    key = F.concat_ws("|", "market_story", "strategy_posture")
    reading = lookup(key, {"|".join(k): v for k, v in READINGS.items()}, "selective participation in a mixed or rotating market")
    evidence = F.array(
        F.concat(F.lit("latest regime: "), "latest_regime"), F.concat(F.lit("buy and hold: "), pct("buy_hold_return")), F.concat(F.lit("strategy: "), pct("strategy_return")),
        F.concat(F.lit("mean exposure: "), pct("mean_exposure")), F.concat(F.lit("strategy drawdown: "), pct("max_drawdown_strategy")), F.concat(F.lit("buy and hold drawdown: "), pct("max_drawdown_buy_hold")),
        F.format_string("bull/bear/sideways: %.1f%%/%.1f%%/%.1f%%", "bull_share", "bear_share", "sideways_share"), F.format_string("high volatility: %.1f%%", "high_vol_share"),
    )
    headline = F.format_string("%s: %s posture %s buy and hold in a %s market", F.col("symbol"), words("strategy_posture"), F.col("relative_result"), words("market_story"))
    return found.withColumns({"headline": headline, "interpretation": reading, "evidence": evidence})


def exposure_sweep(df: DataFrame, maps: dict[str, dict[str, float]] | None = None, regime: str = "regime_name", cost_bps: float = 0.0) -> DataFrame:
    """Metrics per symbol under each exposure map, in one pass over the bars.

    The maps are few, so the targets are columns of the same row and positions need no further exchange.
    """
    maps = maps or EXPOSURE_MAPS
    base = df.withColumn("_targets", F.array(*[F.struct(F.lit(n).alias("name"), exposure(F.col(regime), m).alias("weight")) for n, m in maps.items()]))
    long = base.withColumn("x", F.explode("_targets")).withColumn("asset", F.col("symbol")).withColumn("symbol", F.concat_ws("|", "symbol", "x.name"))
    daily = positions(long, F.col("x.weight"), 1, cost_bps)
    daily = daily.withColumns({"exposure_map": F.col("x.name"), "symbol": F.col("asset")})
    return metrics(daily, regime, ("symbol", "exposure_map"))


# --- diagnostics -------------------------------------------------------------------------------------------------


def regime_group(regime: Column) -> Column:
    """bull, bear, sideways or unknown."""
    starts = lambda *w: F.coalesce(_any(regime, w), F.lit(False))
    return F.when(starts("Bull", "Up"), "bull").when(starts("Bear", "Down"), "bear").when(starts("Sideways"), "sideways").otherwise("unknown")


def forward_diagnostics(df: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), regime: str = "regime_name", least: int = 1, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per symbol, horizon and label: forward returns inside the window and their edge over all of its bars."""
    from tidegauge.operators.analytics import long_returns

    long = long_returns(evaluated(df, start, end), horizons, regime).withColumn("overall", F.avg("r").over(W.partitionBy("symbol", "horizon")))
    r = F.col("r")
    got = long.where(F.col(regime).isNotNull()).groupBy("symbol", "horizon", F.col(regime).alias("regime")).agg(
        F.count(r).alias("count"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), (F.product(1 + r) - 1).alias("compound_return"),
        (100 * F.avg((r > 0).cast("double"))).alias("positive_pct"), (F.avg(r) - F.first("overall")).alias("edge_vs_overall"),
    )
    return got.where(F.col("count") >= least).withColumn("regime_group", regime_group(F.col("regime")))


def bullish_turn(df: DataFrame, regime: str = "regime_name", start: str | None = None, end: str | None = None) -> DataFrame:
    """Per symbol: the lowest close, the first bullish bar from there on, the lag in bars and the return missed."""
    df = numbered(evaluated(df, start, end).drop("rn"))
    low = F.struct("close", "rn")
    df = df.withColumn("_low", F.min(F.when(F.col("close").isNotNull(), low)).over(W.partitionBy("symbol")))
    bull = (regime_group(F.col(regime)) == "bull") & (F.col("rn") >= F.col("_low.rn"))
    first = F.min(F.when(bull, F.struct("rn", "ts", "close")))
    got = df.groupBy("symbol").agg(
        F.min_by("ts", F.when(F.col("close").isNotNull(), low)).alias("trough_date"), F.min("_low.close").alias("trough_price"), F.min("_low.rn").alias("_rn"), first.alias("_b"), F.max_by(regime, "ts").alias("latest_regime")
    )
    return got.select(
        "symbol", "trough_date", "trough_price", F.col("_b.ts").alias("first_bull_date"), F.col("_b.close").alias("first_bull_price"), (F.col("_b.rn") - F.col("_rn")).alias("lag_periods"),
        (F.try_divide(F.col("_b.close"), F.col("trough_price")) - 1).alias("missed_return"), "latest_regime",
    )


def rebound_signal(fast: int = 5, lookback: int = 20, least_rebound: float = 0.03, least_return: float = 0.02, above_ma: bool = True) -> Column:
    """A close well above the recent low that also rose over the last bars and stands above their mean."""
    c = F.col("close")
    low = F.when(F.count(c).over(rolling(lookback)) >= fast, F.min(c).over(rolling(lookback)))
    signal = (F.try_divide(c, low) - 1 >= least_rebound) & (F.try_divide(c, F.lag(c, fast).over(order())) - 1 >= least_return)
    if above_ma:
        signal = signal & (c >= F.when(F.count(c).over(rolling(fast)) >= fast, F.avg(c).over(rolling(fast))))
    return F.coalesce(signal, F.lit(False))


def drawdown_gate(df: DataFrame, lookback: int, limit: float, out: str = "drawdown_gate") -> DataFrame:
    """Whether the deepest recent fall from a recent top reaches the limit."""
    frame = rolling(lookback)
    c = F.col("close")
    df = df.withColumn("_fall", F.when(F.count(c).over(frame) >= 2, F.try_divide(c, F.max(c).over(frame)) - 1))
    deepest = F.when(F.count("_fall").over(frame) >= 2, F.min("_fall").over(frame))
    return df.withColumn(out, F.coalesce(deepest <= limit, F.lit(False))).drop("_fall")


def overlay_signals(df: DataFrame, p: ReboundProfile, regime: str = "regime_name") -> DataFrame:
    """rebound_signal, drawdown_gate, survival_gate and raw_overlay (all of them, and a base exposure below the overlay's)."""
    df = df.withColumn("rebound_signal", rebound_signal(p.fast_window, p.drawdown_lookback, p.min_rebound, p.min_fast_return, p.require_above_fast_ma))
    df = drawdown_gate(df, p.drawdown_gate_lookback, p.min_prior_drawdown) if p.require_prior_drawdown else df.withColumn("drawdown_gate", F.lit(True))
    guard = p.require_survival_guard and "survival_regime" in df.columns
    df = df.withColumn("survival_gate", F.coalesce(~F.col("survival_regime").isin(*p.fragile), F.lit(True)) if guard else F.lit(True))
    return df.withColumn("raw_overlay", F.col("rebound_signal") & F.col("drawdown_gate") & F.col("survival_gate") & (exposure(F.col(regime)) < p.rebound_exposure))


def overlay_bars(df: DataFrame, p: ReboundProfile, regime: str = "regime_name", cost_bps: float = 0.0) -> DataFrame:
    """Bars with the guarded overlay in effect, its positions and its label in overlay_regime."""
    df = folds.risk_guard(overlay_signals(df, p, regime), p.max_holding, p.stop_loss)
    df = df.withColumn("overlay_regime", F.when(F.col("overlay_active"), OVERLAY).otherwise(F.col(regime)))
    return positions(df, exposure(F.col("overlay_regime"), DEFAULT_EXPOSURE | {OVERLAY: p.rebound_exposure}), 1, cost_bps)


def rebound_overlay(df: DataFrame, p: ReboundProfile | None = None, regime: str = "regime_name", start: str | None = None, end: str | None = None, cost_bps: float = 0.0) -> DataFrame:
    """Metrics of an ungated overlay: every rebound signal below the overlay's exposure is taken, without a guard."""
    p = p or ReboundProfile(True)
    df = df.withColumn("rebound_signal", rebound_signal(p.fast_window, p.drawdown_lookback, p.min_rebound, p.min_fast_return, p.require_above_fast_ma))
    active = F.col("rebound_signal") & (exposure(F.col(regime)) < p.rebound_exposure)
    df = df.withColumn("overlay_regime", F.when(active, OVERLAY).otherwise(F.col(regime)))
    daily = positions(df, exposure(F.col("overlay_regime"), DEFAULT_EXPOSURE | {OVERLAY: p.rebound_exposure}), 1, cost_bps)
    extra = {"rebound_signal_count": F.count_if("rebound_signal"), "overlay_active_count": F.count_if(F.col("overlay_regime") == OVERLAY)}
    return metrics(evaluated(daily, start, end), "overlay_regime", extra=extra)


def compare_overlay(df: DataFrame, p: ReboundProfile | None = None, regime: str = "regime_name") -> DataFrame:
    """Current strategy and overlay, two rows per symbol."""
    current, overlay = backtest(df, regime).drop("transaction_cost_bps"), rebound_overlay(df, p, regime).drop("rebound_signal_count", "overlay_active_count")
    return current.withColumn("variant", F.lit("current")).unionByName(overlay.withColumn("variant", F.lit("rebound_overlay")))


# --- groups and walk-forward -------------------------------------------------------------------------------------

COUNTED = ("rebound_signal", "drawdown_gate", "survival_gate", "raw_overlay", "overlay_active", "overlay_stop", "overlay_expired")


def group_of(symbol: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The first group that lists the symbol, in any case; 'other' without one."""
    known: dict[str, str] = {}
    for group, members in groups.items():
        for m in members:
            known.setdefault(m.strip().upper(), group)
    return lookup(F.upper(F.trim(symbol)), known, "other") if known else F.lit("other")


#: What a bar has for each variant beside its asset_return.
_OF_VARIANT = ("position", "gross_return", "turnover", "cost", "strategy_return")


def group_bars(df: DataFrame, groups: dict[str, tuple[str, ...]], profiles: dict[str, ReboundProfile] | None = None, regime: str = "regime_name", cost_bps: float = 0.0) -> DataFrame:
    """Bars of both variants, 'current' and 'group_rebound', each symbol under its group's profile.

    One pass over the bars: the signals of each profile are columns that a bar takes by its group, all over the same
    partitioning, one fold guards the trades of all groups, and both variants' positions stand in one row before they
    become two. Positions do not depend on the windows that are evaluated later.
    """
    profiles = profiles or REBOUND_PROFILES
    df = df.withColumn("group", group_of(F.col("symbol"), groups))
    rest = profiles.get("other", ReboundProfile(False))
    live = [(F.col("group") == g, profiles[g]) for g in groups if g in profiles and profiles[g].enabled]
    if rest.enabled:
        live.append((~F.col("group").isin(*[g for g in groups if g in profiles]), rest))

    def mine(value, without=None) -> Column:
        """The value of the profile that the bar's group lives under."""
        out = F.when(F.lit(False), without)
        for test, p in live:
            out = out.when(test, value(p))
        return out.otherwise(without)

    flags = ("rebound_signal", "drawdown_gate", "survival_gate", "raw_overlay")
    for p in dict.fromkeys(p for _, p in live):
        df = overlay_signals(df, p, regime)
        df = df.withColumn(f"_of_{list(dict.fromkeys(q for _, q in live)).index(p)}", F.struct(*flags)).drop(*flags)
    known = list(dict.fromkeys(p for _, p in live))
    df = df.withColumns({f: F.coalesce(mine(lambda p, f=f: F.col(f"_of_{known.index(p)}.{f}")), F.lit(False)) for f in flags}).drop(*[f"_of_{i}" for i in range(len(known))])
    df = df.withColumn("overlay_enabled", F.coalesce(mine(lambda p: F.lit(True)), F.lit(False)))
    guards = {"_hold": mine(lambda p: F.lit(p.max_holding).cast("double")), "_stop": mine(lambda p: F.lit(p.stop_loss).cast("double"))}
    df = folds.risk_guard(df.withColumns(guards), "_hold", "_stop").drop("_hold", "_stop")
    df = df.withColumn("overlay_regime", F.when(F.col("overlay_active"), OVERLAY).otherwise(F.col(regime)))
    weight = F.when(F.col("overlay_active"), mine(lambda p: F.least(F.greatest(F.lit(float(p.rebound_exposure)), F.lit(0.0)), F.lit(1.0)))).otherwise(exposure(F.col(regime)))
    df = positions(df, exposure(F.col(regime)), 1, cost_bps).withColumn("_now", F.struct(*_OF_VARIANT))
    df = positions(df, weight, 1, cost_bps).withColumn("_new", F.struct(*_OF_VARIANT))

    def variant(name: str, of: str, label: str, counted: bool) -> Column:
        return F.struct(F.lit(name).alias("variant"), F.col(label).alias("evaluated_regime"), (F.col("overlay_enabled") & counted).alias("overlay_enabled"), *[F.col(f"{of}.{c}").alias(c) for c in _OF_VARIANT], *[(F.col(c) & counted).alias(c) for c in COUNTED])

    both = F.explode(F.array(variant("current", "_now", regime, False), variant("group_rebound", "_new", "overlay_regime", True))).alias("_v")
    return df.select("symbol", "ts", "close", "group", "asset_return", both).select("symbol", "ts", "close", "group", "asset_return", "_v.*")


def _compared(daily: DataFrame, keys: tuple[str, ...], cost_bps: float) -> DataFrame:
    extra = {"group": F.first("group"), "overlay_enabled": F.first("overlay_enabled")}
    extra |= {f"{c}_count": F.count_if(c) for c in COUNTED} | {f"{c}_share": F.avg(F.col(c).cast("double")) for c in COUNTED[:5]}
    found = metrics(daily, "evaluated_regime", (*keys, "variant"), extra).withColumn("transaction_cost_bps", F.lit(float(cost_bps)))
    w = W.partitionBy(*keys)
    current = lambda c: F.max(F.when(F.col("variant") == "current", F.col(c))).over(w)
    deltas = {"strategy_return": "strategy_return_delta_vs_current", "excess_return": "excess_return_delta_vs_current", "mean_exposure": "mean_exposure_delta_vs_current", "max_drawdown_strategy": "drawdown_delta_vs_current"}
    found = found.withColumns({out: F.col(c) - current(c) for c, out in deltas.items()})
    return found.withColumn("improved_vs_current", (F.col("variant") == "group_rebound") & (F.col("strategy_return_delta_vs_current") > BETTER_BY))


def compare_groups(df: DataFrame, groups: dict[str, tuple[str, ...]], profiles: dict[str, ReboundProfile] | None = None, cost_bps: float = 0.0) -> DataFrame:
    """Two rows per symbol: the current strategy and the group's overlay, with the differences."""
    return _compared(group_bars(df, groups, profiles, cost_bps=cost_bps), ("symbol",), cost_bps)


def recent_windows(spark: SparkSession, end: str, specs: tuple = None) -> DataFrame:
    """(window, start, end) counted back in days from the date of ``end``."""
    from tidegauge.schema import WALK_FORWARD_WINDOWS

    specs = specs or WALK_FORWARD_WINDOWS
    if any(a < b for _, a, b in specs):
        raise ValueError("a window must not start after its end")
    day = F.to_date(F.lit(end))
    table = spark.createDataFrame([(n, a, b) for n, a, b in specs], "window string, a int, b int")
    return table.select("window", F.date_sub(day, F.col("a")).cast("timestamp").alias("window_start"), F.date_sub(day, F.col("b")).cast("timestamp").alias("window_end"))


def walk_forward(df: DataFrame, windows: DataFrame, groups: dict[str, tuple[str, ...]], profiles: dict[str, ReboundProfile] | None = None, cost_bps: float = 0.0) -> DataFrame:
    """compare_groups for every window: one range join of the finished bars with the few windows, then one aggregate."""
    daily = group_bars(df, groups, profiles, cost_bps=cost_bps)
    inside = daily.join(F.broadcast(windows), (F.col("ts") >= F.col("window_start")) & (F.col("ts") <= F.col("window_end")))
    return _compared(inside, ("window", "symbol"), cost_bps)


def first_mode(c: str) -> Column:
    """The most frequent value, ties to the alphabetically first; counts per value are all that is kept of a group."""
    return F.mode(c, True)


def summarise_groups(compared: DataFrame) -> DataFrame:
    """Per window (if any), group and variant: means, median exposure, counts and the commonest words."""
    keys = [c for c in ("window", "group", "variant") if c in compared.columns]
    got = compared.where("observations > 0").groupBy(*keys).agg(
        F.countDistinct("symbol").alias("asset_count"), F.avg("strategy_return").alias("mean_strategy_return"), F.avg("buy_hold_return").alias("mean_buy_hold_return"), F.avg("excess_return").alias("mean_excess_return"),
        F.median("mean_exposure").alias("median_exposure"), F.avg("strategy_return_delta_vs_current").alias("mean_strategy_delta_vs_current"), F.count_if("improved_vs_current").alias("improved_count"),
        F.count_if("overlay_enabled").alias("overlay_enabled_count"), first_mode("market_story").alias("top_market_story"), first_mode("strategy_posture").alias("top_strategy_posture"),
    )
    return got.withColumns({"is_candidate": F.col("variant") == "group_rebound", "is_baseline": F.col("variant") == "current"})


def variant_summary(compared: DataFrame, baseline: str = "current", candidate: str = "group_rebound") -> DataFrame:
    """Per group: an inner join of the two variants by symbol, and how often and how much the candidate is better."""
    b = compared.where(F.col("variant") == baseline).select("group", "symbol", F.col("strategy_return").alias("b"))
    c = compared.where(F.col("variant") == candidate).select("group", "symbol", F.col("strategy_return").alias("c"), "excess_return", "mean_exposure")
    d = F.col("c") - F.col("b")
    return b.join(c, ["group", "symbol"]).groupBy("group").agg(
        F.count("*").alias("asset_count"), F.avg("b").alias("baseline_mean_strategy_return"), F.avg("c").alias("candidate_mean_strategy_return"), F.avg(d).alias("mean_improvement"),
        F.count_if(d > BETTER_BY).alias("improved_count"), F.count_if(d < -BETTER_BY).alias("degraded_count"), F.avg("excess_return").alias("candidate_mean_excess_return"), F.median("mean_exposure").alias("candidate_median_exposure"),
    )


def group_narratives(found: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per group: mean returns, median exposure and the commonest words of its symbols' metrics."""
    return found.withColumn("group", group_of(F.col("symbol"), groups)).groupBy("group").agg(
        F.count("*").alias("asset_count"), F.avg("strategy_return").alias("mean_strategy_return"), F.avg("buy_hold_return").alias("mean_buy_hold_return"), F.avg("excess_return").alias("mean_excess_return"),
        F.median("mean_exposure").alias("median_exposure"), first_mode("market_story").alias("top_story"), first_mode("strategy_posture").alias("top_posture"), first_mode("relative_result").alias("top_relative_result"),
    )


def narrative_alignment(compared: DataFrame, threshold: float = 0.5) -> DataFrame:
    """narrative_alignment_score of story and posture (null for unknown pairs) and whether it reaches the threshold."""
    score = lookup(F.concat_ws("|", "market_story", "strategy_posture"), {"|".join(k): v for k, v in NARRATIVE_FIT.items()})
    return compared.withColumn("narrative_alignment_score", score).withColumn("narrative_aligned", F.coalesce(F.col("narrative_alignment_score") >= threshold, F.lit(False)))


def promotion(compared: DataFrame, eligible: tuple[str, ...], protected: tuple[str, ...], least_improved: float = 0.60, worst_drawdown: float = -0.02, most_degraded: float = 0.0) -> DataFrame:
    """One row: whether the overlay may become the default, the figures behind it, and the reasons against."""
    if not 0 <= least_improved <= 1 or not 0 <= most_degraded <= 1:
        raise ValueError("shares must lie between 0 and 1")
    c = (F.col("variant") == "group_rebound") & (F.col("observations") > 0)
    mine, safe = c & F.col("group").isin(*eligible), c & F.col("group").isin(*protected)
    worse = F.col("strategy_return_delta_vs_current") < -BETTER_BY
    got = compared.agg(
        F.count_if(mine).alias("eligible_count"), F.coalesce(F.avg(F.when(mine, F.col("improved_vs_current").cast("double"))), F.lit(0.0)).alias("eligible_improved_share"),
        F.count_if(safe).alias("protected_count"), F.coalesce(F.avg(F.when(safe, worse.cast("double"))), F.lit(0.0)).alias("protected_degraded_share"),
        F.coalesce(F.min(F.when(c, F.col("drawdown_delta_vs_current"))), F.lit(0.0)).alias("worst_drawdown_delta"),
    )
    gates = [
        (F.col("eligible_count") > 0, "eligible: nothing observed"),
        (F.col("eligible_improved_share") >= least_improved, "eligible: too few improved"),
        (F.col("protected_degraded_share") <= most_degraded, "protected: too many lost"),
        (F.col("worst_drawdown_delta") >= worst_drawdown, "drawdown: deeper than allowed"),
    ]
    return _gated(got, gates)


def _gated(got: DataFrame, gates: list[tuple[Column, str]], earlier: bool = False) -> DataFrame:
    holds = F.lit(True)
    for test, _ in gates:
        holds = holds & test
    reasons = F.array_compact(F.array(*[F.when(~test, text) for test, text in gates]))
    if earlier:
        return got.withColumns({"promote": F.col("promote") & holds, "reasons": F.concat("reasons", reasons)})
    return got.withColumns({"promote": holds, "reasons": reasons})


def research_promotion(
    compared: DataFrame, eligible: tuple[str, ...], protected: tuple[str, ...], variants: dict[str, DataFrame] | None = None, least_windows: int = 3, recent: str = "recent_1m",
    least_narrative: float = 0.70, least_cost_bps: float = 5.0, least_stable: float = 0.67, **basic,
) -> DataFrame:
    """The promotion gate with windows, costs, narrative fit and stability under neighbouring parameters as further gates."""

    def once(found: DataFrame) -> DataFrame:
        scored = narrative_alignment(found).where("observations > 0")
        mine = (F.col("variant") == "group_rebound") & F.col("group").isin(*eligible)
        base = (F.col("variant") == "current") & F.col("group").isin(*eligible)
        now = F.col("window") == recent
        score = F.col("narrative_alignment_score")
        more = scored.agg(
            F.countDistinct(F.when(mine, F.col("window"))).alias("windows_tested"), F.coalesce(F.min(F.when(mine, F.col("transaction_cost_bps"))), F.lit(0.0)).alias("min_transaction_cost_bps"),
            F.count_if(mine & now).alias("recent_narrative_count"), F.coalesce(F.avg(F.when(mine & now, score)), F.lit(0.0)).alias("recent_narrative_score"), F.coalesce(F.avg(F.when(base & now, score)), F.lit(0.0)).alias("current_narrative_score"),
        )
        joined = promotion(found, eligible, protected, **basic).join(F.broadcast(more), how="cross")  # one row by one row
        fit, seen = F.col("recent_narrative_score"), F.col("recent_narrative_count") > 0
        return _gated(
            joined,
            [
                (F.col("windows_tested") >= least_windows, "windows: too few tested"),
                (F.lit(least_cost_bps <= 0) | (F.col("min_transaction_cost_bps") >= least_cost_bps), "costs: tested below the required rate"),
                (seen, "narrative: nothing recent"),
                (~seen | (fit >= least_narrative), "narrative: poor fit"),
                (~seen | (fit < least_narrative) | (fit + 1e-12 >= F.col("current_narrative_score")), "narrative: worse fit than the baseline"),
            ],
            earlier=True,
        )

    result = once(compared)
    passed = None
    for name, found in (variants or {}).items():
        row = once(found).select(F.lit(name).alias("parameters"), "promote")
        passed = row if passed is None else passed.unionByName(row)
    if passed is None:
        return _gated(result.withColumn("parameter_pass_share", F.lit(0.0)), [(F.lit(False), "stability: no neighbours tested")], earlier=True)
    share = passed.agg(F.avg(F.col("promote").cast("double")).alias("parameter_pass_share"))
    return _gated(result.join(F.broadcast(share), how="cross"), [(F.col("parameter_pass_share") >= least_stable, "stability: too few neighbours pass")], earlier=True)
