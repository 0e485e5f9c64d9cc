"""Crisp, fuzzy and adaptive regime labels, quality flags, and run-length rules on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidegauge.config import Config
from tidegauge.functions import sliding
from tidegauge.functions.frames import order, past, before, half, lookup
from tidegauge.functions.frames import gated as gate
from tidegauge.functions.grouped import doubles
from tidegauge.operators.features import numbered, trend_label
from tidegauge.schema import REGIME_NAMES, REGIMES, UNKNOWN


def regime_label(trend: Column, volatility: Column) -> Column:
    """{trend}-{High|Low}Vol, Unknown if either is."""
    return F.when((trend == UNKNOWN) | (volatility == UNKNOWN), UNKNOWN).otherwise(F.concat(trend, F.lit("-"), volatility, F.lit("Vol")))


def regime_code(regime: Column) -> Column:
    """Place in the label order, -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in REGIMES]), regime), F.lit(0)).cast("int") - 1


def classify(df: DataFrame, cfg: Config) -> DataFrame:
    """trend_regime, volatility_regime, regime and regime_name from trend_strength and volatility (percentile)."""
    df = df.withColumn("trend_regime", trend_label(F.col("trend_strength"), cfg.trend_up, cfg.trend_down))
    judged = F.col("volatility_percentile") if "volatility_percentile" in df.columns else F.col("volatility")
    df = df.withColumn("volatility_regime", F.when(judged.isNull(), UNKNOWN).when(judged > cfg.volatility_percentile, "High").otherwise("Low"))
    df = df.withColumn("regime", regime_label(F.col("trend_regime"), F.col("volatility_regime")))
    return df.withColumn("regime_name", lookup(F.col("regime"), REGIME_NAMES, UNKNOWN))


# --- fuzzy -------------------------------------------------------------------------------------------------------


def triangle(x: Column, a: float, b: float, c: float) -> Column:
    return F.when((x <= a) | (x >= c), 0.0).when(x <= b, (x - a) / (b - a)).otherwise((c - x) / (c - b))


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership that rises from a to b, is full to c and falls to d; equal ends make a shoulder that includes the end."""
    rise = F.lit(1.0) if a == b else (x - a) / (b - a)
    fall = F.lit(1.0) if c == d else (d - x) / (d - c)
    outside = ((x < a) if a == b else (x <= a)) | ((x > d) if c == d else (x >= d))
    return F.when(outside, 0.0).when(x < b, rise).when(x <= c, 1.0).otherwise(fall)


def memberships(strength: Column, vol: Column, cfg: Config) -> dict[str, Column]:
    """Raw membership of each regime: the lesser of its trend's and its volatility's."""
    lo, hi = cfg.fuzzy_trend_range
    vlo, vhi = cfg.fuzzy_percentile_range if cfg.fuzzy_source in {"percentile", "volatility_percentile"} else cfg.fuzzy_vol_range
    mid = (vlo + vhi) / 2
    trend = {"Up": trapezoid(strength, 0.1, 0.5, hi, hi), "Sideways": triangle(strength, -0.3, 0.0, 0.3), "Down": trapezoid(strength, lo, lo, -0.5, -0.1)}
    level = {"LowVol": trapezoid(vol, vlo, vlo, 0.6 * mid, 1.2 * mid), "HighVol": trapezoid(vol, 0.8 * mid, 1.4 * mid, vhi, vhi)}
    return {r: F.least(trend[r.split("-")[0]], level[r.split("-")[1]]) for r in REGIMES}


def fuzzy_name(regime: str) -> str:
    return "fuzzy_" + regime.replace("-", "_").lower()


def fuzzy_features(df: DataFrame, cfg: Config) -> DataFrame:
    """Six memberships that sum to 1, the primary regime, its membership as confidence, and the entropy in nats.

    Missing inputs give memberships of 0, the first regime and a confidence and entropy of 0.
    """
    vol = F.col("volatility_percentile" if cfg.fuzzy_source in {"percentile", "volatility_percentile"} else "volatility")
    raw = memberships(F.col("trend_strength"), vol, cfg)
    known = F.col("trend_strength").isNotNull() & vol.isNotNull()
    df = df.withColumns({f"_{fuzzy_name(r)}": F.when(known, m).otherwise(0.0) for r, m in raw.items()})
    total = sum((F.col(f"_{fuzzy_name(r)}") for r in REGIMES), F.lit(0.0))
    df = df.withColumn("_total", total)
    share = lambda r: F.when(~known, 0.0).when(F.col("_total") > 1e-8, F.col(f"_{fuzzy_name(r)}") / F.col("_total")).otherwise(1 / 6)
    df = df.withColumns({fuzzy_name(r): share(r) for r in REGIMES}).drop("_total", *[f"_{fuzzy_name(r)}" for r in REGIMES])
    top = F.greatest(*[F.col(fuzzy_name(r)) for r in REGIMES])
    # equal memberships may differ in their last bits; they tie at twelve places, and the first regime wins
    first = F.coalesce(*[F.when(F.round(fuzzy_name(r), 12) == F.round(top, 12), F.lit(r)) for r in REGIMES])
    entropy = sum((F.when(F.col(fuzzy_name(r)) > 0, -F.col(fuzzy_name(r)) * F.log(fuzzy_name(r))).otherwise(0.0) for r in REGIMES), F.lit(0.0))
    return df.withColumns({"fuzzy_primary_regime": first, "fuzzy_confidence": top, "fuzzy_entropy": entropy})


def fuzzy_summary(df: DataFrame) -> DataFrame:
    """Per symbol and regime: mean and last membership, and the share of bars where it is primary."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(fuzzy_name(r)).alias("p")) for r in REGIMES])).alias("x")
    long = df.select("symbol", "ts", "fuzzy_primary_regime", pairs).select("symbol", "ts", "fuzzy_primary_regime", "x.*")
    return long.groupBy("symbol", "regime").agg(F.avg("p").alias("mean_membership"), F.max_by("p", "ts").alias("current"), F.avg((F.col("fuzzy_primary_regime") == F.col("regime")).cast("double")).alias("primary_share"))


def fuzzy_nowcast(df: DataFrame) -> DataFrame:
    """Last bar's memberships and their margins over trend and volatility, with a sentence."""
    last = df.groupBy("symbol").agg(F.max_by(F.struct(*df.columns), "ts").alias("x")).select("x.*")
    side = lambda part: sum((F.col(fuzzy_name(r)) for r in REGIMES if part in r), F.lit(0.0))
    out = last.withColumns({f"prob_{p.lower()}": side(p) for p in ("Up", "Sideways", "Down", "LowVol", "HighVol")})
    text = F.format_string("%s: %s with %.0f%% confidence", F.col("symbol"), lookup(F.col("fuzzy_primary_regime"), REGIME_NAMES), 100 * F.col("fuzzy_confidence"))
    return out.select("symbol", "ts", *[fuzzy_name(r) for r in REGIMES], "fuzzy_primary_regime", "fuzzy_confidence", *[f"prob_{p}" for p in ("up", "sideways", "down", "lowvol", "highvol")], text.alias("nowcast"))


# --- flags and thresholds ----------------------------------------------------------------------------------------


def quality_flags(df: DataFrame, cfg: Config, required: tuple[str, ...] = ("trend_strength", "volatility", "volatility_percentile", "regime"), causal: bool = True, warmup: int | None = None) -> DataFrame:
    """calibration_observations, warmup_bars, warmup_complete, causal_mode, valid_signal; a required column that is missing makes no bar valid."""
    bars = cfg.warmup_bars if warmup is None else warmup
    df = numbered(df)
    valid = F.lit(all(c in df.columns for c in required))
    kinds = dict(df.dtypes)
    for c in required:
        if c in df.columns:
            fine = F.col(c).isNotNull() & (F.col(c) != UNKNOWN if kinds[c] == "string" else ~F.isnan(c) & (F.abs(c) < float("inf")))
            valid = valid & fine
    return df.withColumns(
        {"calibration_observations": F.col("rn"), "warmup_bars": F.lit(bars), "warmup_complete": F.col("rn") >= bars, "causal_mode": F.lit(causal), "valid_signal": (F.col("rn") >= bars) & valid}
    )


def quantile_thresholds(value: str, window: int, up: float, down: float, floor_up: float = 0.0, floor_down: float = 0.0, least: int | None = None) -> tuple[Column, Column]:
    """Upper and lower quantiles of the ``window`` values before the current row, kept beyond the floors; null while warming up."""
    if not 0 < down < up < 1:
        raise ValueError("quantiles must satisfy 0 < down < up < 1")
    frame = before(window)
    least = half(window) if least is None else least
    upper = gate(F.percentile(value, F.lit(up)).over(frame), F.col(value), least, frame)
    lower = gate(F.percentile(value, F.lit(down)).over(frame), F.col(value), least, frame)
    return F.when(upper.isNotNull(), F.greatest(upper, F.lit(floor_up))), F.when(lower.isNotNull(), F.least(lower, F.lit(-floor_down)))


def with_quantile_thresholds(
    df: DataFrame, value: str, window: int, up: float, down: float, floor_up: float = 0.0, floor_down: float = 0.0, least: int | None = None, names: tuple[str, str] = ("adaptive_upper", "adaptive_lower")
) -> DataFrame:
    """Adds ``quantile_thresholds``, at about the same cost for any window."""
    if not 0 < down < up < 1:
        raise ValueError("quantiles must satisfy 0 < down < up < 1")
    df = earlier_quantiles(df, value, window, dict(zip(names, (up, down), strict=True)), half(window) if least is None else least)
    upper, lower = map(F.col, names)
    return df.withColumns({names[0]: F.when(upper.isNotNull(), F.greatest(upper, F.lit(floor_up))), names[1]: F.when(lower.isNotNull(), F.least(lower, F.lit(-floor_down)))})


def earlier_quantiles(df: DataFrame, value: str, window: int, shares: dict[str, float], least: int) -> DataFrame:
    """Adds a quantile (name -> share) of the ``window`` rows before each, from ``least`` values on: a sorted window in a fold."""
    names = list(shares)
    return doubles(df, names, lambda r: dict(zip(names, sliding.earlier_quantiles(r[value].to_numpy(float), window, list(shares.values()), least), strict=True)), [value])


def adaptive_label(value: Column, upper: Column, lower: Column) -> Column:
    return F.when(value.isNull() | upper.isNull() | lower.isNull(), UNKNOWN).when(value > upper, "Up").when(value < lower, "Down").otherwise("Sideways")


def adaptive_regime(df: DataFrame, cfg: Config, value: str = "trend_strength") -> DataFrame:
    """adaptive_upper, adaptive_lower and regime_adaptive."""
    df = with_quantile_thresholds(df, value, cfg.adaptive_window, cfg.adaptive_up, cfg.adaptive_down, cfg.adaptive_floor, cfg.adaptive_floor)
    return df.withColumn("regime_adaptive", adaptive_label(F.col(value), F.col("adaptive_upper"), F.col("adaptive_lower")))


def adaptive_volatility(df: DataFrame, window: int = 252, high: float = 0.67) -> DataFrame:
    """High or Low against the quantile of the values before."""
    df = earlier_quantiles(df, "volatility", window, {"adaptive_vol_threshold": high}, half(window))
    v, t = F.col("volatility"), F.col("adaptive_vol_threshold")
    return df.withColumn("regime_vol_adaptive", F.when(v.isNull() | t.isNull(), UNKNOWN).when(v > t, "High").otherwise("Low"))


# --- runs --------------------------------------------------------------------------------------------------------


def min_dwell(df: DataFrame, label: str, least: int, out: str = "regime_dwell") -> DataFrame:
    """Runs of known labels shorter than ``least`` take the label of the last accepted run; the first run is accepted.

    Unknown and missing labels stay, and part runs. A run's length is only known at its end, so the last run may change.
    """
    if least <= 1:
        return df.withColumn(out, F.col(label))
    known = F.col(label).isNotNull() & (F.col(label) != UNKNOWN)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(order())) | F.lag(F.lit(1)).over(order()).isNull()
    df = df.withColumn("_run", F.sum(F.when(changed, 1).otherwise(0)).over(past()))
    df = df.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy("symbol", "_run")))
    df = df.withColumn("_first", F.min(F.when(known, F.col("_run"))).over(Window.partitionBy("symbol")))
    accepted = known & ((F.col("_length") >= least) | (F.col("_run") == F.col("_first")))
    kept = F.last(F.when(accepted, F.col(label)), True).over(past())
    return df.withColumn(out, F.when(known, kept).otherwise(F.col(label))).drop("_run", "_length", "_first")


def bocpd_fires(drop: float) -> Column:
    """The run length, carried forward, falls by at least ``drop``."""
    held = F.last("bocpd_run_length", True).over(past())
    return F.coalesce(F.last("bocpd_run_length", True).over(order().rowsBetween(Window.unboundedPreceding, -1)) - held >= drop, F.lit(False))


def markov_fires(jump: float, crossing: float = 0.5) -> Column:
    """The probability rises by ``jump`` within three bars, or crosses the level upward."""
    p = F.col("markov_prob_high")
    rises = F.coalesce(p - F.lag(p, 3).over(order()) >= jump, F.lit(False))
    return rises | F.coalesce((p > crossing) & (F.lag(p, 1).over(order()) <= crossing), F.lit(False))


def consensus_anchors(df: DataFrame, cfg: Config) -> DataFrame:
    """consensus_anchor: for a Markov fire with change-point fires within the window, the later of it and the last of them."""
    w = cfg.consensus_window
    df = numbered(df).withColumns({"bocpd_fire": bocpd_fires(cfg.consensus_drop), "markov_fire": markov_fires(cfg.consensus_jump)})
    near = F.max(F.when(F.col("bocpd_fire"), F.col("rn"))).over(order().rowsBetween(-w, w))
    return df.withColumn("consensus_anchor", F.when(F.col("markov_fire") & near.isNotNull(), F.greatest(near, F.col("rn"))))
