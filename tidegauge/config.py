"""Parameters of the analysis: one immutable record, with presets for asset classes and bar sizes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    """Defaults suit daily equity bars; ``crypto()`` and ``PROFILES`` give the others."""

    timeframe: str = "1d"
    trend_window: int = 20
    volatility_window: int = 20
    volatility_method: str = "std"
    annualize: bool = False
    percentile_lookback: int = 252
    baseline_window: int = 100
    hurst_window: int = 100
    hurst_method: str = "structure"
    hurst_step: int = 1
    atr_window: int = 14
    trend_up: float = 0.2
    trend_down: float = -0.2
    volatility_percentile: float = 0.67
    hurst_threshold: float = 0.55
    hurst_range: tuple[float, float] = (0.45, 0.55)
    lo_confidence: float = 0.95
    lo_lags: int | None = None
    fractal_method: str = "accumulate"
    tail_window: int = 252
    var_alpha: float = 0.95
    cvar_alpha: float = 0.95
    hill_fraction: float = 0.10
    hill_min: int = 5
    fragile_cvar: float = 0.04
    stressed_cvar: float = 0.02
    fragile_tail: float = 3.0
    stressed_tail: float = 4.0
    fragile_drawdown: float = -0.15
    stressed_drawdown: float = -0.07
    fuzzy_trend_range: tuple[float, float] = (-3.0, 3.0)
    fuzzy_vol_range: tuple[float, float] = (0.0, 0.5)
    fuzzy_percentile_range: tuple[float, float] = (0.0, 1.0)
    fuzzy_source: str = "volatility"
    adaptive_window: int = 252
    adaptive_up: float = 0.70
    adaptive_down: float = 0.30
    adaptive_floor: float = 0.10
    ewma_halflife: float = 20.0
    bocpd_run_length: float = 100.0
    bocpd_df_cap: float | None = None
    #: Runs of a smaller posterior mass are forgotten; None keeps all runs, which takes time quadratic in the bars.
    bocpd_least_mass: float | None = None
    dsm_omega: float = 1.0
    dsm_bandwidth: float = 3.0
    dsm_varx: float | None = None
    causal_varx: bool = False
    consensus_window: int = 5
    consensus_drop: float = 30.0
    consensus_jump: float = 0.3
    consensus_cooldown: int = 10
    min_dwell: int = 1
    horizons: tuple[int, ...] = (5, 10)
    fill: str = "ffill"
    timezone: str = "UTC"

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        """Every rule is (holds, message); the first that does not hold is raised."""
        windows = ("trend_window", "volatility_window", "percentile_lookback", "baseline_window", "hurst_window", "atr_window", "tail_window", "adaptive_window")
        rules = [(getattr(self, w) > 0, f"{w} must be positive") for w in windows]
        rules += [(0 < getattr(self, s) < 1, f"{s} must lie between 0 and 1") for s in ("volatility_percentile", "hurst_threshold", "var_alpha", "cvar_alpha", "hill_fraction")]
        rules += [(getattr(self, r)[0] < getattr(self, r)[1], f"{r} must rise") for r in ("fuzzy_trend_range", "fuzzy_vol_range", "fuzzy_percentile_range")]
        rules += [(getattr(self, p) > 0, f"{p} must be positive") for p in ("fragile_cvar", "stressed_cvar", "fragile_tail", "stressed_tail", "trend_up", "ewma_halflife")]
        rules += [(getattr(self, n) < 0, f"{n} must be negative") for n in ("trend_down", "fragile_drawdown", "stressed_drawdown")]
        rules += [
            (self.volatility_method in {"std", "ewm", "parkinson", "realized"}, "volatility_method must be std, ewm, parkinson or realized"),
            (self.lo_confidence in {0.90, 0.95, 0.99}, "lo_confidence must be 0.90, 0.95 or 0.99"),
            (self.lo_lags is None or self.lo_lags >= 0, "lo_lags must not be negative"),
            (self.hill_min > 1, "hill_min must be greater than 1"),
            (self.fuzzy_source in {"volatility", "raw", "percentile", "volatility_percentile"}, "fuzzy_source is unknown"),
            (self.fill in {"ffill", "drop", "interpolate"}, "fill must be ffill, drop or interpolate"),
            (self.hurst_method in {"structure", "rs", "dfa"}, "hurst_method must be structure, rs or dfa"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        return cls(**values)

    @classmethod
    def crypto(cls) -> Config:
        """Round-the-clock markets: shorter windows, wider tails."""
        return cls(
            trend_window=14, volatility_window=14, hurst_window=75, baseline_window=75, volatility_percentile=0.75, tail_window=120,
            fragile_cvar=0.07, stressed_cvar=0.04, fragile_tail=2.5, stressed_tail=3.5, fragile_drawdown=-0.25, stressed_drawdown=-0.12,
        )

    @property
    def warmup_bars(self) -> int:
        return max(1, self.trend_window, self.volatility_window, self.percentile_lookback, self.hurst_window, self.tail_window)


# Presets (asset class, overrides): fixed values.
PROFILES = {
    "equity_index_h1": ("equity_index", {"timeframe": "1h", "trend_window": 48, "volatility_window": 48, "percentile_lookback": 500, "baseline_window": 250, "hurst_window": 240, "tail_window": 500}),
    "equity_index_h4": ("equity_index", {"timeframe": "4h", "trend_window": 30, "volatility_window": 30, "percentile_lookback": 250, "baseline_window": 125, "hurst_window": 180, "tail_window": 250}),
    "gold_h4": ("gold", {"timeframe": "4h", "trend_window": 30, "volatility_window": 30, "percentile_lookback": 250, "baseline_window": 125, "hurst_window": 180, "tail_window": 250}),
    "crypto_h4": ("crypto", {"timeframe": "4h", "trend_window": 36, "volatility_window": 36, "percentile_lookback": 360, "baseline_window": 180, "hurst_window": 240, "tail_window": 360}),
    "fx_daily": ("fx", {"timeframe": "1d", "trend_window": 20, "volatility_window": 20, "percentile_lookback": 252, "baseline_window": 100, "hurst_window": 100, "tail_window": 252}),
}


def available_profiles() -> tuple[str, ...]:
    return tuple(sorted(PROFILES))


def with_profile(config: Config, name: str) -> Config:
    """The configuration with a preset's windows; presets judge volatility by percentile."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(available_profiles())}")
    return replace(config, fuzzy_source="volatility_percentile", **PROFILES[name][1])
