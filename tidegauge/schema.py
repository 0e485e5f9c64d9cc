"""Fixed values shared by the operators: labels, names, exposures, symbol tables, overlay profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

# Regime labels, in the order in which ties are resolved: fixed values.
REGIMES = ("Up-LowVol", "Up-HighVol", "Sideways-LowVol", "Sideways-HighVol", "Down-LowVol", "Down-HighVol")
REGIME_NAMES = {
    "Up-LowVol": "Bull Quiet",
    "Up-HighVol": "Bull Volatile",
    "Sideways-LowVol": "Sideways Quiet",
    "Sideways-HighVol": "Sideways Volatile",
    "Down-LowVol": "Bear Quiet",
    "Down-HighVol": "Bear Volatile",
}
UNKNOWN = "Unknown"
#: One strategy's return is better or worse than another's only by more than this: products of the same returns may
#: differ by rounding.
BETTER_BY = 1e-9

# Long-only weights per regime and the alternatives that a sweep compares: fixed values.
DEFAULT_EXPOSURE = {"Bull Quiet": 1.0, "Bull Volatile": 0.75, "Sideways Quiet": 0.25, "Sideways Volatile": 0.0, "Bear Quiet": 0.0, "Bear Volatile": 0.0}
DEFAULT_EXPOSURE |= {label: DEFAULT_EXPOSURE[name] for label, name in REGIME_NAMES.items()}
EXPOSURE_MAPS = {
    "current": {"Bull Quiet": 1.0, "Bull Volatile": 0.75, "Sideways Quiet": 0.25, "Sideways Volatile": 0.0, "Bear Quiet": 0.0, "Bear Volatile": 0.0},
    "aggressive": {"Bull Quiet": 1.0, "Bull Volatile": 1.0, "Sideways Quiet": 0.5, "Sideways Volatile": 0.25, "Bear Quiet": 0.0, "Bear Volatile": 0.0},
    "defensive": {"Bull Quiet": 1.0, "Bull Volatile": 0.5, "Sideways Quiet": 0.0, "Sideways Volatile": 0.0, "Bear Quiet": 0.0, "Bear Volatile": 0.0},
    "binary_bull": {"Bull Quiet": 1.0, "Bull Volatile": 1.0, "Sideways Quiet": 0.0, "Sideways Volatile": 0.0, "Bear Quiet": 0.0, "Bear Volatile": 0.0},
}

# Story by posture -> how well they fit: fixed values.
NARRATIVE_FIT = {
    ("risk_on_rebound", "fully_invested"): 1.0,
    ("risk_on_rebound", "selective"): 0.7,
    ("risk_on_rebound", "defensive"): 0.0,
    ("risk_off_selloff", "defensive"): 1.0,
    ("risk_off_selloff", "selective"): 0.6,
    ("risk_off_selloff", "fully_invested"): 0.0,
    ("choppy_or_rangebound", "selective"): 1.0,
    ("choppy_or_rangebound", "defensive"): 0.7,
    ("choppy_or_rangebound", "fully_invested"): 0.2,
}

# Calendar windows counted back from the last bar (name, first day, last day): fixed values.
WALK_FORWARD_WINDOWS = (("recent_1m", 31, 0), ("prior_3m", 123, 92), ("prior_6m", 214, 183), ("prior_12m", 396, 365))

# Symbols with a liquid implied-volatility index: fixed values.
VOL_INDEX = {
    "GC=F": "^GVZ", "GLD": "^GVZ", "IAU": "^GVZ", "XAUUSD": "^GVZ", "XAUUSD=X": "^GVZ",
    "SPY": "^VIX", "IVV": "^VIX", "VOO": "^VIX", "^GSPC": "^VIX", "ES=F": "^VIX",
    "QQQ": "^VXN", "^IXIC": "^VXN", "NQ=F": "^VXN", "IWM": "^RVX", "^RUT": "^RVX",
    "DIA": "^VXD", "^DJI": "^VXD", "CL=F": "^OVX", "USO": "^OVX", "BZ=F": "^OVX",
}
CRYPTO_TICKERS = (
    "ADA", "ARB", "ATOM", "AVAX", "BCH", "BNB", "BTC", "DOGE", "DOT", "ETH", "ETC", "FIL",
    "ICP", "LINK", "LTC", "MATIC", "NEAR", "OP", "SOL", "TRX", "XLM", "XMR", "XRP",
)
# Period -> (bar interval, days) for exchange bars: fixed values.
PERIODS = {"1d": ("1m", 1), "5d": ("5m", 5), "1mo": ("1h", 30), "3mo": ("4h", 90), "6mo": ("1d", 180), "1y": ("1d", 365), "2y": ("1d", 730)}

# Half-lives and expected run lengths by asset class: fixed values.
HALFLIFE = {"equity": 25.0, "fx": 12.0, "crypto": 10.0, "commodity": 18.0}
RUN_LENGTH = {"equity": 250.0, "fx": 150.0, "commodity": 100.0, "crypto": 75.0}
HALFLIFE_GRID = (5, 8, 10, 12, 15, 18, 20, 25, 30, 40, 50)

# Critical values of the modified rescaled range by confidence level: fixed values.
LO_BANDS = {0.90: (0.861, 1.747), 0.95: (0.809, 1.862), 0.99: (0.721, 2.098)}


@dataclass(frozen=True)
class ReboundProfile:
    """Rebound overlay parameters of one asset group; a disabled profile still has all of them. Defaults: fixed values."""

    enabled: bool
    rebound_exposure: float = 0.75
    fast_window: int = 5
    drawdown_lookback: int = 20
    min_rebound: float = 0.03
    min_fast_return: float = 0.02
    require_above_fast_ma: bool = True
    require_prior_drawdown: bool = False
    drawdown_gate_lookback: int = 20
    min_prior_drawdown: float = -0.05
    max_holding: int | None = 5
    stop_loss: float | None = -0.03
    require_survival_guard: bool = True
    fragile: tuple[str, ...] = ("Fragile",)


# Profiles by asset group: fixed values.
REBOUND_PROFILES = {
    "indices": ReboundProfile(True, min_rebound=0.03, require_prior_drawdown=True, min_prior_drawdown=-0.05, stop_loss=-0.03),
    "mega_cap_tech": ReboundProfile(True, min_rebound=0.035, require_prior_drawdown=True, min_prior_drawdown=-0.06, stop_loss=-0.04),
    "diversifiers": ReboundProfile(False, rebound_exposure=0.50, fast_window=7, drawdown_lookback=30, min_rebound=0.04, min_fast_return=0.015),
    "crypto": ReboundProfile(False, rebound_exposure=0.50, fast_window=7, drawdown_lookback=30, min_rebound=0.08, min_fast_return=0.04),
    "other": ReboundProfile(False),
}

# Neighbouring profiles, as (what to do, amount) per parameter: fixed values.
NEIGHBOURS = {
    "lower_exposure": {"rebound_exposure": ("cap", 0.50)},
    "slower_confirmation": {"fast_window": ("add", 2), "drawdown_lookback": ("add", 10), "min_rebound": ("add", 0.02), "min_fast_return": ("add", 0.01)},
    "stricter_risk_gate": {"require_prior_drawdown": ("set", True), "drawdown_gate_lookback": ("add", 10), "min_prior_drawdown": ("cap", -0.08), "max_holding": ("add", -2), "stop_loss": ("cap", -0.04)},
}
