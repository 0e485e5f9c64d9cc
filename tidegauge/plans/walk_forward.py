"""Walk-forward report: strategies over recent windows, under neighbouring parameters too, and whether to promote the overlay."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import backtest as B
from tidegauge.schema import NEIGHBOURS, REBOUND_PROFILES, WALK_FORWARD_WINDOWS, ReboundProfile


#: Least value of parameters that count bars or exposure.
_FLOORS = {"rebound_exposure": 0.0, "fast_window": 1, "drawdown_lookback": 1, "drawdown_gate_lookback": 1, "max_holding": 1}
_CHANGES = {"add": lambda now, amount: now + amount, "cap": min, "set": lambda now, amount: amount}


def neighbours(profile: ReboundProfile) -> dict[str, ReboundProfile]:
    """The profile under each set of changes in NEIGHBOURS; what a profile leaves open starts from the usual value."""
    usual = ReboundProfile(profile.enabled)

    def changed(name: str, how: str, amount: float | bool) -> float | bool:
        now = getattr(profile, name)
        value = _CHANGES[how](getattr(usual, name) if now is None else now, amount)
        return max(_FLOORS[name], value) if name in _FLOORS else value

    return {variant: replace(profile, **{name: changed(name, *change) for name, change in changes.items()}) for variant, changes in NEIGHBOURS.items()}


def common_end(df: DataFrame) -> str:
    """The last date that every symbol has reached."""
    last = df.groupBy("symbol").agg(F.max("ts").alias("last")).agg(F.min("last")).first()[0]
    if last is None:
        raise ValueError("there are no bars")
    return str(last)[:10]


def report(
    df: DataFrame, groups: dict[str, tuple[str, ...]], eligible: tuple[str, ...] = ("indices", "mega_cap_tech"), protected: tuple[str, ...] = ("diversifiers", "crypto"), cost_bps: float = 5.0,
    profiles: dict[str, ReboundProfile] | None = None, end: str | None = None, specs: tuple = WALK_FORWARD_WINDOWS,
) -> dict[str, DataFrame]:
    """comparison, summary, promotion of labelled bars; ``df`` is read once per parameter set, so persist or write it first."""
    profiles = profiles or REBOUND_PROFILES
    windows = B.recent_windows(df.sparkSession, end or common_end(df), specs)
    run = lambda changed: B.walk_forward(df, windows, groups, changed, cost_bps)
    comparison = run(profiles)
    variants = {name: run({g: neighbours(p)[name] if p.enabled else p for g, p in profiles.items()}) for name in NEIGHBOURS}
    return {
        "comparison": B.narrative_alignment(comparison),
        "summary": B.summarise_groups(comparison),
        "promotion": B.research_promotion(comparison, eligible, protected, variants, least_cost_bps=cost_bps),
    }
