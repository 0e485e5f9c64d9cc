"""DuckDB text of the engine's plans: the same bars, features and labels as common table expressions.

Used only to check results: every registered query has its own final SELECT over these.
"""

from __future__ import annotations

from tidegauge.schema import BETTER_BY, DEFAULT_EXPOSURE, REGIME_NAMES, REGIMES, ReboundProfile

P = "PARTITION BY symbol ORDER BY ts"
ALL = f"({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prev(n: int) -> str:
    return f"({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def gate(value: str, counted: str, least: int, frame: str) -> str:
    return f"CASE WHEN count({counted}) OVER {frame} >= {least} THEN {value} END"


def bars(name: str, observed: str) -> str:
    return f"""{name}_obs AS ({observed}),
{name}_r AS (SELECT *, round(coalesce(0.01 * (c - avg(c) OVER (PARTITION BY symbol)) / nullif(stddev_samp(c) OVER (PARTITION BY symbol), 0), 0.0), 9) AS r FROM {name}_obs),
{name}_p AS (SELECT *, round(100 * exp(sum(r) OVER {ALL}), 8) AS close FROM {name}_r),
{name}_o AS (SELECT *, coalesce(lag(close) OVER ({P}), close) AS open FROM {name}_p),
{name} AS (SELECT symbol, ts, open, round(greatest(open, close) * exp(0.005 * abs(r) / 0.01), 6) AS high, round(least(open, close) / exp(0.005 * abs(r) / 0.01), 6) AS low, close, volume FROM {name}_o)"""


def labelled(name: str, source: str, w: int = 20, look: int = 252, base: int = 100, high: float = 0.67) -> str:
    least_p, least_b, least_z = min(look, max(20, look // 10)), min(base, max(20, base // 5)), min(look, 20)
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIME_NAMES.items())
    return f"""{name}_a AS (SELECT *, ln(close) AS log_price, ln(close) - lag(ln(close)) OVER ({P}) AS log_return, close / lag(close) OVER ({P}) - 1 AS ret, row_number() OVER ({P}) AS rn FROM {source}),
{name}_b AS (SELECT *, {gate(f"regr_slope(log_price, CAST(rn AS DOUBLE)) OVER {roll(w)}", "log_price", w // 2, roll(w))} AS slope,
  {gate(f"stddev_samp(log_return) OVER {roll(w)}", "log_return", w // 2, roll(w))} AS volatility,
  {gate(f"sum(log_return * log_return) OVER {roll(w)}", "log_return", w // 2, roll(w))} AS realized_variance FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN volatility IS NOT NULL THEN slope / greatest(volatility, 1e-8) END AS trend_strength, list(volatility) OVER {roll(look)} AS vols, count(*) OVER {roll(look)} AS nrows,
  count(volatility) OVER {roll(look)} AS nvols FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN trend_strength IS NULL THEN 'Unknown' WHEN trend_strength > 0.2 THEN 'Up' WHEN trend_strength < -0.2 THEN 'Down' ELSE 'Sideways' END AS trend_regime,
  CASE WHEN nvols >= {least_p} THEN CASE WHEN volatility IS NULL THEN 0.0 ELSE CAST(len(list_filter(vols, lambda x: x < volatility)) AS DOUBLE) / nrows END END AS volatility_percentile,
  {gate(f"avg(volatility) OVER {roll(base)}", "volatility", least_b, roll(base))} AS volatility_baseline,
  {gate(f"stddev_samp(volatility) OVER {roll(w)}", "volatility", w // 2, roll(w))} AS vol_of_vol,
  volatility / nullif(lag(volatility) OVER ({P}), 0) - 1 AS volatility_change,
  {gate(f"(volatility - avg(volatility) OVER {roll(look)}) / nullif(stddev_samp(volatility) OVER {roll(look)}, 0)", "volatility", least_z, roll(look))} AS volatility_zscore FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN volatility_percentile IS NULL THEN 'Unknown' WHEN volatility_percentile > {high} THEN 'High' ELSE 'Low' END AS volatility_regime FROM {name}_d),
{name}_f AS (SELECT *, CASE WHEN trend_regime = 'Unknown' OR volatility_regime = 'Unknown' THEN 'Unknown' ELSE trend_regime || '-' || volatility_regime || 'Vol' END AS regime FROM {name}_e),
{name} AS (SELECT *, CASE regime {names} ELSE 'Unknown' END AS regime_name FROM {name}_f)"""


def piecewise(x: str, points: list[tuple[float, float]], outside: str) -> str:
    """Linear interpolation through the points; ``outside`` is where it is 0."""
    parts = " ".join(f"WHEN {x} <= {b} THEN {ya} + ({yb} - {ya}) * ({x} - ({a})) / ({b} - ({a}))" for (a, ya), (b, yb) in zip(points, points[1:], strict=False))
    return f"CASE WHEN {outside} THEN 0.0 {parts} END"


def fuzzy(name: str, source: str, vol: str = "volatility", top: float = 0.5) -> str:
    mid = top / 2
    t = {
        "Up": piecewise("trend_strength", [(0.1, 0.0), (0.5, 1.0), (3.0, 1.0)], "trend_strength <= 0.1 OR trend_strength > 3.0"),
        "Sideways": piecewise("trend_strength", [(-0.3, 0.0), (0.0, 1.0), (0.3, 0.0)], "trend_strength <= -0.3 OR trend_strength >= 0.3"),
        "Down": piecewise("trend_strength", [(-3.0, 1.0), (-0.5, 1.0), (-0.1, 0.0)], "trend_strength < -3.0 OR trend_strength >= -0.1"),
    }
    v = {
        "LowVol": piecewise(vol, [(0.0, 1.0), (0.6 * mid, 1.0), (1.2 * mid, 0.0)], f"{vol} < 0 OR {vol} >= {1.2 * mid}"),
        "HighVol": piecewise(vol, [(0.8 * mid, 0.0), (1.4 * mid, 1.0), (top, 1.0)], f"{vol} <= {0.8 * mid} OR {vol} > {top}"),
    }
    col = lambda r: "m_" + r.replace("-", "_").lower()
    out = lambda r: "fuzzy_" + r.replace("-", "_").lower()
    known = f"trend_strength IS NOT NULL AND {vol} IS NOT NULL"
    raw = ", ".join(f"CASE WHEN {known} THEN least({t[r.split('-')[0]]}, {v[r.split('-')[1]]}) ELSE 0.0 END AS {col(r)}" for r in REGIMES)
    total = " + ".join(col(r) for r in REGIMES)
    share = ", ".join(f"CASE WHEN NOT ({known}) THEN 0.0 WHEN {total} > 1e-8 THEN {col(r)} / ({total}) ELSE 1.0 / 6 END AS {out(r)}" for r in REGIMES)
    most = f"greatest({', '.join(out(r) for r in REGIMES)})"
    first = "CASE " + " ".join(f"WHEN round({out(r)}, 12) = round({most}, 12) THEN '{r}'" for r in REGIMES) + " END"
    entropy = " + ".join(f"CASE WHEN {out(r)} > 0 THEN -{out(r)} * ln({out(r)}) ELSE 0.0 END" for r in REGIMES)
    return f"""{name}_m AS (SELECT *, {raw} FROM {source}), {name}_s AS (SELECT *, {share} FROM {name}_m),
{name} AS (SELECT *, {first} AS fuzzy_primary_regime, {most} AS fuzzy_confidence, {entropy} AS fuzzy_entropy FROM {name}_s)"""


def exposure(column: str, weights: dict[str, float] | None = None) -> str:
    weights = DEFAULT_EXPOSURE if weights is None else weights
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 0.0 END"


def positions(name: str, source: str, target: str, keys: str = "symbol", cost_bps: float = 0.0) -> str:
    w = f"(PARTITION BY {keys} ORDER BY ts)"
    return f"""{name}_t AS (SELECT *, coalesce(close / lag(close) OVER {w} - 1, 0.0) AS asset_return, CAST({target} AS DOUBLE) AS target_exposure FROM {source}),
{name}_q AS (SELECT *, coalesce(lag(target_exposure) OVER {w}, 0.0) AS position FROM {name}_t),
{name}_u AS (SELECT *, abs(position - coalesce(lag(position) OVER {w}, 0.0)) AS turnover FROM {name}_q),
{name} AS (SELECT *, position * asset_return AS gross_return, turnover * {cost_bps} / 10000.0 AS cost, position * asset_return - turnover * {cost_bps} / 10000.0 AS strategy_return FROM {name}_u)"""


def metrics(name: str, source: str, regime: str, keys: str = "symbol", extra: str = "") -> str:
    w = f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    share = lambda test: f"coalesce(100.0 * count(*) FILTER (WHERE {test}) / nullif(count({regime}), 0), 0.0)"
    return f"""{name}_e AS (SELECT *, product(1 + strategy_return) OVER {w} AS es, product(1 + asset_return) OVER {w} AS eb FROM {source}),
{name}_d AS (SELECT *, es / max(es) OVER {w} - 1 AS ds, eb / max(eb) OVER {w} - 1 AS db FROM {name}_e),
{name}_g AS (SELECT {keys}, count(*) AS observations, min(ts) AS start_date, max(ts) AS end_date, product(1 + strategy_return ORDER BY ts) - 1 AS strategy_return, product(1 + gross_return ORDER BY ts) - 1 AS gross_strategy_return,
  product(1 + asset_return ORDER BY ts) - 1 AS buy_hold_return, sum(cost) AS total_transaction_cost, sum(turnover) AS turnover, avg(position) AS mean_exposure, arg_max({regime}, ts) AS latest_regime, arg_max(position, ts) AS latest_position,
  min(ds) AS max_drawdown_strategy, min(db) AS max_drawdown_buy_hold,
  {share(f"starts_with({regime}, 'Bull') OR starts_with({regime}, 'Up')")} AS bull_share, {share(f"starts_with({regime}, 'Bear') OR starts_with({regime}, 'Down')")} AS bear_share,
  {share(f"starts_with({regime}, 'Sideways')")} AS sideways_share, {share(f"ends_with({regime}, 'Volatile') OR ends_with({regime}, 'HighVol')")} AS high_vol_share,
  {share(f"ends_with({regime}, 'Quiet') OR ends_with({regime}, 'LowVol')")} AS low_vol_share{extra} FROM {name}_d GROUP BY {keys}),
{name} AS (SELECT *, strategy_return - buy_hold_return AS excess_return,
  CASE WHEN buy_hold_return >= 0.05 THEN 'risk_on_rebound' WHEN buy_hold_return <= -0.05 THEN 'risk_off_selloff' ELSE 'choppy_or_rangebound' END AS market_story,
  CASE WHEN mean_exposure < 0.33 THEN 'defensive' WHEN mean_exposure > 0.66 THEN 'fully_invested' ELSE 'selective' END AS strategy_posture,
  CASE WHEN strategy_return - buy_hold_return > 0.01 THEN 'outperformed' WHEN strategy_return - buy_hold_return < -0.01 THEN 'lagged' ELSE 'matched' END AS relative_result FROM {name}_g)"""


def guarded(name: str, source: str, hold: int, stop: float) -> str:
    """Trades on raw_overlay of a materialised source, bar by bar: held, stopped, expired."""
    stopped = f"(g.entry IS NOT NULL AND coalesce(s.close / g.entry - 1 <= {stop}, false))"
    expired = f"(g.entry IS NOT NULL AND g.age >= {hold})"
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE g AS (
  SELECT symbol, rn, raw_overlay AS held, false AS stopped, false AS expired, CASE WHEN raw_overlay THEN close END AS entry, 1 AS age FROM {source} WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, held, stopped, expired, CASE WHEN held THEN coalesce(entry, close) END, CASE WHEN entry IS NULL THEN 1 ELSE age + 1 END FROM (
    SELECT s.symbol, s.rn, s.close, g.entry, g.age, {stopped} AS stopped, {expired} AS expired, s.raw_overlay AND NOT {stopped} AND NOT {expired} AS held FROM g JOIN {source} s ON s.symbol = g.symbol AND s.rn = g.rn + 1))
  SELECT * FROM g)"""


FLAGS = ("rebound_signal", "drawdown_gate", "survival_gate", "raw_overlay", "overlay_active", "overlay_stop", "overlay_expired")


def overlay_signals(name: str, p: ReboundProfile, where: str = "true") -> str:
    """The labelled bars with the signals of a profile that looks at no survival label."""
    fast, low, gate_ = roll(p.fast_window), roll(p.drawdown_lookback), roll(p.drawdown_gate_lookback)
    fell = f"coalesce(CASE WHEN count(fall) OVER {gate_} >= 2 THEN min(fall) OVER {gate_} END <= {p.min_prior_drawdown}, false)" if p.require_prior_drawdown else "true"
    return f"""{name}_a AS (SELECT *, close / {gate("min(close) OVER " + low, "close", p.fast_window, low)} - 1 AS up, close / lag(close, {p.fast_window}) OVER ({P}) - 1 AS fast, {gate("avg(close) OVER " + fast, "close", p.fast_window, fast)} AS ma,
  CASE WHEN count(close) OVER {gate_} >= 2 THEN close / max(close) OVER {gate_} - 1 END AS fall FROM lab WHERE {where}),
{name}_b AS (SELECT *, coalesce(up >= {p.min_rebound} AND fast >= {p.min_fast_return} AND close >= ma, false) AS rebound_signal, {fell} AS drawdown_gate, true AS survival_gate FROM {name}_a),
{name} AS MATERIALIZED (SELECT *, rebound_signal AND drawdown_gate AND {exposure("regime_name")} < {p.rebound_exposure} AS raw_overlay FROM {name}_b)"""


def group_bars(name: str, groups: dict[str, tuple[str, ...]], profiles: dict[str, ReboundProfile], cost_bps: float) -> str:
    """Bars of both variants with their group; every symbol is in one of the groups or in 'other', which has no overlay."""
    quoted = lambda members: ", ".join(f"'{m}'" for m in members)
    group = "CASE " + " ".join(f"WHEN symbol IN ({quoted(m)}) THEN '{g}'" for g, m in groups.items()) + " ELSE 'other' END"
    same = "symbol, ts, rn, close, asset_return, position, gross_return, turnover, cost, strategy_return"
    none = ", ".join(f"false AS {f}" for f in FLAGS)
    ctes = [positions(f"{name}_now", "lab", exposure("regime_name"), cost_bps=cost_bps)]
    plain = f"SELECT {same}, regime_name AS evaluated_regime, {group} AS grp, '{{}}' AS variant, false AS overlay_enabled, {none} FROM {name}_now"
    parts = [plain.format("current")]
    live = {g: m for g, m in groups.items() if profiles[g].enabled}
    for i, (g, members) in enumerate(live.items()):
        n, p = f"{name}_{i}", profiles[g]
        weight = exposure("evaluated_regime").replace("ELSE 0.0", f"WHEN 'Rebound Overlay' THEN {p.rebound_exposure} ELSE 0.0")
        joined = f"SELECT s.*, g.held AS overlay_active, g.stopped AS overlay_stop, g.expired AS overlay_expired, CASE WHEN g.held THEN 'Rebound Overlay' ELSE s.regime_name END AS evaluated_regime FROM {n}_s s JOIN {n}_g g USING (symbol, rn)"
        ctes += [overlay_signals(f"{n}_s", p, f"symbol IN ({quoted(members)})"), guarded(f"{n}_g", f"{n}_s", p.max_holding, p.stop_loss), f"{n}_j AS ({joined})", positions(f"{n}_p", f"{n}_j", weight, cost_bps=cost_bps)]
        parts.append(f"SELECT {same}, evaluated_regime, '{g}' AS grp, 'group_rebound' AS variant, true AS overlay_enabled, {', '.join(FLAGS)} FROM {n}_p")
    away = ", ".join(quoted(m) for m in live.values())
    parts.append(plain.format("group_rebound") + (f" WHERE symbol NOT IN ({away})" if away else ""))
    return ",\n".join([*ctes, f"{name} AS (" + "\nUNION ALL ".join(parts) + ")"])


def group_metrics(name: str, source: str, cost_bps: float, keys: str = "symbol") -> str:
    """Metrics of both variants with counts and differences, per symbol, and per window if it is among the keys."""
    counts = "".join(f", count(*) FILTER (WHERE {f}) AS {f}_count" for f in FLAGS)
    current = lambda c: f"{c} - max(CASE WHEN variant = 'current' THEN {c} END) OVER (PARTITION BY {keys})"
    return metrics(f"{name}_m", source, "evaluated_regime", f"{keys}, grp, variant, overlay_enabled", counts) + f""",
{name} AS (SELECT *, {cost_bps} AS transaction_cost_bps, {current("strategy_return")} AS strategy_return_delta_vs_current, {current("max_drawdown_strategy")} AS drawdown_delta_vs_current,
  variant = 'group_rebound' AND {current("strategy_return")} > {BETTER_BY} AS improved_vs_current FROM {name}_m)"""


def ewm_std(name: str, source: str, alpha: str, adjust: bool, least: int, keys: str = "symbol") -> str:
    """ewm of a materialised source (keys, n from 1, x): weighted deviation from raw moments."""
    same = " AND ".join(f"s.{k} = r.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    a = f"(1 - {alpha})"
    w = "1.0" if adjust else alpha
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE r AS (SELECT {keys}, n, 1.0::DOUBLE AS s0, x AS s1, x * x AS s2, 1.0::DOUBLE AS q FROM {source} WHERE n = 1
  UNION ALL SELECT {own}, s.n, r.s0 * {a} + {w}, r.s1 * {a} + {w} * s.x, r.s2 * {a} + {w} * s.x * s.x, r.q * {a} * {a} + {w} * {w} FROM r JOIN {source} s ON {same} AND s.n = r.n + 1)
  SELECT {keys}, n, CASE WHEN n >= {least} AND s0 * s0 > q THEN sqrt(greatest(0.0, (s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q))) END AS ewm FROM r)"""


BASE = ",\n".join(
    [
        bars("li", "SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, round(avg(l_extendedprice / l_quantity), 6) AS c, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2"),
        bars("ev", "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS c, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2"),
        labelled("lab", "li"),
        labelled("evlab", "ev"),
        fuzzy("fz", "lab"),
        fuzzy("fzp", "lab", "volatility_percentile", 1.0),
        positions("pos", "lab", exposure("regime_name")),
        positions("posc", "lab", exposure("regime_name"), cost_bps=10.0),
        metrics("met", "posc", "regime_name"),
    ]
)
