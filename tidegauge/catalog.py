"""Registered queries of the engine, each beside its DuckDB counterpart where SQL can express it.

A column list such as "symbol ts:t slope:d n:i" names what both sides return: t a time as text, d a double rounded
to eight places (e: ten, f: six), i a long, anything else as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import oracles as O
from tidegauge.config import Config
from tidegauge.functions.durable import shared_dir
from tidegauge.functions.frames import order, rolling
from tidegauge.operators import analytics as A
from tidegauge.operators import backtest as B
from tidegauge.operators import features as X
from tidegauge.operators import channels, folds, lookups, outlook, scans
from tidegauge.operators import regimes as R
from tidegauge.plans import walk_forward
from tidegauge.plans.analysis import by_source, crisp_labels, labelled
from tidegauge.plans.refresh import Refresher
from tidegauge.schema import BETTER_BY, EXPOSURE_MAPS, HALFLIFE, HALFLIFE_GRID, LO_BANDS, NEIGHBOURS, REBOUND_PROFILES, REGIMES, RUN_LENGTH, VOL_INDEX, WALK_FORWARD_WINDOWS, ReboundProfile
from tidegauge.sources import bars as S
from tidegauge.sources.sinks import daily_projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CFG = Config()
FUZZY = [R.fuzzy_name(r) for r in REGIMES]
HORIZONS = (5, 10)
GROUPS = {"indices": ("A",), "mega_cap_tech": ("N",), "crypto": ("R",)}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(c.split(":")[0], c.split(":")[1] if ":" in c else "") for c in spec.split()]


def shown(df: DataFrame, spec: str) -> DataFrame:
    as_spark = {
        "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "d": lambda c: F.round(F.col(c).cast("double"), 8), "e": lambda c: F.round(F.col(c).cast("double"), 10),
        "f": lambda c: F.round(F.col(c).cast("double"), 6),
        "i": lambda c: F.col(c).cast("long"), "": F.col,
    }
    return df.select(*[as_spark[k](c).alias(c) for c, k in _columns(spec)])


def shown_sql(source: str, spec: str, ctes: str = "") -> str:
    as_sql = {"t": "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}", "d": "round(CAST({0} AS DOUBLE), 8) + 0.0 AS {0}", "e": "round(CAST({0} AS DOUBLE), 10) + 0.0 AS {0}", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "i": "CAST({0} AS BIGINT) AS {0}", "": "{0}"}
    quoted = [as_sql[kind].format(f'"{c}"') for c, kind in _columns(spec)]  # some names are SQL words
    more = f",\n{ctes}" if ctes else ""
    return f"WITH {O.BASE}{more}\nSELECT {', '.join(quoted)} FROM ({source}) AS final"


def register(name: str, spec: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(make(spark, sf_dir), spec)
    if sql is not None:
        ORACLES[name] = shown_sql(sql, spec, ctes)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.numbered(S.with_returns(S.daily_bars(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(S.daily_bars(spark, sf_dir), CFG)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(S.hourly_bars(spark, sf_dir), CFG)


# --- sources -----------------------------------------------------------------------------------------------------

OHLC = "symbol ts:t open:d high:d low:d close:d volume:d"
register("bars_daily", OHLC, S.daily_bars, "SELECT * FROM li")
register("bars_hourly", OHLC, S.hourly_bars, "SELECT * FROM ev")
register(
    "bars_ticks", OHLC,
    lambda s, d: S.tick_bars(s.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "symbol").where("value is not null"), "value"),
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, {'t': ts, 'e': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'t': ts, 'e': event_id}) AS close,
       count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with holes and repeated rows, for the cleaning operators: the repeat arrives later, with another close."""
    b = X.numbered(S.hourly_bars(spark, sf_dir)).withColumn("close", F.when(F.col("rn") % 7 != 3, F.col("close"))).withColumn("arrived", F.lit(1))
    again = b.where("rn % 11 = 5").withColumns({"close": F.col("close") / 2, "volume": F.col("volume") + 1, "arrived": F.lit(2)})
    unknown = b.where("rn % 13 = 6").withColumns({"close": F.lit(1.0), "arrived": F.lit(None).cast("int")})
    return b.unionByName(again).unionByName(unknown)


GAPPY = """gap AS (SELECT symbol, ts, open, high, low, CASE WHEN rn % 7 <> 3 THEN close END AS close, volume, rn, 1 AS arrived FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ev)),
dup AS (SELECT * FROM gap UNION ALL SELECT symbol, ts, open, high, low, close / 2, volume + 1, rn, 2 FROM gap WHERE rn % 11 = 5 UNION ALL SELECT symbol, ts, open, high, low, 1.0, volume, rn, NULL FROM gap WHERE rn % 13 = 6),
ded AS (SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY arrived NULLS LAST) = 1)"""
for _fill, _close in (
    ("ffill", f"last_value(close IGNORE NULLS) OVER {O.ALL}"),
    ("interpolate", None),
    ("drop", ""),
):
    if _close == "":
        _sql = "SELECT * FROM ded WHERE close IS NOT NULL"
    elif _close is None:
        _close = f"""coalesce(close, a + (b - a) * CAST(rn - lo AS DOUBLE) / nullif(hi - lo, 0), a)"""
        _sql = f"""SELECT symbol, ts, open, {_close} AS close, volume FROM (SELECT *, last_value(close IGNORE NULLS) OVER {O.ALL} AS a, last_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER {O.ALL} AS lo,
          first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
          first_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM ded)"""
    else:
        _sql = f"SELECT symbol, ts, open, {_close} AS close, volume FROM ded"
    register(f"bars_{_fill}_dedup", "symbol ts:t open:d close:e volume:d", lambda s, d, fill=_fill: S.clean(gappy(s, d), fill, "arrived"), _sql, GAPPY)
register("log_returns", "symbol ts:t log_price:d log_return:d return:d", returns, 'SELECT *, ret AS "return" FROM lab_a')
register("latest_price", "symbol ts:t close:d", lambda s, d: S.latest_price(S.daily_bars(s, d)), "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM li GROUP BY 1")
#: What the words of part names become, {} being the word or its number: stocks, indices, futures, currencies and pairs.
FORMS = ("{}", "^{}", "{}=X", "{}=F", "{}-USD", "{}USDT", "btc{}", "EUR-{}", "ETHBTC", "SOLUSD", "bad {}", "USDT", " {} ", "BTC-USD", "GBP-EUR")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in the forms of symbols, each with its source, whether it is valid, and how it is written."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = F.element_at(F.split("p_name", " "), (F.col("p_partkey") % 2 + 1).cast("int"))
    form = F.get(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS)).cast("int"))
    s = F.col("symbol")
    return parts.select(F.replace(form, F.lit("{}"), word).alias("symbol")).distinct().select("symbol", S.source_type(s).alias("source"), S.valid_symbol(s).alias("valid"), S.normalise_symbol(s).alias("normalised"))


_T = "|".join(S.CRYPTO_TICKERS)
_F = ",".join(f"'{f}'" for f in S.FIAT)
register(
    "symbol_source_detection", "symbol source valid normalised", symbols,
    f"""SELECT symbol, source, CASE source WHEN 'crypto' THEN regexp_full_match(u, '[A-Z]{{2,10}}(USDT|BUSD|BTC|ETH|BNB|USD)') ELSE regexp_full_match(u, '[\\^]?[A-Z0-9.\\-]{{1,10}}(=[XF])?') END AS valid,
       CASE WHEN len(string_split(u, '-')) = 2 AND split_part(u, '-', 1) <> '' AND split_part(u, '-', 2) IN ({_F}) AND NOT regexp_full_match(split_part(u, '-', 1), '{_T}') THEN replace(u, '-', '') || '=X' ELSE u END AS normalised
       FROM (SELECT symbol, upper(trim(symbol)) AS u, CASE WHEN regexp_matches(upper(trim(symbol)), '(USDT|BUSD)$') OR regexp_full_match(upper(trim(symbol)), '({_T})USD') OR regexp_full_match(upper(trim(symbol)), '({_T})({_T})') THEN 'crypto' ELSE 'stock' END AS source
       FROM (SELECT DISTINCT replace(([{",".join(f"'{f}'" for f in FORMS)}])[1 + p_partkey % {len(FORMS)}], '{{}}', split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS INT))) AS symbol FROM part))""",
)

# --- trend and volatility ----------------------------------------------------------------------------------------

trend = lambda s, d: X.trend_features(S.daily_bars(s, d), CFG)
register("rolling_ols_slope", "symbol ts:t slope:d", lambda s, d: returns(s, d).withColumn("slope", X.ols_slope("log_price", 20)), "SELECT * FROM lab_b")
register("trend_strength", "symbol ts:t trend_strength:d trend_regime", trend, "SELECT * FROM lab_d")
register(
    "trend_consistency", "symbol ts:t trend_strength_ma:d trend_acceleration:d trend_consistency:d", trend,
    f"""SELECT *, avg(trend_strength) OVER {O.roll(5)} AS trend_strength_ma, slope - lag(slope) OVER ({O.P}) AS trend_acceleration,
       CASE WHEN len(codes) > 0 THEN CAST(len(list_filter(codes, lambda x: x = codes[-1])) AS DOUBLE) / len(codes) END AS trend_consistency
       FROM (SELECT *, list(CASE WHEN trend_regime <> 'Unknown' THEN trend_regime END) FILTER (WHERE trend_regime <> 'Unknown') OVER {O.roll(20)} AS codes FROM lab_d)""",
)
register(
    "trend_summary", "symbol mean:d std:d min:d max:d current:d share_up:d share_down:d share_sideways:d", lambda s, d: X.trend_summary(trend(s, d)),
    """SELECT symbol, avg(trend_strength) AS mean, stddev_samp(trend_strength) AS std, min(trend_strength) AS min, max(trend_strength) AS max, arg_max(trend_strength, ts) FILTER (WHERE trend_strength IS NOT NULL) AS current,
       avg(CASE WHEN trend_regime <> 'Unknown' THEN CAST(trend_regime = 'Up' AS INT) END) AS share_up, avg(CASE WHEN trend_regime <> 'Unknown' THEN CAST(trend_regime = 'Down' AS INT) END) AS share_down,
       avg(CASE WHEN trend_regime <> 'Unknown' THEN CAST(trend_regime = 'Sideways' AS INT) END) AS share_sideways FROM lab_d GROUP BY 1""",
)
register("volatility_features", "symbol ts:t realized_variance:d volatility:d volatility_percentile:d volatility_baseline:d volatility_regime vol_of_vol:d volatility_change:d volatility_zscore:d", labels, "SELECT * FROM lab")
register("realized_volatility", "symbol ts:t realized_volatility:d", labels, "SELECT *, sqrt(realized_variance) AS realized_volatility FROM lab")
register(
    "parkinson_volatility", "symbol ts:t parkinson:d", lambda s, d: returns(s, d).withColumn("parkinson", X.parkinson(20)),
    f"SELECT symbol, ts, {O.gate(f'sqrt(avg(pow(ln(high / low), 2)) OVER {O.roll(20)} / (4 * ln(2)))', 'close', 10, O.roll(20))} AS parkinson FROM li",
)
register(
    "true_range", "symbol ts:t true_range:d", lambda s, d: returns(s, d).withColumn("true_range", X.true_range()),
    f"SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER ({O.P})), abs(low - lag(close) OVER ({O.P}))) AS true_range FROM li",
)
ATR = f"""num AS (SELECT symbol, ts, row_number() OVER ({O.P}) AS rn, greatest(high - low, abs(high - lag(close) OVER ({O.P})), abs(low - lag(close) OVER ({O.P}))) AS tr FROM li),
ema AS MATERIALIZED (WITH RECURSIVE step AS (SELECT symbol, ts, rn, tr AS atr FROM num WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.rn, s.atr + (n.tr - s.atr) / 14 FROM step s JOIN num n ON n.symbol = s.symbol AND n.rn = s.rn + 1) SELECT * FROM step)"""
register("atr", "symbol ts:t atr:d", lambda s, d: folds.average_true_range(returns(s, d), CFG), "SELECT * FROM ema", ATR)
register(
    "vol_clusters", "symbol start_ts:t end_ts:t length:i mean_volatility:d max_volatility:d min_volatility:d first_close:d last_close:d", lambda s, d: X.volatility_clusters(labels(s, d)),
    f"""SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length, avg(volatility) AS mean_volatility, max(volatility) AS max_volatility, min(volatility) AS min_volatility, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close
       FROM (SELECT *, rn - sum(CASE WHEN volatility_percentile > 0.7 THEN 1 ELSE 0 END) OVER {O.ALL} AS run FROM lab) WHERE volatility_percentile > 0.7 GROUP BY symbol, run""",
)
register(
    "vol_summary", "symbol mean:d std:d min:d max:d current:d mean_vol_of_vol:d share_high:d", lambda s, d: X.volatility_summary(labels(s, d)),
    """SELECT symbol, avg(volatility) AS mean, stddev_samp(volatility) AS std, min(volatility) AS min, max(volatility) AS max, arg_max(volatility, ts) FILTER (WHERE volatility IS NOT NULL) AS current, avg(vol_of_vol) AS mean_vol_of_vol,
       avg(CASE WHEN volatility_regime <> 'Unknown' THEN CAST(volatility_regime = 'High' AS INT) END) AS share_high FROM lab GROUP BY 1""",
)

# --- labels ------------------------------------------------------------------------------------------------------

register("crisp_regime", "symbol ts:t trend_regime volatility_regime regime regime_name", labels, "SELECT * FROM lab")
register("crisp_regime_hourly", "symbol ts:t regime", hourly, "SELECT * FROM evlab")
register(
    "regime_code", "symbol ts:t code:i", lambda s, d: labels(s, d).withColumn("code", R.regime_code(F.col("regime"))),
    "SELECT *, coalesce(list_position([" + ",".join(f"'{r}'" for r in REGIMES) + "], regime), 0) - 1 AS code FROM lab",
)
register(
    "regime_statistics", "symbol regime n:i share:d mean_return:d std_return:d avg_volatility:d avg_trend_strength:d",
    lambda s, d: A.regime_statistics(labels(s, d)),
    """SELECT symbol, regime, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share, avg(log_return) AS mean_return, stddev_samp(log_return) AS std_return, avg(volatility) AS avg_volatility, avg(trend_strength) AS avg_trend_strength
       FROM lab GROUP BY symbol, regime""",
)
fuzzy = lambda s, d: R.fuzzy_features(labels(s, d), CFG)
percentile_fuzzy = lambda s, d: R.fuzzy_features(labels(s, d), Config(fuzzy_source="percentile"))
FZ = "symbol ts:t " + " ".join(f"{f}:d" for f in FUZZY) + " fuzzy_primary_regime fuzzy_confidence:d fuzzy_entropy:d"
register("fuzzy_memberships", FZ, fuzzy, "SELECT * FROM fz")
register("fuzzy_memberships_percentile", FZ, percentile_fuzzy, "SELECT * FROM fzp")
register(
    "fuzzy_summary", "symbol regime mean_membership:d current:d primary_share:d", lambda s, d: R.fuzzy_summary(percentile_fuzzy(s, d)),
    " UNION ALL ".join(f"SELECT symbol, '{r}' AS regime, avg({f}) AS mean_membership, arg_max({f}, ts) AS current, avg(CAST(fuzzy_primary_regime = '{r}' AS INT)) AS primary_share FROM fzp GROUP BY 1" for r, f in zip(REGIMES, FUZZY, strict=True)),
)
register(
    "fuzzy_nowcast", "symbol ts:t fuzzy_primary_regime fuzzy_confidence:d prob_up:d prob_sideways:d prob_down:d prob_lowvol:d prob_highvol:d", lambda s, d: R.fuzzy_nowcast(percentile_fuzzy(s, d)),
    "SELECT *, " + ", ".join(f"{' + '.join(f for r, f in zip(REGIMES, FUZZY, strict=True) if p in r)} AS prob_{p.lower()}" for p in ("Up", "Sideways", "Down", "LowVol", "HighVol")) + " FROM fzp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
)
register(
    "quality_flags", "symbol ts:t calibration_observations:i warmup_bars:i warmup_complete causal_mode valid_signal", lambda s, d: R.quality_flags(labels(s, d), CFG),
    "SELECT *, rn AS calibration_observations, 252 AS warmup_bars, rn >= 252 AS warmup_complete, true AS causal_mode, rn >= 252 AND trend_strength IS NOT NULL AND volatility IS NOT NULL AND volatility_percentile IS NOT NULL AND regime <> 'Unknown' AS valid_signal FROM lab",
)
ADAPTIVE = f"""ada AS (SELECT *, CASE WHEN count(trend_strength) OVER {O.prev(252)} >= 126 THEN greatest(quantile_cont(trend_strength, 0.7) OVER {O.prev(252)}, 0.1) END AS adaptive_upper,
  CASE WHEN count(trend_strength) OVER {O.prev(252)} >= 126 THEN least(quantile_cont(trend_strength, 0.3) OVER {O.prev(252)}, -0.1) END AS adaptive_lower,
  CASE WHEN count(volatility) OVER {O.prev(252)} >= 126 THEN quantile_cont(volatility, 0.67) OVER {O.prev(252)} END AS adaptive_vol_threshold FROM lab),
adl AS (SELECT *, CASE WHEN trend_strength IS NULL OR adaptive_upper IS NULL THEN 'Unknown' WHEN trend_strength > adaptive_upper THEN 'Up' WHEN trend_strength < adaptive_lower THEN 'Down' ELSE 'Sideways' END AS regime_adaptive,
  CASE WHEN volatility IS NULL OR adaptive_vol_threshold IS NULL THEN 'Unknown' WHEN volatility > adaptive_vol_threshold THEN 'High' ELSE 'Low' END AS regime_vol_adaptive FROM ada)"""
register("adaptive_thresholds", "symbol ts:t adaptive_upper:d adaptive_lower:d regime_adaptive", lambda s, d: R.adaptive_regime(labels(s, d), CFG), "SELECT * FROM adl", ADAPTIVE)
register("adaptive_vol_regime", "symbol ts:t adaptive_vol_threshold:d regime_vol_adaptive", lambda s, d: R.adaptive_volatility(labels(s, d)), "SELECT * FROM adl", ADAPTIVE)
DWELL = f"""dw1 AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, trend_regime ORDER BY ts) AS isl FROM lab),
dw2 AS (SELECT *, count(*) OVER (PARTITION BY symbol, trend_regime, isl) AS len, min(rn) OVER (PARTITION BY symbol, trend_regime, isl) AS rn0, min(CASE WHEN trend_regime <> 'Unknown' THEN rn END) OVER (PARTITION BY symbol) AS first_at FROM dw1),
dw AS (SELECT *, CASE WHEN trend_regime = 'Unknown' THEN 'Unknown' ELSE last_value(CASE WHEN trend_regime <> 'Unknown' AND (len >= 5 OR rn0 = first_at) THEN trend_regime END IGNORE NULLS) OVER {O.ALL} END AS regime_dwell FROM dw2)"""
register("min_dwell", "symbol ts:t trend_regime regime_dwell", lambda s, d: R.min_dwell(labels(s, d), "trend_regime", 5), "SELECT * FROM dw", DWELL)

# --- tail risk and long memory -----------------------------------------------------------------------------------

tail = lambda s, d: X.tail_features(S.daily_bars(s, d), CFG)
_W, _TMOST = O.roll(CFG.tail_window), CFG.tail_window // 2
TAIL = f"""tl0 AS (SELECT *, product(1 + coalesce(log_return, 0.0)) OVER {O.ALL} AS level FROM lab_a),
tl1 AS (SELECT *, list(-log_return) FILTER (WHERE log_return IS NOT NULL) OVER {_W} AS ls, list(level) OVER {_W} AS eq, count(log_return) OVER {_W} AS n, count(*) OVER {_W} AS nr,
  quantile_cont(-log_return, 0.95) OVER {_W} AS v, kurtosis(log_return) OVER {_W} AS k FROM tl0),
tl2 AS (SELECT *, list_reverse_sort(list_filter(ls, lambda x: x > 0)) AS pos FROM tl1),
tl3 AS (SELECT *, least(len(pos), greatest(5, CAST(floor(len(pos) * 0.1) AS BIGINT))) AS hk FROM tl2),
tl4 AS (SELECT *, list_avg(list_transform(pos[1:hk], lambda x: ln(x / pos[hk]))) AS hm FROM tl3),
tl5 AS (SELECT symbol, ts, close, n, nr, v, k, ls, pos, hm, eq FROM tl4),
tl AS (SELECT *, CASE WHEN n >= {_TMOST} THEN v END AS loss_var, CASE WHEN n >= {_TMOST} THEN list_avg(list_filter(ls, lambda x: x >= v)) END AS loss_cvar, CASE WHEN n >= {_TMOST} AND len(pos) >= 5 AND hm > 0 THEN 1 / hm END AS tail_index,
  CASE WHEN n >= {_TMOST} THEN k END AS excess_kurtosis, close / max(close) OVER {O.ALL} - 1 AS drawdown,
  CASE WHEN nr >= {_TMOST} THEN least(0.0, list_min(list_transform(generate_series(1, len(eq)), lambda i: eq[i] / list_max(eq[1:i]) - 1))) END AS rolling_max_drawdown FROM tl5),
sv AS (SELECT *, CASE WHEN loss_cvar IS NULL AND tail_index IS NULL AND rolling_max_drawdown IS NULL THEN 'Unknown'
  WHEN coalesce(loss_cvar >= 0.04, false) OR coalesce(tail_index <= 3, false) OR coalesce(rolling_max_drawdown <= -0.15, false) THEN 'Fragile'
  WHEN coalesce(loss_cvar >= 0.02, false) OR coalesce(tail_index <= 4, false) OR coalesce(rolling_max_drawdown <= -0.07, false) THEN 'Stressed' ELSE 'Resilient' END AS survival_regime,
  list_avg(list_filter([least(greatest(loss_cvar / 0.04, 0), 1), least(greatest(3.0 / tail_index, 0), 1), least(greatest(rolling_max_drawdown / -0.15, 0), 1)], lambda x: x IS NOT NULL)) AS survival_score FROM tl)"""
_SV = """list_avg(list_filter([CASE WHEN loss_cvar IS NOT NULL THEN least(greatest(loss_cvar / 0.04, 0.0), 1.0) END, CASE WHEN tail_index IS NOT NULL THEN least(greatest(3.0 / tail_index, 0.0), 1.0) END,
  CASE WHEN rolling_max_drawdown IS NOT NULL THEN least(greatest(rolling_max_drawdown / -0.15, 0.0), 1.0) END], lambda x: x IS NOT NULL))"""
TAIL = TAIL[: TAIL.rindex("list_avg(list_filter([least")] + _SV + " AS survival_score FROM tl)"
register("var_rolling", "symbol ts:t loss_var:d loss_cvar:d", tail, "SELECT * FROM tl", TAIL)
register("hill_index", "symbol ts:t tail_index:f", tail, "SELECT * FROM tl", TAIL)
register("excess_kurtosis", "symbol ts:t excess_kurtosis:d", tail, "SELECT * FROM tl", TAIL)
register("drawdowns", "symbol ts:t rolling_max_drawdown:d drawdown:d", tail, "SELECT * FROM tl", TAIL)
register("survival", "symbol ts:t survival_regime survival_score:d", tail, "SELECT * FROM sv", TAIL)
_HW, _HMOST = CFG.hurst_window, min(100, CFG.hurst_window // 2)
_LOW, _HIGH = CFG.hurst_range
_BANDS = LO_BANDS[CFG.lo_confidence]
#: Deviations of the differences at each lag inside the window, the slope over lags, and Lo's statistic from lists.
HURST = "hs AS (" + "\nUNION ALL ".join(f"SELECT symbol, rn, {lag} AS lag, stddev_pop(d) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {_HW - 1 - lag} PRECEDING AND CURRENT ROW) AS sd FROM (SELECT symbol, rn, close - lag(close, {lag}) OVER ({O.P}) AS d FROM lab_a)" for lag in range(2, _HMOST)) + f"""),
hx AS (SELECT symbol, rn, 2 * regr_slope(0.5 * ln(sd), ln(lag)) AS hurst FROM hs WHERE sd > 0 AND rn >= {max(20, _HW // 2)} AND lag < least(100, least(rn, {_HW}) // 2) GROUP BY 1, 2 HAVING count(*) >= 2),
lo1 AS (SELECT symbol, rn, list(log_return) FILTER (WHERE log_return IS NOT NULL) OVER {O.roll(_HW)} AS x, count(log_return) OVER {O.roll(_HW)} AS n FROM lab_a),
lo2 AS (SELECT symbol, rn, n, CAST(floor(pow(n, 1.0 / 3) + 1e-12) AS INT) AS q, list_transform(x, lambda v: v - list_avg(x)) AS d FROM lo1 WHERE n >= {max(20, _HW // 2)}),
lo3 AS (SELECT *, list_sum(list_transform(d, lambda v: v * v)) / n + 2.0 / n * list_sum(list_transform(generate_series(1, q), lambda j: (1 - j / (q + 1.0)) * list_sum(list_transform(generate_series(j + 1, n), lambda i: d[i] * d[i - j])))) AS v,
  list_transform(generate_series(1, n), lambda i: list_sum(d[1:i])) AS walk FROM lo2),
lx AS (SELECT symbol, rn, CASE WHEN v > 0 THEN (list_max(walk) - list_min(walk)) / sqrt(v * n) END AS lo_modified_rs FROM lo3),
hl AS (SELECT *, CASE WHEN hurst IS NULL THEN 'Unknown' WHEN hurst > {_HIGH} THEN 'Trending' WHEN hurst < {_LOW} THEN 'Mean-Reverting' ELSE 'Random' END AS hurst_regime,
  CASE WHEN lo_modified_rs IS NULL THEN 'Unknown' WHEN lo_modified_rs > {_BANDS[1]} THEN 'Long-Memory' WHEN lo_modified_rs < {_BANDS[0]} THEN 'Anti-Persistent' ELSE 'Short-Memory' END AS lo_memory_regime
  FROM (SELECT a.symbol, a.ts, hurst, lo_modified_rs FROM lab_a a LEFT JOIN hx ON a.symbol = hx.symbol AND a.rn = hx.rn LEFT JOIN lx ON a.symbol = lx.symbol AND a.rn = lx.rn))"""
register(
    "hurst_rolling", "symbol ts:t hurst:d hurst_regime lo_modified_rs:d lo_memory_regime hurst_confirmed_regime hurst_change:d hurst_ma:d", lambda s, d: folds.hurst_features(returns(s, d), CFG),
    f"""SELECT *, CASE WHEN hurst_regime = 'Unknown' OR lo_memory_regime = 'Unknown' THEN 'Unknown' WHEN hurst_regime = 'Random' THEN 'Random' WHEN hurst_regime = 'Trending' AND lo_memory_regime = 'Long-Memory' THEN 'Trending'
       WHEN hurst_regime = 'Mean-Reverting' AND lo_memory_regime = 'Anti-Persistent' THEN 'Mean-Reverting' ELSE 'Short-Memory' END AS hurst_confirmed_regime, hurst - lag(hurst) OVER ({O.P}) AS hurst_change, avg(hurst) OVER {O.roll(20)} AS hurst_ma FROM hl""", HURST,
)
register(
    "hurst_summary", "symbol mean:d std:d current:d share_trending:d share_reverting:d", lambda s, d: folds.hurst_summary(folds.hurst_features(returns(s, d), CFG)),
    """SELECT symbol, avg(hurst) AS mean, stddev_samp(hurst) AS std, arg_max(hurst, ts) FILTER (WHERE hurst IS NOT NULL) AS current, coalesce(count(*) FILTER (WHERE hurst_regime = 'Trending') / nullif(count(*) FILTER (WHERE hurst_regime <> 'Unknown'), 0), 0) AS share_trending,
       coalesce(count(*) FILTER (WHERE hurst_regime = 'Mean-Reverting') / nullif(count(*) FILTER (WHERE hurst_regime <> 'Unknown'), 0), 0) AS share_reverting FROM hl GROUP BY 1""", HURST,
)
register(
    "hurst_outlook", "symbol min:d max:d current:d share_random:d current_regime average_persistence:d current_persistence:d interpretation", lambda s, d: folds.hurst_outlook(folds.hurst_features(returns(s, d), CFG)),
    """SELECT *, CASE WHEN current > 0.55 THEN format('trends persist (H = {:.3f})', current) WHEN current < 0.45 THEN format('moves revert (H = {:.3f})', current) WHEN current IS NOT NULL THEN format('close to a random walk (H = {:.3f})', current) END AS interpretation
       FROM (SELECT symbol, min(hurst) AS min, max(hurst) AS max, arg_max_null(hurst, ts) AS current, coalesce(count(*) FILTER (WHERE hurst_regime = 'Random') / nullif(count(*) FILTER (WHERE hurst_regime <> 'Unknown'), 0), 0) AS share_random,
               arg_max_null(hurst_regime, ts) AS current_regime, avg(hurst - 0.5) AS average_persistence, arg_max_null(hurst - 0.5, ts) AS current_persistence FROM hl GROUP BY 1)""", HURST,
)
register("hurst_rs_rolling", "symbol ts:t hurst:d", lambda s, d: folds.hurst(returns(s, d), Config(hurst_method="rs")))
register("dfa_rolling", "symbol ts:t hurst:d", lambda s, d: folds.hurst(returns(s, d), Config(hurst_method="dfa")))


def with_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled bars with the rolling exponent."""
    return folds.hurst(labels(spark, sf_dir), CFG)


FRACTAL = HURST + f""",
hu AS (SELECT l.*, hx.hurst FROM lab l LEFT JOIN hx ON l.symbol = hx.symbol AND l.rn = hx.rn),
fm0 AS (SELECT *, CASE WHEN hurst > 0.55 THEN 1.0 ELSE 0.0 END AS raw FROM hu),
fm AS (SELECT *, CASE WHEN avg(raw) OVER {O.roll(5)} >= 0.5 THEN 1.0 ELSE 0.0 END AS fractal_mask FROM fm0),
fr AS (SELECT *, first_value(close) OVER ({O.P}) * exp(sum(fractal_mask * coalesce(log_return, 0)) OVER {O.ALL}) AS fractal_price, fractal_mask * log_return AS fractal_returns FROM fm)"""
fractal = lambda s, d: X.fractal_features(with_persistence(s, d), CFG)
register(
    "fractal_filter", "symbol ts:t fractal_mask:d fractal_price:d fractal_returns:d cumulative_fractal_returns:d fractal_trend_strength:d fractal_volatility:d fractal_efficiency:d", fractal,
    f"""SELECT *, sum(fractal_returns) OVER {O.ALL} AS cumulative_fractal_returns, trend_strength * fractal_mask AS fractal_trend_strength, nullif(volatility * fractal_mask, 0) AS fractal_volatility,
       coalesce(sum(fractal_returns) OVER (PARTITION BY symbol) / nullif(sum(log_return) OVER (PARTITION BY symbol), 0), 0) AS fractal_efficiency FROM fr""", FRACTAL,
)
register(
    "fractal_segments", "symbol start_ts:t end_ts:t length:i avg_hurst:d min_hurst:d max_hurst:d price_change:d", lambda s, d: X.fractal_segments(with_persistence(s, d)),
    f"""SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length, avg(hurst) AS avg_hurst, min(hurst) AS min_hurst, max(hurst) AS max_hurst, arg_max(close, ts) / arg_min(close, ts) - 1 AS price_change
       FROM (SELECT *, rn - sum(raw) OVER {O.ALL} AS run FROM fm0) WHERE raw = 1 GROUP BY symbol, run HAVING count(*) >= 5""", FRACTAL,
)
register(
    "fractal_summary", "symbol coverage:d fractal_return:d total_return:d sharpe:d", lambda s, d: X.fractal_summary(fractal(s, d)),
    "SELECT symbol, avg(fractal_mask) AS coverage, sum(fractal_returns) AS fractal_return, sum(log_return) AS total_return, avg(nullif(fractal_returns, 0)) / stddev_samp(nullif(fractal_returns, 0)) AS sharpe FROM fr GROUP BY 1", FRACTAL,
)

# --- folds -------------------------------------------------------------------------------------------------------

EWM = f"ew AS MATERIALIZED (SELECT symbol, ts, log_return AS x, row_number() OVER ({O.P}) AS n FROM lab_a WHERE log_return IS NOT NULL)"
EWMA = EWM + ",\n" + O.ewm_std("ewt", "ew", f"(1 - exp(-ln(2.0) / {CFG.ewma_halflife}))", False, 2)
register(
    "ewma_trend", "symbol ts:t trend_strength_ewma:d", lambda s, d: folds.ewma_trend(returns(s, d), CFG),
    "SELECT l.symbol, l.ts, CASE WHEN e.ewm IS NOT NULL THEN l.slope / greatest(e.ewm, 1e-8) END AS trend_strength_ewma FROM lab_b l LEFT JOIN (SELECT ew.symbol, ew.ts, ewm FROM ew JOIN ewt USING (symbol, n)) e ON l.symbol = e.symbol AND l.ts = e.ts", EWMA,
)
EWMV = EWM + ",\n" + O.ewm_std("ewv", "ew", f"(2.0 / {CFG.volatility_window + 1})", True, CFG.volatility_window // 2)
register(
    "ewm_volatility", "symbol ts:t volatility:d", lambda s, d: folds.ewm_volatility(returns(s, d), CFG),
    "SELECT l.symbol, l.ts, e.ewm AS volatility FROM lab_a l LEFT JOIN (SELECT ew.symbol, ew.ts, ewm FROM ew JOIN ewv USING (symbol, n)) e ON l.symbol = e.symbol AND l.ts = e.ts", EWMV,
)
GRID = EWM + f""",
gx AS MATERIALIZED (SELECT symbol, h, 1 - exp(-ln(2.0) / h) AS a, x, n FROM ew CROSS JOIN (VALUES {", ".join(f"({float(h)})" for h in HALFLIFE_GRID)}) v(h)),
""" + O.ewm_std("gw", "gx", "s.a", False, 2, "symbol, h") + """,
ge AS (SELECT g.symbol, g.h, pow(g.ewm * g.ewm - x.x * x.x, 2) AS e FROM gw g JOIN gx x ON g.symbol = x.symbol AND g.h = x.h AND x.n = g.n + 1 WHERE g.n > 30),
gm AS (SELECT symbol, h, avg(e) AS mse FROM ge WHERE symbol IN (SELECT symbol FROM ew GROUP BY 1 HAVING count(*) >= 80) GROUP BY 1, 2)"""
register(
    "ewma_halflife_grid", "symbol halflife:d mse_e8:f best", lambda s, d: folds.halflife_grid(returns(s, d)).withColumn("mse_e8", F.col("mse") * 1e8),
    "SELECT symbol, h AS halflife, mse * 1e8 AS mse_e8, row_number() OVER (PARTITION BY symbol ORDER BY mse, h) = 1 AS best FROM gm", GRID,
)
register("bocpd", "symbol ts:t bocpd_run_length:d bocpd_change_prob:d bocpd_recent_prob:d", lambda s, d: folds.bocpd(returns(s, d), CFG))
register("dsm_bocpd", "symbol ts:t bocpd_run_length:d bocpd_change_prob:d", lambda s, d: folds.dsm_bocpd(returns(s, d), CFG))
register("markov_variance", "symbol ts:t markov_prob_high:d markov_prob_smooth:d markov_state", lambda s, d: folds.markov(returns(s, d)))
register("markov_parameters", "symbol variance_low variance_high stay_low:d stay_high:d loglik:d converged", lambda s, d: folds.markov_parameters(returns(s, d)))


def implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily volatility index made of the bars' own realised volatility over five bars."""
    b = returns(spark, sf_dir)
    return b.select("symbol", F.to_date("ts").alias("date"), (F.sqrt(F.avg(F.col("log_return") * F.col("log_return")).over(rolling(5))) * 252**0.5).alias("implied_vol")).where("implied_vol is not null")


register(
    "implied_vol_join", "symbol ts:t log_return:d implied_vol:d", lambda s, d: folds.implied_vol(returns(s, d), implied(s, d)),
    f"""SELECT a.symbol, a.ts, a.log_return, b.implied_vol FROM lab_a a LEFT JOIN (SELECT symbol, CAST(ts AS DATE) AS date, sqrt(avg(log_return * log_return) OVER {O.roll(5)}) * sqrt(252) AS implied_vol FROM lab_a) b
       ON a.symbol = b.symbol AND CAST(a.ts AS DATE) = b.date""",
)
register("markov_multivariate", "symbol ts:t markov_prob_high:d markov_state markov_model", lambda s, d: folds.markov(folds.implied_vol(returns(s, d), implied(s, d)), second="implied_vol"))
register("consensus_events", "symbol ts:t consensus_event", lambda s, d: folds.consensus(folds.markov(folds.dsm_bocpd(returns(s, d), CFG)), CFG))
register(
    "risk_guard", "symbol ts:t raw_overlay overlay_active overlay_stop overlay_expired", lambda s, d: folds.risk_guard(B.overlay_signals(labels(s, d), ReboundProfile(True)), 5, -0.03),
    "SELECT s.symbol, s.ts, s.raw_overlay, g.held AS overlay_active, g.stopped AS overlay_stop, g.expired AS overlay_expired FROM rg_s s JOIN rg USING (symbol, rn)".replace("JOIN rg ", "JOIN rg g "),
    O.overlay_signals("rg_s", ReboundProfile(True)) + ",\n" + O.guarded("rg", "rg_s", 5, -0.03),
)

# --- forward returns ---------------------------------------------------------------------------------------------

FWD = ",\n".join(f"f{h} AS (SELECT *, {h} AS horizon, lead(close, {h}) OVER ({O.P}) / close - 1 AS r FROM fz)" for h in (1, 5, 10, 20)) + ",\nfw AS (SELECT * FROM f5 UNION ALL SELECT * FROM f10)"
DIST = """count(r) AS count, avg(r) AS mean, median(r) AS median, stddev_samp(r) AS std, min(r) AS min, max(r) AS max, CASE WHEN count(r) >= 3 THEN skewness(r) END AS skew, CASE WHEN count(r) >= 4 THEN kurtosis(r) END AS kurtosis,
  quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.75) AS p75, quantile_cont(r, 0.95) AS p95, 100 * avg(CAST(r > 0 AS INT)) AS positive_pct, avg(r) / nullif(stddev_samp(r), 0) AS sharpe,
  CASE WHEN sqrt(avg(CASE WHEN r < 0 THEN r * r END)) > 0 THEN avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r END)) WHEN avg(r) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS sortino"""
DIST_SPEC = "count:i mean:d median:d std:d min:d max:d skew:d kurtosis:d p5:d p25:d p75:d p95:d positive_pct:d sharpe:d sortino:d"
register(
    "forward_returns", "symbol ts:t fwd_5d_return:d fwd_5d_cumulative:d fwd_10d_return:d fwd_10d_cumulative:d", lambda s, d: A.forward_returns(returns(s, d), HORIZONS),
    f"SELECT symbol, ts, " + ", ".join(f"lead(close, {h}) OVER ({O.P}) / close - 1 AS fwd_{h}d_return, lead(close, {h}) OVER ({O.P}) / close AS fwd_{h}d_cumulative" for h in HORIZONS) + " FROM li",
)
register(
    "forward_stats_by_regime", f"horizon:i regime {DIST_SPEC}", lambda s, d: A.forward_stats(labels(s, d), HORIZONS),
    f"SELECT horizon, regime, {DIST} FROM fw WHERE r IS NOT NULL AND regime <> 'Unknown' GROUP BY 1, 2 UNION ALL SELECT horizon, 'Overall' AS regime, {DIST} FROM fw WHERE r IS NOT NULL GROUP BY 1", FWD,
)
register(
    "conditional_forward", f"horizon:i {DIST_SPEC}", lambda s, d: A.conditional_forward(labels(s, d), F.col("volatility_percentile") > 0.8, HORIZONS),
    f"SELECT horizon, {DIST} FROM fw WHERE r IS NOT NULL AND volatility_percentile > 0.8 GROUP BY 1", FWD,
)
register(
    "fuzzy_weighted_forward", "horizon:i regime weight:d mean:d std:d sharpe:d", lambda s, d: A.fuzzy_forward(percentile_fuzzy(s, d), HORIZONS),
    " UNION ALL ".join(
        f"SELECT horizon, '{r}' AS regime, sum({f}) AS weight, sum({f} * r) / sum({f}) AS mean, sqrt(greatest(sum({f} * r * r) / sum({f}) - pow(sum({f} * r) / sum({f}), 2), 0)) AS std, (sum({f} * r) / sum({f})) / nullif(sqrt(greatest(sum({f} * r * r) / sum({f}) - pow(sum({f} * r) / sum({f}), 2), 0)), 0) AS sharpe FROM fw WHERE r IS NOT NULL GROUP BY 1"
        for r, f in zip(REGIMES, FUZZY, strict=True)
    ), FWD.replace("FROM fz)", "FROM fzp)"),
)
register(
    "best_worst_regime", "horizon:i best_regime best_mean:d worst_regime worst_mean:d", lambda s, d: A.best_and_worst(A.forward_stats(labels(s, d), HORIZONS)),
    "SELECT horizon, arg_max(regime, m) AS best_regime, max(m) AS best_mean, arg_min(regime, m) AS worst_regime, min(m) AS worst_mean FROM (SELECT horizon, regime, avg(r) AS m FROM fw WHERE r IS NOT NULL AND regime <> 'Unknown' GROUP BY 1, 2) GROUP BY 1", FWD,
)

register(
    "forward_summary", "place:i regime count:i mean:d median:d std:d sharpe:d win_rate_pct:d min:d max:d", lambda s, d: A.forward_summary(A.forward_stats(labels(s, d), HORIZONS)),
    f"SELECT row_number() OVER (ORDER BY mean DESC, regime) AS place, regime, count, mean, median, std, sharpe, positive_pct AS win_rate_pct, min, max FROM (SELECT regime, {DIST} FROM f5 WHERE r IS NOT NULL AND regime <> 'Unknown' GROUP BY 1)", FWD,
)

# --- transitions -------------------------------------------------------------------------------------------------

TRANS = f"""tp AS (SELECT regime AS from_regime, lead(regime) OVER ({O.P}) AS to_regime FROM lab),
tc AS (SELECT from_regime, to_regime, count(*) AS n FROM tp WHERE to_regime IS NOT NULL AND from_regime <> 'Unknown' AND to_regime <> 'Unknown' GROUP BY 1, 2),
tn AS (SELECT from_regime AS x FROM tc UNION SELECT to_regime FROM tc),
tm AS (SELECT a.x AS from_regime, b.x AS to_regime, coalesce(n, 0) AS n, coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY a.x), 0), 0) AS p FROM tn a CROSS JOIN tn b LEFT JOIN tc ON a.x = from_regime AND b.x = to_regime)"""
matrix = lambda s, d: A.transition_matrix(labels(s, d))
register("transition_matrix", "from_regime to_regime n:i p:d", matrix, "SELECT * FROM tm", TRANS)
register("n_step_transition", "from_regime to_regime p:d", lambda s, d: A.n_step(matrix(s, d), 3), "SELECT a.from_regime, c.to_regime, sum(a.p * b.p * c.p) AS p FROM tm a JOIN tm b ON a.to_regime = b.from_regime JOIN tm c ON b.to_regime = c.from_regime GROUP BY 1, 2", TRANS)
register("persistence", "regime persistence:d expected_duration:d", lambda s, d: A.persistence(matrix(s, d)), "SELECT from_regime AS regime, p AS persistence, 1 / (1 - p) AS expected_duration FROM tm WHERE from_regime = to_regime", TRANS)
register(
    "regime_cycles", "cycle length:i strength:d", lambda s, d: A.cycles(matrix(s, d), 0.02),
    """SELECT a.from_regime || ' -> ' || a.to_regime || ' -> ' || a.from_regime AS cycle, 2 AS length, a.p * b.p AS strength FROM tm a JOIN tm b ON a.to_regime = b.from_regime AND b.to_regime = a.from_regime WHERE a.p > 0.02 AND b.p > 0.02 AND a.from_regime < a.to_regime
       UNION ALL SELECT a.from_regime || ' -> ' || a.to_regime || ' -> ' || b.to_regime || ' -> ' || a.from_regime, 3, a.p * b.p * c.p FROM tm a JOIN tm b ON a.to_regime = b.from_regime JOIN tm c ON b.to_regime = c.from_regime AND c.to_regime = a.from_regime
       WHERE a.p > 0.02 AND b.p > 0.02 AND c.p > 0.02 AND a.from_regime < a.to_regime AND a.from_regime < b.to_regime AND a.to_regime <> b.to_regime""", TRANS,
)
register("transition_entropy", "from_regime entropy:d", lambda s, d: A.row_entropy(matrix(s, d)), "SELECT from_regime, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS entropy FROM tm GROUP BY 1", TRANS)
register("transition_counts", "from_regime to_regime n:i share:d", lambda s, d: A.transition_changes(labels(s, d)), "SELECT *, n / sum(n) OVER () AS share FROM tc WHERE from_regime <> to_regime", TRANS)
register("likely_transitions", "from_regime to_regime p:d", lambda s, d: A.likely_transitions(matrix(s, d), 0.01), "SELECT from_regime, to_regime, p FROM tm WHERE from_regime <> to_regime AND p > 0.01 ORDER BY p DESC, 1, 2 LIMIT 10", TRANS)
register(
    "common_transitions", "from_regime to_regime n:i percentage:d", lambda s, d: A.common_transitions(labels(s, d)),
    "SELECT from_regime, to_regime, n, 100 * n / sum(n) OVER () AS percentage FROM tc WHERE from_regime <> to_regime ORDER BY n DESC, 1, 2 LIMIT 10", TRANS,
)
register(
    "transition_summary", "total_count:i unique_transitions:i n_transitions:i overall_entropy:d bars:i transitions_per_period:d", lambda s, d: A.transition_summary(labels(s, d)),
    """SELECT *, total_count / bars AS transitions_per_period FROM (SELECT sum(n) FILTER (WHERE from_regime <> to_regime) AS total_count, count(*) FILTER (WHERE from_regime <> to_regime AND n > 0) AS unique_transitions,
         count(*) FILTER (WHERE p > 0) - count(DISTINCT from_regime) AS n_transitions, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / count(DISTINCT from_regime) AS overall_entropy, (SELECT count(*) FROM lab) AS bars FROM tm)""", TRANS,
)
POWERS = TRANS + ",\nmp0 AS MATERIALIZED (SELECT from_regime AS i, to_regime AS j, p FROM tm)" + "".join(f",\nmp{k + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM mp{k} a JOIN mp{k} b ON a.j = b.i GROUP BY 1, 2)" for k in range(12))
register("stationary_distribution", "regime share:d", lambda s, d: A.stationary(matrix(s, d)), "SELECT j AS regime, sum(p) / sum(sum(p)) OVER () AS share FROM mp12 GROUP BY 1", POWERS)
PASSAGE = TRANS + """,
fq0 AS MATERIALIZED (SELECT t.x AS t, from_regime AS i, to_regime AS j, p FROM tm CROSS JOIN tn t WHERE from_regime <> t.x AND to_regime <> t.x),
fs0 AS MATERIALIZED (SELECT t.x AS t, i.x AS i, 1.0::DOUBLE AS v FROM tn t JOIN tn i ON i.x <> t.x)""" + "".join(
    f""",
fs{k + 1} AS MATERIALIZED (SELECT s.t, s.i, any_value(s.v) + coalesce(sum(q.p * r.v), 0) AS v FROM fs{k} s LEFT JOIN fq{k} q ON q.t = s.t AND q.i = s.i LEFT JOIN fs{k} r ON r.t = s.t AND r.i = q.j GROUP BY 1, 2),
fq{k + 1} AS MATERIALIZED (SELECT a.t, a.i, b.j, sum(a.p * b.p) AS p FROM fq{k} a JOIN fq{k} b ON a.t = b.t AND a.j = b.i GROUP BY 1, 2, 3)"""
    for k in range(16)
)
register(
    "mean_first_passage", "from_regime to_regime steps:f", lambda s, d: A.first_passage(matrix(s, d)),
    "SELECT i AS from_regime, t AS to_regime, v AS steps FROM fs16 UNION ALL SELECT x, x, 0.0 FROM tn", PASSAGE,
)

# --- segments ----------------------------------------------------------------------------------------------------

SEGS = f"""sg1 AS (SELECT *, CASE WHEN regime <> 'Unknown' AND regime IS DISTINCT FROM lag(regime) OVER ({O.P}) THEN 1 ELSE 0 END AS b1,
  CASE WHEN regime <> 'Unknown' AND regime IS DISTINCT FROM last_value(CASE WHEN regime <> 'Unknown' THEN regime END IGNORE NULLS) OVER ({O.P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b2 FROM lab),
sg2 AS (SELECT *, sum(b1) OVER {O.ALL} AS s1, sum(b2) OVER {O.ALL} AS s2 FROM sg1 )"""
_SEG = """SELECT symbol, any_value(regime) AS regime, min(rn) AS start_rn, max(rn) AS end_rn, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length, arg_min(close, rn) AS start_price, arg_max(close, rn) AS end_price,
  arg_max(close, rn) / arg_min(close, rn) - 1 AS price_change, sum(log_return) AS log_return, avg(log_return) AS mean_return, stddev_samp(log_return) AS return_std, avg(volatility) AS avg_volatility, sum(volume) AS volume
  FROM sg2 WHERE regime <> 'Unknown' GROUP BY symbol, {}"""
SEGS += ",\nseg AS (" + _SEG.format("s1") + "),\nsegb AS (" + _SEG.format("s2") + ")"
SEG_SPEC = "symbol regime start_rn:i end_rn:i start_ts:t end_ts:t length:i start_price:d end_price:d price_change:d log_return:d mean_return:d return_std:d avg_volatility:d volume:d"
closed = lambda s, d: A.segments(labels(s, d))
register("segments_close", SEG_SPEC, closed, "SELECT * FROM seg", SEGS)
register("segments_bridge", SEG_SPEC, lambda s, d: A.segments(labels(s, d), gap="bridge"), "SELECT * FROM segb", SEGS)
register(
    "segment_stats", "regime count:i avg_length:d median_length:d max_length:i total_days:i avg_return:d win_rate_pct:d avg_volatility:d", lambda s, d: A.segment_statistics(closed(s, d)),
    "SELECT regime, count(*) AS count, avg(length) AS avg_length, median(length) AS median_length, max(length) AS max_length, sum(length) AS total_days, avg(price_change) AS avg_return, 100 * avg(CAST(price_change > 0 AS INT)) AS win_rate_pct, avg(avg_volatility) AS avg_volatility FROM seg GROUP BY 1", SEGS,
)
register(
    "segment_topk", "kind symbol regime start_ts:t length:i price_change:d", lambda s, d: A.top_segments(closed(s, d)),
    " UNION ALL ".join(f"(SELECT '{k}' AS kind, symbol, regime, start_ts, length, price_change FROM seg ORDER BY {o}, symbol, start_rn LIMIT 5)" for k, o in (("best", "price_change DESC"), ("worst", "price_change"), ("longest", "length DESC"))), SEGS,
)
register(
    "segment_transitions", "from_regime to_regime n:i avg_return_change:d avg_length_before:d", lambda s, d: A.segment_transitions(closed(s, d)),
    "SELECT regime AS from_regime, nx AS to_regime, count(*) AS n, avg(np - price_change) AS avg_return_change, avg(length) AS avg_length_before FROM (SELECT *, lead(regime) OVER (PARTITION BY symbol ORDER BY start_rn) AS nx, lead(price_change) OVER (PARTITION BY symbol ORDER BY start_rn) AS np FROM seg) WHERE nx IS NOT NULL GROUP BY 1, 2", SEGS,
)

# --- back-test ---------------------------------------------------------------------------------------------------

MET = "observations:i start_date:t end_date:t strategy_return:d gross_strategy_return:d buy_hold_return:d excess_return:d total_transaction_cost:d turnover:d mean_exposure:d latest_regime latest_position:d max_drawdown_strategy:d max_drawdown_buy_hold:d bull_share:d bear_share:d sideways_share:d high_vol_share:d low_vol_share:d market_story strategy_posture relative_result"
register(
    "backtest_daily", "symbol ts:t asset_return:d target_exposure:d position:d turnover:d gross_return:d cost:d strategy_return:d",
    lambda s, d: B.positions(labels(s, d), B.exposure(F.col("regime_name")), 1, 10.0), "SELECT * FROM posc",
)
register("backtest_metrics", f"symbol {MET}", lambda s, d: B.backtest(labels(s, d), cost_bps=10.0), "SELECT * FROM met")
WINDOWED = O.metrics("mw", "(SELECT * FROM posc WHERE ts >= TIMESTAMP '1998-01-01' AND ts <= TIMESTAMP '1999-12-31')", "regime_name")
register("backtest_window", f"symbol {MET}", lambda s, d: B.backtest(labels(s, d), cost_bps=10.0, start="1998-01-01", end="1999-12-31"), "SELECT * FROM mw", WINDOWED)
register(
    "backtest_narrative", "symbol headline",
    lambda s, d: B.narrative(B.backtest(labels(s, d), cost_bps=10.0)),
    "SELECT symbol, symbol || ': ' || replace(strategy_posture, '_', ' ') || ' posture ' || relative_result || ' buy and hold in a ' || replace(market_story, '_', ' ') || ' market' AS headline FROM met",
)
register(
    "regime_mix", "symbol regime_name n:i share_pct:d", lambda s, d: B.regime_mix(labels(s, d)),
    "SELECT symbol, regime_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 1) AS share_pct FROM lab GROUP BY 1, 2",
)
SUPPLIED = O.bars("ls", "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('day', l_shipdate) AS ts, round(avg(l_extendedprice / l_quantity), 6) AS c, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2") + ",\n" + O.labelled("lsl", "ls")
register(
    "regime_mix_many", "symbol regime_name n:i share_pct:d", lambda s, d: B.regime_mix(crisp_labels(S.daily_bars(s, d, "l_suppkey"), CFG)),
    "SELECT symbol, regime_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 1) AS share_pct FROM lsl GROUP BY 1, 2", SUPPLIED,
)
register("dsm_bocpd_many", "symbol ts:t bocpd_run_length:d bocpd_change_prob:d", lambda s, d: folds.dsm_bocpd(X.numbered(S.with_returns(S.daily_bars(s, d, "l_suppkey"))), CFG))
SWEEP = "sw0 AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS exposure_map, {O.exposure('regime_name', m)} AS tgt FROM lab" for n, m in EXPOSURE_MAPS.items()) + "),\n"
SWEEP += O.positions("sw1", "sw0", "tgt", "symbol, exposure_map") + ",\n" + O.metrics("sw", "sw1", "regime_name", "symbol, exposure_map")
register("exposure_map_sweep", f"symbol exposure_map {MET}", lambda s, d: B.exposure_sweep(labels(s, d)), "SELECT * FROM sw", SWEEP)
DIAG = FWD + ",\nfd AS (SELECT symbol, ts, horizon, regime_name AS regime, r, avg(r) OVER (PARTITION BY symbol, horizon) AS overall FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f5 UNION ALL SELECT * FROM f10 UNION ALL SELECT * FROM f20) WHERE r IS NOT NULL)"
register(
    "forward_diagnostics", "symbol horizon:i regime regime_group count:i mean_return:d median_return:d compound_return positive_pct:d edge_vs_overall:d".replace("compound_return", "compound_return:d"),
    lambda s, d: B.forward_diagnostics(labels(s, d)),
    """SELECT symbol, horizon, regime, CASE WHEN starts_with(regime, 'Bull') THEN 'bull' WHEN starts_with(regime, 'Bear') THEN 'bear' WHEN starts_with(regime, 'Sideways') THEN 'sideways' ELSE 'unknown' END AS regime_group, count(*) AS count, avg(r) AS mean_return,
       median(r) AS median_return, product(1 + r ORDER BY ts) - 1 AS compound_return, 100 * avg(CAST(r > 0 AS INT)) AS positive_pct, avg(r) - any_value(overall) AS edge_vs_overall FROM fd GROUP BY 1, 2, 3""", DIAG,
)
register(
    "bullish_turn_lag", "symbol trough_date:t trough_price:d first_bull_date:t first_bull_price:d lag_periods:i missed_return:d latest_regime", lambda s, d: B.bullish_turn(labels(s, d)),
    """SELECT symbol, any_value(trough_date) AS trough_date, any_value(trough_price) AS trough_price, min(CASE WHEN bull THEN ts END) AS first_bull_date, arg_min(close, ts) FILTER (WHERE bull) AS first_bull_price, min(CASE WHEN bull THEN rn END) - any_value(trough_rn) AS lag_periods,
       arg_min(close, ts) FILTER (WHERE bull) / any_value(trough_price) - 1 AS missed_return, arg_max(regime_name, ts) AS latest_regime
       FROM (SELECT l.*, t.trough_rn, t.trough_date, t.trough_price, starts_with(regime_name, 'Bull') AND rn >= trough_rn AS bull FROM lab l JOIN (SELECT symbol, rn AS trough_rn, ts AS trough_date, close AS trough_price FROM lab QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY close, rn) = 1) t USING (symbol)) GROUP BY 1""",
)
REB = f"""rb0 AS (SELECT *, close / (CASE WHEN count(close) OVER {O.roll(20)} >= 5 THEN min(close) OVER {O.roll(20)} END) - 1 AS up, close / lag(close, 5) OVER ({O.P}) - 1 AS fast, CASE WHEN count(close) OVER {O.roll(5)} >= 5 THEN avg(close) OVER {O.roll(5)} END AS ma,
  CASE WHEN count(close) OVER {O.roll(20)} >= 2 THEN close / max(close) OVER {O.roll(20)} - 1 END AS fall FROM lab),
rb AS (SELECT *, coalesce(up >= 0.03 AND fast >= 0.02 AND close >= ma, false) AS rebound_signal, coalesce(CASE WHEN count(fall) OVER {O.roll(20)} >= 2 THEN min(fall) OVER {O.roll(20)} END <= -0.05, false) AS drawdown_gate FROM rb0),
rbo AS (SELECT *, CASE WHEN rebound_signal AND {O.exposure('regime_name')} < 0.75 THEN 'Rebound Overlay' ELSE regime_name END AS overlay_regime FROM rb)"""
register(
    "rebound_signal", "symbol ts:t rebound_signal drawdown_gate",
    lambda s, d: B.drawdown_gate(labels(s, d), 20, -0.05).withColumn("rebound_signal", B.rebound_signal()), "SELECT * FROM rb", REB,
)
_OV = O.exposure("overlay_regime").replace("ELSE 0.0", "WHEN 'Rebound Overlay' THEN 0.75 ELSE 0.0")
OVERLAID = REB + ",\n" + O.positions("rp", "rbo", _OV) + ",\n" + O.metrics("rm", "rp", "overlay_regime", extra=", count(*) FILTER (WHERE rebound_signal) AS rebound_signal_count, count(*) FILTER (WHERE overlay_regime = 'Rebound Overlay') AS overlay_active_count")
register("rebound_overlay", f"symbol {MET} rebound_signal_count:i overlay_active_count:i", lambda s, d: B.rebound_overlay(labels(s, d)), "SELECT * FROM rm", OVERLAID)

# --- groups, walk-forward, promotion -----------------------------------------------------------------------------

WALK = "window symbol group variant overlay_enabled " + MET + " rebound_signal_count:i overlay_active_count:i strategy_return_delta_vs_current:d drawdown_delta_vs_current:d improved_vs_current"
COST = 5.0


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compare_groups(labels(spark, sf_dir), GROUPS, cost_bps=COST)


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.recent_windows(spark, walk_forward.common_end(S.daily_bars(spark, sf_dir)))


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.walk_forward(labels(spark, sf_dir), recent(spark, sf_dir), GROUPS, cost_bps=COST)


def windowed(name: str, profiles: dict[str, ReboundProfile]) -> str:
    """Bars and metrics of both variants inside the recent windows."""
    return O.group_bars(f"{name}_b", GROUPS, profiles, COST) + f",\n{name}_j AS (SELECT * FROM {name}_b JOIN wn ON ts BETWEEN window_start AND window_end),\n" + O.group_metrics(name, f"{name}_j", COST, "win, symbol")


_SPECS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in WALK_FORWARD_WINDOWS)
ENDS = f"""last AS (SELECT CAST(min(m) AS DATE) AS d FROM (SELECT max(ts) AS m FROM li GROUP BY symbol)),
wn AS (SELECT n AS win, CAST(d - a AS TIMESTAMP) AS window_start, CAST(d - b AS TIMESTAMP) AS window_end FROM last CROSS JOIN (VALUES {_SPECS}) v(n, a, b))"""
NAMED = '*, grp AS "group"'
GROUPED = O.group_bars("gb", GROUPS, REBOUND_PROFILES, COST) + ",\n" + O.group_metrics("gc", "gb", COST)
WALKED = ENDS + ",\n" + windowed("wf", REBOUND_PROFILES)
register("group_rebound", WALK.replace("window ", "", 1), compared, f"SELECT {NAMED} FROM gc", GROUPED)
register("walk_forward", WALK, walked, f'SELECT {NAMED}, win AS "window" FROM wf', WALKED)
register("walk_forward_windows", "window window_start:t window_end:t", recent, 'SELECT *, win AS "window" FROM wn', ENDS)
CURRENT = ENDS + ",\n" + O.positions("wp", "lab", O.exposure("regime_name"), cost_bps=COST) + ",\nwj AS (SELECT * FROM wp JOIN wn ON ts BETWEEN window_start AND window_end),\n" + O.metrics("wm", "wj", "regime_name", "win, symbol")
register("walk_forward_current", f"win symbol {MET}", lambda s, d: walked(s, d).where("variant = 'current'").withColumnRenamed("window", "win"), "SELECT * FROM wm", CURRENT)
SUMM = "group variant asset_count:i mean_strategy_return:d mean_buy_hold_return:d mean_excess_return:d median_exposure:d mean_strategy_delta_vs_current:d improved_count:i overlay_enabled_count:i top_market_story top_strategy_posture is_candidate is_baseline"


def summary_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(DISTINCT symbol) AS asset_count, avg(strategy_return) AS mean_strategy_return, avg(buy_hold_return) AS mean_buy_hold_return, avg(excess_return) AS mean_excess_return, median(mean_exposure) AS median_exposure,
       avg(strategy_return_delta_vs_current) AS mean_strategy_delta_vs_current, count(*) FILTER (WHERE improved_vs_current) AS improved_count, count(*) FILTER (WHERE overlay_enabled) AS overlay_enabled_count, mode(market_story) AS top_market_story,
       mode(strategy_posture) AS top_strategy_posture, variant = 'group_rebound' AS is_candidate, variant = 'current' AS is_baseline FROM {source} GROUP BY ALL"""


register("group_summary", SUMM, lambda s, d: B.summarise_groups(compared(s, d)), summary_sql("gc", 'grp AS "group", variant'), GROUPED)
register("walk_forward_summary", "window " + SUMM, lambda s, d: B.summarise_groups(walked(s, d)), summary_sql("wf", 'win AS "window", grp AS "group", variant'), WALKED)
register(
    "variant_summary", "group asset_count:i baseline_mean_strategy_return:d candidate_mean_strategy_return:d mean_improvement:d improved_count:i degraded_count:i candidate_mean_excess_return:d candidate_median_exposure:d", lambda s, d: B.variant_summary(compared(s, d)),
    f"""SELECT a.grp AS "group", count(*) AS asset_count, avg(a.strategy_return) AS baseline_mean_strategy_return, avg(b.strategy_return) AS candidate_mean_strategy_return, avg(b.strategy_return - a.strategy_return) AS mean_improvement,
       count(*) FILTER (WHERE b.strategy_return - a.strategy_return > {BETTER_BY}) AS improved_count, count(*) FILTER (WHERE b.strategy_return - a.strategy_return < -{BETTER_BY}) AS degraded_count, avg(b.excess_return) AS candidate_mean_excess_return, median(b.mean_exposure) AS candidate_median_exposure
       FROM gc a JOIN gc b ON a.symbol = b.symbol AND a.variant = 'current' AND b.variant = 'group_rebound' GROUP BY 1""", GROUPED,
)
NARR = "nr AS (SELECT *, CASE symbol WHEN 'A' THEN 'indices' WHEN 'N' THEN 'mega_cap_tech' WHEN 'R' THEN 'crypto' ELSE 'other' END AS grp FROM met)"
register(
    "group_narratives", "grp asset_count:i mean_strategy_return:d mean_buy_hold_return:d mean_excess_return:d median_exposure:d top_story top_posture top_relative_result",
    lambda s, d: B.group_narratives(B.backtest(labels(s, d), cost_bps=10.0), GROUPS).withColumnRenamed("group", "grp"),
    "SELECT grp, count(*) AS asset_count, avg(strategy_return) AS mean_strategy_return, avg(buy_hold_return) AS mean_buy_hold_return, avg(excess_return) AS mean_excess_return, median(mean_exposure) AS median_exposure, mode(market_story) AS top_story, mode(strategy_posture) AS top_posture, mode(relative_result) AS top_relative_result FROM nr GROUP BY 1", NARR,
)
register(
    "narrative_alignment", "symbol market_story strategy_posture narrative_alignment_score:d narrative_aligned", lambda s, d: B.narrative_alignment(B.backtest(labels(s, d), cost_bps=10.0)),
    "SELECT *, narrative_alignment_score >= 0.5 AS narrative_aligned FROM (SELECT *, CASE market_story || '|' || strategy_posture " + " ".join(f"WHEN '{a}|{b}' THEN {v}" for (a, b), v in B.NARRATIVE_FIT.items()) + " END AS narrative_alignment_score FROM met)",
)
ELIGIBLE, PROTECTED = ("indices", "mega_cap_tech"), ("diversifiers", "crypto")


def gate_sql(name: str, source: str) -> str:
    """The basic promotion figures, and whether each gate holds."""
    listed = lambda groups: ", ".join(f"'{g}'" for g in groups)
    return f"""{name}_c AS (SELECT *, grp IN ({listed(ELIGIBLE)}) AS mine, grp IN ({listed(PROTECTED)}) AS safe FROM {source} WHERE variant = 'group_rebound'),
{name} AS (SELECT *, eligible_count > 0 AS k1, eligible_improved_share >= 0.6 AS k2, protected_degraded_share <= 0 AS k3, worst_drawdown_delta >= -0.02 AS k4 FROM (
  SELECT count(*) FILTER (WHERE mine) AS eligible_count, coalesce(avg(CAST(improved_vs_current AS INT)) FILTER (WHERE mine), 0.0) AS eligible_improved_share, count(*) FILTER (WHERE safe) AS protected_count,
  coalesce(avg(CAST(strategy_return_delta_vs_current < -{BETTER_BY} AS INT)) FILTER (WHERE safe), 0.0) AS protected_degraded_share, coalesce(min(drawdown_delta_vs_current), 0.0) AS worst_drawdown_delta FROM {name}_c))"""


def research_sql(name: str, source: str) -> str:
    """The further figures over windows and narratives, and whether each further gate holds."""
    fit = "CASE market_story || '|' || strategy_posture " + " ".join(f"WHEN '{a}|{b}' THEN {v}" for (a, b), v in B.NARRATIVE_FIT.items()) + " END"
    listed = ", ".join(f"'{g}'" for g in ELIGIBLE)
    return gate_sql(f"{name}_g", source) + f""",
{name}_n AS (SELECT count(DISTINCT win) FILTER (WHERE variant = 'group_rebound') AS windows_tested, coalesce(min(transaction_cost_bps) FILTER (WHERE variant = 'group_rebound'), 0.0) AS min_transaction_cost_bps,
  count(*) FILTER (WHERE variant = 'group_rebound' AND win = 'recent_1m') AS recent_narrative_count, coalesce(avg({fit}) FILTER (WHERE variant = 'group_rebound' AND win = 'recent_1m'), 0.0) AS recent_narrative_score,
  coalesce(avg({fit}) FILTER (WHERE variant = 'current' AND win = 'recent_1m'), 0.0) AS current_narrative_score FROM {source} WHERE grp IN ({listed})),
{name}_h AS (SELECT *, windows_tested >= 3 AS k5, min_transaction_cost_bps >= 5.0 AS k6, recent_narrative_count > 0 AS k7 FROM {name}_g CROSS JOIN {name}_n),
{name} AS (SELECT *, NOT k7 OR recent_narrative_score >= 0.7 AS k8, NOT k7 OR recent_narrative_score < 0.7 OR recent_narrative_score + 1e-12 >= current_narrative_score AS k9 FROM {name}_h)"""


_GATES = ("eligible: nothing observed", "eligible: too few improved", "protected: too many lost", "drawdown: deeper than allowed", "windows: too few tested", "costs: tested below the required rate", "narrative: nothing recent", "narrative: poor fit", "narrative: worse fit than the baseline", "stability: too few neighbours pass")


def reasons_sql(n: int) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT k{i} THEN '{g}' END" for i, g in enumerate(_GATES[:n], 1)) + "], lambda x: x IS NOT NULL), '; ') AS reasons, " + " AND ".join(f"k{i}" for i in range(1, n + 1)) + " AS promote"


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.promotion(compared(spark, sf_dir), ELIGIBLE, PROTECTED).withColumn("reasons", F.array_join("reasons", "; "))


def reported(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: walk_forward.report(labels(s, d), GROUPS, ELIGIBLE, PROTECTED, COST, end=walk_forward.common_end(S.daily_bars(s, d)))[name]


def research(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, windows = labels(spark, sf_dir), recent(spark, sf_dir)
    run = lambda profiles: B.walk_forward(bars, windows, GROUPS, profiles, COST)
    found = B.research_promotion(run(REBOUND_PROFILES), ELIGIBLE, PROTECTED, {n: run(p) for n, p in CHANGED.items()})
    return found.withColumn("reasons", F.array_join("reasons", "; "))


CHANGED = {n: {g: walk_forward.neighbours(p)[n] if p.enabled else p for g, p in REBOUND_PROFILES.items()} for n in NEIGHBOURS}
RESEARCH = WALKED + ",\n" + research_sql("rs", "wf") + "".join(f",\n{windowed(f'v{i}', p)},\n{research_sql(f'vs{i}', f'v{i}')}" for i, p in enumerate(CHANGED.values()))
_PASS = " + ".join(f"(SELECT CAST({' AND '.join(f'k{j}' for j in range(1, 10))} AS INT) FROM vs{i})" for i in range(len(CHANGED)))
RESEARCH += f",\nrp AS (SELECT *, parameter_pass_share >= 0.67 AS k10 FROM (SELECT *, ({_PASS}) / {float(len(CHANGED))} AS parameter_pass_share FROM rs))"
register("promotion_gate", "promote eligible_count:i eligible_improved_share:d protected_count:i protected_degraded_share:d worst_drawdown_delta:d reasons", promoted, f"SELECT *, {reasons_sql(4)} FROM pg", GROUPED + ",\n" + gate_sql("pg", "gc"))
register("research_promotion_gate", "promote windows_tested:i min_transaction_cost_bps:d recent_narrative_count:i recent_narrative_score:d parameter_pass_share:d reasons", research, f"SELECT *, {reasons_sql(10)} FROM rp", RESEARCH)
register("walk_forward_promotion", "promote windows_tested:i parameter_pass_share:d reasons", lambda s, d: reported("promotion")(s, d).withColumn("reasons", F.array_join("reasons", "; ")), f"SELECT *, {reasons_sql(10)} FROM rp", RESEARCH)
register(
    "walk_forward_comparison", WALK + " narrative_alignment_score:d narrative_aligned", reported("comparison"),
    f"""SELECT {NAMED}, win AS "window", coalesce(narrative_alignment_score >= 0.5, false) AS narrative_aligned FROM (SELECT *, CASE market_story || '|' || strategy_posture {" ".join(f"WHEN '{a}|{b}' THEN {v}" for (a, b), v in B.NARRATIVE_FIT.items())} END AS narrative_alignment_score FROM wf)""", WALKED,
)

# --- lookups and detectors ---------------------------------------------------------------------------------------

#: What stands for a customer's market segment and nation: fixed values, some of them unknown to the tables.
CLASSES = {"BUILDING": "equity", "AUTOMOBILE": "fx", "MACHINERY": "crypto", "HOUSEHOLD": " Commodity", "FURNITURE": "bond"}
HELD = ("SPY", "eurusd", "BTCUSDT", " gc=f ", "TLT", "qqq", "^RUT")


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p])[F.col("c_mktsegment")].alias("asset_class"), F.get(F.array(*map(F.lit, HELD)), (F.col("c_nationkey") % len(HELD)).cast("int")).alias("symbol")
    )
    c, s = F.col("asset_class"), F.col("symbol")
    return held.select("c_custkey", "asset_class", "symbol", lookups.default_halflife(c).alias("halflife"), lookups.default_run_length(c).alias("run_length"), lookups.vol_channel(s).alias("vol_index"))


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


register(
    "asset_lookups", "c_custkey:i asset_class symbol halflife:d run_length:d vol_index", looked_up,
    f"""SELECT *, {_case('lower(trim(asset_class))', HALFLIFE)} AS halflife, {_case('lower(trim(asset_class))', RUN_LENGTH)} AS run_length, {_case('upper(trim(symbol))', VOL_INDEX)} AS vol_index
       FROM (SELECT c_custkey, {_case('c_mktsegment', CLASSES)} AS asset_class, ({list(HELD)})[1 + c_nationkey % {len(HELD)}] AS symbol FROM customer)""",
)
register("detector_report", "symbol observations:i sigma:d max_abs_sigma:d std_resets:i std_last_run:d dsm_resets:i dsm_last_run:d", lambda s, d: lookups.detector_report(returns(s, d)))

# --- evaluation --------------------------------------------------------------------------------------------------

register("stability", "symbol stability:d", lambda s, d: A.stability(labels(s, d), "regime"), f"SELECT symbol, avg(CAST(regime = b AS INT)) AS stability FROM (SELECT symbol, regime, lag(regime) OVER ({O.P}) AS b FROM lab) GROUP BY 1")
register("label_entropy", "symbol entropy:d", lambda s, d: A.label_entropy(labels(s, d), "regime"), "SELECT symbol, sum(-p * log2(p)) AS entropy FROM (SELECT symbol, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS p FROM lab GROUP BY symbol, regime) GROUP BY 1")
register(
    "information_ratio", "symbol information_ratio:d", lambda s, d: A.information_ratio(labels(s, d), "regime", 5),
    "SELECT symbol, sum(n * abs(m / sd)) / sum(n) AS information_ratio FROM (SELECT symbol, regime, count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM f5 WHERE r IS NOT NULL GROUP BY 1, 2) WHERE n >= 10 AND sd > 0 GROUP BY 1", FWD,
)
COMPARED = DWELL + f",\ncf AS (SELECT *, lead(close, 5) OVER ({O.P}) / close - 1 AS r, lag(trend_regime) OVER ({O.P}) AS b0, lag(regime_dwell) OVER ({O.P}) AS b1 FROM dw)"


def classifier_sql(name: str, label: str, before: str) -> str:
    return f"""SELECT '{name}' AS classifier, a.symbol, stability, entropy, n_labels, information_ratio FROM (SELECT symbol, avg(CAST({label} = {before} AS INT)) AS stability, count(DISTINCT {label}) AS n_labels FROM cf GROUP BY 1) a
       JOIN (SELECT symbol, sum(-p * log2(p)) AS entropy FROM (SELECT symbol, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS p FROM cf GROUP BY symbol, {label}) GROUP BY 1) e ON a.symbol = e.symbol
       LEFT JOIN (SELECT symbol, sum(n * abs(m / sd)) / sum(n) AS information_ratio FROM (SELECT symbol, {label}, count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM cf WHERE r IS NOT NULL GROUP BY 1, 2) WHERE n >= 10 AND sd > 0 GROUP BY 1) i ON a.symbol = i.symbol"""


register(
    "compare_classifiers", "classifier symbol stability:d entropy:d n_labels:i information_ratio:d", lambda s, d: A.compare_classifiers(R.min_dwell(labels(s, d), "trend_regime", 5), "trend_regime", "regime_dwell", 5),
    classifier_sql("baseline", "trend_regime", "b0") + " UNION ALL " + classifier_sql("candidate", "regime_dwell", "b1"), COMPARED,
)
_FOLDS, _TESTED, _AHEAD, _EMBARGO = 6, 2, 5, 3
_PATHS = [f"({p}, {a}, {b})" for p, (a, b) in enumerate(A.cpcv_paths(_FOLDS, _TESTED))]
_TW = {"bull": {"Bull Quiet": 1.0, "Bull Volatile": 1.0}, "bear": {"Bear Quiet": 1.0, "Bear Volatile": 1.0}, "quiet": {"Bull Quiet": 1.0, "Sideways Quiet": 1.0, "Bear Quiet": 1.0}, **{k: EXPOSURE_MAPS[k] for k in ("current", "aggressive")}}


def path_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five weightings of the labels, each by the return of the bar that follows, on every path of the purged folds."""
    base = labels(spark, sf_dir).withColumn("_next", F.lead("log_return").over(order()))
    return A.path_sharpes(base, {n: B.exposure(F.col("regime_name"), w) * F.col("_next") for n, w in _TW.items()}, _FOLDS, _TESTED, _AHEAD, _EMBARGO)


CPCV = f"""cv0 AS (SELECT *, rn - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, lead(log_return) OVER ({O.P}) AS nx FROM lab),
cv1 AS (SELECT *, least(i // (n // {_FOLDS}), {_FOLDS - 1}) AS fold, n // {_FOLDS} AS size FROM cv0),
cv2 AS (SELECT c.*, p.path_id, fold IN (a, b) AS test,
  (i >= a * size - {_AHEAD} AND i < CASE WHEN a = {_FOLDS - 1} THEN n ELSE (a + 1) * size END + {_EMBARGO}) OR (i >= b * size - {_AHEAD} AND i < CASE WHEN b = {_FOLDS - 1} THEN n ELSE (b + 1) * size END + {_EMBARGO}) AS shut
  FROM cv1 c CROSS JOIN (VALUES {", ".join(_PATHS)}) p(path_id, a, b)),
cv AS (SELECT *, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM cv2 WHERE test OR NOT shut)"""
register("cpcv_folds", "symbol ts:t rn:i path_id:i role", lambda s, d: A.cpcv_roles(labels(s, d), _FOLDS, _TESTED, _AHEAD, _EMBARGO), "SELECT * FROM cv", CPCV)
TRIALS = CPCV + ",\npb1 AS (" + " UNION ALL ".join(f"SELECT symbol, path_id AS path, role, '{n}' AS trial, {O.exposure('regime_name', w)} * nx AS r FROM cv" for n, w in _TW.items()) + """),
pb2 AS (SELECT symbol, path, trial, coalesce(avg(r) FILTER (WHERE role = 'train') / nullif(stddev_samp(r) FILTER (WHERE role = 'train'), 0), 0.0) AS is_sharpe,
  coalesce(avg(r) FILTER (WHERE role = 'test') / nullif(stddev_samp(r) FILTER (WHERE role = 'test'), 0), 0.0) AS oos_sharpe FROM pb1 GROUP BY 1, 2, 3),
pb3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, path ORDER BY round(oos_sharpe, 9), trial) - 1 AS place, row_number() OVER (PARTITION BY symbol, path ORDER BY round(is_sharpe, 9) DESC, trial) AS best, count(*) OVER (PARTITION BY symbol, path) AS n FROM pb2)"""
register("path_sharpes", "symbol path:i trial is_sharpe:d oos_sharpe:d", path_trials, "SELECT * FROM pb2", TRIALS)
register(
    "pbo", "symbol pbo:d paths:i", lambda s, d: A.backtest_overfitting(path_trials(s, d).withColumns({c: F.round(c, 9) for c in ("is_sharpe", "oos_sharpe")}), ("symbol",)),
    "SELECT symbol, avg(CAST(place < (n - 1) / 2.0 AS INT)) AS pbo, count(*) AS paths FROM pb3 WHERE best = 1 GROUP BY 1", TRIALS,
)
PHASES = ", ".join(f"arg_max({f}, ts) AS {f}" for f in FUZZY)
register(
    "market_summary", "symbol ts:t trend_phase volatility_phase", lambda s, d: outlook.market_summary(fuzzy(s, d)),
    f"""SELECT symbol, ts, CASE WHEN {FUZZY[REGIMES.index("Up-LowVol")]} + {FUZZY[REGIMES.index("Up-HighVol")]} > 0.6 THEN 'rising' WHEN {FUZZY[REGIMES.index("Down-LowVol")]} + {FUZZY[REGIMES.index("Down-HighVol")]} > 0.6 THEN 'falling' ELSE 'undecided' END AS trend_phase,
       CASE WHEN {" + ".join(f for f, r in zip(FUZZY, REGIMES, strict=True) if r.endswith("HighVol"))} > 0.6 THEN 'high' ELSE 'contained' END AS volatility_phase FROM (SELECT symbol, max(ts) AS ts, {PHASES} FROM fz GROUP BY 1)""",
)
register(
    "insights", "symbol insight value:d", lambda s, d: outlook.insights(labels(s, d)),
    f"""SELECT symbol, insight, value FROM (SELECT symbol, unnest([
         CASE WHEN up > 1.5 * down THEN {{'insight': 'mostly rising', 'value': up / n}} WHEN down > 1.5 * up THEN {{'insight': 'mostly falling', 'value': down / n}} END,
         CASE WHEN recent > 1.2 * usual THEN {{'insight': 'volatility above its mean', 'value': recent / usual}} WHEN recent < 0.8 * usual THEN {{'insight': 'volatility below its mean', 'value': recent / usual}} END]) AS x
       FROM (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE starts_with(regime, 'Up')) AS up, count(*) FILTER (WHERE starts_with(regime, 'Down')) AS down, avg(volatility) AS usual, arg_max(lately, ts) AS recent
             FROM (SELECT *, avg(volatility) OVER {O.roll(20)} AS lately FROM lab) GROUP BY 1)), LATERAL (SELECT x.insight AS insight, x.value AS value) WHERE x IS NOT NULL""",
)
register("segment_hurst", "symbol seg:i regime length:i hurst:d", lambda s, d: folds.segment_hurst(labels(s, d)))
INDICATORS = ["trend_strength", "volatility", "volatility_percentile", "log_return", "vol_of_vol", "volume"]
register(
    "indicator_correlation", "symbol first second n:i r:d", lambda s, d: A.correlations(labels(s, d), INDICATORS),
    " UNION ALL ".join(f"SELECT symbol, '{a}' AS first, '{b}' AS second, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM lab GROUP BY symbol" for i, a in enumerate(INDICATORS) for b in INDICATORS[i + 1 :]),
)
register(
    "moving_averages", "symbol ts:t sma_50:e sma_200:e", lambda s, d: returns(s, d).withColumns({f"sma_{n}": F.when(F.count("close").over(rolling(n)) >= n, F.avg("close").over(rolling(n))) for n in (50, 200)}),
    "SELECT symbol, ts, " + ", ".join(f"CASE WHEN count(*) OVER {O.roll(n)} >= {n} THEN avg(close) OVER {O.roll(n)} END AS sma_{n}" for n in (50, 200)) + " FROM li",
)
register(
    "daily_export_projection", "symbol ts:t close:d trend_strength:d volatility:d regime regime_name", lambda s, d: daily_projection(labels(s, d), digits=8),
    "SELECT symbol, ts, close, trend_strength, volatility, regime, regime_name FROM lab",
)
__all__ = ["ORACLES", "QUERIES"]


# --- one long symbol ---------------------------------------------------------------------------------------------


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event values as one symbol's ticks, in at least 32 blocks."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0").groupBy("ts")
    made = events.agg(F.round(F.avg("value"), 6).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"))
    return scans.with_returns(scans.blocked(made.select(F.lit("ALL").alias("symbol"), "ts", "high", "low", "close"), least=32))


def tick_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden states of the ticks: calm returns have half their variance, wild ones four times as much."""
    blocks = ticks(spark, sf_dir)
    spread = F.round(F.var_samp("log_return"), 6)
    matrix = F.array(*map(F.lit, (0.95, 0.05, 0.1, 0.9)))
    given = blocks.groupBy("symbol").agg(spread.alias("v")).select("symbol", F.array(F.lit(0.0), F.lit(0.0)).alias("means"), F.array(0.5 * F.col("v"), 4 * F.col("v")).alias("variances"), matrix.alias("transition"), F.array(F.lit(0.5), F.lit(0.5)).alias("start"))
    return scans.markov_filter(blocks, given)


#: Weights older than this are below a rounding error; the SQL sums what is left outright, without a recurrence.
_SEEN = 1000
TICKS = f"""tk AS (SELECT 'ALL' AS symbol, ts, round(avg(value), 6) AS close, max(value) AS high, min(value) AS low FROM events WHERE value > 0 GROUP BY ts),
tn AS (SELECT *, row_number() OVER o AS rn, ln(close) AS lp, ln(close) - ln(lag(close) OVER o) AS r, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr FROM tk WINDOW o AS (ORDER BY ts)),
tt AS (SELECT symbol, ts, rn, list(tr) OVER (ORDER BY ts ROWS BETWEEN {_SEEN - 1} PRECEDING AND CURRENT ROW) AS l FROM tn),
tr AS (SELECT symbol, ts, rn - 1 AS n, list(r) OVER (ORDER BY ts ROWS BETWEEN {_SEEN - 1} PRECEDING AND CURRENT ROW) AS l FROM tn WHERE rn > 1)"""


def _moments(alpha: str, first: str, new: str) -> str:
    """The bias-corrected deviation of a list under weights that fall by age; the series' first value has its own."""
    weight = f"pow(1 - {alpha}, len(l) - i) * CASE WHEN i = 1 AND n <= {_SEEN} THEN {first} ELSE {new} END"
    total = lambda x: f"list_sum(list_transform(l, lambda x, i: {x}))"
    return f"SELECT symbol, ts, n, {total(weight)} AS s0, {total(weight + ' * x')} AS s1, {total(weight + ' * x * x')} AS s2, {total(f'pow({weight}, 2)')} AS q FROM tr"


_STD = "CASE WHEN n >= {} AND s0 * s0 > q THEN sqrt(greatest(0.0, (s2 / s0 - pow(s1 / s0, 2)) * s0 * s0 / (s0 * s0 - q))) END"
_HALF = f"(1 - exp(-ln(2.0) / {CFG.ewma_halflife}))"
register(
    "ticks_atr", "symbol ts:t rn:i atr:d", lambda s, d: scans.average_true_range(ticks(s, d), CFG),
    f"SELECT symbol, ts, rn, list_sum(list_transform(l, lambda x, i: x * pow(1 - 1.0 / {CFG.atr_window}, len(l) - i) * CASE WHEN i = 1 AND rn <= {_SEEN} THEN 1 ELSE 1.0 / {CFG.atr_window} END)) AS atr FROM tt", TICKS,
)
register(
    "ticks_ewm_volatility", "symbol ts:t rn:i volatility:d", lambda s, d: scans.ewm_volatility(ticks(s, d), CFG),
    f"SELECT t.symbol, t.ts, t.rn, {_STD.format(CFG.volatility_window // 2)} AS volatility FROM tn t LEFT JOIN tm USING (symbol, ts)", TICKS + f",\ntm AS ({_moments(f'2.0 / {CFG.volatility_window + 1}', '1', '1')})",
)
register(
    "ticks_ewma_trend", "symbol ts:t rn:i trend_strength_ewma:d", lambda s, d: scans.ewma_trend(ticks(s, d), CFG),
    f"""SELECT t.symbol, t.ts, t.rn, CASE WHEN {_STD.format(2)} IS NOT NULL AND count(lp) OVER w >= {CFG.trend_window // 2} THEN regr_slope(lp, rn) OVER w / greatest({_STD.format(2)}, 1e-8) END AS trend_strength_ewma
       FROM tn t LEFT JOIN tm USING (symbol, ts) WINDOW w AS (ORDER BY t.ts ROWS BETWEEN {CFG.trend_window - 1} PRECEDING AND CURRENT ROW)""", TICKS + f",\ntm AS ({_moments(_HALF, '1', _HALF)})",
)
register(
    "ticks_markov_filter", "symbol ts:t rn:i markov_prob_high:d", tick_chain,
    # the chain forgets by 0.85 a step, so 400 steps from any start are the whole past
    """SELECT t.symbol, t.ts, t.rn, CASE WHEN l IS NOT NULL THEN list_reduce(list_prepend(CASE WHEN len(l) < 400 THEN CAST(-0.5 AS DOUBLE) ELSE 0.5 END, l),
         lambda p, x: CASE WHEN p < 0 THEN -p * x / (-p * x + 1 + p) ELSE (p * 0.9 + (1 - p) * 0.05) * x / ((p * 0.9 + (1 - p) * 0.05) * x + p * 0.1 + (1 - p) * 0.95) END) END AS markov_prob_high
       FROM tn t LEFT JOIN (SELECT ts, list(x) OVER (ORDER BY ts ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS l FROM tx) USING (ts)""",
    TICKS + ",\ntx AS (SELECT ts, exp(-r * r / (8 * v) + r * r / v) / sqrt(8.0) AS x FROM tn, (SELECT round(var_samp(r), 6) AS v FROM tn) WHERE r IS NOT NULL)",
)


# --- volatility channel ------------------------------------------------------------------------------------------

#: Stand-ins for symbols that have a volatility index, and for the indices: fixed values.
TRADED = {"A": "SPY", "N": "QQQ", "R": "GLD"}
QUOTED = {"1-URGENT": "^VIX", "2-HIGH": "^vxn ", "3-MEDIUM": "^GVZ"}


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars under the names of traded symbols; return flags without one keep their own."""
    b = returns(spark, sf_dir)
    return b.withColumn("symbol", F.coalesce(F.create_map(*[F.lit(x) for p in TRADED.items() for x in p])[F.col("symbol")], F.col("symbol")))


def vol_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as quotes of the volatility indices: several a day, none in the middle of a month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.dayofmonth("o_orderdate").between(1, 9) | (F.dayofmonth("o_orderdate") > 20))
    name = F.create_map(*[F.lit(x) for p in QUOTED.items() for x in p])[F.col("o_orderpriority")]
    return o.select(name.alias("symbol"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 10000).alias("close")).where("symbol is not null")


_TRADED_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRADED.items())
_QUOTED_SQL = " ".join(f"WHEN '{k}' THEN '{v.strip().upper()}'" for k, v in QUOTED.items())
_INDEX_SQL = " ".join(f"WHEN '{v}' THEN '{VOL_INDEX[v]}'" for v in TRADED.values())
register(
    "vol_channel_asof", "symbol ts:t log_return:d implied_vol:d", lambda s, d: channels.implied_vol(traded(s, d), vol_quotes(s, d), 4),
    "SELECT b.symbol, b.ts, b.log_return, CASE WHEN date_diff('day', q.day, b.day) <= 4 THEN q.v END AS implied_vol FROM vb b ASOF LEFT JOIN vq q ON b.idx = q.idx AND b.day >= q.day",
    f"""vb AS (SELECT *, CASE symbol {_INDEX_SQL} END AS idx FROM (SELECT CASE symbol {_TRADED_SQL} ELSE symbol END AS symbol, ts, log_return, CAST(ts AS DATE) AS day FROM lab_a)),
vq AS (SELECT idx, CAST(o_orderdate AS DATE) AS day, max(o_totalprice / 10000 / 100) AS v FROM (SELECT *, CASE o_orderpriority {_QUOTED_SQL} END AS idx FROM orders)
       WHERE idx IS NOT NULL AND (day(o_orderdate) BETWEEN 1 AND 9 OR day(o_orderdate) > 20) GROUP BY 1, 2)""",
)
register("markov_vol_channel", "symbol ts:t markov_prob_high:d markov_state markov_model", lambda s, d: folds.markov(channels.implied_vol(traded(s, d), vol_quotes(s, d), 4), second="implied_vol"))


# --- configuration by source -------------------------------------------------------------------------------------

#: Return flags under the names of a stock and two crypto pairs: fixed values.
MIXED = {"A": "SPY", "N": "BTCUSDT", "R": "ethbtc"}
COINS = Config.crypto()


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.daily_bars(spark, sf_dir)
    return b.withColumn("symbol", F.create_map(*[F.lit(x) for p in MIXED.items() for x in p])[F.col("symbol")])


register(
    "labels_by_source", "symbol ts:t trend_strength:d volatility:d volatility_percentile:d volatility_baseline:d regime regime_name", lambda s, d: by_source(mixed(s, d), labelled),
    "SELECT * FROM ls UNION ALL SELECT * FROM lc",
    "mx AS (SELECT CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIXED.items()) + " END AS symbol, ts, open, high, low, close, volume FROM li),\n"
    "ms AS (SELECT * FROM mx WHERE symbol = 'SPY'), mc AS (SELECT * FROM mx WHERE symbol <> 'SPY'),\n"
    + O.labelled("ls", "ms") + ",\n" + O.labelled("lc", "mc", COINS.trend_window, COINS.percentile_lookback, COINS.baseline_window, COINS.volatility_percentile),
)


# --- append-only refresh -----------------------------------------------------------------------------------------


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the daily bars from three batches, each going on from the states of the one before."""
    bars = S.daily_bars(spark, sf_dir)
    table = Refresher(spark, f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}", CFG)
    for batch in ("ts < '1997-03-01'", "ts >= '1997-03-01' and ts < '1997-03-02'", "ts >= '1997-03-02'"):
        table.apply(bars.where(batch))
    return table.labels()


register("refreshed_labels", "symbol ts:t rn:i trend_strength:d volatility_percentile:d volatility_zscore:d regime atr:d", refreshed, "SELECT l.*, e.atr FROM lab l JOIN ema e ON l.symbol = e.symbol AND l.ts = e.ts", ATR)
