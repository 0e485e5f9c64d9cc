"""Sinks: tables as CSV, JSON or Parquet, nowcasts as JSON lines or text, and a short text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.regimes import fuzzy_name
from tidegauge.schema import REGIMES

DAILY = (
    "symbol", "ts", "open", "high", "low", "close", "volume", "trend_strength", "trend_regime", "volatility", "volatility_percentile", "volatility_regime",
    "hurst", "regime", "regime_name", "valid_signal",
)


def daily_projection(df: DataFrame, fuzzy: bool = False, digits: int = 6) -> DataFrame:
    """The columns of the daily file that are there, doubles rounded."""
    wanted = [*DAILY, *([fuzzy_name(r) for r in REGIMES] + ["fuzzy_confidence"] if fuzzy else [])]
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in wanted if c in kinds])


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None) -> None:
    """A table in one of Spark's formats, through its commit protocol."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).partitionBy(*([partition_by] if partition_by else [])).save(path)


def write_matrix(matrix: DataFrame, path: str, digits: int = 4) -> None:
    """The transition matrix in wide form, one row per regime."""
    labels = sorted(r[0] for r in matrix.select("to_regime").distinct().collect())  # at most as many as there are regimes
    wide = matrix.groupBy("from_regime").pivot("to_regime", labels).agg(F.first(F.round("p", digits))).orderBy("from_regime")
    write_table(wide.coalesce(1), path)


def nowcast_json(nowcast: DataFrame) -> DataFrame:
    """One JSON document per symbol."""
    return nowcast.select(F.to_json(F.struct(*nowcast.columns)).alias("value"))


def export_all(tables: dict[str, DataFrame], df: DataFrame, folder: str, fuzzy: bool = False) -> None:
    """Every table of an analysis below one folder."""
    write_table(daily_projection(df, fuzzy), f"{folder}/daily")
    for name, table in tables.items():
        flat = table.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in table.dtypes])
        write_table(flat, f"{folder}/{name}")


def report(tables: dict[str, DataFrame], most: int = 200) -> str:
    """A text report from the small tables: one line per regime, symbol or pair; past ``most`` lines a section says how many are left out."""
    lines = ["MARKET REGIME REPORT", "=" * 80]
    for title, name, order, template in (
        ("Strategy", "backtest", "symbol", "{headline}\n    {interpretation}"),
        ("Market", "market_summary", "symbol", "{symbol}: {summary}"),
        ("Insights", "insights", "symbol", "{symbol}: {insight} ({value:.3f})"),
        ("Segments", "segment_statistics", "regime", "{regime:<18} n={count} mean length={avg_length:.1f} win rate={win_rate_pct:.1f}%"),
        ("Persistence", "persistence", "regime", "{regime:<18} stays with p={persistence:.3f}"),
        ("Forward returns", "best_and_worst", "horizon", "{horizon:>3} bars: best {best_regime} ({best_mean:.4f}), worst {worst_regime} ({worst_mean:.4f})"),
    ):
        lines += ["", title, "-" * len(title)]
        if name in tables:
            got = tables[name].orderBy(order).limit(most + 1).collect()
            lines += [template.format(**r.asDict()) for r in got[:most]]
            if len(got) > most:
                lines.append(f"... and {tables[name].count() - most} more in the exported table")
    return "\n".join(lines)
