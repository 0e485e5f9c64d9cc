"""As-of joins, and the implied-volatility channel of a symbol through its index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.lookups import vol_channel


def as_of(rows: DataFrame, series: DataFrame, by: list[str], at: str, since: str, value: str, tolerance_days: int | None = None) -> DataFrame:
    """Adds ``value``, the latest of ``series`` (by, since, value) that is not after the row's ``at``; null without one,
    or with one more than ``tolerance_days`` older.

    One union of both tables, sorted once per key: no dates are exploded and nothing is broadcast. A value counts from
    its own time on, so it reaches rows of the same time. Null values are skipped, of several at one time the largest
    counts. Rows with a null key or time keep a null; repeated rows stay.
    """
    dated = series.where(F.col(value).isNotNull() & F.col(since).isNotNull()).groupBy(*by, F.col(since).cast("timestamp").alias("_at")).agg(F.max(value).alias("_value"))
    asked = rows.drop(value).withColumns({"_at": F.col(at).cast("timestamp"), "_asks": F.lit(True)})
    both = asked.unionByName(dated.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    frame = W.partitionBy(*by).orderBy("_at", "_asks").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("_asks"), F.struct("_at", "_value")), True).over(frame)
    known = F.lit(True)
    for c in (*by, "_at"):
        known = known & F.col(c).isNotNull()
    if tolerance_days is not None:
        known = known & (F.datediff(F.col("_at"), F.col("_last._at")) <= tolerance_days)
    found = both.withColumn("_last", last).where("_asks").withColumn(value, F.when(known, F.col("_last._value")))
    return found.drop("_at", "_asks", "_value", "_last")


def implied_vol(bars: DataFrame, quotes: DataFrame, tolerance_days: int = 0) -> DataFrame:
    """Adds implied_vol: the close of the symbol's volatility index on the bar's date, as a share, or the latest one of
    the ``tolerance_days`` days before.

    ``quotes`` are bars of the indices, in per cent. Quotes are routed to every symbol of their index, so that the join
    is dealt by symbol, like every window over bars, and an index that most symbols share makes no large group. A symbol
    without an index, or whose index is not quoted, has nulls.
    """
    routes = bars.select("symbol").distinct().withColumn("_index", vol_channel(F.col("symbol"))).where("_index is not null")
    dated = quotes.select(F.upper(F.trim("symbol")).alias("_index"), F.to_date("ts").alias("_since"), (F.col("close") / 100).alias("implied_vol")).join(routes, "_index").drop("_index")
    return as_of(bars.withColumn("_day", F.to_date("ts")), dated, ["symbol"], "_day", "_since", "implied_vol", tolerance_days).drop("_day")
