"""Bar sources: readers, cleaning, symbol rules, and bars built from fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.functions.frames import order, past, whole
from tidegauge.schema import BARS, CRYPTO_TICKERS, PERIODS

#: Full-match symbol formats: fixed values.
STOCK_PATTERN = r"^[\^]?[A-Z0-9.\-]{1,10}(=[XF])?$"
CRYPTO_PATTERN = r"^[A-Z]{2,10}(USDT|BUSD|BTC|ETH|BNB|USD)$"
FIAT = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD")


class SourceError(Exception):
    """Anything that keeps a source from giving bars."""


class InvalidSymbol(SourceError):
    """A symbol that no source accepts."""


class NoData(SourceError):
    """A source without rows for the request."""


def source_type(symbol: Column) -> Column:
    """'crypto' for exchange pairs, else 'stock'."""
    s = F.upper(F.trim(symbol))
    tickers = "|".join(CRYPTO_TICKERS)
    pair = s.endswith("USDT") | s.endswith("BUSD") | s.rlike(f"^({tickers})USD$") | s.rlike(f"^({tickers})({tickers})$")
    return F.when(pair, "crypto").otherwise("stock")


def valid_symbol(symbol: Column) -> Column:
    """Whether the symbol fits the format of its source."""
    s = F.upper(F.trim(symbol))
    return F.coalesce(F.when(source_type(symbol) == "crypto", s.rlike(CRYPTO_PATTERN)).otherwise(s.rlike(STOCK_PATTERN)), F.lit(False))


def normalise_symbol(symbol: Column) -> Column:
    """Currency pairs written with a dash get the quote suffix; all else is trimmed and upper-cased."""
    s = F.upper(F.trim(symbol))
    base, quote = F.element_at(F.split(s, "-"), 1), F.try_element_at(F.split(s, "-"), F.lit(2))
    fx = (F.size(F.split(s, "-")) == 2) & (base != "") & quote.isin(*FIAT) & ~base.isin(*CRYPTO_TICKERS)
    return F.when(fx, F.concat(base, quote, F.lit("=X"))).otherwise(s)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, fmt: str = "parquet", period: str | None = None) -> DataFrame:
    """Bars of a path in any of Spark's formats; symbol and time limits are pushed into the scan.

    Without ``start`` a ``period`` (as 3mo; unknown ones mean 1y) counts back from ``end``, or from now. A requested
    symbol that no source accepts raises InvalidSymbol.
    """
    if symbols:
        asked = spark.createDataFrame([(s,) for s in symbols], "s string")  # as short as the request
        refused = [r["s"] for r in asked.where(~valid_symbol(F.col("s"))).collect()]
        if refused:
            raise InvalidSymbol(f"no source accepts {', '.join(map(repr, refused))}")
    reader = spark.read.format(fmt)
    df = (reader.option("header", True).schema(BARS) if fmt == "csv" else reader.schema(BARS) if fmt == "json" else reader).load(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    elif period is not None:
        until = F.lit(end).cast("timestamp") if end is not None else F.current_timestamp()
        df = df.where(F.col("ts") >= until - F.make_dt_interval(F.lit(PERIODS.get(period, PERIODS["1y"])[1])))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def requested(period: str | None, start: str | None, end: str | None) -> None:
    """Raises ValueError unless a request names a period, or both a start and an end, or nothing."""
    if period and (start or end):
        raise ValueError("give a period, or a start and an end, not both")
    if bool(start) != bool(end):
        raise ValueError("a start needs an end, and an end a start")


def require_rows(df: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """The bars themselves if every requested symbol (without any: the table) has some; else NoData names what is missing."""
    if symbols is None:
        missing = [] if df.head(1) else ["any symbol"]
    else:
        here = {r["symbol"] for r in df.where(F.col("symbol").isin([s.strip().upper() for s in symbols])).select("symbol").distinct().collect()}  # at most the request
        missing = [s for s in symbols if s.strip().upper() not in here]
    if missing:
        raise NoData(f"no bars of {', '.join(missing)}")
    return df


def clean(df: DataFrame, fill: str = "ffill", arrival: str | None = None) -> DataFrame:
    """One row per symbol and time, gaps filled forward, dropped or interpolated, missing columns made up.

    Of repeated rows the first stays: by the column ``arrival`` (nulls last), or without one in the order of the scan
    (file by file, as Spark reads them; give ``arrival`` where the order of files says nothing). A missing volume
    column is 0, a missing price column is the close. Rows without symbol or time go.
    """
    have = set(df.columns)
    if arrival is None:
        df = df.withColumn("_arrival", F.monotonically_increasing_id())
    for c in ("open", "high", "low"):
        if c not in have:
            df = df.withColumn(c, F.col("close"))
    if "volume" not in have:
        df = df.withColumn("volume", F.lit(0.0))
    first = W.partitionBy("symbol", "ts").orderBy(F.col(arrival or "_arrival").asc_nulls_last())
    df = df.where("symbol is not null and ts is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_arrival")
    values = ["open", "high", "low", "close", "volume"]
    if fill == "drop":
        return df.dropna(subset=values)
    if fill == "ffill":
        return df.withColumns({c: F.last(c, True).over(past()) for c in values})
    after = order().rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_rn", F.row_number().over(order()))
    made = {}
    for c in values:
        place = F.when(F.col(c).isNotNull(), F.col("_rn"))
        lo, hi = F.last(place, True).over(past()), F.first(place, True).over(after)
        a, b = F.last(c, True).over(past()), F.first(c, True).over(after)
        made[c] = F.coalesce(F.col(c), a + (b - a) * F.try_divide(F.col("_rn") - lo, hi - lo), a)
    return df.withColumns(made).drop("_rn")


def with_returns(bars: DataFrame) -> DataFrame:
    """log_price, log_return and return of the close; non-positive prices have none."""
    log_price = F.when(F.col("close") > 0, F.log("close"))
    df = bars.withColumn("log_price", log_price)
    before = F.lag("close").over(order())
    return df.withColumns({"log_return": F.col("log_price") - F.lag("log_price").over(order()), "return": F.try_divide(F.col("close"), before) - 1})


def latest_price(bars: DataFrame) -> DataFrame:
    """Last close of each symbol."""
    return bars.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def integrated(observed: DataFrame) -> DataFrame:
    """Bars from (symbol, ts, c, volume): c standardised per symbol is taken as the return and summed up to a price."""
    spread = F.stddev_samp("c").over(whole())
    df = observed.withColumn("_r", F.round(F.coalesce(F.try_divide(0.01 * (F.col("c") - F.avg("c").over(whole())), spread), F.lit(0.0)), 9))
    df = df.withColumn("close", F.round(100 * F.exp(F.sum("_r").over(past())), 8))
    df = df.withColumn("open", F.coalesce(F.lag("close").over(order()), F.col("close")))
    stretch = F.exp(0.005 * F.abs("_r") / 0.01)
    return df.select(
        "symbol", "ts", "open", F.round(F.greatest("open", "close") * stretch, 6).alias("high"), F.round(F.least("open", "close") / stretch, 6).alias("low"), "close", "volume"
    )


def daily_bars(spark: SparkSession, sf_dir: str, key: str = "l_returnflag") -> DataFrame:
    """Daily bars of unit prices by return flag, or by another key of the line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity") > 0)
    observed = items.groupBy(F.col(key).cast("string").alias("symbol"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("c"), F.sum("l_quantity").cast("double").alias("volume")
    )
    return integrated(observed)


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("value").isNotNull())
    observed = events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.round(F.avg("value"), 6).alias("c"), F.count("*").cast("double").alias("volume")
    )
    return integrated(observed)


def tick_bars(ticks: DataFrame, price: str, size: str = "1 hour", tie: str = "event_id") -> DataFrame:
    """True open, high, low and close of (symbol, ts, price) ticks per tumbling window."""
    order = F.struct("ts", tie)
    bucket = F.window("ts", size)["start"].alias("bar")
    df = ticks.groupBy("symbol", bucket).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return df.withColumnRenamed("bar", "ts")
