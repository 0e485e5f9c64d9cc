"""Where each symbol stands and what stands out of its history, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.frames import rolling
from tidegauge.operators.regimes import fuzzy_name
from tidegauge.schema import REGIMES


def market_summary(df: DataFrame, clear: float = 0.6, persistent: float = 0.55, reverting: float = 0.45) -> DataFrame:
    """Per symbol the phase of trend, volatility and (with a column hurst) memory at its last bar, and a sentence.

    A phase is clear if its memberships add up to more than ``clear``. Of equal last times any one bar counts.
    """
    names = [fuzzy_name(r) for r in REGIMES]
    memory = ["hurst"] if "hurst" in df.columns else []
    last = df.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by(F.struct(*names, *memory), "ts").alias("x")).select("symbol", "ts", "x.*")

    def mass(fits) -> Column:
        return sum((F.col(fuzzy_name(r)) for r in REGIMES if fits(r)), F.lit(0.0))

    rising, falling, wild = mass(lambda r: r.startswith("Up")), mass(lambda r: r.startswith("Down")), mass(lambda r: r.endswith("HighVol"))
    h = F.col("hurst") if memory else F.lit(None).cast("double")
    phases = {
        "trend_phase": F.when(rising > clear, "rising").when(falling > clear, "falling").otherwise("undecided"),
        "volatility_phase": F.when(wild > clear, "high").otherwise("contained"),
        "memory_phase": F.when(h > persistent, "persistent").when(h < reverting, "reverting").when(h.isNotNull(), "random"),
    }
    told = F.concat_ws(", ", F.concat(F.lit("trend "), "trend_phase"), F.concat(F.lit("volatility "), "volatility_phase"), F.concat(F.lit("moves "), "memory_phase"))
    return last.withColumns(phases).select("symbol", "ts", *phases, told.alias("summary"))


def insights(df: DataFrame, regime: str = "regime", recent: int = 20, persistent: float = 0.55) -> DataFrame:
    """(symbol, insight, value) for what stands out: a side of the trend that prevails by half, volatility of the last
    ``recent`` bars a fifth off its mean, an exponent that is high in over 60 % of the bars (with a column hurst).

    A symbol of which nothing stands out has no row.
    """
    lately = df.withColumn("_lately", F.avg("volatility").over(rolling(recent)))
    memory = F.avg(F.coalesce(F.col("hurst") > persistent, F.lit(False)).cast("double")) if "hurst" in df.columns else F.lit(None).cast("double")
    side = lambda name: F.count_if(F.col(regime).startswith(name))
    told = lately.groupBy("symbol").agg(
        F.count("*").alias("n"), side("Up").alias("up"), side("Down").alias("down"), F.avg("volatility").alias("usual"), F.max_by("_lately", "ts").alias("recent"), memory.alias("memory")
    )
    up, down, ratio = F.col("up"), F.col("down"), F.try_divide("recent", "usual")
    say = lambda text, value: F.struct(F.lit(text).alias("insight"), value.alias("value"))
    found = F.array(
        F.when(up > 1.5 * down, say("mostly rising", up / F.col("n"))).when(down > 1.5 * up, say("mostly falling", down / F.col("n"))),
        F.when(ratio > 1.2, say("volatility above its mean", ratio)).when(ratio < 0.8, say("volatility below its mean", ratio)),
        F.when(F.col("memory") > 0.6, say("persistent", F.col("memory"))),
    )
    return told.select("symbol", F.explode(F.array_compact(found)).alias("x")).select("symbol", "x.*")
