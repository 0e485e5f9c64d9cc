"""Mixing sources to target weights that change over the training run.

Every source has a schedule: knots (at, weight) over training time 0 to 1, straight lines between them. Its integral is
the source's weight in the whole mix; all weights share the corpus's size out, no source gets more than ``repeats``
times what it holds, and what it cannot use goes to the others by weight. The documents of a source, in an order drawn
by hash, form a stream that is read again from its start up to ``repeats`` times. How much of the stream is demanded by
a given time is the integral of the schedule, scaled to the target; inverting that gives every document of every pass
the time at which its first word is due, and a range sort by that time is the training order.

Only SQL functions are used. Running sums over the documents of a source are taken in two levels, within buckets of the
hash and over the buckets' sums, so that a source may hold any share of all rows: with n documents there are about the
square root of n buckets a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import cut
from tidegauge.llm.native import word_count

#: Bits of the document hash that buckets are drawn from.
_BITS = 32
#: Weights count to nine places, so that their sums are the same in any order.
_WEIGHT = "decimal(28,9)"
KNOTS = "array<struct<at:double,weight:double>>"


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source (string), size in words, and mark, which orders the documents of a source."""
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), mark.alias("mark")), "mix-sizes")


def ordered_sources(sized: DataFrame) -> DataFrame:
    """(source, place): the distinct sources with their place from 0, by code point, null last.

    Places are counted within the ranges of a range sort and then over the ranges.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sized.select("source").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    known = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "mix-sources").withColumn("_part", F.shiftright("_at", 33))
    parts = known.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    starts = parts.select("_part", "first", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return known.join(starts, "_part").select("source", (F.col("before") + F.col("_at") - F.col("first")).alias("place"))


def cyclic_schedule(sized: DataFrame, schedules: list[list[tuple[float, float]]]) -> DataFrame:
    """(source, knots): the given schedules dealt to the sources in turn, by code point, null last."""
    dealt = F.array(*[F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(float(w)).alias("weight")) for at, w in s]) for s in schedules])
    return ordered_sources(sized).select("source", F.get(dealt.cast(f"array<{KNOTS}>"), (F.col("place") % len(schedules)).cast("int")).alias("knots"))


def _pieces(knots: Column) -> Column:
    """array<struct<at, length, a, b, before>>: each line of a schedule, with the integral up to its start."""
    knots = F.sort_array(knots)
    lines = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(knots) - 2, F.lit(0))),
        lambda i: F.struct(F.get(knots, i)["at"].alias("at"), (F.get(knots, i + 1)["at"] - F.get(knots, i)["at"]).alias("length"), F.get(knots, i)["weight"].alias("a"), F.get(knots, i + 1)["weight"].alias("b")),
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.expr("cast(array() as array<struct<at:double,length:double,a:double,b:double,before:double>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(x["at"].alias("at"), x["length"].alias("length"), x["a"].alias("a"), x["b"].alias("b"), acc["sum"].alias("before"))
        return F.struct((acc["sum"] + x["length"] * (x["a"] + x["b"]) / 2).alias("sum"), F.concat(acc["out"], F.array(more)).alias("out"))

    return F.aggregate(lines, start, step)


def _due(pieces: Column, demanded: Column) -> Column:
    """The time at which a schedule's integral reaches ``demanded``, from 0 up to below its whole."""
    line = F.element_at(F.filter(pieces, lambda p: (p["before"] <= demanded) & (p["length"] > 0) & (p["a"] + p["b"] > 0)), -1)
    rest = demanded - line["before"]
    root = F.sqrt(F.greatest(line["a"] * line["a"] + 2 * (line["b"] - line["a"]) / line["length"] * rest, F.lit(0.0)))
    into = F.when(rest <= 0, F.lit(0.0)).otherwise(F.least(2 * rest / (line["a"] + root), line["length"]))
    return line["at"] + into


def targets(sized: DataFrame, schedule: DataFrame, repeats: int = 3) -> DataFrame:
    """Per source: source, source_size, target, weight and pieces of its schedule.

    A source without a schedule, or with one knot, weighs nothing. Shares are dealt again until no source is above
    ``repeats`` times its size; each round is one aggregate over the table of sources.
    """
    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = schedule.select(F.col("source").cast("string").alias("_source"), _pieces(F.col("knots").cast(KNOTS)).alias("_whole"))
    known = sizes.join(given, F.col("source").eqNullSafe(F.col("_source")), "left")
    known = cut(known.select("source", "source_size", F.coalesce(F.col("_whole.sum").cast(_WEIGHT), F.lit(0).cast(_WEIGHT)).alias("weight"), F.col("_whole.out").alias("pieces")), "mix-weights")
    most = F.col("source_size") * repeats
    total, weight = known.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, left, full = total or 0, weight or 0, -1
    while left > 0:
        stopped = (F.col("weight") > 0) & (most <= F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(left)))
        used, heavy, n = known.where(stopped).agg(F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0).cast(_WEIGHT)), F.count("*")).first()
        if n == full or heavy == weight:
            break
        rest, left, full = total - used, weight - heavy, n
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(left or 1))
    return known.withColumn("target", F.least(most.cast("double"), share))


def mix(sized: DataFrame, schedule: DataFrame, repeats: int = 3) -> DataFrame:
    """Per row of ``measure``: doc_id, source, size, source_size, target, taken and passes.

    ``passes`` is an array<struct<pass,words,position>>: in pass 0, 1, … the document gives ``words`` words, due at
    ``position`` (0 to 1) of the run; only passes that give words are listed. ``taken`` is their sum. The words taken of
    a source are its target without the fraction, so one document at most is cut. No words (null or empty text): no
    pass. Repeated rows are documents of their own; rows that differ in nothing but further columns share their
    passes out in any order. An empty table gives no rows.
    """
    goals = targets(sized, schedule, repeats)
    buckets = 1 << max(0, (max(sized.count(), 1).bit_length() + 1) // 2)
    number = F.conv(F.substring("mark", 1, _BITS // 4), 16, 10).cast("long")
    placed = sized.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_bucket", F.shiftright(number * buckets, _BITS).cast("int"))
    keys = ["_none", "_source", "_bucket"]
    sums = placed.groupBy(*keys).agg(F.sum("size").alias("_words"))
    starts = sums.withColumn("_before", F.coalesce(F.sum("_words").over(W.partitionBy("_none", "_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goals = goals.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", F.col("weight").cast("double").alias("_weight"), "pieces")
    starts = cut(starts.join(goals, ["_none", "_source"]).drop("_words"), "mix-starts")
    inside = F.coalesce(F.sum("size").over(W.partitionBy(*keys).orderBy("mark", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("_inside", inside).join(starts, keys).withColumn("_first", F.col("_before") + F.col("_inside"))
    want = F.floor("target")

    def give(r: Column) -> Column:
        at = F.col("_first") + r * F.col("source_size")
        words = F.greatest(F.least(want - at, F.col("size")), F.lit(0))
        return F.struct(r.alias("pass"), words.alias("words"), F.when(words > 0, _due(F.col("pieces"), at / F.col("target") * F.col("_weight"))).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), give), lambda p: p["words"] > 0)
    rows = rows.withColumn("passes", passes).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "passes")


def training_order(mixed: DataFrame) -> DataFrame:
    """(position, doc_id, source, pass, words) of every pass of every document, range-sorted by position."""
    each = mixed.select("doc_id", "source", F.explode("passes").alias("_p")).select(F.col("_p.position").alias("position"), "doc_id", "source", F.col("_p.pass").alias("pass"), F.col("_p.words").alias("words"))
    return each.orderBy("position", "doc_id", "pass")


def digest(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and position, the time of the first pass; range-sorted by it."""
    first = F.get("passes", F.lit(0))["position"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")
