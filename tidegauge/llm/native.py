"""Match positions in SQL functions alone: spans of a regular expression in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def spans(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches: start, exclusive end, matched text.

    The text between the matches is what split() returns, so starts are running sums of lengths. Rows for which
    ``only_if`` is false have none and are not searched. A match must not be empty.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda part: F.length(part))
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"), (gap + F.length(m)).alias("step")))
    placed = F.zip_with(steps, offsets(F.transform(steps, lambda x: x["step"])), lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["step"]).alias("e"), x["m"].alias("m")))
    made = F.when(F.size(found) > 0, placed).otherwise(F.expr(NO_SPANS))
    return made if only_if is None else F.when(only_if, made).otherwise(F.expr(NO_SPANS))


#: Elements that are summed up together; arrays are copied per element within such a piece, and per piece beyond.
_PIECE = 256


def offsets(lengths: Column) -> Column:
    """For each element of an array of integers the sum of those before it; an array of any length in nearly linear time."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / _PIECE).cast("int")), lambda p: F.slice(lengths, p * _PIECE + 1, F.lit(_PIECE)))
    none = lambda kind: F.struct(F.lit(0).alias("sum"), F.expr(f"cast(array() as {kind})").alias("out"))

    def within(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def across(acc: Column, piece: Column) -> Column:
        moved = F.transform(piece["out"], lambda x: x + acc["sum"])
        return F.struct((acc["sum"] + piece["sum"]).alias("sum"), F.concat(acc["out"], F.array(moved)).alias("out"))

    folded = F.transform(pieces, lambda p: F.aggregate(p, none("array<int>"), within))
    return F.flatten(F.aggregate(folded, none("array<array<int>>"), across, lambda acc: acc["out"]))


def named(found: Column, kind: str, order: int) -> Column:
    """The same spans as array<struct<s, o, e, kind, m>>, which sorts by start and then by kind."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined in array order."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked(text: Column, found: Column, mark) -> Column:
    """The text with every span replaced by ``mark(span)``; of overlapping spans the first is extended to cover all."""

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        overlap = (F.size(acc) > 0) & (x["s"] < F.try_element_at(acc, F.lit(-1))["e"])
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when(overlap, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))

    empty = F.expr("cast(array() as array<struct<s:int,e:int,kind:string>>)")
    apart = F.aggregate(F.sort_array(found), empty, merge)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["e"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), mark(x)).alias("out"))

    return F.aggregate(apart, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def word_count(text: Column) -> Column:
    """How many runs ``[^\\x20\\x09-\\x0D]+`` the text holds; 0 for null. Parts between gaps, less the empty ends."""
    blank = lambda c: c.rlike(r"^[\x20\x09-\x0D]").cast("int")
    inner = F.size(F.split(text, r"[\x20\x09-\x0D]+", -1)) - blank(text) - blank(F.substring(text, -1, 1))
    return F.when(F.length(text) > 0, F.greatest(inner, F.lit(0))).otherwise(0).cast("long")
