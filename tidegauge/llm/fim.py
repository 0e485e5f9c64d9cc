"""Fill-in-the-middle transformation by a matcher that passes over a text twice and stores no unit.

Units of a text are what ``unit`` matches from left to right. The first pass only counts them; the cuts are drawn from
a hash of the document's id and that count; the second pass advances a lazy iterator of matches to the smaller and then
to the larger rank, and remembers two offsets. Beyond the text itself a document takes constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bound_batches, tidy

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def count_units(pattern: re.Pattern, text: str) -> int:
    """How often the pattern matches; matches are dropped as they are made."""
    last = deque(enumerate(pattern.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def unit_ends(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Offsets behind unit number ``low`` and unit number ``high`` (low <= high, from 1; 0 is the text's start)."""
    matches, at = pattern.finditer(text), 0
    ends = []
    for steps in (low, high - low):
        if steps:
            at = next(islice(matches, steps - 1, None)).end()
        ends.append(at)
    return ends[0], ends[1]


def draw(key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32, the first digit groups of the key's SHA-256."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def cut_text(pattern: re.Pattern, text: str, key: str, keep: int, spm: int) -> tuple[int, str, int | None, int | None]:
    """(units, form, characters before the middle, characters of the middle); the last two are None for form plain."""
    n = count_units(pattern, text)
    h1, h2, h3, h4 = draw(key)
    if not text or h3 % 100 >= keep or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = unit_ends(pattern, text, low, high)
    return n, "spm" if h4 % 100 < spm else "psm", first, second - first


def fill_in_middle(docs: DataFrame, seed: str = "1:", unit: str = UNIT, keep: int = 90, spm: int = 20) -> DataFrame:
    """All rows and columns of ``docs``, with n, form, prefix_chars, middle_chars and output added.

    ``keep`` per cent of the documents are rearranged, ``spm`` per cent of them with the suffix first; empty texts and
    texts that hold a marker stay plain. Null text is empty. Repeated rows are each transformed, and alike, as the cuts
    follow from doc_id (null: no digits) and the text. Texts of any length are read whole. An own column of one of the
    added names is replaced. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<n:long,form:string,prefix_chars:long,middle_chars:long>")
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pattern = re.compile(unit)
        for ids, texts in batches:
            n, form, first, middle = [], [], [], []
            for i, t in zip(ids, texts, strict=True):
                for values, value in zip((n, form, first, middle), cut_text(pattern, t.as_py(), seed + i.as_py(), keep, spm), strict=True):
                    values.append(value)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64())], ADDED[:4])
        tidy()

    own = [c for c in docs.columns if c not in ADDED]
    made = "_" + max(own, key=len)  # longer than any column's name
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(*[F.col(f"`{c}`") for c in own], cuts(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias(made))
    return cut.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"`{made}`")[c].alias(c) for c in ADDED[:4]], arranged(text, F.col(f"`{made}`")).alias("output"))


def arranged(text: Column, cut: Column) -> Column:
    """The text in the order of its form, parts behind their markers."""
    first, middle = cut["prefix_chars"].cast("int"), cut["middle_chars"].cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring(text, F.lit(1), first))
    suffix = F.concat(F.lit(SUFFIX), F.substring(text, first + middle + 1, F.length(text)))
    ordered = F.when(cut["form"] == "spm", F.concat(suffix, prefix)).otherwise(F.concat(prefix, suffix))
    return F.when(cut["form"] == "plain", text).otherwise(F.concat(ordered, F.lit(MIDDLE), F.substring(text, first + 1, middle)))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone.

    A marker has no end that is also its beginning, so none can arise where a part meets a marker.
    """
    behind = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    before = F.split_part(output, F.lit(MIDDLE), F.lit(1))
    psm = F.concat(F.substr(F.split_part(before, F.lit(SUFFIX), F.lit(1)), F.lit(len(PREFIX) + 1)), behind, F.split_part(before, F.lit(SUFFIX), F.lit(2)))
    spm = F.concat(F.split_part(before, F.lit(PREFIX), F.lit(2)), behind, F.substr(F.split_part(before, F.lit(PREFIX), F.lit(1)), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digest(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
