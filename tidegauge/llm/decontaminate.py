"""Benchmark decontamination: a prefix-filtered containment join of documents with item-sized windows.

A benchmark window is ``window`` consecutive words of an item (a shorter item is one window). Words are ordered by
rarity, that is by the number of documents that hold them, counted over the whole corpus. For containment of all
words, the necessary prefix of a window is its one rarest word: a document without it cannot hold the window. So
documents join windows only on that word; its place in the window fixes where the window would start (positional
bound) and end (length bound), and the words between are then compared exactly.

Everything is a join of tables, the benchmark included. While the windows are few (their size is counted), they are
sent to the tasks, each document's words are looked up as they are split, and nothing but counts and hits leaves the
task. Beyond that only (row key, place, word hash) of the documents is shuffled, and the texts are met again for the
final comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_words, bound_batches, cut, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words in a text as it is, A-Z included in the words.
NO_WORD_AS_IS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of windows that are broadcast at most.
BROADCAST_BYTES = 32 << 20


def pieces_of(text: Column) -> Column:
    """words_of(), with an empty string before or behind them where the text begins or ends otherwise."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NO_WORD)


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; none for null."""
    return F.array_remove(pieces_of(text), "")


def count_words(text: Column) -> Column:
    """How many words words_of() has."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), NO_WORD_AS_IS), "")).cast("long")


def _broadcast(df: DataFrame, row_bytes: int, limit: int) -> tuple[DataFrame, bool]:
    small = df.count() * row_bytes <= limit
    return (F.broadcast(df) if small else df), small


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (words, item) of every window; items without words have none, a null id counts as ''."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item", "w", F.explode(starts).alias("at")).select(F.slice("w", F.col("at"), window).alias("words"), "item").distinct()


def rarities(docs: DataFrame, windows: DataFrame, limit: int) -> DataFrame:
    """(h, df): documents that hold each window word that any holds, by hash, over the whole corpus."""
    wanted, _ = _broadcast(cut(windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("h")).distinct(), "windows-words"), 16, limit)
    here = docs.select(F.explode(F.array_distinct(pieces_of(F.col("text")))).alias("word")).select(F.xxhash64("word").alias("h"))
    found, _ = _broadcast(cut(here.join(wanted, "h").groupBy("h").agg(F.count("*").alias("df")), "windows-rarities"), 24, limit)
    return found


def prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """(number, h, place, words): the rarest word of each distinct window, by hash, and its place; windows with a word
    that no document holds are gone."""
    ranked = windows.select("words").distinct().select("words", F.posexplode("words").alias("place", "word")).withColumn("h", F.xxhash64("word"))
    first = ranked.join(rarity, "h").groupBy("words").agg(F.min(F.struct("df", "word", "place", "h")).alias("least"), F.count("*").alias("known"))
    return first.where(F.col("known") == F.size("words")).select(F.monotonically_increasing_id().alias("number"), "least.h", "least.place", "words")


def by_prefix(index: pa.Table) -> dict[bytes, list]:
    """Rarest word -> [(its place, length, {window words: number})], of rows (number, place, words)."""
    found: dict[bytes, dict] = {}
    for number, place, words in zip(*(index.column(c).to_pylist() for c in ("number", "place", "words")), strict=True):
        words = tuple(w.encode() for w in words)
        found.setdefault(words[place], {}).setdefault((place, len(words)), {})[words] = number
    return {word: [(place, n, same) for (place, n), same in places.items()] for word, places in found.items()}


def probe(words: list[bytes], index: dict[bytes, list]) -> list[dict]:
    """start and window number of every occurrence: entered at rarest words, bounded by place and length, compared."""
    if index.keys().isdisjoint(words):
        return []
    found = []
    for at, word in enumerate(words):
        for place, n, same in index.get(word, ()):
            start = at - place
            number = same.get(tuple(words[start : start + n])) if 0 <= start <= len(words) - n else None
            if number is not None:
                found.append({"start": start, "number": number})
    return found


def _scan_few(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    shared = docs.sparkSession.sparkContext.broadcast(by_prefix(index.select("number", "place", "words").toArrow()))
    bound_batches(docs.sparkSession)
    hits = pa.list_(pa.struct([("start", pa.int32()), ("number", pa.int64())]))

    @F.arrow_udf("struct<n_words:long,hits:array<struct<start:int,number:long>>>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, found = [], []
            for at in range(0, len(batch), 256):
                for text in batch.slice(at, 256).to_pylist():
                    words = ascii_words(text)
                    sizes.append(len(words))
                    found.append(probe(words, shared.value))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(found, hits)], ["n_words", "hits"])
        tidy()

    looked = docs.select("doc_id", F.xxhash64("text").alias("th"), look(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("x"))
    rows = cut(looked.select("doc_id", "th", "x.n_words", "x.hits"), "windows-scanned")
    each = rows.select("doc_id", "th", "n_words", F.explode("hits").alias("x")).select("doc_id", "th", "n_words", "x.*")
    return rows.select("doc_id", "th", "n_words"), each.join(F.broadcast(index.select("number", "words")), "number").drop("number")


def _scan_many(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text"))
    words = rows.select("doc_id", "th", words_of(F.col("text")).alias("w"))
    each = words.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    start, n = F.col("pos") - F.col("place"), F.size("words")
    near = each.withColumn("h", F.xxhash64("word")).join(index, "h").where((start >= 0) & (start + n <= F.col("n_words")))
    # texts stay at home while words travel, and meet the few places left over
    places = cut(near.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_words", start.alias("start"), "words").distinct(), "windows-places")
    met = places.join(words, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    found = met.where(F.slice("w", F.col("start") + 1, n) == F.col("words")).select("doc_id", "th", "n_words", "start", "words")
    return rows.select("doc_id", "th", count_words(F.col("text")).alias("n_words")), found


def scan(docs: DataFrame, index: DataFrame, window: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every row, and (doc_id, th, n_words, start, words) of every place where a window stands."""
    few = index.count() * (64 + 24 * window) <= limit
    return _scan_few(docs, index) if few else _scan_many(docs, index)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every row, and (id, th, n_words, n_hit, items) of those that hold any window; items are sorted."""
    windows = cut(item_windows(benchmark, window), "windows-all")
    index = cut(prefixes(windows, rarities(docs, windows, limit)), "windows-prefixes")
    rows, found = scan(docs, index, window, limit)
    found = cut(found, "windows-found")
    span = F.struct(F.col("start").alias("s"), (F.col("start") + F.size("words")).alias("e"))
    spans = found.groupBy("doc_id", "th", "n_words").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    named = found.select("doc_id", "th", "words").distinct().join(windows, "words").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "items")
    both = spans.join(named, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows, cut(both.select(F.col("doc_id").alias("id"), "th", "n_words", _covered(F.col("spans")).alias("n_hit"), "items"), "windows-hits")


def _contaminated(n_hit: Column, n_words: Column, percent: int) -> Column:
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted array), items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of a window; a document is contaminated if at least one word and
    at least ``percent`` per cent of its words are hit. Null or wordless text has no words and no hits. Repeated
    rows are judged one by one; equal windows of several items count for each; other columns are dropped. An empty
    benchmark hits nothing; an empty table gives no rows. Windows of more than ``limit`` bytes are not broadcast.
    """
    rows, found = hits(docs, benchmark, window, limit)
    found, _ = _broadcast(found, 512, limit)
    rows = rows.select("doc_id", F.col("th").alias("_th"), F.col("n_words").alias("_n"))
    joined = rows.join(found, (rows["_th"] == found["th"]) & rows["doc_id"].eqNullSafe(found["id"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return joined.select(
        "doc_id", F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), _contaminated(n_hit, F.col("_n"), percent).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were, whatever those are called.

    A document below ``percent`` keeps the benchmark passages it holds.
    """
    found = hits(docs, benchmark, **options)[1].where(_contaminated(F.col("n_hit"), F.col("n_words"), percent)).select("id", "th").distinct()
    found, _ = _broadcast(found, 48, options.get("limit", BROADCAST_BYTES))
    return docs.join(found, (F.xxhash64(docs["text"]) == found["th"]) & docs["doc_id"].eqNullSafe(found["id"]), "left_anti")
