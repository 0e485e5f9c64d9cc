"""Toxicity scores behind a noisy-channel restoration of disguised words.

A character trigram model is counted over every document. A token that may be disguised (digits or signs among
letters, separators between letters, letters repeated three times and more; also runs of single letters set apart
by spaces, with the short tokens beside them) becomes a lattice: at each place the sign itself, the letters it commonly stands for, or nothing for a
separator, space or repetition, each with a channel cost. Viterbi decoding under the language model restores the likeliest
reading; tokens without such signs have a single path. The restored words and their beginnings are the features.

Weights are log odds of document frequencies in labelled training rows, then a logistic function of a document's
two highest weights. Labels are used from training rows only, at most ``most_labelled`` of them (a bounded sample by
hash); everything counted from the corpus covers all of it. What reaches the driver is bounded: alphabet cubed
trigram counts, features that at least one in fifty of the toxic sample share, and two numbers per sampled row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import bound_batches, broadcast_if_small, cut, tidy

#: Letters of the model, place 0 being everything else: fixed values.
ALPHABET = "abcdefghijklmnopqrstuvwxyz\xdf\xe0\xe1\xe2\xe3\xe4\xe5\xe6\xe7\xe8\xe9\xea\xeb\xec\xed\xee\xef\xf1\xf2\xf3\xf4\xf5\xf6\xf8\xf9\xfa\xfb\xfc\xffœ"
#: What signs stand for in disguised words: fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = ".-_*~'"
SIZE = len(ALPHABET) + 1
_PLACE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_LOOKUP = np.zeros(0x180, np.int64)
for _c, _i in _PLACE.items():
    _LOOKUP[ord(_c)] = _i
_SAME, _SWAP, _DROP, _TWICE, _KEEP = log(0.6), log(0.12), log(0.25), log(0.05), log(0.002)
#: Signs after which shared beginnings are put out.
_SETTLE = 64
_CACHE_TOKENS = 50_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+(€.*~_'-]|.*([^\W\d_])\1\1)", re.S)
_TRIPLE = re.compile(r"(.)\1\1", re.S)
_TRIM = ".,;:!?\"')]}([{<>…»«"


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams over all texts; texts are kept apart by two non-letters."""
    codes = np.frombuffer("  ".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
    place = np.where(codes < len(_LOOKUP), _LOOKUP[np.minimum(codes, len(_LOOKUP) - 1)], 0)
    return np.bincount((place[:-2] * SIZE + place[1:-1]) * SIZE + place[2:], minlength=SIZE**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) of the corpus, interpolated with lower orders, as an array of shape (SIZE, SIZE, SIZE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                total += trigram_counts([t for t in batch.column(0).slice(at, 256).to_pylist() if t])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})
        tidy()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    three = np.zeros(SIZE**3)
    for row in counts.collect():
        three[row["gram"]] = row["n"]
    three = three.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


def _options(c: str) -> list[tuple[int, float]]:
    """Places that a sign may stand for, with the channel's cost."""
    own = _PLACE.get(c, 0)
    return [*((_PLACE[x], _SWAP) for x in LEET.get(c, "")), (own, _SAME if own or c == " " else _KEEP)]


def _settle(ends: list[_Node], root: _Node, out: list[str]) -> _Node:
    """Puts out what all surviving paths share beyond ``root`` and forgets it; gives the node where they part."""
    meet = list({id(n): n for n in ends}.values())
    while len(meet) > 1:
        deepest = max(n.depth for n in meet)
        meet = list({id(n): n for n in (n.parent if n.depth == deepest else n for n in meet)}.values())
    at, letters = meet[0], []
    while at is not root:
        letters.append(ALPHABET[at.place - 1] if at.place else " ")
        at = at.parent
    out += letters[::-1]
    meet[0].parent = None
    return meet[0]


class _Node:
    """One letter of a path; the paths of a lattice share their beginnings."""

    __slots__ = ("depth", "parent", "place")

    def __init__(self, parent: _Node | None, place: int):
        self.parent, self.place = parent, place
        self.depth = parent.depth + 1 if parent else 0


def decode(token: str, model: list) -> str:
    """The likeliest reading of a disguised token of any length; what is no letter comes out as a space.

    All surviving states go on from sign to sign; now and then the beginning that they agree on is put out, so that a
    long token needs little memory and still gets its best path.
    """
    out: list[str] = []
    root = _Node(None, 0)
    paths: dict[tuple[int, int], tuple[float, _Node]] = {(0, 0): (0.0, root)}
    before = earlier = ""
    for i, c in enumerate(token):
        # a double letter is common in clean words, a triple one is not
        drop = _DROP if c in SEPARATORS or c == " " or (c == before and c == earlier) else _TWICE if c == before else None
        options = _options(c)
        best: dict[tuple[int, int], tuple[float, _Node, int]] = {}
        for (a, b), (score, node) in paths.items():
            if drop is not None and score + drop > best.get((a, b), (-1e300,))[0]:
                best[a, b] = (score + drop, node, -1)
            row = model[a][b]
            for x, cost in options:
                new = score + cost + row[x]
                if new > best.get((b, x), (-1e300,))[0]:
                    best[b, x] = (new, node, x)
        paths = {state: (score, node if x < 0 else _Node(node, x)) for state, (score, node, x) in best.items()}
        earlier, before = before, c
        if i % _SETTLE == _SETTLE - 1:
            root = _settle([node for _, node in paths.values()], root, out)
    last = max(paths.items(), key=lambda p: (p[1][0] + model[p[0][0]][p[0][1]][0], p[0]))
    _settle([last[1][1]], root, out)
    return "".join(out)


def words_of(token: str, model: list) -> set[str]:
    """Letter words of a lower-case token, as they stand and as restored."""
    bare = token.strip(_TRIM)
    words = set(_LETTERS.findall(bare))
    if bare and (" " in bare or _SUSPECT.match(bare)):
        words.update(decode(bare, model).split())
    return words


def features_of(word: str) -> list[str]:
    """The word and its beginnings of four to six letters (marked with a dash)."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens; a run of short ones (one or two signs, but for punctuation around them) with at least
    three single signs also counts as one token with its spaces, which decode() drops or keeps, and its single signs joined."""
    found = text.lower().split()
    distinct = set(found)
    ones = {t for t in distinct if len(t) == 1 or (len(t) < 6 and len(t.strip(_TRIM) or t) == 1)}
    if ones and sum(map(ones.__contains__, found)) >= 3:
        short = [(t if len(t) == 1 else t.strip(_TRIM) or t) if len(t) < 6 else "" for t in found]
        for some, run in groupby(short, lambda t: 0 < len(t) < 3):
            signs = list(run) if some else []
            if sum(len(t) == 1 for t in signs) >= 3 and any(map(_LETTERS.search, signs)):
                distinct.add(" ".join(signs))
                distinct.update("".join(part) for part in (list(g) for one, g in groupby(signs, lambda t: len(t) == 1) if one) if len(part) >= 3)
    return distinct


class _TokenFeatures(dict):
    """Token -> tuple of features; the same token is restored once."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model.tolist()

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= _CACHE_TOKENS // 2:
            self.clear()
        made = self[token] = tuple({f for w in words_of(token, self.model) for f in features_of(w)})
        return made


class _TokenWeights(dict):
    """Token -> highest weight among its features; tokens that need no decoding are looked up and not kept."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        super().__init__()
        self.model = model.tolist()
        self.whole = {f: w for f, w in weights.items() if not f.endswith("-")}
        self.begins = {f[:-1]: w for f, w in weights.items() if f.endswith("-")}

    def of_word(self, word: str) -> float:
        most, n = self.whole.get(word, 0.0), len(word)
        if n > 4:
            begins = self.begins
            most = max(most, begins.get(word[:4], 0.0))
            if n > 5:
                most = max(most, begins.get(word[:5], 0.0), begins.get(word[:6], 0.0) if n > 6 else 0.0)
        return most

    def of(self, token: str) -> float:
        bare = token.strip(_TRIM)
        if bare.isalpha() and not _TRIPLE.search(bare):
            return self.of_word(bare)
        return self[bare] if bare else 0.0

    def __missing__(self, bare: str) -> float:
        if len(self) >= _CACHE_TOKENS:
            self.clear()
        made = self[bare] = max(map(self.of_word, words_of(bare, self.model)), default=0.0)
        return made


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled training rows, those of the smallest hashes; equal texts once."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "toxicity-labels")
    joined = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(broadcast_if_small(chosen, row_bytes=48), F.col("_id") == F.col("doc_id"))
    first = joined.where("text is not null").groupBy(F.xxhash64("text").alias("th")).agg(F.min(F.struct("doc_id", "toxic")).alias("x"))
    kept = broadcast_if_small(cut(first.select("x.doc_id", "x.toxic"), "toxicity-chosen"), row_bytes=48)
    return cut(docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(kept, F.col("_id") == F.col("doc_id")).select("text", "toxic"), "toxicity-sample")


def _count(sample: DataFrame, model, wanted, toxic: int, least: int) -> dict[str, int]:
    """Documents of the sample with each feature: of all features, or of those in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _TokenFeatures(model.value)
        only = None if wanted is None else wanted.value
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                here = {f for t in tokens(text) for f in known[t]}
                counts.update(here if only is None else here & only)
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        tidy(counts, known)

    made = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    return {r["f"]: r["n"] for r in made.where(F.col("n") >= least).collect()}


def _fit(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; all-equal labels give that label a sure intercept."""
    beta = np.zeros(3)
    if not len(y):
        return np.array([0.0, 0.0, -8.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        ridge = np.diag([0.02, 0.02, 0.002])
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + ridge, rows.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _top_two(text: str, weights: _TokenWeights) -> tuple[float, float]:
    top = nlargest(2, filter(None, map(weights.of, tokens(text))))
    return (*top, 0.0, 0.0)[:2]


class Model:
    """Language model, feature weights and calibration; small enough to send to every task."""

    def __init__(self, language: np.ndarray, weights: dict[str, float], beta: np.ndarray):
        self.language, self.weights, self.beta = language, weights, beta


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> Model:
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    language = language_model(docs)
    shared = spark.sparkContext.broadcast(language)
    sample = _sample(docs, labels, most_labelled)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    least = max(4, bad // 50)
    ones = _count(sample, shared, None, 1, least) if bad else {}
    zeros = _count(sample, shared, spark.sparkContext.broadcast(frozenset(ones)), 0, 1) if ones else {}

    def weigh(less_bad: int, less_good: int) -> dict[str, float]:
        """Log odds of each feature, as they are for a document that itself is left out of the counts."""
        made = {}
        for f, n in ones.items():
            n1, n0 = n - less_bad, max(0, zeros.get(f, 0) - less_good)
            w = log((n1 + 0.5) / (bad + 1)) - log((n0 + 0.5) / (good + 1))
            if w > 1 and n1 >= least:
                made[f] = w
        return made

    weights = weigh(0, 0)
    known = spark.sparkContext.broadcast((weigh(0, 1), weigh(1, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_TokenWeights(shared.value, w) for w in known.value]
        for batch in batches:
            two = [_top_two(t, tables[y]) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in two], pa.float64()), pa.array([b for _, b in two], pa.float64()), batch.column(1)], ["a", "b", "toxic"])
        tidy(*tables)

    found = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "a double, b double, toxic int").collect()
    rows = np.array([[r["a"], r["b"], 1.0] for r in found]).reshape(-1, 3)
    return Model(language, weights, _fit(rows, np.array([r["toxic"] for r in found], float)))


def score_of(text: Column, model: Model) -> Column:
    """Score (0 to 1) of each text; null scores as empty. Only texts go to Python, and only scores come back."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        got = shared.value
        table = _TokenWeights(got.language, got.weights)
        for batch in batches:
            two = [_top_two(t, table) for at in range(0, len(batch), 256) for t in batch.slice(at, 256).to_pylist()]
            rows = np.array([(*ab, 1.0) for ab in two]).reshape(-1, 3)
            yield pa.array(1 / (1 + np.exp(-np.clip(rows @ got.beta, -30, 30))), pa.float64())
        tidy(table)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5).

    Null text scores as an empty one. Rows are scored one by one, repeated ones alike; nothing but the text counts.
    """
    bound_batches(docs.sparkSession)
    made = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return made.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they were."""
    return docs.where(score_of(F.col("text"), fit(docs, labels, **options)) < 0.5)
