"""Packing of tokenised documents into fixed windows by non-negative least squares over the length histogram.

Only the histogram (one count per length bin, so bounded by the window) ever reaches the driver. There, every
combination of at most ``depth`` bins that exactly fills a window is a column of a matrix; non-negative least
squares finds how often to repeat each, the counts are rounded to what the histogram holds, and what is left is
packed greedily (best fit, longest first) on the histogram as well. The result is a small plan of rank ranges
("pieces 0..4999 of bin 63 go to sequences 100..2599, two each"), which a join by bin and rank applies to all
pieces in parallel.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidegauge.llm.common import bound_batches, cut, tidy

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: Latin-1 without controls, no-break space and soft hyphen: lower-casing, normal form C and the letter, number
#: and space classes are simple there. Any other text goes through the tokenizer library itself.
_SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\r {_LETTER}{_NUMBER}]+")
_CACHE_WORDS = 100_000


def _byte_symbols() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of a pre-token; repeated words are looked up, not merged again.

    The vocabulary names each merge product once, in merge order, so merging by rank over raw bytes gives the same
    ids as the merge list. The end-of-word mark is one more byte, 0xFF, which UTF-8 never uses; its pairs with the
    last byte have the lowest ranks of all and so merge first.
    """

    def __init__(self, tokenizer):
        super().__init__()
        import tiktoken

        raw, ranks = {shown: b for b, shown in _byte_symbols().items()}, {}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            if token not in special:
                ranks[bytes(raw[c] for c in body) + b"\xff" * (body != token)] = i
        ranks[b"\xff"] = 1 << 20
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> list[int]:
        ids = self.merge(word.encode() + b"\xff")
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Exactly ``Tokenizer.encode(text, add_special_tokens=False).ids``, with a word cache for Latin-1 text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)

    def ids(self, text: str) -> np.ndarray:
        if "<|" not in text and _SAFE.fullmatch(text):
            found = chain.from_iterable(map(self.words.__getitem__, _SPLIT.findall(text.lower())))
            return np.fromiter(found, np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: every document's ids, closed by ``end_id``, cut at multiples of ``window``.

    Null text is empty, so it has the single id ``end_id``. Repeated rows stay separate documents. Other columns
    are dropped. With ``keep_ids`` each piece also carries its ids (array<int>); the checksum is always there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path).ids
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(6 if keep_ids else 5)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                        for values, value in zip(out, row, strict=False):
                            values.append(value)
                        if keep_ids:
                            out[5].append(piece.astype(np.int32))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=False)], names[: len(out)])
        tidy(_encoder(tokenizer_path).words)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def bin_size(length, width: int, fine: int):
    """Upper length of a piece's bin: exact up to ``fine``, then rounded up to a multiple of ``width``."""
    return F.when(length <= fine, length).otherwise(F.ceil(length / F.lit(width)) * width).cast("int")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson-Hanson: argmin ||a x - b|| over x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        free = np.where(passive, -np.inf, gradient)
        if passive.all() or free.max() <= limit:
            break
        passive[int(free.argmax())] = True
        while True:
            index = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, index], b, rcond=None)[0]
            if (s > 0).all():
                break
            old = x[index]
            low = s <= 0
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            moved = old + step * (s - old)
            moved[low & (moved <= 1e-12)] = 0.0
            x[:] = 0.0
            x[index] = moved
            passive[index[moved <= 0]] = False
        x[:] = 0.0
        x[index] = s
        gradient = a.T @ (b - a @ x)
    return x


def fillings(sizes: list[int], window: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` of these sizes that sum to the window, largest first."""
    have, out = sorted(sizes), []

    def grow(prefix: tuple[int, ...], rest: int, most: int) -> None:
        if rest == 0:
            out.append(prefix)
            return
        left = depth - len(prefix)
        for s in have:
            if s > min(most, rest):
                break
            if s * left >= rest:
                grow((*prefix, s), rest - s, s)

    grow((), window, window)
    return out


def plan(histogram: dict[int, int], window: int = 2048, depth: int = 3, coarse_from: int = 65) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end rank, first sequence, pieces per sequence, slot) ranges that place every piece.

    ``histogram`` counts pieces by bin size. Each range puts piece number ``first rank + i`` of its bin into
    sequence ``first sequence + i // per``. An empty histogram gives an empty plan.
    """
    left, cursor, out, sequences, slot = dict(histogram), dict.fromkeys(histogram, 0), [], 0, 0

    def place(size: int, first: int, n: int, per: int) -> None:
        nonlocal slot
        out.append((size, cursor[size], cursor[size] + n * per, first, per, slot))
        slot += 1
        cursor[size] += n * per
        left[size] -= n * per

    if left.get(window):
        n = left[window]
        place(window, 0, n, 1)
        sequences = n
    sizes = [s for s, n in left.items() if n and coarse_from <= s < window]
    combos = fillings(sizes, window, depth)
    if combos:
        row = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(combos)))
        for j, combo in enumerate(combos):
            for s in combo:
                a[row[s], j] += 1
        # long pieces weigh more: what is left over should be short, for the greedy step to fill gaps with
        weight = (np.array(sizes) / window) ** 2
        repeats = nnls(a * weight[:, None], np.array([left[s] for s in sizes]) * weight)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] < 0.5:
                break
            need = {s: combos[j].count(s) for s in combos[j]}
            n = min(round(float(repeats[j])), *(left[s] // m for s, m in need.items()))
            if n > 0:
                for s, m in need.items():
                    place(s, sequences, n, m)
                sequences += n
    open_: list[list[int]] = []  # [room, first sequence, number of sequences]
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        while left[size] > 0:
            fits = [g for g in open_ if g[0] >= size]
            if fits:
                group = min(fits, key=lambda g: (g[0], g[1]))
            else:
                group = [window, sequences, -(-left[size] // (window // size))]
                sequences += group[2]
                open_.append(group)
            per = min(group[0] // size, left[size])
            n = min(group[2], left[size] // per)
            place(size, group[1], n, per)
            if n < group[2]:
                open_.append([group[0], group[1] + n, group[2] - n])
            group[:] = [group[0] - per * size, group[1], n]
            open_ = [g for g in open_ if g[0] > 0]
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, depth: int = 3, width: int = 8, fine: int = 64, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their place: the columns of ``tokenize_pieces``, sequence_id and offset.

    Every id of every document lies in exactly one piece; pieces of a sequence follow one another without gaps
    from offset 0 and never exceed the window. An empty table gives no pieces. Ranks are counted in two levels
    (within the written part files, then over their counts), so that a length shared by a third of all documents
    never meets in one task.
    """
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    pieces = tokenize_pieces(docs, tokenizer_path, window, end_id, keep_ids)
    pieces = cut(pieces.withColumn("_bin", bin_size(F.col("length"), width, fine)).withColumn("_rid", F.monotonically_increasing_id()), "pieces")
    pieces = pieces.withColumn("_part", F.shiftright("_rid", 33))
    counts = cut(pieces.groupBy("_bin", "_part").agg(F.count("*").alias("_n")), "piece-counts")
    before = W.partitionBy("_bin").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_bin", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    histogram = {r["_bin"]: r["n"] for r in counts.groupBy("_bin").agg(F.sum("_n").alias("n")).collect()}
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_b", "_lo", "_hi", "_seq", "_per", "_slot")])
    ranges = spark.createDataFrame(plan(histogram, window, depth, fine + 1), schema)
    local = F.row_number().over(W.partitionBy("_bin", "_part").orderBy("_rid")) - 1
    ranked = pieces.withColumn("_local", local).join(starts, ["_bin", "_part"]).withColumn("_rank", F.col("_first") + F.col("_local"))
    # The plan has a few ranges per bin and at most `window` bins, whatever the corpus: safe to broadcast.
    placed = ranked.join(F.broadcast(ranges), (F.col("_bin") == F.col("_b")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.col("_seq") + F.expr("(_rank - _lo) div _per"))
    within = W.partitionBy("sequence_id").orderBy("_slot", "_rank").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if keep_ids else [])
    return placed.select(*[F.col(n).cast("long") if n == "length" else F.col(n) for n in names])
