"""Exact top-k inner-product search by MaxScore over integer vectors.

The coordinates are the query's terms, and a value's part of the score counts from the least that the term gives in a
block of rows, so that "absent" means giving the least. Every shard (one task's rows, in blocks) keeps for each
coordinate its range and its postings, the rows sorted by value. With the query's k-th best score so far as
threshold, terms are ordered by the width of their bounds and split: non-essential terms are the longest tail whose
bounds together cannot lift a row over the threshold that gives the least in all terms before it. The first essential
term's postings are entered where its value and all other bounds reach the threshold, so rows below are never met;
the other essential terms are read for those rows, and the non-essential ones are probed a few at a time while a row
is competitive. Ties are never pruned. Each shard gives its own k best per query, and a ranking per query merges them.

Queries travel in blocks of bounded bytes, one pass over the written vectors each; neither the driver nor a task ever
holds more than one block of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import cut

RESULT = "own long, vec_id long, score long"
BLOCK_ROWS = 8192


def quantise(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double; null for a null vector or one with null or non-finite parts."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros or cut to ``width`` (missing terms add nothing)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out, starts = np.zeros((len(sizes), width)), np.cumsum(sizes) - sizes
    for i, (at, n) in enumerate(zip(starts, sizes, strict=True)):
        out[i, : min(n, width)] = values[at : at + min(n, width)]
    return out


class Shard:
    """The k best rows of one shard for each query of a block; rows arrive in batches.

    ``probed`` counts the (query, row, term) values that were read, ``full`` those that a plain scan would read.
    """

    def __init__(self, query_rows: np.ndarray, queries: np.ndarray, k: int, probe: int = 4):
        self.query_rows, self.queries, self.k, self.probe = query_rows, queries, k, probe
        n = len(query_rows)
        self.score, self.vec = [np.empty(0) for _ in range(n)], [np.empty(0, np.int64) for _ in range(n)]
        self.probed = self.full = 0

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.vec[q], ids]), np.concatenate([self.score[q], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.vec[q], self.score[q] = ids[best], scores[best]

    def add(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``own`` numbers the rows of the table, ``ids`` are what they are called."""
        if not len(ids):
            return
        low, high = rows.min(axis=0), rows.max(axis=0)
        columns = np.ascontiguousarray(rows.T)
        postings = np.argsort(columns, axis=1, kind="stable")
        for q, query in enumerate(self.queries):
            self.full += rows.size
            found, scores = self._search(q, query, columns, postings, low, high)
            other = own[found] != self.query_rows[q]
            if other.any():
                self._keep(q, ids[found[other]], scores[other])

    def _search(self, q: int, query: np.ndarray, columns: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block that may be among the k best, with their whole scores."""
        least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
        terms = np.argsort(least - most, kind="stable")
        rest = np.concatenate([np.cumsum(most[terms][::-1])[::-1], [0.0]])  # bound of the terms from a place on
        threshold = self.score[q][-1] if len(self.score[q]) >= self.k else -np.inf
        # before: what a row that is absent from all earlier terms has
        before = np.concatenate([[0.0], np.cumsum(least[terms])])
        hopeless = np.flatnonzero(before[1:] + rest[1:] < threshold)
        essential = int(hopeless[0]) + 1 if len(hopeless) else len(terms)
        live = self._enter(postings[terms[0]], columns[terms[0]], query[terms[0]], threshold - rest[1]) if len(terms) else np.arange(columns.shape[1])
        at, partial = 0, np.zeros(len(live))
        for stop in [*range(essential, len(terms), self.probe), len(terms)]:
            if not len(live):
                break
            step = terms[at:stop]
            self.probed += len(live) * len(step)
            partial = partial + query[step] @ columns[step][:, live]
            at = stop
            stay = partial + rest[at] >= threshold
            if not stay.all():
                live, partial = live[stay], partial[stay]
        return live, partial

    def _enter(self, posting: np.ndarray, column: np.ndarray, weight: float, needed: float) -> np.ndarray:
        """Rows of a posting, sorted by value, that give at least ``needed`` in its term."""
        if weight == 0 or needed == -np.inf:
            return posting if needed <= 0 else posting[:0]
        parts = column[posting] * weight
        if weight > 0:
            return posting[np.searchsorted(parts, needed, "left") :]
        return posting[: len(parts) - np.searchsorted(parts[::-1], needed, "left")]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(v) for v in self.vec]
        own = np.repeat(self.query_rows, sizes)
        vec = np.concatenate(self.vec) if sizes else np.empty(0, np.int64)
        score = np.concatenate(self.score) if sizes else np.empty(0)
        whole = np.clip(score, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(vec, pa.int64()), pa.array(whole, pa.int64())], ["own", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by integer inner product.

    Every query row has its own ranking, over all rows but itself: of rows that share a vec_id each is a query and a
    candidate of its own. Ties go to the smaller vec_id. Vectors that are null, or hold nulls or non-finite
    components, take no part, nor do rows without a vec_id; of vectors of unequal length the missing components count
    as 0. Fewer than k candidates give fewer rows; empty tables give none. Sums are exact while they stay below
    2**53; beyond, they are the nearest double, and outside of a long its nearest end. Other columns are dropped.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantise(F.col("embedding"), scale).alias("v"))
    ready = cut(named.where("vec_id is not null and v is not null").withColumn("own", F.monotonically_increasing_id()), "topk-vectors")
    queries = ready.where("asks").select("own", "vec_id", "v")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = -(-n * (8 * width + 64 + 16 * k) // block_bytes)
    found = spark.createDataFrame([], RESULT)
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("own"), F.lit(blocks)) == b).orderBy("own").toArrow()
        shared = spark.sparkContext.broadcast((mine.column("own").to_numpy(), _matrix(mine.column("v"), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shard = Shard(*shared.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    shard.add(part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width))
            yield shard.rows()

        part = ready.select("own", "vec_id", "v").mapInArrow(run, RESULT)
        found = found.unionByName(part if blocks == 1 else cut(part, "topk-part"))
    order = W.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select("own", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "own").select("query_id", "rank", "vec_id", "score")
