"""Shared plumbing of the corpus operators: table access, lineage cuts and byte-level word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Word characters are digits, ASCII letters (lower-cased) and every byte of a non-ASCII character.
_ALNUM = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20
    for b in range(256)
)


#: Bytes that a task holds of a table it writes before they go out.
ROW_GROUP_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or a substitute where that is unset.

    Unset on a local master (tests) means /tmp/checkpoints; unset on a cluster means the warehouse if that lies on a
    file system of the cluster. A warehouse in local files is refused, as executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "/tmp/checkpoints"
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.split(":", 1)[0] == "file" or ":" not in warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join for a table that grows with the corpus: both sides are dealt by key and merged, never broadcast.

    The planner judges files by their compressed bytes and takes an array for one element, so that it may broadcast
    what the driver cannot hold.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint if the rows of a table that was ``cut`` stay below ``limit`` bytes; ``dealt`` otherwise.

    ``row_bytes`` is what a row takes, or an expression of it where rows hold arrays or texts of any size.
    """
    taken = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if taken <= limit else dealt(df)


#: A key with at least one of so many rows is heavy; there are no more of them than that.
HEAVY_SHARE = 1000


def join_spread(rows: DataFrame, side: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``side``, which was ``cut`` and has each of their keys once and, as ``weight``, how many
    rows have it.

    Heavy keys are broadcast, which bounds what is sent by their number; the rows of all others are dealt by key, so
    that no key brings a task more than a thousandth of the rows.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(side.where(F.col(weight) * HEAVY_SHARE >= total).drop(weight))
    light = dealt(side.where(F.col(weight) * HEAVY_SHARE < total).drop(weight))
    if not light.take(1):
        return rows.join(heavy, key)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "4m", scanned: int = 512) -> None:
    """Smaller batches than Spark's defaults, which long texts make too large for a small executor: of Arrow (10,000
    rows, no limit of bytes) and of the Parquet reader (4,096 rows).

    A session that has set its own sizes keeps them.
    """
    arrow = "spark.sql.execution.arrow"
    for key, usual, mine in ((f"{arrow}.maxRecordsPerBatch", "10000", rows), (f"{arrow}.maxBytesPerBatch", None, size), ("spark.sql.parquet.columnarReaderBatchSize", "4096", scanned)):
        now = spark.conf.get(key, None)
        if now is not None and (usual is None or now == usual):
            spark.conf.set(key, str(mine))


def tidy(*caches: dict) -> None:
    """At the end of a task: empty its caches and give freed memory back, as workers live on through later stages."""
    for cache in caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8 bytes."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 bytes."""
    return text.translate(ASCII_LOWER).split() if text else []
