"""Prefix trie of conversations, built a level at a time and rolled up the same way.

A node at depth d is a distinct sequence of d turns and is named by its depth and the smallest conv_id below it. Going
down, the conversations still live at depth d - 1 are grouped by (node, next turn); each group is a node of depth d.
One of a single conversation is the head of a chain that ends with it, so only members of larger groups stay live, and
the levels end where nothing is shared any more. Going up, each level's sums of leaves and savings are joined to the
nodes above it.

Turns are compared by SHA-256 of role and text. Neither a long conversation nor a turn that many share meets in one
task: places of turns are counted within and then over the ranges of a range sort, turns travel in blocks of
``BLOCK_TURNS``, groups are partial aggregates, and the few groups that hold a thousandth of the live conversations or
more are broadcast when names are given back to their members. Tables of the levels lie in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import bound_batches, cut, scratch_path
from tidegauge.llm.native import word_count

BLOCK_TURNS = 16
#: A group with at least one of so many live conversations is heavy; there are no more of them than that.
HEAVY_SHARE = 1000
#: Characters of joined ids that one row of the hashing of ends carries.
CHUNK_CHARS = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, parts): every turn with its key, words and range, and per (conv_id, part) what its place is counted from.

    Turns are ordered by turn (null first), ties by key. The place of a turn, from 0, is ``_at`` - first + before. Rows
    without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), key.alias("key"), word_count(text).alias("words")).where("conv_id is not null")
    ranged = rows.repartitionByRange("conv_id", "_turn", "key").sortWithinPartitions("conv_id", "_turn", "key").drop("_turn")
    turns = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "trie-turns").withColumn("_part", F.shiftright("_at", 33))
    parts = turns.groupBy("conv_id", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return turns, cut(parts.withColumn("before", before), "trie-parts")


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) of conversations as they are: (conv_id, n_turns) and (conv_id, depth, key, words)."""
    turns, parts = numbered_turns(conversations)
    placed = turns.join(parts, ["conv_id", "_part"]).withColumn("depth", F.col("_at") - F.col("first") + F.col("before") + 1)
    return parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns")), placed.select("conv_id", "depth", "key", "words")


def rebuilt(conversations: DataFrame, head: Column, group: int) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) like ``plain``, after each conversation c has taken the first ``head`` turns (0 to ``group`` - 1,
    of the column conv_id) from conversation c - c % group in place of its own.

    Where that one has fewer, all of them are taken; where it is absent, none. A conversation may be left without turns.
    """
    turns, parts = numbered_turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumn("head", head.cast("long")).withColumn("base", base)
    lenders = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(lenders, "base", "left").withColumn("lent", F.least("head", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.withColumn("n_turns", F.col("lent") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))), "trie-convs")
    # joined by conversation and range, so that a long conversation lies in as many groups as it has ranges
    placed = turns.join(parts.join(convs.select("conv_id", "head", "lent"), "conv_id"), ["conv_id", "_part"]).withColumn("place", F.col("_at") - F.col("first") + F.col("before"))
    own = placed.where(F.col("place") >= F.col("head")).select("conv_id", (F.col("place") - F.col("head") + F.col("lent") + 1).alias("depth"), "key", "words")
    offered = placed.where((F.col("conv_id") % group == 0) & (F.col("place") < group)).select(F.col("conv_id").alias("base"), "place", "key", "words")
    lent = convs.where("lent > 0").select("conv_id", "base", "lent").join(offered, "base").where(F.col("place") < F.col("lent"))
    return convs.select("conv_id", "n_turns"), own.unionByName(lent.select("conv_id", (F.col("place") + 1).alias("depth"), "key", "words"))


def _ends(enders: DataFrame) -> DataFrame:
    """(depth, node, ends): SHA-256 of the comma-joined ids of the conversations that end at a node, ascending.

    Ids are sorted and joined in ranges, many ranges to a node if need be; the hash of a node then reads its chunks of
    ids one after another, which is all that the definition leaves to one task.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["depth", "node", "first", "ids"])

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((depth, node) != at or size >= CHUNK_CHARS):
                    yield chunk()
                    held, size = [], 0
                if not held:
                    at, first = (depth, node), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "node", "ends"])

        for batch in batches:
            for depth, node, ids in zip(*(batch.column(i) for i in (0, 1, 3)), strict=True):
                here = (depth.as_py(), node.as_py())
                if here != at:
                    if at is not None:
                        yield result()
                    at, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if at is not None:
            yield result()

    order = ["depth", "node", "conv_id"]
    chunks = enders.select(*[F.col(c).cast("long") for c in order]).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, node long, first long, ids string")
    chunks = cut(chunks, "trie-ends")
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node long, ends string")


def build(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie, the root included: the columns of ``NODE``.

    ``convs`` is (conv_id, n_turns), ``turns`` is (conv_id, depth from 1, key, words). ``saved_tokens`` sums over a
    node's subtree the words of each node's last turn, times its conversations but one. No conversations: no nodes.
    """
    spark = convs.sparkSession
    bound_batches(spark)
    home = scratch_path(spark, "trie-levels")
    turn = F.struct("depth", "key", "words")
    blocks = turns.groupBy("conv_id", ((F.col("depth") - 1) / BLOCK_TURNS).cast("long").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("ahead"))
    blocks = cut(blocks, "trie-blocks")
    # a conversation that is alone in the table is a chain from the root on; the root is a group like any other
    root, everyone = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not everyone:
        return spark.createDataFrame([], NODE)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    live = convs.select("conv_id", "n_turns", F.lit(root).alias("node"), F.lit(0).cast("long").alias("depth"))
    live, depth, n_live = written(live, "live/level=0"), 0, everyone
    levels: list[DataFrame] = []
    while n_live:
        if depth % BLOCK_TURNS == 0:
            live = live.select("conv_id", "n_turns", "node").join(blocks.where(F.col("block") == depth // BLOCK_TURNS).drop("block"), "conv_id")
            live = written(live, f"supplied/level={depth}")
        depth += 1
        going = live.where(F.col("n_turns") >= depth).select("conv_id", "n_turns", "node", F.get("ahead", F.lit(0)).alias("_next"), F.slice("ahead", 2, BLOCK_TURNS).alias("ahead"))
        going = going.select("conv_id", "n_turns", "node", F.col("_next.key").alias("key"), F.col("_next.words").alias("words"), "ahead")
        groups = going.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("n_turns").alias("last"))
        groups = written(groups.withColumn("depth", F.lit(depth).cast("long")), f"groups/level={depth}")
        levels.append(groups)
        shared = groups.where("n_convs > 1").select("node", "key", F.col("conv_id").alias("_to"), "n_convs")
        n_live, most = shared.agg(F.coalesce(F.sum("n_convs"), F.lit(0)), F.max("n_convs")).first()
        if n_live:
            heavy = F.broadcast(shared.where(F.col("n_convs") * HEAVY_SHARE >= n_live).drop("n_convs"))
            light = shared.where(F.col("n_convs") * HEAVY_SHARE < n_live).drop("n_convs")
            moved = going.join(heavy, ["node", "key"])
            if light.take(1):
                moved = moved.unionByName(going.join(heavy, ["node", "key"], "left_anti").join(light, ["node", "key"]))
            moved = moved.select("conv_id", "n_turns", F.col("_to").alias("node"), F.lit(depth).cast("long").alias("depth"), "ahead")
            live = written(moved, f"live/level={depth}")
    return _rolled_up(levels, home, root, everyone)


def _rolled_up(levels: list[DataFrame], home: str, root: int, everyone: int) -> DataFrame:
    """Nodes with their sums: shared ones from the deepest level up, the chains of single conversations beside them."""
    spark = levels[0].sparkSession
    members = spark.read.schema("conv_id long, n_turns long, node long, depth long").parquet(f"{home}/live")
    ends = cut(_ends(members.where("n_turns = depth").select("depth", "node", "conv_id")), "trie-hashes")
    top = spark.range(1).select(F.lit(None).cast("long").alias("node"), F.lit(root).alias("conv_id"), F.lit(everyone).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("depth"))
    below: DataFrame | None = None
    for depth in range(len(levels), -1, -1):
        level = levels[depth - 1] if depth else top
        shared = level.where("n_convs > 1") if depth else level
        columns = ["conv_id", "depth", F.col("node").alias("parent_conv_id"), "n_convs", "words"]
        if below is None:
            rolled = shared.select(*columns, F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            rolled = shared.select(*columns).join(sums, "conv_id", "left")
        rolled = rolled.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
        rolled.write.parquet(f"{home}/rolled/level={depth}")
        rolled = spark.read.schema(rolled.schema).parquet(f"{home}/rolled/level={depth}")
        if depth:
            alone = level.where("n_convs = 1").select(F.col("node").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
            below = rolled.select("parent_conv_id", "n_leaves", "saved_tokens").unionByName(alone)
    names = [c.split()[0] for c in NODE.split(", ")]
    nodes = spark.read.schema(", ".join(NODE.split(", ")[:-1])).parquet(f"{home}/rolled")
    hashes = ends.withColumnRenamed("node", "conv_id")
    nodes = nodes.join(hashes, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NOTHING)))
    heads = spark.read.schema("conv_id long, depth long, node long, n_convs long, last long").parquet(f"{home}/groups").where("n_convs = 1")
    chain = heads.select("conv_id", F.col("depth").alias("_head"), F.col("node").alias("_above"), "last", F.explode(F.sequence("depth", "last")).alias("depth"))
    one, none, end = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("depth") == F.col("last")
    chain = chain.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("_head"), F.col("_above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(end, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    )
    return nodes.select(*names).unionByName(chain.select(*names))


__all__ = ["NODE", "build", "plain", "rebuilt"]
