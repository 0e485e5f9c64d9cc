"""Near-duplicate components by an inverted join over MinHash signature coordinates.

1. Sketch. Each document's set of word shingles (64-bit hashes) gives a signature of ``K`` coordinates. Documents
   with equal sets form a class and only its representative goes on, so copies never meet pairwise.
2. Postings. A representative is posted under each (coordinate, value) pair. Pairs that only one of them has cannot
   collide and go; a representative with fewer than ``T`` others cannot reach the match threshold and goes too.
3. Prefix. For at least T common pairs, two signatures must share one among the (m - T + 1) rarest of their m pairs,
   in one global order (frequency, then pair). Only these prefixes are posted for the join.
4. Merging. Inside a bucket, collisions are counted over whole signatures; a pair is handled only in the first prefix
   bucket that it shares, skipped if its sizes cannot reach the similarity, and kept from ``T`` collisions on. In
   large groups the first member is compared with all, which connects most of them.
5. Hot buckets, those of more than a block of members, are never gathered. Their members are first tested against a
   few centres, a block of members at a time with the centre beside it; a member tested in many buckets is tested
   once. Members that reach the bucket's first centre over such links are connected and need no comparison among
   themselves. The others, and only they, meet all members of the bucket, as pairs of blocks.
6. Confirmation. The members of candidate pairs get their full sets, recomputed from the text, and the exact
   similarity is tested. Pairs that are already connected inside the group are skipped: a group emits a spanning
   forest of its links, at most one row per member, whatever the number of links.
7. Components by alternating large-star and small-star rounds over the links, all as aggregates and joins.

The similarity test is exact. The candidates are complete up to the chance that a pair has fewer than T equal
coordinates of K. T lies four standard deviations below the mean for a pair at the bare threshold (21 of 40 at 0.8),
which misses fewer than 1 in 10,000 such pairs and far fewer above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bound_batches, broadcast_if_small, cut, dealt, join_spread, space_words, tidy

K = 40
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_COEFFICIENTS = np.random.default_rng(20240229).integers(0, 2**63, (2, K), dtype=np.uint64)
_MULTIPLY, _ADD = _COEFFICIENTS[0] * np.uint64(2) + np.uint64(1), _COEFFICIENTS[1]
_CACHE_WORDS = 100_000
BLOCK_ROWS, BLOCK_SHINGLES, STAR_FROM, CENTRES = 512, 2_000_000, 64, 4
#: Of tables that grow with the corpus: what a row of (doc_id, th) and a value takes at most as a broadcast relation, and
#: the bytes of such a relation. The driver holds it beside the collected rows and its serialised copy.
RELATION_ROW, RELATION_BYTES = 160, 8 << 20


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHash()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``words`` words; of all words if there are fewer."""
    found = space_words(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, n)
    size = min(words, n)
    with np.errstate(over="ignore"):
        mixed = hashes[: n - size + 1].copy()
        for i in range(1, size):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX1 + hashes[i : n - size + 1 + i] * _MIX2
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX3
        mixed ^= (mixed >> np.uint64(29)) ^ np.uint64(size)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """K coordinates: the least of the upper halves of K linear hashes."""
    low = np.full(K, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            low = np.minimum(low, ((found[at : at + 2048, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return low


def match_threshold(percent: int) -> int:
    """Least number of equal coordinates of a candidate pair."""
    share = min(percent, 100) / 100
    return max(1, int(K * share - 4 * (K * share * (1 - share)) ** 0.5))


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (hash of the text), rid, n (set size), key (128-bit hash of the set), sig; the last two null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, keys, sigs = [], [], []
                for text in part.column(2).to_pylist():
                    found = shingles(text, words)
                    n.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sigs.append(signature(found).view(np.int32) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "th", "n", "key", "sig"])
        tidy(_WORDS)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    made = read.mapInArrow(run, "doc_id long, th long, n long, key binary, sig array<int>")
    return made.withColumn("rid", F.monotonically_increasing_id())


def grouped(batches: Iterator[pa.RecordBatch], keys: int, handle: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """Calls ``handle`` once per run of rows with equal first ``keys`` columns, over a sorted stream of batches."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            made = handle(pa.Table.from_batches(held))
            held.clear()
            if made is not None and made.num_rows:
                yield from made.combine_chunks().to_batches()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(column[a] for column in columns)
            if key != last:
                yield from flush()
                last = key
            held.append(batch.slice(a, b - a))
    yield from flush()
    tidy()


def _signatures(table: pa.Table) -> np.ndarray:
    return table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, K)


def candidate_pairs(table: pa.Table, percent: int, least_hits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows it must be compared with) of one group: columns bkey, b1, b2, block, cid, n, mask, sig.

    Rows are ordered by block, then cid. In a group of a hot bucket (b2 from 0 on) rows of block 0 are compared with
    those of block 1 and with no others.
    """
    coordinate = np.int64(table.column("bkey")[0].as_py() >> 32)
    across = table.column("b2")[0].as_py() >= 0
    block, n, mask, cid = (table.column(c).to_numpy() for c in ("block", "n", "mask", "cid"))
    sig = _signatures(table)
    below = np.int64((1 << int(coordinate)) - 1)
    bits = np.int64(1) << np.arange(K, dtype=np.int64)
    for i in range(len(n) - 1):
        star = i == 0 and len(n) > STAR_FROM
        later = np.arange(i + 1, len(n))
        if across:
            if block[i]:
                break
            later = later[(block[i + 1 :] == 1) & (cid[i + 1 :] != cid[i])]
        least, most = np.minimum(n[i], n[later]), np.maximum(n[i], n[later])
        later = later[100 * least >= percent * most]
        if not len(later):
            continue
        equal = sig[later] == sig[i]
        later_hit = equal.sum(axis=1) >= least_hits
        if later_hit.any():
            # first shared prefix bucket: no lower coordinate is in both prefixes with equal values
            shared = (equal[later_hit] @ bits) & mask[i] & mask[later[later_hit]] & below
            found = later[later_hit][(shared == 0) | star]
            if len(found):
                yield i, found


def _flag(percent: int) -> Callable:
    """Members of a group that have any candidate there."""

    least_hits = match_threshold(percent)

    def handle(table: pa.Table) -> pa.Table | None:
        if table.num_rows < 2:
            return None
        keep = np.zeros(table.num_rows, bool)
        for i, later in candidate_pairs(table, percent, least_hits):
            keep[i] = True
            keep[later] = True
        return table.filter(pa.array(keep)).select(["bkey", "b1", "b2", "block", "cid", "n", "mask", "sig"]) if keep.any() else None

    return lambda batches: grouped(batches, 3, handle)


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of some sets is as similar to the first one as a link asks; all are sorted and not empty."""
    sizes = np.array([len(s) for s in others])
    together = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, together), len(one) - 1)
    common = np.add.reduceat((one[place] == together).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(one) + sizes - common)


def _beside_centre(percent: int) -> Callable:
    """(a, b) of the members of one block that are linked with the centre in its first row."""

    def handle(table: pa.Table) -> pa.Table | None:
        cid = table.column("cid").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
        hit = [_linked(sets[0], sets[at : at + 256], percent) for at in range(1, len(sets), 256)]
        if not hit:
            return None
        found = cid[1:][np.concatenate(hit)]
        return pa.table({"a": pa.array(np.full(len(found), cid[0]), pa.int64()), "b": pa.array(found, pa.int64())})

    return lambda batches: grouped(batches, 2, handle)


def _confirm(percent: int) -> Callable:
    """A spanning forest of a group's links, tested on full sets."""

    least_hits = match_threshold(percent)

    def handle(table: pa.Table) -> pa.Table | None:
        cid = table.column("cid").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
        parent = list(range(len(cid)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        for i, later in candidate_pairs(table, percent, least_hits):
            mine = root(i)
            later = np.array([j for j in later.tolist() if root(j) != mine], int)
            for at in range(0, len(later), 256):
                some = later[at : at + 256]
                for j in some[_linked(sets[i], [sets[j] for j in some], percent)].tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[b] = a
                        links.append((i, j))
        if not links:
            return None
        ends = np.sort(cid[np.array(links)], axis=1)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return lambda batches: grouped(batches, 3, handle)


def posted(classes: DataFrame, least_hits: int) -> DataFrame:
    """(bkey, cid, n, mask, sig): one row per member and prefix bucket, written, as several steps read some of it."""
    pair = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    postings = classes.select("cid", F.posexplode("sig").alias("c", "v")).select("cid", pair.alias("pair"))
    counts = postings.groupBy("pair").agg(F.count("*").alias("f")).where("f > 1")
    mine = postings.join(dealt(counts), "pair").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("f", "pair"))).alias("pairs")).where(F.size("pairs") >= least_hits)
    prefix = F.transform(F.slice("pairs", F.lit(1), F.size("pairs") - (least_hits - 1)), lambda x: x["pair"])
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(p, 32).cast("int"))
    mask = F.aggregate("prefix", F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(bit(p)))
    heads = mine.select("cid", prefix.alias("prefix")).withColumn("mask", mask)
    rows = heads.join(dealt(classes.select("cid", "n", "sig")), "cid")
    return cut(rows.select(F.explode("prefix").alias("bkey"), "cid", "n", "mask", "sig"), "neardup-prefixes")


def bucket_sizes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bkey, members, blocks) of the buckets that one task can hold, and of the hot ones; buckets of one are gone."""
    sizes = rows.groupBy("bkey").agg(F.count("*").alias("members"), F.sum("n").alias("volume")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int")
    sizes = cut(sizes.select("bkey", "members", blocks.alias("blocks")), "neardup-buckets")
    return sizes.where("blocks = 1").select("bkey"), sizes.where("blocks > 1")


def _block(cid: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(cid), F.col(blocks)).cast("int")


def centre_links(hot: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of exact links with centres, and the members (bkey, cid) that do not reach their bucket's first centre.

    ``hot`` is (bkey, members, blocks, cid, n, mask, sig). Centres are drawn by hash, so buckets with the same members
    mostly draw the same ones.
    """
    drawn = [F.min(F.struct(F.xxhash64("cid", F.lit(i)), "cid"))["cid"] for i in range(CENTRES)]
    centres = cut(hot.groupBy("bkey").agg(F.array_distinct(F.array(*drawn)).alias("centres")), "neardup-centres")
    members = hot.select("bkey", "cid", "blocks").join(broadcast_if_small(centres, RELATION_ROW, RELATION_BYTES), "bkey")
    pairs = members.select("cid", "blocks", F.explode("centres").alias("centre")).where("cid <> centre")
    pairs = pairs.groupBy("centre", "cid").agg(F.max("blocks").alias("blocks"))
    pairs = cut(pairs, "neardup-tested")
    parts = pairs.groupBy("centre").agg(F.max("blocks").alias("parts"))
    parts = broadcast_if_small(cut(parts, "neardup-parts"), RELATION_ROW, RELATION_BYTES)
    sides = pairs.join(parts, "centre").select("centre", _block("cid", "parts").alias("part"), "cid", F.lit(1).alias("side"))
    sides = sides.unionByName(parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("cid"), F.lit(0).alias("side")))
    ready = sides.join(dealt(sets), "cid").select("centre", "part", "side", "cid", "set").repartition("centre", "part").sortWithinPartitions("centre", "part", "side", "cid")
    found = cut(ready.mapInArrow(_beside_centre(percent), "a long, b long"), "neardup-centre-links")
    # which of its bucket's centres each member is linked with, and which centres hang together over members
    own = found.groupBy(F.col("b").alias("cid")).agg(F.collect_set("a").alias("linked"))
    bits = F.aggregate(F.transform("centres", lambda c, i: F.when((c == F.col("cid")) | F.array_contains("linked", c), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda x, y: x.bitwiseOR(y))
    marked = cut(members.join(dealt(own), "cid", "left").withColumn("linked", F.coalesce("linked", F.expr("cast(array() as array<long>)"))).select("bkey", "cid", bits.alias("bits")), "neardup-marked")
    reach = F.lit(1)
    grow = lambda have: F.aggregate("sets", have, lambda r, b: F.when(r.bitwiseAND(b) != 0, r.bitwiseOR(b)).otherwise(r))
    for _ in range(CENTRES - 1):
        reach = grow(reach)
    reached = marked.groupBy("bkey").agg(F.collect_set("bits").alias("sets")).select("bkey", reach.alias("reach"))
    left = marked.join(broadcast_if_small(cut(reached, "neardup-reach"), RELATION_ROW, RELATION_BYTES), "bkey").where(F.col("bits").bitwiseAND(F.col("reach")) == 0)
    return found, cut(left.select("bkey", "cid"), "neardup-left")


def hot_rows(hot: DataFrame, left: DataFrame) -> DataFrame:
    """Rows of the groups in which the members left over meet all members of their bucket, one pair of blocks each."""
    some = left.groupBy("bkey").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("few"))
    sized = hot.join(broadcast_if_small(cut(some, "neardup-left-sizes"), RELATION_ROW, RELATION_BYTES), "bkey")
    rest = [F.col(c) for c in ("cid", "n", "mask", "sig")]
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    all_of = sized.select("bkey", spread("few").alias("b1"), _block("cid", "blocks").alias("b2"), F.lit(1).alias("block"), *rest)
    few = sized.join(dealt(left), ["bkey", "cid"]).select("bkey", _block("cid", "few").alias("b1"), spread("blocks").alias("b2"), F.lit(0).alias("block"), *rest)
    return few.unionByName(all_of)


_GROUP = "bkey long, b1 int, b2 int, block int, cid long, n long, mask long, sig array<int>"


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("bkey", "b1", "b2").sortWithinPartitions("bkey", "b1", "b2", "block", "cid")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, set) of the classes wanted (cid, doc_id, th), from the text of their representatives."""
    wanted = broadcast_if_small(wanted, RELATION_ROW, RELATION_BYTES)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingles(t, words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["cid", "set"])
        tidy(_WORDS)

    read = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text"))
    texts = read.join(wanted, (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("cid", "_text")
    # repeated rows give the same set again
    return cut(texts.mapInArrow(sets, "cid long, set binary").groupBy("cid").agg(F.first("set").alias("set")), "neardup-sets")


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between class representatives whose similarity reaches ``percent``: a spanning set of them."""
    # A set of n members and a larger one have similarity n / (n + 1) at most: smaller sets link with equal ones only.
    smallest = next((n for n in range(1, 101) if 100 * n >= percent * (n + 1)), 100)
    rows = posted(classes.where(F.col("n") >= smallest), match_threshold(percent))
    small, large = bucket_sizes(rows)
    many = not large.isEmpty()
    beside = rows
    if many:
        large = broadcast_if_small(large, RELATION_ROW, RELATION_BYTES)
        beside = rows.join(large, "bkey", "left_anti")
    plain = beside.join(dealt(small), "bkey").select("bkey", F.lit(0).alias("b1"), F.lit(-1).alias("b2"), F.lit(0).alias("block"), "cid", "n", "mask", "sig")
    flagged = cut(_by_group(plain).mapInArrow(_flag(percent), _GROUP), "neardup-flagged")
    wanted = flagged.select("cid")
    if many:
        hot = cut(rows.join(large, "bkey"), "neardup-hot")
        wanted = wanted.union(hot.select("cid"))
    full = full_sets(docs, cut(wanted.distinct().join(dealt(classes.select("cid", "rep.doc_id", "rep.th")), "cid"), "neardup-wanted"), words)
    if many:
        found, left = centre_links(hot, full, percent)
        flagged = flagged.unionByName(cut(_by_group(hot_rows(hot, left)).mapInArrow(_flag(percent), _GROUP), "neardup-flagged-hot"))
    ready = _by_group(flagged.join(dealt(full), "cid").select(*[c.split()[0] for c in _GROUP.split(", ")], "set"))
    confirmed = ready.mapInArrow(_confirm(percent), "a long, b long")
    return cut((confirmed.union(found) if many else confirmed).distinct(), "neardup-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that links reach, for every node of an edge (a, b).

    Rounds of large-star and small-star until nothing changes; every step is an aggregate or an equi-join.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")).first())
        if state == before or not state[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: every greater neighbour moves to the least one
        large = both.where("b > a").join(dealt(least), "a").select(F.col("m").alias("a"), "b").distinct()
        # small-star: the lesser neighbours and the node itself move to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(dealt(low), "b").select("m", "a", "b")
        moved = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b"))
        edges = cut(moved.where("a < b").distinct(), "cc-edges")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, th, n_shingles, class_id, component_id (smallest doc_id that links reach), kept, first.

    Two documents are linked if 100 * |common shingles| >= percent * |all shingles|. With fewer words than a shingle
    the whole sequence is one shingle; null or wordless text is an empty set, linked with nothing. Equal sets are
    linked and share a class_id. A null doc_id names a component only if nothing else is there. ``kept`` is doc_id =
    component_id (nulls equal); ``first`` is true for exactly one row of each component, even if rows are repeated.
    ``th`` is xxhash64 of the text. Other columns are dropped; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = cut(sketch(docs, words), "neardup-sketch")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "th")).alias("rep")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("rid").alias("cid"), rep, F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = cut(classes, "neardup-classes")
    joined = components(links(docs, classes, words, percent))
    # classes that are linked with any other; the rest are components of their own
    nodes = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    linked = cut(classes.select("cid", "rep").join(dealt(nodes), F.col("cid") == F.col("node")).drop("node"), "neardup-linked")
    lows = cut(linked.groupBy("root").agg(F.min("rep").alias("low"), F.count("*").alias("members")), "neardup-lows")
    told = join_spread(linked.select("cid", "root"), lows, "root", "members")
    mine = classes.select("key", "cid", "rep", "copies").join(dealt(told), "cid", "left")
    mine = cut(mine.select("key", F.coalesce("root", "cid").alias("class_id"), F.coalesce("low", "rep").alias("low"), "copies"), "neardup-components")
    # texts without words belong to no class and meet nowhere
    lone = rows.where("key is null").withColumns({"class_id": F.lit(None).cast("long"), "low": F.lit(None).cast(mine.schema["low"].dataType)})
    out = join_spread(rows.where("key is not null"), mine, "key", "copies").unionByName(lone)
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id"))
    return out.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("class_id", "rid").alias("class_id"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("rid") == F.col("low.rid"), F.lit(True)).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its columns as they were, whatever those are called: that of the smallest doc_id."""
    found = near_duplicates(docs, words, percent)
    fate = cut(found.groupBy("doc_id", "th").agg(F.max("first").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "neardup-fate")
    fate = broadcast_if_small(fate, RELATION_ROW, RELATION_BYTES)
    same = (F.xxhash64(docs["text"]) == fate["th"]) & docs["doc_id"].cast("long").eqNullSafe(fate["doc_id"])
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    marked = docs.join(fate, same, "left").select(row.alias("row"), fate["doc_id"].alias("id"), fate["th"], fate["stays"])
    again = marked.where("stays").dropDuplicates(["id", "th"])
    return marked.where("stays is null").unionByName(again).select("row.*")


__all__ = ["components", "drop_near_duplicates", "links", "near_duplicates", "shingles", "signature", "sketch"]
