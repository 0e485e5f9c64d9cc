"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

Writing: payload digests are grouped (pre-aggregated, so a payload shared by a third of all pages is no hot spot)
and only the repeats, page by page, are joined back. Records are plain WARC/1.0 text, so Spark's own committed
text writer stores them, in any file system that it knows.

Reading: the magic ``WARC/1.0`` may also stand inside a payload. Every task splits its part of a file at each
magic and emits candidates: offset, and the successor offset that the candidate's own header implies. Candidates
of one segment (``segment_bytes`` of a file) are first chained among themselves, which gives for each the first
successor beyond the segment; pointer jumping from offset 0 of every file over those exits then doubles its reach
per round, so a file of n segments takes log2(n) rounds. Only what is reached is a record; any other magic is
payload. No task holds more than the candidates of one segment. A successor beyond the end of its file is none: the
chain of that file ends there.
"""

from __future__ import annotations

from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import cut, scratch_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
SHORTEST_REVISITED = 100
#: Profile of revisit records: fixed value of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _header_value(value: Column) -> Column:
    """Line breaks and other controls would break the header: they are dropped."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", "")


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """<urn:uuid:...> made of what the record is; rows that are alike in all of it get the same one."""
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit(""))), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))


def write_warc(pages: DataFrame, path: str, shortest: int = SHORTEST_REVISITED, date: datetime | None = None) -> None:
    """One record per row of (page_id, url, html); null html is an empty payload, a null url has no target header.

    Of rows with equal payloads of at least ``shortest`` bytes, those with the smallest page_id (or all of them, if
    no row of the group has one) are responses and the others, null ids included, revisit it; a revisit carries
    the full payload's digest and length, the response's record id, but no payload. All records bear ``date`` (now by
    default). Other columns are ignored.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("id"), _header_value(F.col("url").cast("string")).alias("url"), body.alias("body"))
    read = read.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    keys = read.where(F.col("bytes") >= shortest).select("id", "url", "digest")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    groups = keys.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # Repeated payloads only. As a written table its size is known, so the planner broadcasts it if it is small and shuffles otherwise.
    groups = cut(groups, "payload-groups")
    read = read.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ((F.col("id") != F.col("first.id")) | F.col("id").isNull())
    held = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    origin = F.concat(line("WARC-Refers-To", _record_id(F.col("first.id"), F.col("first.url"), F.col("digest"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("X-Refers-To-Page-Id", F.col("first.id").cast("string")))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("url"), F.col("digest"))),
        F.lit(f"WARC-Date: {(date or datetime.now(UTC)).strftime('%Y-%m-%dT%H:%M:%SZ')}\r\nContent-Type: text/html\r\n"),
        F.coalesce(line("X-Page-Id", F.col("id").cast("string")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, origin).otherwise(""),
        line("Content-Length", F.octet_length(held).cast("string")),
        F.lit("\r\n"),
        held,
    )
    read.select(record.alias("value")).write.option("lineSep", END).text(path)


def _header(name: str) -> Column:
    return F.nullif(F.expr(rf"regexp_extract(concat('\r\n', head), '(?i)\r\n{name}: *([^\r\n]*)', 1)"), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per magic in the archives: file, size up to the next magic, what its header says, payload facts.

    ``length`` is null where no length is stated or the stated one exceeds the file. ``whole`` says whether the
    declared payload ends exactly where the next magic (or the file) begins; ``digest`` is then the payload's.
    ``chunk`` is the text from behind the magic up to the next one.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("rid"), F.col("value").alias("chunk")
    )
    # The reader ends a line at each magic, so the first line of a file is what stands before the first one: nothing.
    lines = lines.withColumn("head", F.expr("substring_index(chunk, '\r\n\r\n', 1)"))
    stated = F.expr(r"try_cast(regexp_extract(concat('\r\n', head), '(?i)\r\nContent-Length: *([0-9]+)', 1) as bigint)")
    lines = lines.withColumns({"size": F.octet_length("chunk").cast("long"), "th": F.xxhash64("chunk"), "length": F.when(stated <= F.col("file_size"), stated), "body_at": F.octet_length("head").cast("long") + 4})
    whole = F.col("length").isNotNull() & (F.col("body_at") + F.col("length") + 4 == F.col("size"))
    payload = F.expr("substring(cast(chunk as binary), try_cast(body_at + 1 as int), try_cast(length as int))")
    lines = lines.withColumn("whole", whole).withColumn("digest", F.when(F.col("whole"), F.sha2(payload, 256)))
    said = {"page_id": _header("X-Page-Id").try_cast("long"), "kind": _header("WARC-Type"), "url": _header("WARC-Target-URI"), "stated": F.regexp_replace(_header("WARC-Payload-Digest"), "^sha256:", "")}
    said |= {"stated_length": _header("X-Payload-Length").try_cast("long"), "refers_to": _header("X-Refers-To-Page-Id").try_cast("long")}
    return lines.withColumns(said).drop("head")


def _with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Candidates without their text, and the byte offset of each one's magic in its file.

    Lines are counted up inside a split, and split totals inside a file; neither group outgrows a split or the
    number of splits.
    """
    facts = cut(candidates(spark, path).drop("chunk"), "warc-lines")
    step = F.col("size") + len(MAGIC)
    totals = facts.groupBy("file", "block").agg(F.sum(step).alias("total"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("file", "block").orderBy("rid").rowsBetween(W.unboundedPreceding, -1)
    placed = facts.withColumn("inner", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(bases, ["file", "block"])
    # A line starts behind the magic that ended the line before it; its own magic is therefore len(MAGIC) earlier.
    placed = placed.withColumn("offset", F.col("base") + F.col("inner") - len(MAGIC)).where("offset >= 0")
    succ = F.col("offset") + len(MAGIC) + F.col("body_at") + F.col("length") + 4
    return placed.withColumn("succ", F.when(succ <= F.col("file_size"), succ)).drop("base", "inner", "block", "file_size")


def _rows(file: str, **columns: list) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"file": pa.array([file] * n, pa.string()), **{k: pa.array(v, pa.int64()) for k, v in columns.items()}})


def _exits(rows: pa.Table, segment_bytes: int) -> pa.Table:
    """For each candidate of one segment the first successor beyond it; null where the chain breaks."""
    rows = rows.sort_by("offset")
    end = (rows.column("segment")[0].as_py() + 1) * segment_bytes
    offsets = rows.column("offset").to_pylist()
    out: dict[int, int | None] = {}
    for offset, succ in zip(offsets[::-1], rows.column("succ").to_pylist()[::-1], strict=True):
        out[offset] = succ if succ is None or succ >= end else out.get(succ)
    return _rows(rows.column("file")[0].as_py(), offset=offsets, exit=[out[o] for o in offsets])


def _walk(rows: pa.Table) -> pa.Table:
    """The candidates of one segment that the chain passes, from its entry on."""
    at = min(filter(lambda x: x is not None, rows.column("entry").to_pylist()), default=None)
    succ = dict(zip(rows.column("offset").to_pylist(), rows.column("succ").to_pylist(), strict=True))
    kept = []
    while at in succ:
        kept.append(at)
        at = succ[at]
    return _rows(rows.column("file")[0].as_py(), offset=kept)


def reachable(found: DataFrame, segment_bytes: int = 64 << 20) -> DataFrame:
    """(file, offset) of the candidates that the chain from offset 0 of their file reaches."""
    pointers = found.select("file", "offset", "succ", F.expr(f"offset div {segment_bytes}").alias("segment"))
    exits = pointers.groupBy("file", "segment").applyInArrow(lambda rows: _exits(rows, segment_bytes), "file string, offset long, exit long")
    last = pointers.agg(F.max("segment")).first()[0]
    reached = found.where("offset = 0").select("file", "offset")
    if last:
        jump = cut(exits.where("exit is not null"), "warc-jumps")
        reached = cut(reached, "warc-reached")
        for _ in range(int(last).bit_length()):
            more = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
            reached = cut(reached.union(more).distinct(), "warc-reached")
            far = jump.select("file", F.col("offset").alias("_from"), F.col("exit").alias("offset")).join(jump, ["file", "offset"])
            jump = cut(far.select("file", F.col("_from").alias("offset"), "exit"), "warc-jumps")
    entries = reached.select("file", F.col("offset").alias("entry"), F.expr(f"offset div {segment_bytes}").alias("segment"))
    marked = pointers.join(entries.select("file", F.col("entry").alias("offset"), F.col("entry")), ["file", "offset"], "left")
    return marked.groupBy("file", "segment").applyInArrow(_walk, "file string, offset long")


def read_warc(spark: SparkSession, path: str, segment_bytes: int = 64 << 20) -> DataFrame:
    """Verified records: page_id, url, record_type, refers_to, payload_bytes, payload_digest (both of the full payload), verified, file, offset.

    A revisit's length and digest are those its header states; a response's are measured, and ``verified`` says
    whether they equal the stated ones. A record that states no length, or one beyond its file's end, is the last of
    its file: it has neither length nor digest and is not verified. A file that does not begin with a record has
    none. Empty archives give no rows.
    """
    found = cut(_with_offsets(spark, path), "warc-candidates")
    records = found.join(reachable(found, segment_bytes), ["file", "offset"])
    # Payloads that hold a magic reach over several lines; only those lines are read again, and only those are gathered.
    # They are told by what they hold: how files are split, and so how lines are numbered, may differ between two reads.
    broken = cut(records.where(~F.col("whole") & (F.col("length") > 0) & F.col("succ").isNotNull()).select("file", F.col("offset").alias("record"), "succ", "body_at", "length"), "warc-broken")
    digest = F.col("digest")
    if not broken.isEmpty():
        bucket = lambda c: F.expr(f"{c} div {1 << 20}")
        spread = broken.withColumn("mib", F.explode(F.sequence(bucket("record"), bucket("succ"))))
        parts = found.withColumn("mib", bucket("offset")).join(spread.select("file", "record", F.col("succ").alias("end"), "mib"), ["file", "mib"])
        parts = cut(parts.where("offset >= record and offset < end").select("file", "th", "size", "offset", "record"), "warc-parts")
        wanted = candidates(spark, path).select("th", "size", "chunk").join(parts.select("th", "size").distinct(), ["th", "size"], "left_semi")
        texts = parts.join(wanted.groupBy("th", "size").agg(F.first("chunk").alias("chunk")), ["th", "size"])
        whole = texts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("offset", "chunk"))).alias("lines"))
        whole = whole.withColumn("text", F.array_join(F.col("lines.chunk"), MAGIC)).join(broken, ["file", "record"])
        payload = F.expr("substring(cast(text as binary), try_cast(body_at + 1 as int), try_cast(length as int))")
        joined = whole.select("file", F.col("record").alias("offset"), F.sha2(payload, 256).alias("joined"))
        records = records.join(joined, ["file", "offset"], "left")
        digest = F.coalesce(digest, F.col("joined"))
    again = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    measured = F.when(F.col("succ").isNotNull(), F.coalesce(digest, F.sha2(F.lit(b""), 256)))
    return records.select(
        "page_id",
        F.when(again, F.col("stated_length")).when(F.col("succ").isNotNull(), F.col("length")).alias("payload_bytes"),
        F.when(again, F.col("stated")).otherwise(measured).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
        "url",
        (F.col("succ").isNotNull() & (again | F.coalesce(F.col("stated") == measured, F.lit(False)))).alias("verified"),
        "file",
        "offset",
    )


def round_trip(pages: DataFrame, segment_bytes: int = 64 << 20) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, segment_bytes)
