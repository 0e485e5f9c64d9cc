"""URL rules by hashed expressions: host suffixes times path prefixes, short-prefix equi-join, full digest check.

Only SQL functions are used. Every URL is expanded into the expressions that could name a rule that fits it: its
host and parent domains joined with prefixes of its path, at the (label depth, path length) pairs that rules have.
The join key is the first four bytes of an expression's SHA-256 and nothing else; a partner counts only if the full
digests agree behind the join. The planner broadcasts the rules if they are small by its own estimate and shuffles
by key otherwise. Expressions without a partner go in the same task, all but one of each row, and what is left
folds into its row in partial aggregates before the one shuffle, which is keyed by row and not by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(digest: Column, hex_digits: int) -> Column:
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")


def prepare_rules(rules: DataFrame, hex_digits: int = PREFIX_HEX) -> DataFrame:
    """(host, path, verdict) -> rule, verdict, digest, key and sizes; equal rules keep the smaller verdict."""
    rule = F.concat("host", "path")
    kept = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    digest = F.sha2(rule, 256)
    sizes = [F.length(rule).alias("size"), F.length("host").alias("host_size"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_size")]
    return kept.select(rule.alias("rule"), "verdict", digest.alias("digest"), _key(digest, hex_digits).alias("key"), *sizes)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", hex_digits: int = PREFIX_HEX) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    A rule fits its own host and all subdomains if the path starts with the rule's path; the longest rule (host and
    path together) wins, then the longer host. Without a fitting rule, ``rule`` is null and the verdict is
    ``default``. Null URLs and URLs without ``://`` have an empty host and path and fit no rule with a host. Rows
    are judged one by one, repeated ones too; extra columns are dropped. Keys of ``hex_digits`` digits may collide
    as they like: digests decide.
    """
    ready = prepare_rules(rules, hex_digits)
    shapes = ready.agg(F.collect_set(F.struct("labels", "path_size")).alias("shapes")).scalar()
    read = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("_row"), shapes.alias("_shapes"))
    depth = F.when(F.col("host") != "", F.size(F.split("host", r"\."))).otherwise(0)
    fitting = F.filter("_shapes", lambda x: (x["labels"] <= depth) & (x["path_size"] <= F.length("path")))

    def expression(x: Column) -> Column:
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -x["labels"])
        return F.struct(F.sha2(F.concat(suffix, F.substring(F.col("path"), F.lit(1), x["path_size"])), 256).alias("digest"), F.length(suffix).alias("host_size"))

    spread = read.select("page_id", "host", "path", "_row", F.posexplode_outer(F.transform(fitting, expression)).alias("_at", "_x"))
    spread = spread.withColumn("_key", _key(F.col("_x.digest"), hex_digits))
    joined = spread.join(ready, F.col("_key") == F.col("key"), "left")
    same = F.coalesce((F.col("_x.digest") == F.col("digest")) & (F.col("_x.host_size") == F.col("host_size")), F.lit(False))
    # each row keeps one expression at least, so that it comes out even if nothing fits
    matched = joined.withColumn("_same", same).where(F.col("_same") | (F.coalesce("_at", F.lit(0)) == 0))
    best = F.max(F.when(F.col("_same"), F.struct("size", "host_size", "rule", "verdict")))
    folded = matched.groupBy("_row", "page_id", "host", "path").agg(best.alias("best"))
    return folded.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
