"""Secret scan by a trigram inverted index: Boolean trigram queries from each rule's expression, then verification.

From the parse tree of a rule's regular expression follows a query over trigrams, of the form AND of ORs of ANDs,
that every text with a match satisfies. One search of each text gives the trigrams of all rules that it holds (the
others can't matter), and the index that is written from them has, for each block of texts and each trigram, a
posting list of text hashes. Equal texts are one entry. Rules intersect and unite the posting lists of a block; the
texts that remain, and no others, are searched for the rule's expression. A rule without mandatory trigrams scans
every text. Blocks are drawn by hash, so no list outgrows its block, however common a trigram or a text is.
Everything on the data's path is SQL functions; only the rules are analysed in Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, cut
from tidegauge.llm.native import listed, named, spans

#: A query is a conjunction of disjunctions of trigram sets; no disjunctions at all means "any text".
Query = list[list[frozenset[str]]]
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same to Python's and Java's engines; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules whose spans are the base: fixed values. The last two match only where the length suffices, which for
#: whole runs is the same as dropping shorter ones.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Token formats with published prefixes.
FORMAT_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any_of(texts: set[str]) -> Query:
    """Texts that hold one of these strings; nothing to demand if one has no trigram."""
    sets = sorted({_grams(t) for t in texts}, key=sorted)
    # a set that holds another one demands nothing beyond it
    return [[a for a in sets if not any(b < a for b in sets)]] if texts and all(len(t) >= 3 for t in texts) else []


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(the exact lower-case strings, if they are few; what any match demands)."""
    exact, whole, query = {""}, True, []

    def flush() -> None:
        nonlocal exact, whole, query
        query = query + _any_of(exact)
        exact, whole = {""}, False

    for op, arg in nodes:
        if op is C.LITERAL:
            piece, inner = {chr(arg).lower()}, []
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            piece, inner = {chr(a).lower() for _, a in arg}, []
        elif op is C.SUBPATTERN:
            piece, inner = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            piece = set().union(*(p for p, _ in parts)) if all(p is not None for p, _ in parts) else None
            inner = []
            if piece is None:
                demands = [q if p is None else _any_of(p) for p, q in parts]
                if all(demands):  # one clause of each alternative, the first, in one disjunction
                    inner = [[wanted for d in demands for wanted in d[0]]]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            piece, inner = _walk(sub)
            if low == high == 1:
                pass
            elif piece is not None and (low, high) == (0, 1):
                piece, inner = piece | {""}, []
            else:
                inner = [] if low == 0 else inner if piece is None else _any_of(piece)
                piece = None
        elif op is C.AT:
            continue
        else:
            piece, inner = None, []
        if piece is not None and len(piece) * len(exact) <= _MOST:
            exact = {a + b for a, b in product(exact, piece)}
        elif piece is not None:
            flush()
            exact = set(piece)
        else:
            flush()
            query = query + inner
    if whole:
        return exact, _any_of(exact)
    return None, query + _any_of(exact)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must hold for the pattern to match; [] if no trigram is mandatory."""
    exact, query = _walk(parser.parse(pattern))
    return query if exact is None else _any_of(exact)


def _one_of(grams: list[str]) -> str:
    """An expression that stands before each place of any of the trigrams and captures it; sorted by first sign."""
    by_first: dict[str, list[str]] = {}
    for g in sorted(grams):
        by_first.setdefault(g[0], []).append(re.escape(g[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(tails)})" for c, tails in by_first.items()) + "))"


def build_index(docs: DataFrame, grams: list[str], block_texts: int = 4096) -> DataFrame:
    """(block, gram, posting): the sorted hashes of a block's texts that hold the trigram, whatever the case of letters."""
    blocks = max(1, -(-docs.count() // block_texts))
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    held = docs.select(F.xxhash64("text").alias("th"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(_one_of(grams)), F.lit(1)))).alias("gram"))
    lists = held.groupBy(F.pmod(F.xxhash64("th"), F.lit(blocks)).alias("block"), "gram").agg(F.sort_array(F.collect_set("th")).alias("posting"))
    return cut(lists, "secret-postings")


def look_up(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(th, rules): for each text hash that satisfies any of the queries, their bits."""
    none = F.expr("cast(array() as array<long>)")
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "posting"))).alias("of"))

    def both(lists: list[Column]) -> Column:
        return reduce(F.array_intersect, lists)

    def texts(query: Query) -> Column:
        posting = lambda g: F.coalesce(F.try_element_at("of", F.lit(g)), none)
        return both([reduce(F.array_union, [both([posting(g) for g in sorted(wanted)]) for wanted in clause]) for clause in query])

    def marked(query: Query, bit: int) -> Column:
        return F.transform(texts(query), lambda th: F.struct(th.alias("th"), F.lit(bit).cast("long").alias("rule")))

    hits = [marked(q, 1 << i) for i, q in enumerate(queries) if q]
    found = block.select(F.explode(F.concat(*hits)).alias("x")).select("x.*")
    return cut(found.groupBy("th").agg(F.bit_or("rule").alias("rules")), "secret-candidates")


def _verified(text: Column, rule: Rule, candidate: Column) -> Column:
    # A text without any match is the usual case: one search finds that, before the three that positions take.
    searched = candidate & text.rlike(rule.pattern)
    found = spans(text, rule.pattern, searched)
    if not rule.least:
        return found
    group = F.when(searched, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).otherwise(F.expr("cast(array() as array<string>)"))
    paired = F.filter(F.zip_with(found, group, lambda x, g: F.struct(x.alias("x"), g.alias("g"))), lambda p: F.length(p["g"]) >= rule.least)
    return F.transform(paired, lambda p: p["x"])


def scan_secrets(docs: DataFrame, base: list[Rule] | None = None, more: list[Rule] | None = None) -> DataFrame:
    """Per row: doc_id, base (sorted spans of the base rules), found (those of all rules), each array<struct<s,o,e,kind,m>>.

    Spans count code points, the end is exclusive; they sort by start, then by rule order. Null text is empty and has
    none. Repeated rows are scanned one by one. Other columns are dropped; an empty table gives no rows.
    """
    base, more = base or BASE_RULES, FORMAT_RULES if more is None else more
    rules = [*base, *more]
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for wanted in clause for g in wanted})
    read = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.xxhash64("text").alias("_th"))
    if grams:
        candidates = broadcast_if_small(look_up(build_index(docs, grams), queries), 160, 8 << 20)
        read = read.join(candidates, F.col("_th") == F.col("th"), "left")
    else:
        read = read.withColumn("rules", F.lit(None).cast("long"))
    wanted = lambda i, q: F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False)) if q else F.lit(True)
    found = [named(_verified(F.col("_text"), r, wanted(i, q)), r.kind, i) for i, (r, q) in enumerate(zip(rules, queries, strict=True))]
    out = read.select("doc_id", F.sort_array(F.concat(*found)).alias("found"))
    return out.withColumn("base", F.filter("found", lambda x: x["o"] < len(base)))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


__all__ = ["BASE_RULES", "FORMAT_RULES", "Rule", "build_index", "digest", "look_up", "scan_secrets", "trigram_query"]
