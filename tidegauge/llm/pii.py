"""Personal data: exact patterns, and terms that give protected entities away by corpus co-occurrence.

A protected entity is any value that the patterns find (one mail address, say). Terms are all words of all texts,
outside the values found. How strongly a term t reveals an entity c is its pointwise mutual information as a share of
the entity's own information, PMI(c; t) / IC(c), which is 1 if whoever sees t can be sure of c; all probabilities are
document counts over whole texts of the whole corpus. P(c | t) is drawn to P(c) by the weight of ``doubt`` texts, so
that few texts speak less surely than many; by default that weight is the least that keeps a single text from passing
``generalise`` alone, in a corpus of any size: a word that stands beside an entity once is as likely a typo, while two
different texts that agree are enough. Entities of any number of mentions are judged by the same measure. Every
occurrence of a term is replaced by a category mark from ``generalise`` on, and deleted from ``remove`` on, in whatever
text it stands.
Only SQL functions are used, and nothing but aggregates is gathered: counts per (entity, term) and per term, both
summed within tasks before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, cut
from tidegauge.llm.native import listed, masked, named, spans

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans, written so that no text makes the engine backtrack: runs are possessive, and a match
#: starts where a run does (\G: behind the match before it). Chains of digits are maximal either way.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NO_WORD, WORD = r"[^\p{L}]+", r"\p{L}+"
#: What a row of a few numbers takes in a broadcast relation, and the most that one relation may take.
ROW_BYTES, MOST_BYTES = 160, 8 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    figures = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _small_parts(value: Column) -> Column:
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """array<struct<s,o,e,kind,m>> of mail addresses, IP addresses, card and phone numbers, in that order of kinds.

    Only texts that an emptier search finds anything in pay for positions.
    """
    email = spans(text, EMAIL, F.contains(text, F.lit("@")) & text.rlike(EMAIL))
    ip = F.filter(spans(text, IP, text.rlike(IP)), lambda x: _small_parts(x["m"]))
    card = F.filter(spans(text, CARD, text.rlike(CARD)), lambda x: _luhn(x["m"]))
    phone = F.filter(spans(text, PHONE, F.contains(text, F.lit("+")) & text.rlike(PHONE)), lambda x: F.length(_digits(x["m"])).between(8, 15))
    return F.concat(*[named(found, kind, i) for i, (kind, found) in enumerate(zip(KINDS, (email, ip, card, phone), strict=True))])


def _visible(text: Column, found: Column) -> Column:
    """The text with blanks in place of the spans, so that all other places stay where they are."""
    return F.when(F.size(found) > 0, masked(text, found, lambda x: F.repeat(F.lit(" "), x["e"] - x["s"]))).otherwise(text)


def _entity(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], F.when(x["kind"] == "email", F.lower(x["m"])).when(x["kind"] == "ip", x["m"]).otherwise(_digits(x["m"])))


def _words(text: Column) -> Column:
    """Distinct words as they stand."""
    return F.filter(F.array_distinct(F.split(text, NO_WORD)), lambda w: w != "")


def _terms(words: Column) -> Column:
    """Distinct words whatever their case, by hash."""
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lower(w))))


def candidates(rows: DataFrame, least_share: float) -> DataFrame:
    """(term, df): terms of which at least ``least_share`` of their rows hold some entity; no other can be telling.

    A pair is in no more rows than its term and any entity are, and smoothing only lowers what speaks for it. Words are counted by hash and within tasks first, so
    common words move as one count per task, and not as one row per document.
    """
    words = rows.select((F.size("base") > 0).cast("long").alias("some"), F.explode(_terms(_words(F.col("seen")))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("df"), F.sum("some").alias("some"))
    return counts.where((F.col("some") > 0) & (F.col("some") >= F.col("df") * F.lit(least_share * (1 - 1e-9)))).select("term", "df")


def _located(docs: DataFrame) -> DataFrame:
    """(own, th, base, doc_id, text): every row as a struct, with the hash of its text and its base spans; written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    return cut(docs.select(own, F.xxhash64(text).alias("th"), base_spans(text).alias("base")), "pii-base").select("*", F.col("own.doc_id").alias("doc_id"), F.coalesce(F.col("own.text").cast("string"), F.lit("")).alias("text"))


def least_doubt(total: float, generalise: float) -> float:
    """The weight, in texts, under which the word of one text that holds an entity no other text holds just fails."""
    needed = total ** (generalise - 1)
    return 1.001 * (1 - needed) / (needed - 1 / total) if needed > 1 / total else 0.0


def telling_terms(located: DataFrame, generalise: float = 0.9, doubt: float | None = None) -> DataFrame:
    """(term, strength): the words, by hash, that reveal some entity to ``generalise`` of its information or more."""
    rows = located.select("th", "base", _visible(F.col("text"), F.col("base")).alias("seen"))
    total = float(rows.count() or 1)
    doubt = least_doubt(total, generalise) if doubt is None else doubt
    known = cut(candidates(rows, total ** (generalise - 1) if generalise > 0 else 0.0), "pii-candidates")
    holding = rows.where(F.size("base") > 0).select("th", "seen", F.array_distinct(F.transform("base", lambda x: F.xxhash64(_entity(x)))).alias("entities"))
    beside = holding.select("th", "entities", F.explode(_terms(_words(F.col("seen")))).alias("term")).join(broadcast_if_small(known, ROW_BYTES, MOST_BYTES), "term")
    # one row per text and pair, then sums within tasks; texts are told apart by their hash
    per_text = beside.select("th", "term", "df", F.explode("entities").alias("entity")).groupBy("entity", "term", "df", "th").agg(F.count("*").alias("n"))
    pairs = per_text.groupBy("entity", "term", "df").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    whole = holding.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("c"))
    scored = pairs.join(whole, "entity")
    share = lambda a, b: a.cast("double") / b
    information = -F.log(share(F.col("c"), F.lit(total)))
    # the share of a term's rows that hold the entity, drawn to the entity's share of all rows by ``doubt`` texts
    sure = (F.col("texts") * share(F.col("both"), F.col("df")) + doubt * share(F.col("c"), F.lit(total))) / (F.col("texts") + doubt)
    scored = scored.withColumn("strength", F.when(information > 0, (F.log(sure) + information) / information).otherwise(F.lit(0.0)))
    return cut(scored.where(F.col("strength") >= generalise).groupBy("term").agg(F.max("strength").alias("strength")), "pii-telling")


#: Told words of a row are dealt into so many lists at most, for a word to be looked up in one of them.
_MOST_LISTS = 256


def _told(located: DataFrame, telling: DataFrame) -> DataFrame:
    """(_id, _th, told): for each different row that holds telling terms, those terms with their strength, dealt by hash
    into lists of some sixteen."""
    rows = located.select("doc_id", "th", _visible(F.col("text"), F.col("base")).alias("seen"))
    every = rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.explode(_terms(_words(F.col("seen")))).alias("term"))
    hits = every.join(broadcast_if_small(telling, ROW_BYTES, MOST_BYTES), "term").groupBy("_id", "_th").agg(F.collect_set(F.struct("term", "strength")).alias("terms"))
    lists = F.least(F.floor(F.size("terms") / 16) + 1, F.lit(_MOST_LISTS)).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), lists - 1), lambda i: F.filter("terms", lambda t: F.pmod(t["term"], lists) == i))
    return cut(hits.select("_id", "_th", dealt.alias("told")), "pii-told")


def _term_spans(seen: Column, told: Column, remove: float) -> Column:
    """All places of told words, by start; the text is split once and every word looked up in one list."""

    def judged(x: Column) -> Column:
        term = F.xxhash64(F.lower(x["m"]))
        listed = F.get(told, F.pmod(term, F.size(told)).cast("int"))
        return F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), x["e"].alias("e"), F.get(F.filter(listed, lambda t: t["term"] == term), F.lit(0))["strength"].alias("strength"), F.lower(x["m"]).alias("m"))

    kind = lambda x: F.when(x["strength"] >= remove, "cut").otherwise("term")
    known = F.filter(F.transform(spans(seen, WORD, told.isNotNull()), judged), lambda x: x["strength"].isNotNull())
    return F.transform(known, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), kind(x).alias("kind"), x["m"].alias("m")))


def _found(docs: DataFrame, generalise: float = 0.9, remove: float = 0.98, doubt: float | None = None) -> DataFrame:
    """``_located`` with found, the base spans and behind them those of terms."""
    located = _located(docs)
    told = _told(located, telling_terms(located, generalise, doubt))
    same = (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # rows with told words go their own way: their lists may be long, and no other row's text should move for them
    keys = broadcast_if_small(told.select("_id", "_th"), ROW_BYTES, MOST_BYTES)
    more = _term_spans(_visible(F.col("text"), F.col("base")), F.col("told"), remove)
    marked = located.join(keys, same, "left_semi").join(told, same).select(located["*"], F.concat("base", more).alias("found"))
    return located.join(keys, same, "left_anti").withColumn("found", F.col("base")).unionByName(marked)


def find_pii(docs: DataFrame, generalise: float = 0.9, remove: float = 0.98, doubt: float | None = None) -> DataFrame:
    """Per row: doc_id, th (xxhash64 of the text), base and found, array<struct<s,o,e,kind,m>> each.

    ``base`` are the pattern spans by kind, then start; ``found`` adds spans of kind ``term`` (to generalise) and
    ``cut`` (to remove) behind them, by start. Code points, end exclusive. Null text is empty. Repeated rows get the
    same spans each; they count as documents, but not as different texts. Other columns are dropped; an empty table
    gives no rows.
    """
    return _found(docs, generalise, remove, doubt).select("doc_id", "th", "base", "found")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The same rows and columns, whatever those are called; spans in ``text`` become <email>, <ip>, <card>, <phone> or
    <term>, or go (cut)."""
    mark = lambda x: F.when(x["kind"] == "cut", "").otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
    found = _found(docs, **options)
    clean = F.when(F.size("found") > 0, masked(F.col("text"), F.col("found"), mark)).otherwise(F.col("own.text"))
    return found.select(*[(clean if c == "text" else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


__all__ = ["KINDS", "base_spans", "digest", "find_pii", "sanitise"]
