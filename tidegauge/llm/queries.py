"""Registered queries of the corpus operators: ``QUERIES`` by name, and ``ORACLES`` where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP8_SQL = """
WITH e AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.own <> c.own WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidegauge.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


#: (host, path, verdict): fixed values.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.urlfilter import judge

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules)


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".replace("{}", f"{h}{p}|{v}") for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
)
OP3_SQL = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE {_FITS} END AS hit FROM u)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule, coalesce(split_part(hit, '|', 2), 'allow') AS verdict FROM j
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.secretscan import digest, scan_secrets

    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.licenses import scan_licenses

    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["first"], x["end"])), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("spans", listed)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: A-Z to a-z only; words are runs of digits, letters and non-ASCII characters.
_SQL_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

#: Knots (time, weight) of the schedules that sources take in turn; they integrate to 1, 2 and 3.
MIX_SCHEDULES = [[(0, 1.5), (0.5, 1), (1, 0.5)], [(0, 2), (1, 2)], [(0, 2), (0.5, 3), (1, 4)]]


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.mixing import cyclic_schedule, digest, measure, mix

    sized = measure(table(spark, sf_dir, "documents"))
    return digest(mix(sized, cyclic_schedule(sized, MIX_SCHEDULES))).withColumn("position", F.round("position", 6))


def _due_sql(y: str) -> str:
    """The time at which a source of weight k (1, 2, 3) has given the share ``y`` of its target."""
    rising = f"CASE WHEN {y} * 3 < 1.25 THEN {y} * 6 / (2 + sqrt(4 + 4 * {y} * 3)) ELSE 0.5 + 2 * ({y} * 3 - 1.25) / (3 + sqrt(9 + 4 * ({y} * 3 - 1.25))) END"
    falling = f"CASE WHEN {y} < 0.625 THEN 2 * {y} / (1.5 + sqrt(2.25 - 2 * {y})) ELSE 0.5 + 2 * ({y} - 0.625) / (1 + sqrt(1 - 2 * ({y} - 0.625))) END"
    return f"CASE k WHEN 1 THEN {falling} WHEN 2 THEN {y} ELSE {rising} END"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS mark, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 1 + place % 3 AS k, 3.0::DOUBLE * source_size / (1 + place % 3) AS ratio FROM s),
b AS (SELECT *, sum(source_size) OVER () AS total, sum(k) OVER () AS weight, coalesce(sum(3 * source_size) OVER p, 0) AS used, coalesce(sum(k) OVER p, 0) AS heavy FROM w
      WINDOW p AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size <= CAST(k AS DOUBLE) * CAST(total - used AS DOUBLE) / CAST(weight - heavy AS DOUBLE) AS stops FROM b),
f AS (SELECT *, total - coalesce(sum(CASE WHEN stops THEN 3 * source_size END) OVER (), 0) AS rest, weight - coalesce(sum(CASE WHEN stops THEN k END) OVER (), 0) AS unstopped FROM c),
t AS (SELECT source, source_size, k, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(k AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(unstopped AS DOUBLE) END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.k, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mark, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CAST(list_sum(list_transform([0, 1, 2], lambda i: greatest(least(floor(target) - first - i * source_size, size), 0))) AS BIGINT) AS taken FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round({_due_sql("(first / target)")}, 6) END AS position FROM g
"""


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.fim import digest, fill_in_middle

    return digest(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS h FROM documents),
k AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.trie import build, rebuilt

    return build(*rebuilt(table(spark, sf_dir, "conversations"), F.crc32(F.col("conv_id").cast("string")) % 4, 20))


#: CRC-32 of a decimal number mod 4, a bit at a time: a digit enters, then eight shifts follow.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], list_transform(range(8), lambda i: -1))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4"""
OP13_SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(words ORDER BY turn NULLS FIRST, key) AS words FROM t GROUP BY c),
h AS (SELECT *, CAST({_CRC_SQL} AS BIGINT) AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.keys, [])[1:h], h.keys[h + 1:]) AS keys, list_concat(coalesce(b.words, [])[1:h], h.words[h + 1:]) AS words FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS (SELECT c, d, len(keys) AS n, array_to_string(keys[1:d], ',') AS name, array_to_string(keys[1:d - 1], ',') AS above, words[d] AS w FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM r)),
n AS (SELECT d, name, any_value(CASE WHEN d > 0 THEN above END) AS above, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) * (count(*) - 1) AS own, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM m GROUP BY d, name),
k AS (SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, above),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM n LEFT JOIN k USING (d, name) LEFT JOIN (SELECT d + 1 AS d, name AS above, conv_id FROM n) p USING (d, above)),
u AS (SELECT e, array_to_string(string_split(name, ',')[1:e], ',') AS name, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM a) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN u ON u.e = a.d AND u.name = a.name
"""

def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many personal data of each kind the patterns of op2_pii find."""
    from tidegauge.llm.pii import KINDS, base_spans

    found = table(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of each kind the base rules of op4_secrets find."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of the base phrases of op5_licenses."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_ALL = "regexp_extract_all(t, '{}')"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) < 5 THEN 2 * CAST(c AS INT) ELSE 2 * CAST(c AS INT) - 9 END)) % 10 = 0"
BASE_PII_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_ALL.format("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+")} AS email, {_ALL.format("[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)")} AS ip,
      {_ALL.format("[0-9]([ -]?[0-9])+")} AS card, {_ALL.format("[+][0-9][ ().0-9-]+[0-9]")} AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
       CAST(len(list_filter(ip, lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0)) AS BIGINT) AS n_ip,
       CAST(len(list_filter(card, lambda m: length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
       CAST(len(list_filter(phone, lambda m: length({_DIGITS}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM f
"""
_ASSIGN = """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
BASE_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 1), lambda m: length(m) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter({_ALL.format("AKIA[A-Z0-9]+")}, lambda m: length(m) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter({_ALL.format("[0-9a-f]+")}, lambda m: length(m) >= 24)) AS BIGINT) AS n_hex FROM d
"""
_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_STARTS = " UNION ALL ".join(f"SELECT rid, i AS place, '{label}' AS label FROM v WHERE " + " AND ".join(f"x{k} = '{w}'" for k, w in enumerate(p.split())) for p, label in _PHRASES.items())
BASE_LICENSES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT rid, i, x0, lead(x0) OVER (PARTITION BY rid ORDER BY i) AS x1, lead(x0, 2) OVER (PARTITION BY rid ORDER BY i) AS x2 FROM (SELECT rid, unnest(w) AS x0, unnest(range(len(w))) AS i FROM d)),
s AS ({_STARTS}),
g AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_urlfilter": op3_urlfilter,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_neardup": op9_neardup,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_fim": op12_fim,
    "op13_trie": op13_trie,
    "base_pii": base_pii,
    "base_secrets": base_secrets,
    "base_licenses": base_licenses,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_urlfilter": OP3_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_topk": OP8_SQL,
    "op11_mixing": OP11_SQL,
    "op12_fim": OP12_SQL,
    "op13_trie": OP13_SQL,
    "base_pii": BASE_PII_SQL,
    "base_secrets": BASE_SECRETS_SQL,
    "base_licenses": BASE_LICENSES_SQL,
}
