"""Mixing, middle-fill cuts and the conversation trie against plain versions, with odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import fim, mixing, trie

TALK = "conv_id long, turn long, role string, text string"
CLASH = "_cut n form output key words depth node ahead block _at _part first before base head lent place pass _p".split()


def clashing(df, skip=()):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns and c not in skip])


# --- fill in the middle ------------------------------------------------------------------------------------------


def cut_plainly(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD_TEXTS = [None, "", " ", "\n", "a", "1", "word " * 20000, "x" * 30000, "<P>x", "a <M>", "<S", "P> <", "<<P<S<M", "Ünïcödé ßtraße 東京 \U0001f600á", "a\r\n\r\nb\x00c", "same", "same", "<" * 50, "P>S>M>" * 9]


def test_middle_fill(spark):
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS * 4)] + [(None, "no id"), (5, "same id"), (5, "same id")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, other string")
    made = fim.fill_in_middle(clashing(df))
    assert made.columns[:3] == ["doc_id", "text", "other"] and made.columns[-5:] == fim.ADDED
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in ("doc_id", *fim.ADDED)) for r in got), key=key) == sorted((cut_plainly(*d) for d in docs), key=key)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    everything = fim.fill_in_middle(df, keep=100, spm=100).select("form", "text").collect()
    assert all((r["form"] == "plain") == (not r["text"] or any(x in r["text"] for x in ("<P>", "<S>", "<M>"))) for r in everything)


def test_matcher_keeps_no_unit():
    import tracemalloc

    text, pattern = "ab, " * 500_000, re.compile(fim.UNIT)
    tracemalloc.start()
    n = fim.count_units(pattern, text)
    ends = fim.unit_ends(pattern, text, n // 2, n)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 1_500_000 and ends == (len(text) // 2, len(text)) and peak < 100_000
    assert fim.unit_ends(pattern, text, 0, 0) == (0, 0)


# --- mixing ------------------------------------------------------------------------------------------------------


def spread(sizes, weights, repeats=3):
    """Targets by pouring: all get a share by weight, what overflows is poured again."""
    total, target = sum(sizes), [0.0] * len(sizes)
    rest = float(total)
    while rest > 1e-9:
        room = [i for i, s in enumerate(sizes) if target[i] < repeats * s - 1e-9 and weights[i]]
        if not room:
            break
        heavy = sum(weights[i] for i in room)
        given = {i: rest * weights[i] / heavy for i in room}
        for i in room:
            target[i] = min(repeats * sizes[i], target[i] + given[i])
        rest = total - sum(target)
    return target


def test_mixing(spark):
    texts = [("b", "w " * n) for n in (5, 0, 70, 1, 1)] + [("a", "w\t" * n) for n in (3, 2)] + [(None, " x\n" * 40), ("", "one two"), ("é", "  y " * 9), ("z", None), ("zz", "q " * 3000), ("zzz", ""), ("c", "k " * 11)]
    docs = [(i, t, s) for i, (s, t) in enumerate(texts)] + [(None, "p p p", "a"), (0, "w " * 5, "b")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"), skip=("pass",)).withColumn("pass", F.lit(1))
    schedules = [[(0, 1.5), (0.5, 1), (1, 0.5)], [(0, 2), (1, 2)], [(0, 2), (0.5, 3), (1, 4)]]
    sized = mixing.measure(df)
    mixed = mixing.mix(sized, mixing.cyclic_schedule(sized, schedules))
    got = mixed.collect()
    words = lambda t: len(brute.GAP.findall(t or ""))
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(d), str(s), words(t)) for d, t, s in docs)
    order = sorted({s for _, _, s in docs if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(words(t) for _, t, s in docs if s == o) for o in order]
    want = dict(zip(order, spread(sizes, [1 + i % 3 for i in range(len(order))]), strict=True))
    for o, size in zip(order, sizes, strict=True):
        mine = [r for r in got if r["source"] == o]
        assert all(r["source_size"] == size and abs(r["target"] - want[o]) < 1e-6 and r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[o]) < 1.001
    again = {str(r) for r in mixing.mix(sized.repartition(7), mixing.cyclic_schedule(sized.repartition(3), schedules)).collect()}
    assert again == {str(r) for r in got}
    assert mixing.mix(mixing.measure(df.limit(0)), mixing.cyclic_schedule(mixing.measure(df.limit(0)), schedules)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(sized, mixing.cyclic_schedule(sized, schedules), repeats=0)


def test_training_order_follows_the_schedules(spark):
    """Two sources of equal weight, one early and one late: at every time each has given the integral of its schedule."""
    docs = [(i, "w " * (1 + i % 7), "early" if i % 2 else "late") for i in range(2000)]
    schedule = spark.createDataFrame([("early", [(0.0, 2.0), (0.25, 2.0), (1.0, 0.0)]), ("late", [(0.0, 0.0), (0.25, 0.0), (1.0, 2.0)])], f"source string, knots {mixing.KNOTS}")
    mixed = mixing.mix(mixing.measure(spark.createDataFrame(docs, "doc_id long, text string, source string")), schedule)
    run = mixing.training_order(mixed).collect()
    assert [r["position"] for r in run] == sorted(r["position"] for r in run) and all(0 <= r["position"] < 1 for r in run)
    integral = {"early": lambda t: 2 * t if t < 0.25 else 0.5 + 2 * (t - 0.25) - (t - 0.25) ** 2 / 0.75, "late": lambda t: 0 if t < 0.25 else (t - 0.25) ** 2 / 0.75}
    target = {r["source"]: r["target"] for r in mixed.collect()}
    given = defaultdict(int)
    for r in run:
        due = target[r["source"]] * integral[r["source"]](r["position"]) / integral[r["source"]](1)
        assert abs(given[r["source"]] - due) < 1e-6 * target[r["source"]] + 1e-6
        given[r["source"]] += r["words"]
    assert all(abs(given[s] - t) < 1.001 for s, t in target.items())
    assert run[0]["source"] == "early" and run[-1]["source"] == "late"


def test_unscheduled_sources_give_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", "known"), (2, "d e", "other"), (3, "f", None)], "doc_id long, text string, source string")
    schedule = spark.createDataFrame([("known", [(0.0, 1.0), (1.0, 1.0)]), ("other", [(0.5, 1.0)])], f"source string, knots {mixing.KNOTS}")
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(mixing.measure(docs), schedule).collect()}
    assert got == {1: (6.0, 6), 2: (0.0, 0), 3: (0.0, 0)}


# --- trie --------------------------------------------------------------------------------------------------------


def grow(rows, head=None, group=20):
    """Every node from sets of members: conv_id, depth, parent, members, children, leaves, savings, ends."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            talks[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in talks.items()}
    made = own if head is None else {c: own.get(c - c % group, [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    nodes = []
    for name, convs in members.items():
        below = [n for n in members if n[: len(name)] == name]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(brute.GAP.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(name))
        children = sum(len(n) == len(name) + 1 for n in below)
        nodes.append((min(convs), len(name), min(members[name[:-1]]) if name else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


TALKS = [
    *[(c, t, "user", f"turn {t}") for c in (1, 2, 3) for t in range(4)], (3, 4, "user", "more words here"), (2, 9, None, None), (4, None, "user", "turn 0"), (4, 0, "user", "turn 0"), (4, 0, "user", "turn 0"),
    (5, 1, "", ""), (6, 1, None, None), (20, 0, "user", "lent one"), (20, 1, "user", "lent two"), *[(c, 0, "user", "hi") for c in range(21, 40)], *[(c, 1, "bot", f"own {c}") for c in range(21, 40)],
    *[(c, t, "a", f"long {t}") for c in (100, 101, 102) for t in range(18)], (102, 18, "a", "end"), (None, 0, "user", "lost"), (7, 0, "b", "  \n"), (8, 0, "b", "x" * 9000), (-3, 0, "user", "turn 0"),
]


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK_CHARS", chunk)
    df = clashing(spark.createDataFrame(TALKS, TALK))
    got = trie.build(*trie.plain(df))
    assert got.schema.simpleString() == "struct<" + ",".join(c.replace(" long", ":bigint").replace(" string", ":string") for c in trie.NODE.split(", ")) + ">"
    assert sorted(map(tuple, got.collect()), key=str) == grow(TALKS)


def test_rebuilt_trie(spark):
    head = lambda c: zlib.crc32(str(c).encode()) % 4
    talks = [t for t in TALKS if t[0] is None or t[0] >= 0]
    got = trie.build(*trie.rebuilt(spark.createDataFrame(talks, TALK).repartition(5), F.crc32(F.col("conv_id").cast("string")) % 4, 20))
    assert sorted(map(tuple, got.collect()), key=str) == grow(talks, head)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tries(spark, n):
    talks = [(c, t, "user", "same") for c in range(1, n + 1) for t in range(3)]
    got = trie.build(*trie.plain(spark.createDataFrame(talks, TALK)))
    assert sorted(map(tuple, got.collect()), key=str) == grow(talks)


def test_many_copies(spark):
    """All members of a node with many copies: heavy groups, light groups and ends in several ranges."""
    talks = [(c, t, "user", f"{t}") for c in range(1500) for t in range(2)] + [(c, 2, "user", f"{c % 700}") for c in range(1400)]
    got = trie.build(*trie.plain(spark.createDataFrame(talks, TALK)))
    ends = hashlib.sha256(",".join(map(str, range(1400, 1500))).encode()).hexdigest()
    rows = {(r["depth"], r["conv_id"]): r for r in got.collect()}
    assert len(rows) == 3 + 700 and rows[2, 0]["n_convs"] == 1500 and rows[2, 0]["n_children"] == 700 and rows[2, 0]["ends_sha256"] == ends
    assert rows[0, 0]["n_leaves"] == 700 and rows[0, 0]["saved_tokens"] == 2 * 1499 + 700
    assert rows[3, 5]["n_convs"] == 2 and rows[3, 5]["parent_conv_id"] == 0
