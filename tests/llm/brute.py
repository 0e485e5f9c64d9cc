"""Plain single-process versions of the operators' results, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(r"[^\x20\x09-\x0D]+")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def pii(text: str | None) -> tuple:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = {
        "email": list(EMAIL.finditer(text)),
        "ip": [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }
    listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
    return (*map(len, found.values()), sha(listed), listed)


def all_personal(docs: list[tuple], generalise: float = 0.9, remove: float = 0.98, doubt: float | None = None) -> list[str]:
    """The spans of every row, base ones and those of telling terms, from counts over all rows."""
    import math
    from collections import Counter, defaultdict

    import regex

    total = len(docs)
    if doubt is None:
        needed = total ** (generalise - 1)
        doubt = 1.001 * (1 - needed) / (needed - 1 / total)
    bases, seen, entities = [], [], []
    for _, text in docs:
        text = text or ""
        spans = [s.split(":") for s in pii(text)[5].split(",") if s]
        bases.append(spans)
        covered = list(text)
        for _, a, b in spans:
            covered[int(a) : int(b)] = " " * (int(b) - int(a))
        seen.append("".join(covered))
        values = ((k, text[int(a) : int(b)]) for k, a, b in spans)
        entities.append({(k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for k, v in values})
    words = [[(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}+", t)] for t in seen]
    terms = [{w for _, _, w in ws} for ws in words]
    df, c = Counter(w for ts in terms for w in ts), Counter(e for es in entities for e in es)
    both, texts = Counter(), defaultdict(set)
    for (_, text), ts, es in zip(docs, terms, entities, strict=True):
        for e in es:
            for w in ts:
                both[w, e] += 1
                texts[w, e].add(text)
    strength: dict = {}
    for (w, e), n in both.items():
        known = -math.log(c[e] / total)
        k = len(texts[w, e])
        sure = (k * n / df[w] + doubt * c[e] / total) / (k + doubt)
        if known > 0:
            strength[w] = max(strength.get(w, 0.0), (math.log(sure) + known) / known)
    out = []
    for spans, ws in zip(bases, words, strict=True):
        found = [f"{'cut' if strength[w] >= remove else 'term'}:{a}:{b}" for a, b, w in ws if strength.get(w, 0.0) >= generalise]
        out.append(",".join([":".join(s) for s in spans] + found))
    return out


def secrets(text: str | None) -> tuple:
    text = text or ""
    found = {
        "assign": [m for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6],
        "access": [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20],
        "hex": [m for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24],
    }
    rows = sorted((m.start(), i, m.end(), k) for i, (k, ms) in enumerate(found.items()) for m in ms)
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in rows)
    return (*map(len, found.values()), sha(listed), listed)


def phrases(text: str | None) -> tuple:
    w = words(text)
    known = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [(i, label) for p, label in known.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def shingle_set(text: str | None, size: int) -> frozenset:
    w = GAP.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_duplicates(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> set size, component, kept, from all pairs that share a shingle."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by_shingle: dict = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    seen = set()
    for members in by_shingle.values():
        for a, b in combinations(members, 2):
            if (a, b) in seen or root(a) == root(b):
                continue
            seen.add((a, b))
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
