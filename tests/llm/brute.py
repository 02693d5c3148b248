"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def quality(text: str) -> tuple:
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    cover = {i for v in at.values() if len(v) > 1 for k in v for i in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def contamination(docs: dict, items: list[tuple[str, str]]) -> dict:
    windows = defaultdict(set)
    for i, text in items:
        w = LETTERS.findall((text or "").translate(UP))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, text in docs.items():
        w = LETTERS.findall((text or "").translate(UP))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= of
        out[d] = len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)
    return out


def removal(rows: list[tuple], length: int = 100) -> list[tuple]:
    """rows: (key, text) in order."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(UP))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def links(docs: dict) -> dict:
    """doc -> (size of its set, component)."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = top(a), top(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), top(d)) for d in docs}


def word_scores(docs: dict) -> dict:
    tokens = {d: [*WORD.findall((t or "").translate(UP)), ""] for d, t in docs.items()}
    c = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (zlib.crc32(str(d).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text: str) -> list[tuple]:
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def share(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """budget over (name, weight, cap), by weight as far as each can give."""
    out, open_ = {}, [(n, w, c if w > 0 else 0) for n, w, c in children]
    while open_:
        total = sum(w for _, w, _ in open_)
        left = budget - sum(out.values())
        full = [x for x in open_ if x[2] * total <= x[1] * left]
        if not full:
            return out | {n: w * left // total if total else 0 for n, w, _ in open_}
        out |= {n: c for n, _, c in full}
        open_ = [x for x in open_ if x not in full]
    return out


def mix(rows: list[tuple], weights: dict, percent: int, epochs: int, seed: int) -> dict:
    """(doc, domain, lang, source, tokens) -> doc -> copies."""
    leaf = defaultdict(int)
    for _, *key, n in rows:
        leaf[tuple(key)] += n
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    levels = ("domain", "lang", "source")
    wanted = lambda k: all(weight(level, name) > 0 for level, name in zip(levels, k, strict=True))
    cap = lambda prefix: epochs * sum(n for k, n in leaf.items() if k[: len(prefix)] == prefix and wanted(k))
    got = {(): sum(leaf.values()) * percent // 100}
    for depth, level in enumerate(("domain", "lang", "source")):
        after = {}
        for parent, budget in got.items():
            names = sorted({k[depth] for k in leaf if k[:depth] == parent})
            after |= {(*parent, n): g for n, g in share(budget, [(n, weight(level, n), cap((*parent, n))) for n in names]).items()}
        got = after
    out = {}
    for key, total in leaf.items():
        mine = [(d, n) for d, *k, n in rows if tuple(k) == key]
        whole, rest = divmod(got[key], total) if total else (0, 0)
        order = sorted(mine, key=lambda x: hashlib.md5(f"{seed}:{whole}:{'' if x[0] is None else x[0]}".encode()).hexdigest())
        before = 0
        for d, n in order:
            out[d] = (whole + (before < rest)) if total else 0
            before += n
    return out
