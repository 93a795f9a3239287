"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_FEW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(_LOW)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(sets, percent=80):
    """Links of all pairs of (id, set) that share an element."""
    at = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            at[x].add(i)
    shared = Counter((i, j) for ids in at.values() for i in ids for j in ids if i < j)
    return [(i, j) for (i, j), n in shared.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]


def near_duplicates(docs, size):
    sets = {i: shingles(t, size) for i, t in docs}
    return {i: (len(sets[i]), c) for i, c in components(sets, near(sets)).items()}


def line_sets(docs, shingle):
    out = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            raw = low(line).strip(" \t\n\v\f\r")
            if raw:
                out[i, k] = frozenset(raw[a : a + shingle] for a in range(max(1, len(raw) - shingle + 1)))
    return out


def repeats(docs, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) by id."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[p : p + length] for _, r in raw for p in range(len(r) - length + 1))
    out = {}
    for i, r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out[i] = (len(r), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs, items, window):
    """(n_words, n_hit, items) by id."""
    windows = defaultdict(set)
    for name, text in items:
        words = _FEW.findall(low(text))
        k = min(window, len(words))
        for p in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[p : p + k])].add(str(name))
    out = {}
    for i, text in docs:
        words, hit, names = _FEW.findall(low(text)), set(), set()
        for k in {len(w) for w in windows}:
            for p in range(len(words) - k + 1):
                found = windows.get(tuple(words[p : p + k]))
                if found:
                    names |= found
                    hit |= set(range(p, p + k))
        out[i] = (len(words), len(hit), ",".join(sorted(names)))
    return out
