"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def decontaminated(docs, benchmark, window=13):
    patterns = collections.defaultdict(set)
    for item, text in benchmark:
        ws = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            patterns[tuple(ws[k:k + window])] |= {str(item)} if item is not None else set()
    out = {}
    for i, text in docs:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, items = [0] * len(ws), set()
        for size in {len(p) for p in patterns}:
            for k in range(len(ws) - size + 1):
                if tuple(ws[k:k + size]) in patterns:
                    items |= patterns[tuple(ws[k:k + size])]
                    hit[k:k + size] = [1] * size
        out[i] = len(ws), sum(hit), sorted(items), sum(hit) > 0 and 20 * sum(hit) >= len(ws)
    return out


def substrings(rows, window=13):
    docs = [(i, SPACED.findall(t or "")) for i, t in rows]
    first: dict = {}
    for i, ws in docs:
        for k in range(len(ws) - window + 1):
            if i is not None:
                first[tuple(ws[k:k + window])] = min(first.get(tuple(ws[k:k + window]), i), i)
    out = []
    for i, ws in docs:
        gone = [0] * len(ws)
        for k in range(len(ws) - window + 1):
            holder = first.get(tuple(ws[k:k + window]))
            if holder is not None and (i is None or holder < i):
                gone[k:k + window] = [1] * window
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def near(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        ws = SPACED.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)]) if ws else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


def top(vectors, k=5):
    import math

    rows = [(i, [math.floor(256 * x) if abs(x) < 2 ** 53 else int(x) * 256 for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(rows):
        if i % 50 == 0:
            score = lambda v: max(min(sum(a * b for a, b in zip(q, v, strict=True)), (1 << 63) - 1), -(1 << 63))  # noqa: B023, E731
            scores = sorted((-score(v), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)
