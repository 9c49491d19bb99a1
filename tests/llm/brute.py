"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k):
    w = words(ascii_lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def groups(sets, linked):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def near(percent):
    return lambda a, b: 100 * len(a & b) >= percent * len(a | b)


def ngram_join(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = groups(sets, near(percent))
    low = {}
    for (i, _), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, i), i)
    return sorted((i, len(s), low[r]) for (i, _), s, r in zip(rows, sets, root, strict=True))


def decontamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for name, item in items:
            v = split(item)
            m = min(window, len(v))
            for a in range(len(v) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == v[a : a + m]:
                        hit.update(range(b, b + m))
                        names.add(str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, got, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not full:
            got |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            got[s] = most * sizes[s]
        left -= sum(got[s] for s in full)
        open_ -= full
    return got


def top_k(rows, every=50, k=5):
    v = {i: [math.floor(256 * float(x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def lines_kept(rows, gram=8, percent=80):
    """doc_id to its text without the lines that go."""
    all_lines = [(i, n, x) for i, t in sorted(rows) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    kinds = list(dict.fromkeys(x for _, _, x in all_lines))
    sets = [frozenset(x[j : j + gram] for j in range(len(x) - gram + 1)) or frozenset([x]) for x in kinds]
    root = dict(zip(kinds, groups(sets, near(percent)), strict=True))
    seen, gone = set(), set()
    for i, n, x in all_lines:
        if root[x] in seen:
            gone.add((i, n))
        seen.add(root[x])
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def token_digest(rows, tok):
    key = lambda t: (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64)  # noqa: E731  in the order of signed numbers
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r[1]), r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return sorted(out, key=repr)


def merges(data, ranks):
    """Tokens of a pretoken by rescanning all pairs for the lowest rank."""
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((ranks.get((a, b), math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(math.inf, 0))
        if best[0] == math.inf:
            return len(parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def counted(rows):
    return Counter(map(repr, rows))
