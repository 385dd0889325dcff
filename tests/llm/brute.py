"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWEST = -(1 << 63)


def low(text):
    return (text or "").translate(UPPER)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring_dedup(rows, width=50):
    """rows: (doc_id, text). List of (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    words = [(LOWEST if d is None else d, d, WORD.findall(t or "")) for d, t in rows]
    for key, _, x in sorted(words, key=lambda r: r[0]):
        for i in range(len(x) - width + 1):
            first.setdefault(tuple(x[i:i + width]), key)
    out = []
    for key, d, x in words:
        gone = [False] * len(x)
        for i in range(len(x) - width + 1):
            if first[tuple(x[i:i + width])] < key:
                gone[i:i + width] = [True] * width
        out.append((d, len(x), sum(gone), sha(" ".join(w for w, g in zip(x, gone) if not g))))
    return out


def suffix_dedup(rows, width=200):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def jaccard_components(rows, p=75, q=100):
    """(doc_id, n_shingles, component_id); links by all pairs."""
    sets = []
    for d, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                up[top(i)] = top(j)
    ids = [LOWEST if d is None else d for d, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [(d, len(sets[i]), None if least[top(i)] == LOWEST else least[top(i)]) for i, (d, _) in enumerate(rows)]


def contamination(rows, items, width=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = TERM.findall(low(t))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[k:k + width])].add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w = TERM.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: {source or None: words}. Shares are capped and the excess shared again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    t = {s: share * total * w[s] / sum(w.values()) for s in order}
    capped = set()
    while over := [s for s in order if s not in capped and t[s] > most * sizes[s] * (1 + 1e-12)]:
        capped |= set(over)
        left = share * total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        for s in order:
            t[s] = most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free)
    return t


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
