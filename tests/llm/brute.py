"""Plain Python versions of the registered contracts; tests hold the Spark results against them."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE = re.compile("[\x20\x09-\x0d]+")


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def contamination(docs, items, window=10):
    """docs, items: lists of (id, text); gives {id: (n_words, n_hit, items)}."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda s: word.findall(ascii_lower(s or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[t]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def near_groups(docs, k=4):
    """{id: (n_shingles, component_id)} by comparing every pair that shares a shingle."""
    sets = {}
    for doc, text in docs:
        w = [x for x in SPACE.split(ascii_lower(text or "")) if x]
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, length=400):
    """{id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    seen = defaultdict(int)
    data = {d: (t or "").encode() for d, t in docs}
    for b in data.values():
        for i in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] += 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def exact(docs):
    """{id: (keep_id, group_size, sha256)}."""
    groups = defaultdict(list)
    norm = {d: hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest() for d, t in docs}
    for d, h in norm.items():
        groups[h].append(d)
    return {d: (min(groups[h]), len(groups[h]), h) for d, h in norm.items()}
