"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [w.lower() for w in words]  # bytes.lower() changes A-Z only
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else (tuple(words[i : i + n]) for i in range(len(words) - n + 1)))


def near_dedup(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept); all pairs that share a shingle are compared."""
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    for ids in by_set.values():
        for d in ids:
            a, b = sorted((find(ids[0]), find(d)))
            up[b] = a
    reps = {min(ids): s for s, ids in by_set.items()}
    places = defaultdict(list)
    for d, s in reps.items():
        for x in s:
            places[x].append(d)
    pairs = defaultdict(int)
    for ids in places.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                pairs[min(a, b), max(a, b)] += 1
    for (a, b), common in pairs.items():
        if 100 * common >= percent * (len(reps[a]) + len(reps[b]) - common):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        gone = bytearray(len(data))
        end = 0
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            key = s if length < 16 else hashlib.blake2b(s, digest_size=12).digest()
            if key in seen:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
            else:
                seen.add(key)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
