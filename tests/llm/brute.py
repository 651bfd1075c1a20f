"""The same results by plain loops over a small list of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(ids, edges):
    parent = {i: i for i in ids}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def lower(raw):
    return raw.lower()  # bytes: A-Z only


def ngram_join(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", lower((t or "").encode()))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids, edges, links = sorted(sets), [], Counter()
    where = defaultdict(list)
    for i in ids:
        near = Counter(j for g in sets[i] for j in where[g])
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                edges.append((j, i))
                links[i] += 1
                links[j] += 1
        for g in sets[i]:
            where[g].append(i)
    comp = components(ids, edges)
    return {i: (len(sets[i]), links[i], comp[i]) for i in ids}


def decontamination(rows, items, size):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((t or "").encode()))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if got := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= got
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out[d] = (len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def suffix_removal(rows, k=50):
    first = {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        for p in range(len(raw) - k + 1):
            first.setdefault(raw[p : p + k], d)
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - k + 1):
            if first[raw[p : p + k]] < d:
                gone[p : p + k] = b"\1" * k
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def line_dedup(rows, words=50, least=24):
    """id to (text, lines, lines removed), by the rules of the operator read line by line; ids are distinct."""
    import struct

    import xxhash

    def of_long(x, seed):
        return xxhash.xxh64(struct.pack("<q", x - (x >> 63 << 64)), seed=seed).intdigest()

    def rolled(x, y, gap):
        h = [xxhash.xxh64(z.encode(), seed=42).intdigest() for z in (x, y)]
        h = xxhash.xxh64(struct.pack("<i", gap), seed=of_long(h[1], of_long(h[0], 42))).intdigest()
        return h - (h >> 63 << 64)

    def chunks(lines):
        """(start, stop, the windows beside it that are no chunks)"""
        filled = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        said = lambda i: lines[i].count(" ") + 1
        pairs = [(i, j + 1, rolled(lines[i], lines[j], j - i)) if len((lines[i] + lines[j]).encode()) >= least else None for i, j in zip(filled, filled[1:])]
        at = lambda k: pairs[k] if 0 <= k < len(pairs) else None
        is_ = []
        for k, p in enumerate(pairs):
            near = [q[2] for q in (at(k - 1), at(k + 1)) if q]
            is_.append(bool(p) and (said(p[0]) + said(p[1] - 1) > words or not near or any(p[2] <= q for q in near)))
        one = lambda k: at(k)[:2] if at(k) and not is_[k] else None
        out = [(*p[:2], [x for x in (one(k - 1), one(k + 1)) if x]) for k, p in enumerate(pairs) if is_[k]]
        return out + [(i, i + 1, []) for i in filled if said(i) > words]

    texts = {d: (t or "").split("\n") for d, t in rows if d is not None and t is not None}
    found = {d: chunks(lines) for d, lines in texts.items()}
    body = lambda d, lo, hi: tuple(texts[d][lo:hi])
    many = Counter(body(d, lo, hi) for d, cs in found.items() for lo, hi, _ in cs)
    spans = {(d, lo, hi) for d, cs in found.items() for lo, hi, _ in cs}
    spans |= {(d, *w) for d, cs in found.items() for lo, hi, near in cs if many[body(d, lo, hi)] > 1 for w in near}
    place, gone = {}, defaultdict(set)
    for d, lo, hi in sorted(spans):
        first = place.setdefault(body(d, lo, hi), (d, lo, hi))
        if first[0] != d or lo >= first[2]:
            gone[d] |= set(range(lo, hi))
    return {d: (t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(t.split("\n")) if t is not None else 0, len(gone[d]))
            for d, t in rows}
