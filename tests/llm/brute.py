"""Plain versions of what the operators are to return, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WHITE = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def repeats(docs, length=100):
    """(doc_id, n_bytes, spans, kept) of documents in order of doc_id, then text hash order as given."""
    seen, out = {}, []
    for n, (doc_id, text) in enumerate(docs):
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                covered[i : i + length] = b"\1" * length
            else:
                seen[k] = (n, i)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(covered))]
        out.append((doc_id, len(b), spans, bytes(x for x, c in zip(b, covered, strict=True) if not c)))
    return out


def lines(docs, least=10):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    place = lambda d: (1 << 63) - 1 if d is None else d
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(place(d))
    out = []
    for d, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == place(d)]
        out.append((d, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near(docs, percent=80):
    """{doc_id: component}, for distinct doc_ids that are not null."""
    g, sets = Groups(), [(d, shingles(t)) for d, t in docs if d is not None]
    for i, (d, a) in enumerate(sets):
        g.find(d)
        for e, b in sets[:i]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                g.link(d, e)
    return {d: g.find(d) for d, _ in sets}


def phrases(docs, items, width=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        if i is not None and n:
            for a in range(len(w) - n + 1):
                windows[tuple(w[a : a + n])].add(str(i))
    out = []
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def targets(totals: Counter, weights=(1, 2, 3), cap=3):
    """Shares by weight, with the excess over each cap shared again until none is left."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(totals.values())), set(order)
    while free:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if unit * w[s] > cap * totals[s] + 1e-9}
        if not full:
            for s in free:
                target[s] = unit * w[s]
            break
        for s in full:
            target[s] = float(cap * totals[s])
            left -= target[s]
        free -= full
    return target
