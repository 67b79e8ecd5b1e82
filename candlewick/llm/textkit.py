"""Vectorised text primitives shared by the Arrow-side operators.

A batch of texts is held as one byte buffer in which every document is followed by a separator byte, so
that tokenising, hashing and shingling are a handful of numpy passes over the buffer and no Python loop
runs per word.  Word hashes are 64-bit polynomial hashes read off a prefix sum: with ``C[i]`` the sum of
``t[b_j] * r**j`` over ``j < i`` modulo 2**64, the hash of bytes ``[s, e)`` is ``(C[e] - C[s]) * r**-s``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: Bytes of text handled at once; working arrays take about 60 times as much.
CHUNK_BYTES = 1 << 20


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_TABLES = (_table(20011), _table(20029))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of an alphanumeric word after lower-casing: 0-9, a-z and everything beyond ASCII.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n at least, kept between calls."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, r in enumerate((_R, _R_INV)):
            a = np.full(size, r, U64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=U64)
    return _POWERS[0], _POWERS[1]


def fmix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Prefix:
    """Prefix sums over a byte buffer, from which any substring's hash is read."""

    def __init__(self, buf: np.ndarray, family: int = 0):
        p, self.inv = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_TABLES[family][buf] * p[: len(buf)], out=self.sums[1:], dtype=U64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return fmix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U64))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` bytes of text each, or of one row."""
    sizes = np.diff(_offsets(texts))
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def _offsets(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_binary())
    o = np.frombuffer(texts.buffers()[1], np.int64, count=texts.offset + len(texts) + 1)
    return o[texts.offset :]


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary()).to_pylist()]


def buffer(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with a separator (a space) after each row; the rows' starts and ends in it."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    start = np.zeros(len(rows), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    return np.frombuffer(b" ".join(rows) + b" ", np.uint8), start, start + size


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; the last element is false."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def shingles(rows: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct runs of `n` words, sorted within the row, and where each row's begin.

    Words are what white space (0x20, 0x09-0x0D) separates, with A-Z lower-cased.  A row of fewer words, but
    not none, has one shingle, the whole sequence; a row without words has none.
    """
    raw, start, _ = buffer(rows)
    low = LOWER[raw]
    s, e = word_spans(~IS_SPACE[raw])
    w = Prefix(low).hash(s, e)
    first = np.searchsorted(s, start)
    count = np.diff(np.append(first, len(s)))
    mult = np.array([pow(_R, k + 1, 1 << 64) for k in range(n)], U64)
    full = np.zeros(max(0, len(w) - n + 1), U64)
    for k in range(n):
        full += w[k : k + len(full)] * mult[k]
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(per, out=at[1:])
    doc = np.repeat(np.arange(len(rows)), per)
    pos = np.arange(at[-1]) - at[doc] + first[doc]
    out = np.zeros(at[-1], U64)
    long = (count >= n)[doc]
    out[long] = fmix(full[pos[long]] + U64(n))
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = U64(0)
        with np.errstate(over="ignore"):
            for k in range(count[d]):
                h += w[first[d] + k] * mult[k]
            out[at[d]] = fmix(np.array([h + U64(count[d])]))[0]
    order = np.lexsort((out, doc)) if len(rows) > 64 else None
    if order is None:
        for d in range(len(rows)):
            out[at[d] : at[d + 1]].sort()
    else:
        out = out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[at]
