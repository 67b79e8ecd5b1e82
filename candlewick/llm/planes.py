"""The token file format: fixed-size blocks of ids, transposed into planes and compressed plane by plane.

    "CWP1" | block 0 | block 1 | ... | directory | index | index length (8 bytes) | "CWP1"

A block holds up to `block` ids as unsigned 32-bit integers, transposed into 4 byte planes (or 32 bit planes), each
compressed with zstandard; planes of zeros take a few bytes.  The directory lists the documents: ids, null flags and
token counts.  The index is JSON: the kind of planes, the documents, and for every block its offset, its number of
ids and the lengths of its planes, so that a range of ids is read from the blocks that hold it alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"CWP1"
BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Byte planes, lowest first; or bit planes, highest first, padded to whole bytes."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [by_byte[:, k].tobytes() for k in range(4)]
    if kind != "bit":
        raise ValueError(f"unknown kind of planes: {kind}")
    bits = np.unpackbits(by_byte[:, ::-1], axis=1)
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        out = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8))[:n] for p in planes], 1)
    return np.ascontiguousarray(np.packbits(bits, axis=1)[:, ::-1]).view("<u4").reshape(-1)


class Writer:
    """Writes documents to a binary sink, in the order in which they are added."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK_IDS, level: int = 1):
        self.sink, self.kind, self.block = sink, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.blocks: list[list[int]] = []
        self.pending: list[bytes] = []
        self.waiting = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, end, self.block):
            part = ids[a : min(end, a + self.block)]
            packed = [self.zstd.compress(p) for p in to_planes(part, self.kind)]
            self.blocks.append([self.at, len(part), *map(len, packed)])
            for p in packed:
                self.sink.write(p)
                self.at += len(p)
        self.pending, self.waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        parts = [np.array([x or 0 for x in self.doc_ids], "<i8"), known, np.array(self.counts, "<i8")]
        directory = [self.zstd.compress(x.tobytes()) for x in parts]
        for p in directory:
            self.sink.write(p)
        index = {
            "planes": self.kind, "docs": len(self.doc_ids), "ids": self.n_ids, "block": self.block,
            "directory": [self.at, *map(len, directory)], "blocks": self.blocks,
        }
        tail = json.dumps(index).encode()
        self.sink.write(tail + len(tail).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads a file of `Writer` through a seekable source of `size` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        self.unzstd = zstandard.ZstdDecompressor()
        end = self._at(size - 12, 12)
        if end[8:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(end[:8], "little")
        self.index = json.loads(self._at(size - 12 - n, n))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def directory(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, whether each is known, and token counts."""
        at, *sizes = self.index["directory"]
        out = []
        for n, kind in zip(sizes, ("<i8", np.uint8, "<i8"), strict=True):
            out.append(np.frombuffer(self.unzstd.decompress(self._at(at, n)), kind))
            at += n
        return out[0], out[1].astype(bool), out[2]

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index["blocks"][k]
        raw, planes = self._at(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzstd.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, self.index["planes"])

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids [start, start + n), from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, "<u4")
        b = self.index["block"]
        ids = np.concatenate([self.block(k) for k in range(start // b, (start + n - 1) // b + 1)])
        return ids[start % b : start % b + n]

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document's id and its ids in pieces, with one block in memory at a time."""
        doc_ids, known, counts = self.directory()
        k, have = 0, np.zeros(0, "<u4")
        for doc_id, ok, n in zip(doc_ids.tolist(), known.tolist(), counts.tolist(), strict=True):
            pieces = []
            while n:
                if not len(have):
                    have = self.block(k)
                    k += 1
                pieces.append(have[:n])
                n -= len(pieces[-1])
                have = have[len(pieces[-1]) :]
            yield doc_id if ok else None, pieces
