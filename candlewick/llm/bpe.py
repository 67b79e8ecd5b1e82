"""Byte-level BPE encoding at corpus speed.

The tokenizers library encodes one pre-token at a time, and corpora repeat theirs.  A text whose white space is
single spaces and newlines, none at an end, falls apart at them into pieces that the pre-tokenizer never joins: a
newline between two other characters is a pre-token, and a space belongs to what follows it.  The library encodes
each piece once, many to a call, and the rest is lookup.  Any other text is given to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per worker and generation: a full cache becomes the older one, from which pieces come back when they are met.
CACHE_PIECES = 300_000
#: Texts' characters and pieces that go through the library in one call.
CALL_CHARS, CALL_PIECES = 8 << 20, 4_000
_MARKS = ".,!?;:%&*#$|"
_loaded: dict[str, "Encoder"] = {}


def _falls_apart(t: str) -> bool:
    """Whether white space in `t` is single spaces and newlines between other characters; any other is not printable."""
    if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n":
        return False
    return t.replace("\n", "").isprintable()


class Encoder:
    """`encode` gives texts' ids as little-endian 32-bit bytes; special tokens' strings in a text are ordinary text,
    and null is empty.

    A piece is a word with the newline before it, if there is one, and else stands for the word after a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.newline = self.whole("\n")
        self.marks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        space, line = self.whole(" x")[:4], self.newline
        lead = self.tokenizer.id_to_token(int.from_bytes(space, "little"))[0]
        starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        starts[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(lead)]] = True
        breaks = np.zeros(len(starts), bool)
        breaks[int.from_bytes(line, "little")] = True
        self._starts = {" ": starts, "": breaks}
        # for words of letters alone, each of which is one pre-token with the space before it
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = Sequence([Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)])

    @staticmethod
    def load(path: str) -> "Encoder":
        """One encoder per worker process and file."""
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        known = self.pieces
        # letters and the run of marks after them are separate pre-tokens
        marked: list[tuple[str, str]] = []
        plain: set[str] = set()
        for p in new:
            base = p.rstrip(_MARKS)
            if base != p and base.isalpha():
                marked.append((p, base))
                if base not in known:
                    plain.add(base)
            else:
                plain.add(p)
        words = [p for p in plain if p.isalpha()]
        plain.difference_update(words)
        lines = [p for p in plain if p[0] == "\n"]
        plain.difference_update(lines)
        for tokenizer, lead, pieces in ((self.letters, " ", words), (self.tokenizer, " ", list(plain)), (self.tokenizer, "", lines)):
            for a in range(0, len(pieces), CALL_PIECES):
                part = pieces[a : a + CALL_PIECES]
                ids = np.array(tokenizer.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)[0].ids, "<u4")
                at = np.flatnonzero(self._starts[lead][ids])
                if len(at) == len(part):
                    raw, cuts = ids.tobytes(), (at * 4).tolist()
                    known.update(zip(part, [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))
                else:
                    known.update((p, self.whole(lead + p)) for p in part)
        marks = self.marks
        for p, base in marked:
            tail = p[len(base) :]
            if tail not in marks:
                if len(marks) > 10_000:
                    marks.clear()
                marks[tail] = self.whole(tail)
            known[p] = known[base] + marks[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b] or "") <= CALL_CHARS):
                n += len(texts[b] or "")
                b += 1
            out += self._some(texts[a:b])
            a = b
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        simple = [bool(t) and _falls_apart(t) for t in texts]
        line = " ".join([("\n" + t).replace("\n", " \n")[1:] for t, ok in zip(texts, simple, strict=True) if ok])
        cuts = np.cumsum([t.count(" ") + t.count("\n") + 1 if ok else 0 for t, ok in zip(texts, simple, strict=True)])
        ids, ends = self._pieces(line) if line else (b"", np.zeros(0, np.int64))
        upto = np.append(0, ends)[cuts] * 4
        out, start, skip = [], 0, len(self.newline)
        for text, ok, end in zip(texts, simple, upto.tolist(), strict=True):
            out.append(ids[start + skip : end] if ok else self.whole(text) if text else b"")
            start = end
        return out

    def _pieces(self, line: str) -> tuple[bytes, np.ndarray]:
        """The ids of the pieces between the spaces of `line`, and how many there are up to each piece's end."""
        coded = pc.split_pattern(pa.array([line], pa.large_string()), " ").values.dictionary_encode()
        distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        got = list(map(self.pieces.get, distinct))
        gaps = [i for i, x in enumerate(got) if x is None]
        if gaps:
            if len(self.pieces) > CACHE_PIECES:
                self.older, self.pieces = self.pieces, {}
            older, unknown = self.older, []
            for i in gaps:
                p = distinct[i]
                ids = older.get(p)
                if ids is None:
                    unknown.append(p)
                else:
                    self.pieces[p] = got[i] = ids
            self._learn(unknown)
            for i in gaps:
                if got[i] is None:
                    got[i] = self.pieces[distinct[i]]
        table = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        return table[np.repeat(first[code] - ends + n, n) + np.arange(ends[-1])].tobytes(), ends
