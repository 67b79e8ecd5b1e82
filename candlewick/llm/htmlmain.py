"""HTML extraction: the article's text as the maximum-scoring stretch of a page.

A page is a sequence of words and tags with a score each: words score the probability that their block is main text,
less a half, so words of an article score above zero (those of a block below zero share a score that grows with the
logarithm of their number); tags score below zero, the less the more often a tag of that name
stands in main texts.  How much tags and words below zero weigh against words above is learned too.  One linear scan finds the contiguous stretch with the largest sum.  Its words that score above
zero are the main text; what scores below zero within it, such as an advert between two paragraphs, stays out.

The probabilities are those of a logistic model over what a block's markup says (names of the elements around it, and
the words in their class, id and role attributes) and its text (its length, the share of links, its last character);
all weights are learned from labelled pages.  A name that is part of a longer one is weaker evidence than the name alone;
names on elements that hold all of the page's words are none, since they tell no part from another; and names outside
the article element around a block have weights of their own.

A block is what block-level tags and table cells bound; a line break is white space.  Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined in page order by a newline.  Defined
results: null, empty and text-free pages give the empty string; of two stretches with equal sums the first is taken;
unclosed elements end with their parent; a comment or script that never ends reaches to the page's end; what is hidden
by its own attributes is no text; very long pages take time in proportion to their length; repeated rows are treated
alike.  Other columns are kept.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from candlewick.llm import labelled_pages
from candlewick.llm.runtime import small_batches

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z) | <[!?][^>]*(?:>|\Z) | <(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Elements by how HTML treats them.
_RAW = frozenset("script style noscript template textarea title iframe object svg canvas select audio video noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_BEFORE_ITS_KIND = frozenset("p li td th tr dd dt".split())
_SCOPE = "table ul ol dl div section article blockquote".split()
_SECTION = frozenset(("article", "main"))


@dataclass(slots=True)
class Element:
    """An element with what its markup says; `outer` is the article around it, itself included, as a number."""

    name: str
    parent: int
    names: tuple[str, ...]
    outer: int
    words: int = 0


@dataclass
class Page:
    """Tokens are (block, number of words) or (-1 - element, 0) for a tag; blocks have a text, an element and counts."""

    tokens: list[tuple[int, int]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    counts: list[tuple[int, int]] = field(default_factory=list)


def _names(attributes: str) -> tuple[tuple[str, ...], bool]:
    """What class, id and role attributes say, and whether the element is hidden."""
    said: dict[str, None] = {}
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            for token in value.split():
                parts = [x.lower() for x in _PART.findall(token)]
                said.update(dict.fromkeys(f"{'c' if len(parts) == 1 else 'p'}:{x}" for x in parts))
        elif key == "aria-hidden" and value.lower() == "true":
            said["a:hidden"] = None
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return tuple(said), hidden


def parse(source: str) -> Page:
    page = Page()
    stack: list[int] = []  # elements that are open
    unseen: list[int] = []  # places in the stack of those that are hidden
    links: list[int] = []
    places: dict[str, list[int]] = defaultdict(list)  # by name, their places in the stack
    run: list[str] = []
    pending: list[int] = []
    of_block = [0, 0, -1]  # words, words in links, element

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.tokens.extend((len(page.texts), n) for n in pending)
                page.texts.append(text)
                page.owner.append(of_block[2])
                page.counts.append((of_block[0], of_block[1]))
                if of_block[2] >= 0:
                    page.elements[of_block[2]].words += of_block[0]
            run.clear()
            pending.clear()
            of_block[:] = [0, 0, -1]

    def words(text: str) -> None:
        if unseen:
            return
        text = entities.unescape(text) if "&" in text else text
        run.append(text)
        n = len(text.split())
        if n:
            if not of_block[0]:
                own = stack[-1] if stack else -1
                while own >= 0 and page.elements[own].name not in _BLOCK and not page.elements[own].names:
                    own = page.elements[own].parent
                of_block[2] = own
            of_block[0] += n
            of_block[1] += n if links else 0
            pending.append(n)

    def close(k: int) -> None:
        for own in stack[k:]:
            places[page.elements[own].name].pop()
        del stack[k:]
        for marks in (unseen, links):
            while marks and marks[-1] >= k:
                marks.pop()

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            words(source[at:])
            break
        if m.start() > at:
            words(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, name, attributes = m[1] or m[4], name.lower(), m[3] if m[2] else m[6]
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                end = _end_of(name).search(source, at)
                at = end.end() if end else n
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if closing:
            if places[name]:
                own = stack[places[name][-1]]
                close(places[name][-1])
                if name in _BLOCK or name == "a":
                    page.tokens.append((-1 - own, 0))
        elif name not in _VOID:
            if name in _ENDS_BEFORE_ITS_KIND and places[name]:
                # these end where the next of their kind begins, unless another list or table has begun since
                k = places[name][-1]
                if not any(places[x] and places[x][-1] > k for x in _SCOPE):
                    close(k)
            names, hidden = _names(attributes) if attributes else ((), False)
            parent = stack[-1] if stack else -1
            own = len(page.elements)
            outer = own if name in _SECTION else page.elements[parent].outer if parent >= 0 else -1
            page.elements.append(Element(name, parent, names, outer))
            places[name].append(len(stack))
            if hidden:
                unseen.append(len(stack))
            if name == "a":
                links.append(len(stack))
            stack.append(own)
            if name in _BLOCK or name == "a":
                page.tokens.append((-1 - own, 0))
    flush()
    return page


@functools.cache
def _end_of(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I)


def _own_features(page: Page) -> list[tuple[str, ...]]:
    """What each element says of the blocks in it; names on elements that hold all words say nothing."""
    below = [e.words for e in page.elements]
    for k in range(len(below) - 1, -1, -1):
        if page.elements[k].parent >= 0:
            below[page.elements[k].parent] += below[k]
    total = sum(n for n, _ in page.counts)
    out = []
    for e, held in zip(page.elements, below, strict=True):
        tag = (f"t:{e.name}",) if e.name in _BLOCK and e.name not in ("html", "body") else ()
        # an element around everything still speaks of the words that are directly in it
        out.append(tag + e.names if e.name not in ("html", "body") and (held < total or 0 < e.words < total) else tag)
    return out


def _block_features(text: str, n: int, linked: int) -> tuple[str, ...]:
    return (f"w:{min(6, n.bit_length())}", f"l:{0 if not linked else 4 if linked == n else 1 + 3 * linked // n}", f"s:{text[-1] in '.!?:;…。'}")


def _around(page: Page, own: Sequence[tuple[str, ...]]) -> list[frozenset[str]]:
    """All that the markup around it says, by element: each once, with `o:` before what is outside the article element."""
    inside: list[frozenset[str]] = []
    outside: list[frozenset[str]] = []
    for k, e in enumerate(page.elements):
        up = e.parent
        if up < 0:
            inside.append(frozenset(own[k]))
            outside.append(frozenset())
        elif e.outer == k:
            outside.append(outside[up] | {f"o:{x}" for x in inside[up]})
            inside.append(frozenset(own[k]))
        else:
            new = frozenset(own[k])
            inside.append(inside[up] if new <= inside[up] else inside[up] | new)
            outside.append(outside[up])
    return [a | b if b else a for a, b in zip(inside, outside, strict=True)]


def features(page: Page) -> list[set[str]]:
    """The features of each block."""
    around = _around(page, _own_features(page))
    nothing: frozenset[str] = frozenset()
    return [
        ((around[o] if o >= 0 else nothing) or {"bare"}) | set(_block_features(t, *c))
        for t, o, c in zip(page.texts, page.owner, page.counts, strict=True)
    ]


@dataclass(frozen=True)
class Weights:
    """Of the features of blocks (log odds), with their bias; the scores of tags by name; the factor of scores of words
    that are below zero."""

    bias: float
    block: dict[str, float]
    tag: dict[str, float]
    other_tag: float
    below: float = 1.0

    def probabilities(self, page: Page) -> list[float]:
        own = [(self.bias + sum(self.block.get(f, 0.0) for f in x)) for x in features(page)]
        return (1 / (1 + np.exp(-np.clip(own, -50, 50)))).tolist()

    def scores(self, page: Page, p: list[float]) -> list[float]:
        """The score of each token, from the probability of each block."""
        # a long advert is hardly more of a break than a short one
        word = [x - 0.5 if x > 0.5 else self.below * (x - 0.5) * math.log2(1 + n) / n for x, (n, _) in zip(p, page.counts, strict=True)]
        return [n * word[b] if b >= 0 else self.tag.get(page.elements[-1 - b].name, self.other_tag) for b, n in page.tokens]


def best_stretch(scores: Sequence[float]) -> tuple[int, int]:
    """[start, end) of the first contiguous stretch with the largest sum; empty if no score is above zero."""
    best = total = 0.0
    found, start = (0, 0), 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def _truth(page: Page, lines: Iterable[str]) -> list[bool]:
    """Which blocks are main text: the labelled lines, found in their order."""
    wanted = list(lines)
    good, k = [False] * len(page.texts), 0
    for b, text in enumerate(page.texts):
        if k < len(wanted) and text == wanted[k]:
            good[b], k = True, k + 1
    return good


def learn(pages: Iterable[tuple[str, list[str]]], rounds: int = 400, rate: float = 0.6, decay: float = 3e-4) -> Weights:
    """Weights from labelled pages: logistic regression over blocks, and for tags what share of each stands outside.

    How much tags and words below zero count against words above it are the values, of a few, with which the labelled
    pages come out best.
    """
    parsed = [(p, _truth(p, lines)) for p, lines in ((parse(source), lines) for source, lines in pages)]
    blocks = [(f, y, c[0]) for p, good in parsed for f, y, c in zip(features(p), good, p.counts, strict=True)]
    number = {f: i for i, f in enumerate(sorted(set().union(*(f for f, _, _ in blocks))))} if blocks else {}
    x = np.zeros((len(blocks), len(number)), np.float32)
    for i, (f, _, _) in enumerate(blocks):
        x[i, [number[k] for k in f]] = 1
    y = np.array([good for _, good, _ in blocks], np.float32)
    w, bias, speed = np.zeros(len(number), np.float32), 0.0, np.zeros(len(number), np.float32)
    for _ in range(rounds if len(blocks) else 0):
        off = y - 1 / (1 + np.exp(-(x @ w + bias)))
        speed = 0.9 * speed + rate * (x.T @ off / len(y) * 4 - decay * w)
        w, bias = w + speed, bias + rate * 4 * float(off.mean())
    inside: Counter[str] = Counter()
    every: Counter[str] = Counter()
    for page, good in parsed:
        at = [i for i, (b, _) in enumerate(page.tokens) if b >= 0 and good[b]]
        for i, (b, _) in enumerate(page.tokens):
            if b < 0:
                every[page.elements[-1 - b].name] += 1
                inside[page.elements[-1 - b].name] += bool(at) and at[0] <= i < at[-1]
    block = dict(zip(number, w.tolist(), strict=True))
    made = []
    first = Weights(bias, block, {}, 0.0)
    known = [(page, good, first.probabilities(page)) for page, good in parsed]
    for below in (0.01, 0.03, 0.1, 0.3, 1.0):
        for size in (0.01, 0.03, 0.1, 0.3):
            tag = {k: -size * (1 - (inside[k] + 0.5) / (n + 1)) for k, n in every.items()}
            weights = Weights(bias, block, tag, -size / 2, below)
            right = sum(_agreement(weights, *k) for k in known)
            made.append((right, below, size, weights))
    # of values that come out alike, within a five-hundredth of a page's words, those that break up an article least
    best = max(m[0] for m in made)
    return min((m for m in made if m[0] >= best - 0.002 * len(known)), key=lambda m: (m[1], m[2]))[3]


def _agreement(weights: Weights, page: Page, good: list[bool], p: list[float]) -> float:
    """Share of a labelled page's words that are told right."""
    kept = set(chosen(page, weights, p))
    n = [c[0] for c in page.counts]
    return sum(c for b, c in enumerate(n) if (b in kept) == good[b]) / max(1, sum(n))


def chosen(page: Page, weights: Weights, p: list[float] | None = None) -> list[int]:
    """The blocks of the main text, in page order."""
    p = weights.probabilities(page) if p is None else p
    start, end = best_stretch(weights.scores(page, p))
    return [b for b in dict.fromkeys(b for b, _ in page.tokens[start:end] if b >= 0) if p[b] > 0.5]


def main_text(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    page = parse(source)
    return "\n".join(page.texts[b] for b in chosen(page, weights))


@functools.cache
def default_weights() -> Weights:
    return learn(labelled_pages.PAGES)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The columns of `pages` without html, and `text`; a column of that name is replaced."""
    small_batches(pages.sparkSession)
    weights = weights or default_weights()
    kept = [c for c in pages.columns if c not in ("html", "text")]
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch["html"].to_pylist()]
            # a reference to half a surrogate pair is no character
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*kept, "html").mapInArrow(part, schema)
