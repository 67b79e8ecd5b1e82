"""Labelled pages from which the weights of HTML extraction are learned by default.

Each is (html, lines of main text).  They are invented: four written by hand, and a few hundred put together by rule
from the common ways of marking up a site, with names that mislead among them.  Other labelled pages can be given to
`htmlmain.learn`.
"""

from __future__ import annotations

import random
import re

# How sites mark what is not the article, by kind: elements, and names in class and id attributes.
_PARTS: dict[str, tuple[str, str]] = {
    "menu": ("nav nav div ul", "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topnav"),
    "header": ("header header div", "header masthead topbar banner"),
    "footer": ("footer footer div", "footer copyright colophon contentinfo"),
    "aside": ("aside aside div section", "sidebar widget widgets related recommended recommendations complementary outbrain taboola"),
    "notice": ("div section dialog", "cookie cookies consent gdpr notice notices popup modal overlay"),
    "advert": ("div div div aside section", "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion"),
    "form": ("form form div", "search login signup subscribe subscription newsletter"),
    "comments": ("section div ol", "comment comments commentlist respond disqus reply replies"),
    "share": ("div ul", "share sharing social toolbar"),
}
_SUFFIXES = "box list links wrapper area section container block bar inner top left right item form slot buttons notice".split()
_ARTICLE_NAMES = "content main article post entry story body text entry-content post-body article-text main-content story-text".split()
_LAYOUTS = "page wrapper container site layout has-sidebar with-sidebar no-comments two-columns has-header".split()
_TOPICS = "work works algorithms history method methods theory market culture science results study policy design season".split()
_SYLLABLES = "an be cor del ev fi gan hu ir jo kel lo mi nor os pra qui res sto tal un ver wis yl zen".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))


def _words(rng: random.Random, n: int, end: str = "") -> str:
    return " ".join(_word(rng) for _ in range(n)).capitalize() + end


def _prose(rng: random.Random) -> str:
    return " ".join(_words(rng, rng.choice([1, 2, 4, 8, 12, 20]), rng.choice("...?!")) for _ in range(rng.choice([1, 1, 2, 3, 5])))


def _links(rng: random.Random, n: int, wrap: str = "") -> str:
    one = [f'<a href="/{_word(rng)}">{_words(rng, rng.randint(1, 3))}</a>' for _ in range(n)]
    return " ".join(f"<{wrap}>{x}</{wrap}>" if wrap else x for x in one)


def _attributes(rng: random.Random, kind: str) -> str:
    name = rng.choice(_PARTS[kind][1].split())
    if rng.random() < 0.4:
        name = rng.choice([f"{name}-{rng.choice(_SUFFIXES)}", f"site-{name}", f"page_{name}", f"js-{name}", f"{name}{rng.randint(1, 9)}"])
    return rng.choice([f' class="{name}"', f' class="{name} {_word(rng)}"', f" id='{name}'", f" class={name}"])


def _part(rng: random.Random, kind: str) -> str:
    """One part of a page that is not the article."""
    tag = rng.choice(_PARTS[kind][0].split())
    named = tag in ("div", "ul", "ol", "section", "dialog") or rng.random() < 0.4
    body = {
        "menu": lambda: f"<ul>{_links(rng, rng.randint(2, 7), 'li')}</ul>" if tag != "ul" and rng.random() < 0.7 else _links(rng, rng.randint(2, 7), "li" if tag == "ul" else ""),
        "header": lambda: rng.choice([f"<h1>{_words(rng, 2)}</h1>", f"<a href='/'>{_words(rng, 2)}</a><p>{_words(rng, 5)}</p>", _words(rng, 3)]),
        "footer": lambda: rng.choice([f"&copy; {_words(rng, 3)} &middot; {_prose(rng)}", f"<p>{_prose(rng)}</p>{_links(rng, 3)}", _links(rng, 4, "li"), _words(rng, 4)]),
        "aside": lambda: rng.choice([f"<h3>{_words(rng, 2)}</h3><ul>{_links(rng, 4, 'li')}</ul>", f"<p>{_prose(rng)}</p>", f"{_words(rng, 1)}: {_links(rng, 2)}", _prose(rng)]),
        "notice": lambda: f"<p>{_prose(rng)}</p>" + rng.choice(["", f"<button>{_words(rng, 1)}</button>", _links(rng, 1)]),
        "advert": lambda: rng.choice([_prose(rng), f"<p>{_prose(rng)}</p>", f"<h3>{_words(rng, 3)}</h3><p>{_prose(rng)}</p>", _links(rng, 1), _words(rng, 3)]),
        "form": lambda: f"<label>{_words(rng, 1)}</label><input name=q><button>{_words(rng, 1)}</button>" + rng.choice(["", f"<p>{_prose(rng)}</p>"]),
        "comments": lambda: f"<h3>{_words(rng, 1)}</h3>" + "".join(
            rng.choice([f"<article class=comment><p>{_prose(rng)}</p></article>", f"<div class='comment'><p>{_prose(rng)}</p></div>", f"<p>{_prose(rng)}</p>", f"<li>{_prose(rng)}</li>", f"<article><p>{_prose(rng)}</p></article>"]) for _ in range(rng.randint(1, 5))
        ),
        "share": lambda: _links(rng, 3, "li" if tag == "ul" else ""),
    }[kind]()
    return f"<{tag}{_attributes(rng, kind) if named else ''}>{body}</{tag}>"


def _misleading(rng: random.Random) -> str:
    name = rng.choice(_PARTS[rng.choice(list(_PARTS))][1].split())
    return rng.choice([f"{name}-{rng.choice(_TOPICS)}", f"{name}-{_word(rng)}", f"{rng.choice(_TOPICS)}-{name}"])


def _article(rng: random.Random, lines: list[str]) -> str:
    """The inside of an article; its lines are added to `lines`."""
    out: list[str] = []

    def say(tag: str, text: str, inner: str | None = None) -> None:
        lines.append(text)
        out.append(f"<{tag}>{inner or text}</{tag}>")

    if rng.random() < 0.8:
        say("h1", _words(rng, rng.randint(1, 9)))
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
        kind = rng.random()
        if kind < 0.62:
            text = _prose(rng)
            link = rng.random() < 0.25 and len(text.split()) > 4
            inner = " ".join(f"<a href='#'>{w}</a>" if link and i == 1 else f"<b>{w}</b>" if i == 2 else w for i, w in enumerate(text.split()))
            say("p", text, inner)
        elif kind < 0.72:
            say(rng.choice(["h2", "h3"]), _words(rng, rng.randint(1, 5)))
        elif kind < 0.8:
            tag = rng.choice(["ul", "ol"])
            out.append(f"<{tag}>")
            for _ in range(rng.randint(1, 4)):
                say("li", rng.choice([_prose(rng), _words(rng, 2)]))
            out.append(f"</{tag}>")
        elif kind < 0.85:
            say(rng.choice(["blockquote", "pre", "figcaption", "div", "dd"]), _prose(rng))
        elif kind < 0.89:
            out.append("<table><tr>")
            for _ in range(rng.randint(2, 5)):
                say(rng.choice(["td", "th"]), rng.choice([_words(rng, 1), str(rng.randint(1, 999))]))
            out.append("</tr></table>")
        elif kind < 0.94:
            tag = rng.choice(["section", "div"])
            out.append(f'<{tag} {rng.choice(["class", "id"])}="{_misleading(rng)}">')
            say("p", _prose(rng))
            out.append(f"</{tag}>")
        elif kind < 0.975:
            out.append(_part(rng, rng.choice(["advert", "advert", "aside", "share", "form"])))
        else:
            out.append(f"<aside>{_words(rng, rng.randint(50, 300))}</aside>")
    return "".join(out)


def _page(rng: random.Random) -> tuple[str, list[str]]:
    lines: list[str] = []
    if rng.random() < 0.1:  # next to no markup
        lines = [rng.choice([_prose(rng), _words(rng, rng.randint(1, 9))]) for _ in range(rng.choice([1, 1, 2, 4]))]
        return ("".join(f"<p>{x}" for x in lines) if len(lines) > 1 or rng.random() < 0.4 else lines[0]), lines
    inside = _article(rng, lines)
    name = f' {rng.choice(["class", "id"])}="{rng.choice(_ARTICLE_NAMES)}"'
    start, end = rng.choice(
        [("<article>", "</article>")] * 4
        + [("<div>", "</div>")] * 2
        + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{name}>", "</div>"), (f"<div{name}>", "</div>"), (f"<article{name}>", "</article>"), (f"<section{name}>", "</section>"), ("<div>", "</div>"), ("", "")]
        + [(f'<div class="{rng.choice(["has", "no", "with"])}-{rng.choice(["sidebar", "comments", "ads", "menu"])}"><article>', "</article></div>"), (f'<article class="post {rng.choice(["no", "has"])}-comments">', "</article>")]
    )
    before = [_part(rng, k) for k in ("header", "menu", "notice", "advert", "aside", "form") if rng.random() < 0.45]
    after = [_part(rng, k) for k in ("share", "comments", "aside", "advert", "form", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    if rng.random() < 0.1:
        kind = rng.choice(["advert", "menu", "notice", "aside"])  # never closed
        before.append(f"<{rng.choice(_PARTS[kind][0].split())}{_attributes(rng, kind)}>{_words(rng, 3)}")
        start, end = "<article>", "</article>"
    if rng.random() < 0.35:  # one element around everything
        before.insert(0, f"<div{rng.choice(['', f' class={rng.choice(_LAYOUTS)}', f' id={rng.choice(_LAYOUTS)}'])}>")
        after.append("</div>")
    head = f"<!doctype html><html><head><title>{_words(rng, 3)}</title><style>p{{margin:0}}</style></head><body{rng.choice(['', ' class=has-sidebar', ' class=page'])}>"
    source = "".join([head, *before, start, inside, end, *after, "</body></html>"])
    return (unnamed(source) if rng.random() < 0.04 else source), lines


def unnamed(source: str) -> str:
    """A page whose elements have no names, as where a site's own are unknown."""
    return re.sub(r"""\s(?:class|id)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", source)


_BY_HAND: list[tuple[str, list[str]]] = [
    (
        """<!doctype html><html><head><title>Rain</title></head><body><header><a href="/">Daily Field</a><p>News from the fields</p></header>
        <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Weather</a></li><li><a href="/c">Crops</a></li></ul></nav>
        <main><article><h1>Rain comes late</h1><p>The first rain of the year fell on <a href="/mon">Monday</a> evening.</p>
        <p>Farmers had waited for it since March.</p><div class="ad">Buy boots now, half price</div><p>More is expected.</p></article></main>
        <aside><h3>Most read</h3><ul><li><a href="/1">Ten seeds to sow</a></li><li><a href="/2">A dry spring</a></li></ul></aside>
        <footer><p>&copy; Daily Field. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body></html>""",
        ["Rain comes late", "The first rain of the year fell on Monday evening.", "Farmers had waited for it since March.", "More is expected."],
    ),
    (
        """<html><body><div id="top-menu"><a href="/x">Start</a> <a href="/y">Archive</a> <a href="/z">About</a></div>
        <div class="cookie-notice"><p>We use cookies to make this site better.</p><button>Accept</button></div>
        <div id="content"><h2>On walking</h2><p>One foot before the other, and the road <em>does the rest</em>.<br>So they say.</p>
        <blockquote>Who walks alone walks far.</blockquote><ul><li>Take water with you.</li><li>Start early.</li></ul></div>
        <section class="comments"><h3>Comments</h3><div class="comment"><p>Lovely text, thank you!</p></div></section>
        <form action="/s"><label>Search</label><input name="q"></form></body></html>""",
        ["On walking", "One foot before the other, and the road does the rest. So they say.", "Who walks alone walks far.", "Take water with you.", "Start early."],
    ),
    (
        """<html><body><table class="nav"><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table>
        <div><h1>Results</h1><p>The table lists the winners.</p><table><tr><th>Name</th><th>Time</th></tr><tr><td>Ada</td><td>12.4</td></tr></table>
        <p>All times are in seconds.</p></div><div class="sidebar"><p>Related: <a href="/r">last year</a></p></div>
        <div class="footer">Contact us at any time.</div></body></html>""",
        ["Results", "The table lists the winners.", "Name", "Time", "Ada", "12.4", "All times are in seconds."],
    ),
    (
        """<html><body><nav><a href="/de">DE</a><a href="/en">EN</a></nav><div class="share-buttons"><a href="#">Share</a></div>
        <article><h1>Bread</h1><h2>What you need</h2><ol><li>Flour</li><li>Water</li></ol><p>Mix.</p><p>Wait.</p><pre>220 C</pre>
        <figure><img src="a.png"><figcaption>A loaf</figcaption></figure><p>Bake.</p></article>
        <div class="newsletter"><p>Subscribe to our letter.</p></div><footer>Privacy, terms</footer></body></html>""",
        ["Bread", "What you need", "Flour", "Water", "Mix.", "Wait.", "220 C", "A loaf", "Bake."],
    ),
]

#: Pages put together by rule, and how often those written by hand are repeated among them.
MADE, REPEATED = 700, 5


def pages(made: int = MADE, seed: int = 17) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [*_BY_HAND * REPEATED, *(_page(rng) for _ in range(made))]


PAGES: list[tuple[str, list[str]]] = pages()
