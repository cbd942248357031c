"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed once into blocks: runs of text between block-level tags, each with the tags, classes and ids of its ancestors. A chain
over the blocks in page order labels each as main text or not. Features are ancestor tags, words of ancestors' class and id attributes, and
the text's own shape (length, links, punctuation, marks); the chain's pair weights make neighbours agree. Weights are fitted by
maximum likelihood (forward-backward, AdaGrad) to labelled pages, and pages are decoded by Viterbi.

The labelled pages are made by ``labelled_pages``: page layouts of many kinds (article tags, content classes, bare containers, comment
threads, side bars, notices, forms), whose blocks are labelled as they are written. Every process makes the same pages from one seed.

Defined cases: null and empty html give an empty text; pages without markup are one block; unclosed and stray tags are closed the way
browsers do for paragraphs, list items and table cells; scripts, styles, templates, form controls, drawings (svg) and the
head are never text, a head left open ends at the first tag or text that can't stand in it and a drawing at the first tag of ordinary markup; formulas
are part of their sentence, and fallback text of noscript, iframes, objects, canvas, audio and video is a block that the chain labels; white space is
what Unicode calls so, no-break spaces included; pages of any length and depth take time in proportion (a block's ancestors are carried down
the tree, class names that the chain does not know are counted only); rows that repeat a page_id are extracted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, texts_of

SKIPPED = frozenset("script style template head title svg select textarea button datalist".split())
#: What can stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Their fallback text is a block of its own.
FALLBACK = frozenset("object audio video canvas noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that end a drawing left open.
ORDINARY = BLOCKS | frozenset("b big br code em embed font i img nobr s small span strike strong sub sup tt u var".split())
#: Tags that end an open paragraph.
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
#: An opening tag ends these open ones, up to the scope's tags.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
REGIONS = frozenset("article main section nav header footer aside form dialog figure table".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Place:
    """An open tag and what it hands down: the innermost block and region, the block tags, and the names of classes, ids and roles above a block."""

    __slots__ = ("tag", "inner", "near", "kinds", "names", "few")

    def __init__(self, tag: str, names: list[str], above: Place | None, known: frozenset[str] | None):
        self.tag = tag
        self.inner = tag if tag in BLOCKS else above.inner if above else ""
        self.near = tag if tag in REGIONS else above.near if above else ""
        kinds, over, few = (above.kinds, above.names, above.few) if above else (frozenset(), {}, ())
        self.kinds = kinds if tag in kinds or tag not in BLOCKS or tag in ("html", "body") else kinds | {tag}
        for name in names:
            if len(few) < 3 and name not in few:
                few = (*few, name)
        new = [n for n in names if n not in over and (known is None or n in known)]
        self.names = over | dict.fromkeys(new) if new else over  # of known names at most
        self.few = few


TOP = Place("", [], None, None)


class Block:
    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Place, linked: int):
        self.text, self.place, self.linked = text, place, linked


class BlockParser(HTMLParser):
    """Blocks of a page, in order. known: the names that matter; all if not given."""

    def __init__(self, known: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.blocks: list[Block] = []
        self.stack: list[Place] = []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = self.skip = self.links = self.fallbacks = 0
        self.inside = False

    def flush(self, depth: int | None = None) -> None:
        """End a block, of the first depth open tags if given."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                at = len(self.stack) if depth is None else depth
                self.blocks.append(Block(text, self.stack[at - 1] if at else TOP, self.linked))
            self.text.clear()
            self.linked = 0

    def pop(self, at: int) -> None:
        for place in self.stack[at:]:
            tag = place.tag
            self.open[tag] -= 1
            self.skip -= tag in SKIPPED
            self.links -= tag == "a"
            self.fallbacks -= tag in FALLBACK
        del self.stack[at:]
        self.inside &= self.fallbacks > 0

    def end_head(self) -> None:
        while self.stack and self.stack[-1].tag == "head":
            self.pop(len(self.stack) - 1)

    def implied(self, ends: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if not any(self.open[tag] for tag in ends):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at].tag
            if tag in scope:
                return
            if tag in ends:
                last = at
                while last and self.stack[last - 1].tag in ends:
                    last -= 1
                self.flush()
                self.pop(last)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if self.open["svg"] and tag in ORDINARY:
            self.pop(next(at for at in range(len(self.stack) - 1, -1, -1) if self.stack[at].tag == "svg"))
        if tag == "br" or tag == "wbr":
            self.text.append(" " if tag == "br" else "")
            return
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES_P:
            self.implied(("p",), ("button", "object", "table", "td", "th", "body"))
        if tag in IMPLIED:
            self.implied(*IMPLIED[tag])
        if tag == "body":  # whatever the head left open ends here
            self.pop(0)
        if tag in VOID:
            return
        names = [w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in NAME.findall(v)] if attrs else []
        self.stack.append(Place(tag, names, self.stack[-1] if self.stack else None, self.known))
        self.open[tag] += 1
        self.skip += tag in SKIPPED
        self.links += tag == "a"
        self.fallbacks += tag in FALLBACK

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # the slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if self.open[tag]:
            at = next(at for at in range(len(self.stack) - 1, -1, -1) if self.stack[at].tag == tag)
            if tag in BLOCKS or any(p.tag in BLOCKS or self.inside and p.tag in FALLBACK for p in self.stack[at:]):
                self.flush()
            self.pop(at)
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.skip and self.stack[-1].tag == "head" and data.strip():
            self.end_head()
        if not self.skip:
            if self.fallbacks and not self.inside and data.strip():
                self.flush(next(at for at, place in enumerate(self.stack) if place.tag in FALLBACK))
                self.inside = True
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str, known: frozenset[str] | None = None) -> list[Block]:
    parser = BlockParser(known)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


MARKS = re.compile(r"[©®™]|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
CLOSING = tuple(".!?…:;\"”»")


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    n = len(blocks)
    for k, block in enumerate(blocks):
        words = block.text.count(" ") + 1
        place = block.place
        found = ["bias", f"leaf={place.tag}", f"block={place.inner}", f"near={place.near}", f"near={place.near}/{place.inner}", f"depth={place.near}/{len(place.few)}"]
        found += [f"in={t}" for t in place.kinds]
        found += [f"name={w}" for w in place.names]
        found.append(f"words={min(6, words.bit_length())}")
        share = block.linked / len(block.text)
        found.append(f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
        if block.text.endswith(CLOSING):
            found.append("closed")
        if "," in block.text or ". " in block.text:
            found.append("prose")
        if MARKS.search(block.text):
            found.append("marks")
        if block.text[:1].isdigit():
            found.append("digit")
        if k == 0:
            found.append("first")
        if k == n - 1:
            found.append("last")
        out.append(found)
    return out


class Chain:
    """Two-label linear-chain CRF; label 1 is main text."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pair: np.ndarray):
        self.index, self.weights, self.pair = index, weights, pair
        self.names = frozenset(name[5:] for name in index if name.startswith("name="))
        self.table = {name: (float(weights[i, 0]), float(weights[i, 1])) for name, i in index.items()}

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        table, none = self.table, (0.0, 0.0)
        (p00, p01), (p10, p11) = self.pair.tolist()
        back = []
        a = b = 0.0
        for k, names in enumerate(rows):
            e0 = e1 = 0.0
            for name in names:
                x, y = table.get(name, none)
                e0 += x
                e1 += y
            if k:
                from0 = (a + p00 >= b + p10, a + p01 > b + p11)
                a, b = max(a + p00, b + p10) + e0, max(a + p01, b + p11) + e1
                back.append(from0)
            else:
                a, b = e0, e1
        label = int(b > a)
        path = [label]
        for from0 in reversed(back):
            label = 0 if from0[label] else 1
            path.append(label)
        return path[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """Maximum likelihood by AdaGrad, one page a step."""
    index: dict[str, int] = {}
    rows = [[np.array([index.setdefault(n, len(index)) for n in names]) for names in page] for page, _ in pages]
    weights, pair = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_w, seen_p = np.full_like(weights, 1e-6), np.full_like(pair, 1e-6)
    order = random.Random(7)
    for _ in range(epochs):
        for at in order.sample(range(len(pages)), len(pages)):
            labels, used = pages[at][1], rows[at]
            n = len(used)
            if not n:
                continue
            emit = np.array([weights[u].sum(axis=0) for u in used])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0]
            for k in range(1, n):
                forward[k] = emit[k] + np.logaddexp(forward[k - 1, 0] + pair[0], forward[k - 1, 1] + pair[1])
            for k in range(n - 2, -1, -1):
                after = emit[k + 1] + backward[k + 1]
                backward[k] = np.logaddexp(pair[:, 0] + after[0], pair[:, 1] + after[1])
            total = np.logaddexp(*forward[-1])
            slope = np.exp(forward + backward - total)
            slope[np.arange(n), labels] -= 1
            steps = np.zeros((2, 2))
            if n > 1:
                joint = forward[:-1, :, None] + pair[None] + (emit[1:] + backward[1:])[:, None, :] - total
                steps = np.exp(joint).sum(axis=0)
                np.add.at(steps, (np.array(labels[:-1]), np.array(labels[1:])), -1)
            flat = np.concatenate(used)
            grad = np.repeat(slope, [len(u) for u in used], axis=0)
            change = np.zeros_like(weights)
            np.add.at(change, flat, grad)
            touched = np.unique(flat)
            step = change[touched] + ridge * weights[touched]
            seen_w[touched] += step**2
            weights[touched] -= rate * step / np.sqrt(seen_w[touched])
            steps += ridge * pair
            seen_p += steps**2
            pair -= rate * steps / np.sqrt(seen_p)
    return Chain(index, weights, pair)


# ---- labelled pages -------------------------------------------------------------------------------------------------------------

SYLLABLES = "an ber con del en fa gre hol in jo ka lu mer no or pa qui ri sto ta un ver wi ya zo é ü ñ".split()
CONTENT_NAMES = ("content", "post-content", "entry-content", "article-body", "post-body", "story", "main-content", "post", "entry", "text", "article__body", "blog-item-content", "body-copy", "rich-text", "page-content", "prose")
OUTER_NAMES = ("container", "wrapper", "page", "site", "row", "col", "layout", "inner", "app", "grid")
SIDE_NAMES = ("sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "popular", "trending", "archive-list", "tag-cloud", "author-box", "rail", "secondary", "blogroll")
MENU_NAMES = ("nav", "menu", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "pagination", "toc", "site-nav", "topbar", "skip-link")
HEAD_NAMES = ("header", "site-header", "masthead", "banner", "top", "branding", "tagline", "logo")
FOOT_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "credits")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adsense", "promoted")
NOTICE_NAMES = ("cookie-notice", "cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer", "signup", "message")
COMMENT_NAMES = ("comments", "comment", "comment-list", "respond", "discussion", "replies", "reply", "disqus", "comment-body", "reader-comments", "responses")
SHARE_NAMES = ("share", "social", "share-buttons", "social-links", "follow")
META_NAMES = ("meta", "byline", "post-meta", "entry-meta", "date", "author", "tags", "categories")


class Writer:
    """One page with its labels; every piece of text carries a key in the order of writing."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(200)]
        self.main: list[str] = []
        self.odd = rng.random() < 0.15  # prose with marks and bars, as bad pages have
        self.serial = 0

    def say(self, low: int, high: int, close: bool = True) -> str:
        rng = self.rng
        out = [rng.choice(self.words) + ("," if rng.random() < 0.1 else ". " if rng.random() < 0.05 else "") for _ in range(rng.randint(low, high))]
        if self.odd:
            out = [w + rng.choice(("", "###", "&&&", " |", "!!")) for w in out]
        self.serial += 1
        return (" ".join(out).strip(" .,").capitalize() + f" q{self.serial}z" + ("." if close else "")).strip()

    def keep(self, text: str) -> str:
        self.main.append(" ".join(text.split()))
        return escape(text, quote=False)

    def other(self, low: int, high: int, close: bool = True) -> str:
        return escape(self.say(low, high, close), quote=False)

    def named(self, names: tuple[str, ...]) -> str:
        rng = self.rng
        kind = rng.random()
        name = rng.choice(names)
        if rng.random() < 0.3:
            name += " " + rng.choice(OUTER_NAMES)
        return f' class="{name}"' if kind < 0.7 else f' id="{name}"' if kind < 0.9 else f' class="{name}" id="{rng.choice(names)}"'

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{k}">{self.other(1, 4, False)}</a>{f"</{item}>" if self.rng.random() < 0.9 else ""}' for k in range(n))

    def menu(self) -> str:
        rng = self.rng
        tag = rng.choice(("nav", "nav", "div", "ul"))
        inner = self.links(rng.randint(2, 8)) if tag == "ul" else f"<ul>{self.links(rng.randint(2, 8))}</ul>" if rng.random() < 0.7 else " ".join(f"<a href=/{k}>{self.other(1, 3, False)}</a>" for k in range(rng.randint(2, 6)))
        return f"<{tag}{self.named(MENU_NAMES) if tag != 'nav' or rng.random() < 0.5 else ''}>{inner}</{tag}>"

    def header(self) -> str:
        rng = self.rng
        tag = rng.choice(("header", "header", "div"))
        parts = [f"<{rng.choice(('a', 'span', 'div', 'p'))}>{self.other(1, 4, False)}"]
        if rng.random() < 0.5:
            parts.append(f"<p>{self.other(3, 10, rng.random() < 0.5)}</p>")
        if rng.random() < 0.5:
            parts.append(self.menu())
        return f"<{tag}{self.named(HEAD_NAMES) if tag == 'div' or rng.random() < 0.5 else ''}>{''.join(parts)}</{tag}>"

    def footer(self) -> str:
        rng = self.rng
        tag = rng.choice(("footer", "footer", "div"))
        mark = rng.choice(("&copy; ", "© 2020 ", "Copyright ", ""))
        parts = [f"{mark}{self.other(1, 12, rng.random() < 0.6)}"]
        if rng.random() < 0.4:
            parts.append(f"<ul>{self.links(rng.randint(2, 5))}</ul>")
        if rng.random() < 0.4:
            parts.append(f"<p>{self.other(5, 30)}</p>")
        return f"<{tag}{self.named(FOOT_NAMES) if tag == 'div' or rng.random() < 0.4 else ''}>{''.join(parts)}</{tag}>"

    def advert(self) -> str:
        rng = self.rng
        tag = rng.choice(("div", "div", "aside", "section", "p"))
        inner = self.other(2, 40) if rng.random() < 0.7 or tag == "p" else f"<p>{self.other(3, 30)}</p><a href=#>{self.other(1, 3, False)}</a>"
        return f"<!-- ad --><{tag}{self.named(AD_NAMES)}>{inner}</{tag}>"

    def notice(self) -> str:
        rng = self.rng
        tag = rng.choice(("div", "div", "section", "aside", "dialog"))
        return f"<{tag}{self.named(NOTICE_NAMES)}><p>{self.other(5, 40)}</p>{f'<a href=#>{self.other(1, 2, False)}</a>' if rng.random() < 0.5 else ''}</{tag}>"

    def side(self) -> str:
        rng = self.rng
        tag = rng.choice(("aside", "aside", "div", "section"))
        heading = f"<h{rng.randint(2, 4)}>{self.other(1, 4, False)}</h3>".replace("h3>", "h3>") if rng.random() < 0.5 else f"<h3>{self.other(1, 4, False)}</h3>"
        inner = rng.choice((lambda: f"<ul>{self.links(rng.randint(2, 7))}</ul>", lambda: f"<p>{self.other(8, 60)}</p>", lambda: self.advert()))()
        return f"<{tag}{self.named(SIDE_NAMES) if tag != 'aside' or rng.random() < 0.5 else ''}>{heading}{inner}</{tag}>"

    def form(self) -> str:
        rng = self.rng
        return f'<form action="/s"{self.named(("search", "contact", "subscribe", "login")) if rng.random() < 0.4 else ""}><label>{self.other(1, 4, False)}</label><input name=q><p>{self.other(2, 20)}</p><button>{self.other(1, 2, False)}</button></form>'

    def comments(self) -> str:
        rng = self.rng
        tag = rng.choice(("section", "div", "div", "ol", "ul"))
        item = "li" if tag in ("ol", "ul") else rng.choice(("div", "article", "div"))
        items = "".join(f"<{item}{self.named(COMMENT_NAMES) if rng.random() < 0.6 else ''}><{'b' if rng.random() < 0.5 else 'div'}>{self.other(1, 3, False)}</b></div><p>{self.other(4, 60)}</p></{item}>" for _ in range(rng.randint(1, 5)))
        head = f"<h3>{self.other(1, 3, False)}</h3>" if tag in ("section", "div") and rng.random() < 0.7 else ""
        return f"<{tag}{self.named(COMMENT_NAMES)}>{head}{items}{self.form() if rng.random() < 0.4 else ''}</{tag}>"

    def share(self) -> str:
        return f"<div{self.named(SHARE_NAMES)}>{' '.join(f'<a href=#>{self.other(1, 2, False)}</a>' for _ in range(self.rng.randint(1, 4)))}</div>"

    def meta(self) -> str:
        rng = self.rng
        return f"<{(t := rng.choice(('div', 'p')))}{self.named(META_NAMES)}>{self.other(1, 6, False)}</{t}>"

    def paragraph(self) -> str:
        rng = self.rng
        kind = rng.random()
        low, high = rng.choice(((1, 3), (4, 20), (15, 80), (15, 80), (40, 150)))
        text = self.say(low, high, rng.random() < 0.9)
        if kind < 0.62:
            opened = rng.choice(("", "", "", "<b>", "<em>", "<span>"))
            return f"<p>{opened}{self.keep(text)}" + rng.choice(("</p>", "</p>", "</p>", "<br>", "", "\n</p>\n"))
        if kind < 0.70:
            words = text.split()
            cut = rng.randint(0, max(0, len(words) - 2))
            self.keep(text)
            return "<p>" + escape(" ".join(words[:cut]), quote=False) + f' <a href="/x">{escape(words[cut], quote=False)}</a> ' + escape(" ".join(words[cut + 1 :]), quote=False) + "</p>"
        if kind < 0.76:
            return f"<h{(n := rng.randint(2, 4))}>{self.keep(self.say(2, 7, False))}</h{n}>"
        if kind < 0.84:
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.keep(self.say(2, 25, rng.random() < 0.6))}" + rng.choice(("</li>", "")) for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.90:
            return f"<blockquote><p>{self.keep(text)}</p></blockquote>" if rng.random() < 0.6 else f"<blockquote>{self.keep(text)}</blockquote>"
        if kind < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.say(1, 6, False))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        if kind < 0.96:
            return f"<pre>{self.keep(text)}</pre>"
        return f"<figure><img src=x.png><figcaption>{self.keep(self.say(3, 15))}</figcaption></figure>"

    def article(self) -> str:
        rng = self.rng
        title = self.keep(self.say(2, 12, False))
        heading = f"<h1>{title}</h1>" if rng.random() < 0.85 else f"<h2{rng.choice(('', ' class=title'))}>{title}</h2>"
        if rng.random() < 0.15:
            heading = f"<header>{heading}</header>"
        body = []
        if rng.random() < 0.3:
            body.append(self.meta())
        for _ in range(rng.choice((1, 2, 4, 6, 9, 14))):
            body.append(self.paragraph())
            chance = rng.random()
            if chance < 0.04:
                body.append(self.advert())
            elif chance < 0.06:
                body.append(self.notice())
            elif chance < 0.07:
                body.append(self.form())
        tail = "".join(f() for f in (self.share, self.side, self.meta, self.comments) if rng.random() < 0.12)
        inner = "".join(body)
        kind = rng.random()
        if kind < 0.45:
            if rng.random() < 0.3:
                inner = f"<div{self.named(CONTENT_NAMES)}>{inner}</div>"
            out = f"<article{self.named(CONTENT_NAMES) if rng.random() < 0.3 else ''}>{heading}{inner}{tail}</article>"
        elif kind < 0.6:
            out = f"<main>{heading}{inner}{tail}</main>"
        elif kind < 0.9:
            out = f"<div{self.named(CONTENT_NAMES)}>{heading}{inner}{tail}</div>"
        elif kind < 0.95:
            out = f"<section{self.named(CONTENT_NAMES)}>{heading}{inner}</section>{tail}"
        else:
            out = f"<div>{heading}{inner}</div>{tail}"
        return f"<main>{out}</main>" if rng.random() < 0.15 and "<main" not in out else out

    def page(self) -> str:
        rng = self.rng
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.6), (self.menu, 0.6), (self.form, 0.1), (self.advert, 0.35), (self.side, 0.1)) if rng.random() < p]
        after = [f for f, p in ((self.share, 0.2), (self.comments, 0.3), (self.side, 0.35), (self.advert, 0.3), (self.form, 0.15), (self.notice, 0.15), (self.menu, 0.15), (self.footer, 0.85)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(before)
        body = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        for _ in range(rng.randint(0, 2)):
            body = f"<div{self.named(OUTER_NAMES) if rng.random() < 0.8 else ''}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.other(2, 8, False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}" + ("</body></html>" if rng.random() < 0.9 else "")


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, texts of the main blocks) of n pages."""
    for k in range(n):
        writer = Writer(random.Random(seed * 1_000_003 + k))
        html = writer.page()
        yield html, writer.main


@cache
def trained(n: int = 700, seed: int = 11) -> Chain:
    """The chain fitted to n labelled pages; a bounded sample that this module makes."""
    pages = []
    for html, main in labelled_pages(n, seed):
        blocks, known = blocks_of(html), set(main)
        pages.append((features(blocks), [int(b.text in known) for b in blocks]))
    return fit(pages)


def main_text(html: str, chain: Chain) -> str:
    blocks = blocks_of(html, chain.names)
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(features(blocks)), strict=True) if label)


def extract_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    session(pages)
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = [main_text(h, fitted) for h in texts_of(batch["html"])]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
