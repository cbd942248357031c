"""A small HTML tree with CSS selectors and a Markdown writer, on the standard library's tokenizer.

Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], compounds of these, descendants, and commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open paragraph.
FLOW = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "index")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.index: dict[str, list[Node]] | None = None

    def candidates(self, tests: tuple[tuple, ...]) -> Iterator[Node]:
        """Elements below that may fit a compound, in document order: a root looks its tags and classes up."""
        if self.tag != "#root":
            return self.walk()
        if self.index is None:
            self.index = {}
            for node in self.walk():
                for key in {node.tag, *("." + c for c in node.attrs.get("class", "").split())}:
                    self.index.setdefault(key, []).append(node)
        for tag, cls, *_ in tests:
            if cls or tag and tag != "*":
                return iter(self.index.get("." + cls if cls else tag.lower(), ()))
        return self.walk()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def text(self, skip: frozenset[str] = frozenset(("script", "style", "template"))) -> str:
        out: list[str] = []
        pending: list[Node | str] = [self]
        while pending:
            node = pending.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is self or node.tag not in skip:
                pending.extend(reversed(node.children))
        return "".join(out)

    def html(self) -> str:
        inner = "".join(c if isinstance(c, str) and self.tag in ("script", "style") else escape(c) if isinstance(c, str) else c.html() for c in self.children)
        attrs = "".join(f' {k}="{escape(v).replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return inner if self.tag == "#root" else f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)

    def select(self, selector: str) -> list[Node]:
        groups = compiled(selector)
        if len(groups) == 1:
            return [n for n in self.candidates(groups[0][-1]) if matches(n, groups[0])]
        return [n for n in self.walk() if any(matches(n, steps) for steps in groups)]

    def first(self, selector: str) -> Node | None:
        groups = compiled(selector)
        if len(groups) == 1:
            return next((n for n in self.candidates(groups[0][-1]) if matches(n, groups[0])), None)
        return next((n for n in self.walk() if any(matches(n, steps) for steps in groups)), None)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _end_open(self, ends: set[str] | frozenset[str], scope: set[str]) -> None:
        node = self.at
        while node.parent and node.tag not in scope:
            if node.tag in ends:
                self.at = node.parent
                if self.at.tag in ends:
                    self._end_open(ends, scope)
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FLOW:
            self._end_open({"p"}, {"td", "th", "li", "table", "button"})
        if tag in SIBLINGS:
            self._end_open(SIBLINGS[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return builder.root


SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]")
SPLIT = re.compile(r"\s+(?![^\[]*\])")


@lru_cache(512)
def compiled(selector: str) -> tuple[tuple[tuple[tuple, ...], ...], ...]:
    """Comma groups of descendant steps of simple tests."""
    return tuple(tuple(tuple(m.groups() for m in SIMPLE.finditer(step)) for step in SPLIT.split(part.strip())) for part in re.split(r",(?![^\[]*\])", selector))


def _fits(node: Node, tests: tuple[tuple, ...]) -> bool:
    for tag, cls, ident, name, op, value in tests:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if name:
            have = node.attrs.get(name)
            if have is None:
                return False
            if op == "=" and have != value or op == "*=" and value not in have or op == "^=" and not have.startswith(value) or op == "$=" and not have.endswith(value) or op == "~=" and value not in have.split():
                return False
    return True


def matches(node: Node, steps: tuple[tuple[tuple, ...], ...]) -> bool:
    if not _fits(node, steps[-1]):
        return False
    above = node.parent
    for step in reversed(steps[:-1]):
        while above is not None and (above.tag == "#root" or not _fits(above, step)):
            above = above.parent
        if above is None:
            return False
        above = above.parent
    return True


BLANKS = re.compile(r"[ \t\r\n]+")


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return BLANKS.sub(" ", node)
    if node.tag in ("script", "style", "meta", "link", "template"):
        return ""
    inner = "".join(_inline(c) for c in node.children)
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    if not inner.strip():
        return inner
    if node.tag in ("em", "i"):
        return f"_{inner.strip()}_"
    if node.tag in ("strong", "b"):
        return f"**{inner.strip()}**"
    if node.tag == "code":
        return f"`{inner.strip()}`"
    if node.tag == "a" and node.attrs.get("href"):
        return f"[{inner.strip()}]({node.attrs['href']})"
    return inner


CONTAINERS = frozenset("#root html body div section article main header footer aside nav figure figcaption form table tbody thead tfoot tr td th dl dt dd ul ol li blockquote pre p h1 h2 h3 h4 h5 h6 address hr".split())


def markdown(node: Node, depth: int = 0) -> str:
    """Markdown of a tree: headings, paragraphs, lists, quotes, code, links, images, emphasis."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run).strip(" \n")
        run.clear()
        if text.strip():
            blocks.append(text.strip())

    for child in node.children:
        if isinstance(child, str) or child.tag not in CONTAINERS:
            run.append(_inline(child))
            continue
        flush()
        if child.tag[0] == "h" and child.tag[1:].isdigit():
            if inner := "".join(_inline(c) for c in child.children).strip():
                blocks.append("#" * int(child.tag[1:]) + " " + inner)
        elif child.tag == "hr":
            blocks.append("* * *")
        elif child.tag == "pre":
            blocks.append("\n".join("    " + line for line in child.text().strip("\n").split("\n")))
        elif child.tag == "blockquote":
            if inner := markdown(child, depth):
                blocks.append("\n".join("> " + line if line else ">" for line in inner.split("\n")))
        elif child.tag in ("ul", "ol"):
            items = []
            for k, item in enumerate((c for c in child.children if isinstance(c, Node) and c.tag == "li"), 1):
                inner = markdown(item, depth + 1).replace("\n\n", "\n").split("\n")
                mark = f"{k}. " if child.tag == "ol" else "* "
                items.append("  " * (depth + 1) + mark + inner[0] + "".join("\n" + ("" if line.lstrip().startswith(("*", "1.")) else "  " * (depth + 2)) + line for line in inner[1:]))
            if items:
                blocks.append("\n".join(items))
        elif inner := markdown(child, depth):
            blocks.append(inner)
    flush()
    return "\n\n".join(blocks)


def cleaned(html: str | None, site_url: str, vendor_class: str = "sqs-") -> Node:
    """A tree without scripts, styles and metadata, without data attributes on a site builder's classes, and with rooted links made full."""
    root = parse(html)
    site = site_url.rstrip("/")
    for node in list(root.walk()):
        if node.tag in ("script", "style", "meta", "link"):
            node.remove()
            continue
        if vendor_class in node.attrs.get("class", ""):
            node.attrs = {k: v for k, v in node.attrs.items() if not k.startswith("data-")}
        for name in ("src", "href"):
            if node.attrs.get(name, "").startswith("/"):
                node.attrs[name] = site + node.attrs[name]
    return root
