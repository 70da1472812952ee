"""A tolerant HTML tree of elements and text blocks, kept as parallel lists."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Groups of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text without tags.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Shown only where something is missing, or drawn: skipped whole.
SKIPPED = frozenset("noscript template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose start tag ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
#: A start tag ends an open element of these names, up to the nearest container given.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Tree:
    """Node 0 is the root. tag is '#text' for a text block; text and linked count its characters, those in links apart."""

    def __init__(self):
        self.parent, self.tag, self.attrs, self.depth, self.text, self.linked = [-1], ["#root"], [""], [0], [""], [0]

    def add(self, parent: int, tag: str, attrs: str = "", text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


class Scanner:
    """Where tags and skipped elements end. What is found once is remembered, so that the work grows with the page."""

    def __init__(self, html: str):
        self.html, self.plain, self.gt = html, False, -2
        self.last: dict[str, int] = {}

    def next_gt(self, at: int) -> int:
        """Place of the next '>', -1 if there is none."""
        if self.gt != -1 and self.gt < at:
            self.gt = self.html.find(">", at)
        return self.gt

    def tag_end(self, at: int) -> int:
        """Place of the '>' that ends a tag; quoted ones are passed over, unless a page's quotes never close."""
        if self.plain or self.next_gt(at) == -1:
            return self.next_gt(at)
        first = self.gt
        while True:
            at = _PLAIN.match(self.html, at).end()
            if at < len(self.html) and self.html[at] == ">":
                return at
            close = self.html.find(self.html[at], at + 1) if at < len(self.html) else -1
            if close == -1:
                self.plain = True
                return first
            at = close + 1

    def close(self, name: str, at: int) -> int | None:
        """Where the text after the element's end tag begins; None if it is never closed."""
        pattern = re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I)
        if name not in self.last:
            self.last[name] = max((m.start() for m in pattern.finditer(self.html, at)), default=-1)
        if at > self.last[name]:
            return None
        end = self.next_gt(pattern.search(self.html, at).end())
        return len(self.html) if end == -1 else end + 1


def parse(html: str) -> Tree:
    """Blocks are runs of text and inline elements between the borders of block elements.

    Inline elements get no node: their text belongs to the block, formulas and the content of objects and
    canvases too. Raw text elements (scripts, styles and so on) and SKIPPED ones are left out whole. Unclosed
    and misnested tags are accepted: an unclosed raw text element or comment ends the page, as it does in
    browsers, an unclosed skipped one ends at the next tag of a block. A '<' that begins no tag is text.
    Any length of page takes time in proportion.
    """
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open block elements
    open_: Counter[str] = Counter()  # how many of each name
    links = 0
    parts: list[str] = []
    linked = 0
    muted = False
    scanner = Scanner(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                tree.add(stack[-1][1], "#text", "", text, min(linked, len(text)))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        open_.subtract(name for name, _ in stack[k:])
        del stack[k:]

    at, end = 0, len(html)
    while at < end:
        if html[at] != "<":
            stop = html.find("<", at)
            stop = end if stop == -1 else stop
            piece = html[at:stop]
            at = stop
        else:
            piece = "<"
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                at = end if stop == -1 else stop + 3
                continue
            if html[at + 1 : at + 2] in ("!", "?") and scanner.next_gt(at) != -1:
                at = scanner.gt + 1
                continue
            m = _NAME.match(html, at + 1) if scanner.next_gt(at) != -1 else None
            stop = scanner.tag_end(m.end()) if m else -1
            at = at + 1 if stop == -1 else at
        if piece != "<" or stop == -1:
            if not muted:
                parts.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        closing = m[0][0] == "/"
        name, rest = m[0].lstrip("/").lower(), html[m.end() : stop]
        at = stop + 1
        if name in RAW or name in SKIPPED:
            if not closing and not rest.rstrip().endswith("/"):
                after = scanner.close(name, at)
                if after is not None:
                    at = after
                elif name in RAW:
                    at = end
                else:
                    muted = True
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        flush()
        links, muted = 0, False
        if closing:
            for k in range(len(stack) - 1, 0, -1) if open_[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in ENDS_P and stack[-1][0] == "p":
            close(len(stack) - 1)
        ends, within = ENDS.get(name, ((), ()))
        for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in ends) else ():
            if stack[k][0] in within:
                break
            if stack[k][0] in ends:
                close(k)
                break
        if name in VOID:
            continue
        attrs = " ".join(f"{a[0]}={a[1] or a[2] or a[3]}" for a in _ATTR.findall(rest)).lower() if rest else ""
        node = tree.add(stack[-1][1], name, attrs)
        if not rest.rstrip().endswith("/"):
            stack.append((name, node))
            open_[name] += 1
    flush()
    return tree
