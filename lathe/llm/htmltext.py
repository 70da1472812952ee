"""Main text of web pages by a tree-structured graphical model.

Each block element and each text block of a page is a node that is content or not. A node's potential comes
from its tag, its class and id words, and the length and links of its text; an edge's potential is a two by two
table for each kind of child. Messages go up from the leaves and down again (sum-product), which on a tree
gives exact marginals; text blocks with a marginal of at least one half are the main text. The weights
maximise the likelihood of labelled pages that `labelled_pages` lays out in many ways.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.dom import Tree, parse

#: In the labelled pages content begins with this character, which is taken off before features are made.
MARK = "\ue001"
TRAIN_PAGES = 600
#: Pages whose nodes go through the messages together.
TOGETHER = 256
_NAMES = re.compile(r"[a-z]+")
_STOPS = re.compile(r"[.!?…。؟:;,]")


def features(tree: Tree, ids: dict[str, int], grow: bool = False) -> tuple[list[list[int]], list[int]]:
    """Feature numbers of each node, and the kind of its edge to the parent. Unknown features are left out."""
    n = len(tree.parent)
    chars, linked, words = [len(t) for t in tree.text], list(tree.linked), [0] * n
    for i in range(n - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
        linked[tree.parent[i]] += linked[i]
    out, kinds = [], []
    for i in range(n):
        tag = tree.tag[i]
        links = 4 * linked[i] // max(1, chars[i])
        if tag == "#text":
            text = tree.text[i]
            size = min(6, len(text).bit_length() // 2)
            names = [f"text in {tree.tag[tree.parent[i]]}", f"size {size}", f"links {links}", f"size {size} links {links}", f"stops {min(3, len(_STOPS.findall(text)))}"]
            if "©" in text:
                names.append("copyright sign")
            kind = "#text"
        else:
            names = [f"tag {tag}", f"all {min(8, chars[i].bit_length() // 2)}", f"all links {links}", f"depth {min(4, tree.depth[i])}"]
            if tree.attrs[i]:
                names += [f"named {w}" for w in set(_NAMES.findall(tree.attrs[i]))]
            kind = tag
        if grow:
            out.append([ids.setdefault(x, len(ids)) for x in names])
            kinds.append(ids.setdefault(f"edge {kind}", len(ids)))
        else:
            out.append([k for x in names if (k := ids.get(x)) is not None])
            kinds.append(ids.get(f"edge {kind}", ids["edge div"]))
    return out, kinds


class Forest:
    """Nodes of many trees by depth, ready for messages."""

    def __init__(self, trees: list[Tree], ids: dict[str, int], grow: bool = False):
        parent, depth, kind, cols, counts, base = [], [], [], [], [], 0
        for t in trees:
            f, k = features(t, ids, grow)
            parent += [p + base if p >= 0 else -1 for p in t.parent]
            depth += t.depth
            kind += k
            for x in f:
                cols += x
                counts.append(len(x))
            base += len(t.parent)
        self.n = base
        self.parent, self.kind = np.array(parent), np.array(kind)
        self.cols, self.row = np.array(cols, np.int64), np.repeat(np.arange(base), counts)
        depth = np.array(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))

    def beliefs(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of content per node, and joint (parent, child) marginals per node, by sum-product.

        unary: score of content per feature; pair: (kinds, 2, 2) scores of (parent, child) states.
        """
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.row, unary[self.cols], self.n)
        edge = pair[self.kind]
        up = np.zeros((self.n, 2))  # message to the parent, by the parent's state
        got = own.copy()  # own score and all children's messages
        for at in reversed(self.levels[1:]):
            up[at] = np.logaddexp(edge[at, :, 0] + got[at, None, 0], edge[at, :, 1] + got[at, None, 1])
            for s in (0, 1):
                np.add.at(got[:, s], self.parent[at], up[at, s])  # not a sum over all nodes: a deep tree has many levels
        down = np.zeros((self.n, 2))
        joint = np.zeros((self.n, 2, 2))
        for at in self.levels[1:]:
            p = self.parent[at]
            rest = got[p] + down[p] - up[at]
            both = rest[:, :, None] + edge[at] + got[at, None, :]
            down[at] = np.logaddexp(rest[:, 0, None] + edge[at, 0], rest[:, 1, None] + edge[at, 1])
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[at] = both / both.sum(axis=(1, 2), keepdims=True)
        z = got + down
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50))), joint


class PageModel:
    """Weights of features and edges."""

    def __init__(self, ids: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.ids, self.unary, self.pair = ids, unary, pair

    def extract(self, pages: list[str]) -> list[str]:
        """The main text of each page: its content blocks in page order, a line each."""
        trees = [parse(p) for p in pages]
        forest = Forest(trees, self.ids)
        content = forest.beliefs(self.unary, self.pair)[0] >= 0.5 if trees else []
        out, at = [], 0
        for t in trees:
            n = len(t.parent)
            out.append("\n".join(x for x, tag, c in zip(t.text, t.tag, content[at : at + n], strict=True) if c and tag == "#text"))
            at += n
        return out


def train(pages: list[str], rounds: int = 150, l2: float = 0.02) -> PageModel:
    """Weights that maximise the likelihood of labelled pages: expected minus observed counts, with Adam's steps.

    An element is content if a content block is inside it.
    """
    trees, ids = [parse(p) for p in pages], {}
    labels = []
    for t in trees:
        own = [MARK in x for x in t.text]
        t.text[:] = [x.replace(MARK, "") for x in t.text]
        for i in range(len(own) - 1, 0, -1):
            own[t.parent[i]] |= own[i]
        labels += own
    forest = Forest(trees, ids, grow=True)
    y = np.array(labels, float)
    inner = forest.parent >= 0
    states = np.zeros((forest.n, 2, 2))
    p, c = y[forest.parent[inner]].astype(int), y[inner].astype(int)
    states[np.flatnonzero(inner), p, c] = 1
    unary, pair = np.zeros(len(ids)), np.zeros((len(ids), 2, 2))
    moments = [np.zeros_like(w) for w in (unary, unary, pair, pair)]
    for step in range(1, rounds + 1):
        belief, joint = forest.beliefs(unary, pair)
        g = np.bincount(forest.cols, (y - belief)[forest.row], len(ids)) - l2 * unary
        gp = np.stack([np.bincount(forest.kind, (states - joint)[:, a, b], len(ids)) for a in (0, 1) for b in (0, 1)], axis=1).reshape(-1, 2, 2) - l2 * pair
        for w, grad, m, v in ((unary, g, moments[0], moments[1]), (pair, gp, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return PageModel(ids, unary, pair)


# Class and id words of page parts.
PARTS = {
    "nav": "nav navbar navigation menu topnav mainnav breadcrumb breadcrumbs pagination pager toc links".split(),
    "header": "header masthead topbar banner logo branding siteheader hero".split(),
    "footer": "footer colophon copyright legal bottom sitefooter credits".split(),
    "aside": "sidebar aside widget related recommended popular trending archive tags tagcloud teaser more".split(),
    "notice": "cookie cookies consent notice gdpr alert notification popup modal overlay privacy message paywall".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsbygoogle commercial".split(),
    "form": "form search subscribe newsletter signup login contact searchbox".split(),
    "comments": "comments comment reply replies discussion respond disqus commentlist reader".split(),
    "share": "share social sharing follow buttons toolbar".split(),
    "content": "content article post entry story main text body page articlebody postcontent entrycontent maincontent".split(),
}


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[str]:
    """Pages in many layouts, their content marked. Words are invented; layouts, names and nesting vary."""
    d = random.Random(seed)
    word = lambda: "".join(d.choice(["an", "er", "ti", "on", "le", "su", "mo", "ka", "ri", "th", "é", "ß", "in"]) for _ in range(d.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(d.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return "".join((say(a, b).capitalize(), d.choice([".", ".", ".", "!", "?", ",", ""])))

    def prose(least: int = 1, most: int = 5) -> str:
        if d.random() < 0.08:  # long stretches without stops, or of one word
            return d.choice([say(30, 200), f"{word()} " * d.randint(20, 300)])
        return " ".join(sentence() for _ in range(d.randint(least, most)))

    def named(part: str) -> str:
        names = d.sample(PARTS[part], k=min(len(PARTS[part]), d.randint(1, 2)))
        return f' {d.choice(["class", "class", "id"])}="{d.choice(["-", " ", "_"]).join(names)}"'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{say(1, 4)}</a></li>' for i in range(k))

    def boiler(part: str) -> str:
        bare = d.random() < 0.35
        if part == "nav":
            tag = d.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{'' if bare and tag == 'nav' else named('nav')}>{'<ul>' + links(d.randint(2, 9)) + '</ul>' if tag != 'ul' else links(d.randint(2, 9))}</{tag}>"
        if part in ("header", "footer"):
            tag = d.choice([part, part, "div"])
            inner = d.choice([f"<p>&copy; {say(1, 4)}</p>", f"&copy; {say(1, 5)}", f"<h1>{say(1, 3)}</h1><p>{say(2, 8)}</p>", f"<ul>{links(3)}</ul>", say(1, 12), f"<p>{sentence(2, 10)}</p>"])
            return f"<{tag}{'' if bare and tag != 'div' else named(part)}>{inner}</{tag}>"
        if part == "aside":
            tag = d.choice(["aside", "aside", "div", "section"])
            inner = d.choice([f"<h3>{say(1, 3)}</h3><ul>{links(d.randint(2, 6))}</ul>", f"<p>{prose(1, 3)}</p>", f"<h2>{say(1, 4)}</h2><p>{prose(1, 3)}</p>", say(2, 20)])
            return f"<{tag}{'' if bare and tag == 'aside' else named('aside')}>{inner}</{tag}>"
        if part in ("notice", "ad"):
            tag = d.choice(["div", "div", "section", "p", "aside"])
            inner = prose(1, 3) if tag == "p" or d.random() < 0.5 else f"<p>{prose(1, 3)}</p>"
            return f"<{tag}{named(part)}>{inner}{'<button>OK</button>' if d.random() < 0.3 else ''}</{tag}>"
        if part == "form":
            extra = f"<p>{sentence(2, 14)}</p>" if d.random() < 0.5 else ""
            return f"<form action='/'{'' if bare else named('form')}>{extra}<label>{say(1, 3)}</label><input name='q'><select><option>{say(1, 2)}<option>{say(1, 2)}</select><button>{say(1, 2)}</button></form>"
        if part == "comments":
            tag = d.choice(["section", "div", "ol", "ul"])
            item = d.choice(["li", "article"]) if tag in ("section", "div") else "li"
            item = "div" if item == "li" and tag in ("section", "div") else item
            own = "".join(f"<{item}{d.choice([' class=comment', named('comments'), ''])}>{d.choice([f'<b>{say(1, 2)}</b>', '', f'<h4>{say(1, 2)}</h4>'])}<p>{prose(1, 3)}</p></{item}>" for _ in range(d.randint(1, 5)))
            head = f"<h3>{say(1, 3)}</h3>" if tag in ("section", "div") and d.random() < 0.6 else ""
            return f"<{tag}{named('comments')}>{head}{own}</{tag}>"
        return f"<div{named('share')}>{links(3)}</div>"

    def block() -> str:
        kind, m = d.random(), MARK
        if kind < 0.06:
            return f"<p>{m}{say(1, 4)}</p>"
        if kind < 0.6:
            return f"<p>{m}{prose()}</p>"
        if kind < 0.66:
            return f"<p><b>{m}{prose()}<br>"
        if kind < 0.72:
            return f"<h{(k := d.randint(2, 4))}>{m}{say(1, 8)}</h{k}>"
        if kind < 0.78:
            return f"<{(k := d.choice(['ul', 'ol']))}>{''.join(f'<li>{m}{sentence(2, 14)}</li>' for _ in range(d.randint(1, 5)))}</{k}>"
        if kind < 0.82:
            return f"<blockquote><p>{m}{prose(1, 2)}</p></blockquote>"
        if kind < 0.86:
            return f"<p>{m}{sentence()} <a href='/x'>{say(1, 3)}</a> {sentence()}</p>"
        if kind < 0.89:
            return f"<table>{''.join(f'<tr><td>{m}{say(1, 4)}</td><td>{m}{say(1, 4)}</td></tr>' for _ in range(d.randint(1, 4)))}</table>"
        if kind < 0.92:
            return f"<figure><img src='x'><figcaption>{m}{sentence(2, 10)}</figcaption></figure>"
        if kind < 0.95:
            return f"<pre>{m}{say(2, 12)}</pre>"
        return f"<div>{m}{prose(1, 3)}</div>"

    def page() -> str:
        blocks = [block() for _ in range(d.randint(1, 9) if d.random() < 0.85 else 0)]
        if d.random() < 0.75:
            blocks.insert(0, f"<h1>{MARK}{say(1, 9)}</h1>")
        for _ in range(d.choice([0, 0, 0, 1, 2])):
            blocks.insert(d.randint(0, len(blocks)), boiler(d.choice(["ad", "ad", "aside", "share", "form", "notice", "comments", "nav"])))
        inner = "".join(blocks)
        kind = d.random()
        if kind < 0.45:
            main = f"<article{named('content') if d.random() < 0.3 else ''}>{inner}</article>"
        elif kind < 0.6:
            main = f"<main{named('content') if d.random() < 0.3 else ''}>{inner}</main>"
        elif kind < 0.9:
            tag = d.choice(["div", "div", "section", "td"])
            main = f"<{tag}{named('content')}>{inner}</{tag}>"
            main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
        else:
            main = inner
        if d.random() < 0.3:
            main = f"<{(k := d.choice(['div', 'main', 'section']))}{d.choice(['', named('content'), ' class=container', ' id=wrapper'])}>{main}</{k}>"
        before = [boiler(p) for p in ("notice", "header", "nav", "ad", "form", "aside") if d.random() < 0.4]
        after = [boiler(p) for p in ("share", "comments", "aside", "ad", "notice", "form", "footer") if d.random() < 0.4]
        d.shuffle(before)
        body = "".join([*before, main, *after])
        if d.random() < 0.2:
            body = f"<div{d.choice([' id=wrapper', ' class=container', ''])}>{body}</div>"
        return d.choice([f"<!DOCTYPE html><html><head><title>{say(1, 4)}</title><style>p{{}}</style></head><body>{body}</body></html>"] * 4 + [f"<body>{body}", body])

    bare = [f"<p>{MARK}{prose()}</p>", f"{MARK}{prose()}", f"<html><body><h1>{MARK}{say(1, 5)}</h1><p>{MARK}{prose()}</p></body></html>"]
    return [*(page() for _ in range(n)), *bare * max(1, n // 60)]


@lru_cache(1)
def default_model() -> PageModel:
    return train(labelled_pages())


def extract_text(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null or empty html has an empty text, a broken one what `dom.parse` reads in it; a page of any length or
    depth is read whole, in time that grows with it. Repeated rows give repeated results; other columns are not
    read; an empty table gives an empty result. Pages are judged by themselves, so there is no shuffle.
    """
    model = model or default_model()  # trained once on the driver; some hundred weights go along with the tasks

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = model.extract([h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
