"""HTML main-text extraction by gradient-boosted trees over DOM nodes.

Every block-level element is a node with features of its subtree (text, link
and tag density, punctuation, controls), its tag and attribute tokens, its
ancestors', its depth and its siblings. Boosted trees give the odds that a node
belongs to the article; a Viterbi pass over the page's tree then chooses
outside, inside or cut out for all nodes together, so that nothing below a
rejected ancestor comes back and an article's inside holds together.

The table has no labels. The trees are trained on pages that a seeded
generator lays out: articles among menus, headers, footers, sidebars, notices,
adverts, forms and comments, in the tags and class names that sites give them.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vintage.llm import common

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript object ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = frozenset("input select textarea button label option".split())
#: A start tag of the key ends an open element of the values, up to the nearest of SCOPES.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table html body article section div main aside nav header footer form td th".split())
#: Elements whose content is code, a control's or not shown, up to the end tag of the same name. Without one, or closed by a slash, those that aren't CODE are like any other element.
RAW_END = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in "script style iframe textarea select title template".split()}
CODE = ("script", "style")
#: Elements that a page may have before its body.
HEAD = frozenset("base link meta noscript script style template title".split())
DRAWN = ("svg", "math")
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that a browser doesn't show have this attribute token.
UNSHOWN = "displaynone"
HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w=-])|(?<![\w-])(?:hidden\s*=|aria-hidden\s*=\s*["']?true)|style\s*=\s*(?:"[^"]*|'[^']*|)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PARAGRAPH_ENDS = frozenset(BLOCKS - {"html", "body", "noscript", "object"})


@dataclass
class Page:
    """Block-level elements in page order, with the texts they hold directly."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)  # attribute tokens
    chars: list[int] = field(default_factory=list)  # of own text
    linked: list[int] = field(default_factory=list)  # of those, inside links
    signs: list[int] = field(default_factory=list)  # sentence punctuation in own text
    tags: list[int] = field(default_factory=list)  # elements, the node and inline ones in it
    controls: list[int] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)  # (node, text) of each block
    label: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, words: tuple[str, ...], label: int) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.words, words), (self.chars, 0), (self.linked, 0), (self.signs, 0), (self.tags, 1), (self.controls, 0), (self.label, label)):
            column.append(value)
        return len(self.tag) - 1


def _attributes(text: str) -> tuple[tuple[str, ...], int | None]:
    words, label = [], None
    for name, *values in ATTRIBUTE.findall(text):
        value = next((v for v in values if v), "")
        if name.lower() == "data-y":
            label = {"0": 0, "1": 1}.get(value, label)
        else:
            words += [w.lower() for w in ATTRIBUTE_WORD.findall(value)]
    return tuple(words), label


class Open:
    """The open elements, each with the block node it is in, and where those of a name are."""

    def __init__(self, root: int):
        self.stack: list[tuple[str, int]] = [("html", root)]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.outer: list[int] = [0]  # scopes that aren't table cells

    def push(self, name: str, node: int) -> None:
        k = len(self.stack)
        self.places.setdefault(name, []).append(k)
        if name in SCOPES:
            self.scopes.append(k)
            if name not in ("td", "th"):
                self.outer.append(k)
        self.stack.append((name, node))

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.places[name].pop()
        if name in SCOPES:
            self.scopes.pop()
            if name not in ("td", "th"):
                self.outer.pop()
        return name

    def last(self, name: str) -> int:
        """The place of the innermost element of a name, 0 if none is open."""
        own = self.places.get(name)
        return own[-1] if own else 0

    def first_of(self, names: tuple[str, ...]) -> int:
        """The place of the outermost element of some names within the innermost scope that isn't a cell, 0 if none is."""
        found = []
        for name in names:
            own = self.places.get(name, ())
            at = bisect.bisect_right(own, self.outer[-1])
            found += own[at : at + 1]
        return min(found, default=0)


def parse(source: str, labels: bool = True) -> Page:
    """The block-level tree of a page, however broken its markup; with labels, those that training pages carry."""
    page = Page()
    root = page.add("html", -1, (), 0)
    opened = Open(root)
    stack = opened.stack
    links, drawn, pieces, at = 0, 0, [], 0
    body, unclosed = -1, set()

    def open_body() -> None:
        """What isn't in another element is in the body, whether or not a tag says so."""
        nonlocal body
        if len(stack) == 1:
            close()
            body = page.add("body", root, (), page.label[root]) if body < 0 else body
            opened.push("body", body)

    def text(piece: str) -> None:
        if piece:
            if len(stack) == 1 and not piece.isspace():
                open_body()
            pieces.append((piece, links > 0))

    def close() -> None:
        """The block of text that ends here belongs to the innermost node."""
        if not pieces:
            return
        node = stack[-1][1]
        whole = "".join(p for p, _ in pieces)
        whole = " ".join((html.unescape(whole) if "&" in whole else whole).split())
        if whole:
            page.texts.append((node, whole))
            page.chars[node] += len(whole)
            page.linked[node] += min(len(whole), sum(len(p) for p, linked in pieces if linked))
            page.signs[node] += whole.count(".") + whole.count(",")
        pieces.clear()

    def pop_to(k: int) -> None:
        nonlocal links, drawn
        while len(stack) > k:
            if stack[-1][0] in BLOCKS:
                close()
            name = opened.pop()
            links -= name == "a"
            drawn -= name in DRAWN

    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ends, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            place = opened.last(name)
            if name == "p" and not place:
                close()
            # An end tag reaches beyond a scope for a block only.
            if place and (name in BLOCKS or place > opened.scopes[-1]):
                pop_to(place)
            continue
        if name in ("html", "head") or name == "body" and body >= 0:
            continue
        if name not in HEAD and name != "body":
            open_body()
        if name in RAW_END and name not in unclosed and (name in CODE or not attributes.endswith("/")):
            if end := RAW_END[name].search(source, at):
                at = end.end()
            elif name in CODE:
                at = len(source)
            else:
                unclosed.add(name)
            if name not in unclosed:
                page.tags[stack[-1][1]] += not drawn
                page.controls[stack[-1][1]] += name in CONTROLS
                continue
        if name == "br":
            text(" ")
        if name in PARAGRAPH_ENDS and opened.last("p") > opened.scopes[-1]:
            pop_to(opened.last("p"))
        if name in IMPLIED and (place := opened.first_of(IMPLIED[name])):
            pop_to(place)
        node = stack[-1][1]
        if name in BLOCKS:
            close()
            words, label = _attributes(attributes) if "=" in attributes else ((), None)
            if attributes and HIDDEN.search(attributes):
                words += (UNSHOWN,)
            node = page.add(name, node, words, page.label[node] if label is None or not labels else label)
            if name == "body":
                body = node
        else:
            page.tags[node] += not drawn  # a drawing or formula counts as one
            page.controls[node] += name in CONTROLS
        if name not in VOID and not attributes.endswith("/"):
            opened.push(name, node)
            links += name == "a"
            drawn += name in DRAWN
    text(source[at:])
    pop_to(1)
    close()
    return page


FEATURES = 22
#: Tags of parts of a page.
REGIONS = frozenset("article aside footer form header main nav section".split())


def features(page: Page, tag_odds: dict[str, float], word_odds: dict[str, float]) -> np.ndarray:
    n = len(page.tag)
    out = np.zeros((n, FEATURES))
    chars, linked, signs, tags, controls = (list(x) for x in (page.chars, page.linked, page.signs, page.tags, page.controls))
    blocks, children = [int(c > 0) for c in page.chars], [0] * n
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        chars[up] += chars[k]
        linked[up] += linked[k]
        signs[up] += signs[k]
        tags[up] += tags[k]
        controls[up] += controls[k]
        blocks[up] += blocks[k]
        children[up] += 1
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        key = (page.parent[k], page.tag[k])
        same[key] = same.get(key, 0) + 1
    tag = [tag_odds.get(t, 0.0) for t in page.tag]
    word = [max(-4.0, min(4.0, sum(word_odds.get(w, 0.0) for w in ws))) for ws in page.words]
    seen, depth = [0] * n, [0] * n
    worst_tag, best_tag, worst_word, best_word, last_tag, last_word = ([0.0] * n for _ in range(6))
    for k in range(n):
        up, total = page.parent[k], max(chars[k], 1)
        # The innermost region around that tells by its tag, or by its name.
        last_tag[k] = tag[k] if page.tag[k] in REGIONS else last_tag[up] if up >= 0 else 0.0
        last_word[k] = word[k] or (last_word[up] if up >= 0 else 0.0)
        if up >= 0:
            depth[k] = depth[up] + 1
            seen[up] += 1
            worst_tag[k], best_tag[k] = min(worst_tag[up], tag[up]), max(best_tag[up], tag[up])
            worst_word[k], best_word[k] = min(worst_word[up], word[up]), max(best_word[up], word[up])
            place, brothers, alike, above = seen[up] / children[up], children[up], same[up, page.tag[k]] / children[up], linked[up] / max(chars[up], 1)
        else:
            place, brothers, alike, above = 0.0, 1, 1.0, 0.0
        out[k] = (
            tag[k], word[k], worst_tag[k], best_tag[k], worst_word[k], best_word[k], depth[k], math.log1p(chars[k]), linked[k] / total, chars[k] / tags[k],
            math.log1p(brothers), place, alike, math.log1p(page.chars[k]), chars[k] / max(blocks[k], 1), signs[k] / total, controls[k], chars[k] / max(chars[0], 1), above, children[k], last_tag[k], last_word[k],
        )
    return out


class Trees:
    """Boosted trees of one depth on binned features, for logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base, self.trees = 0.0, []

    def fit(self, rows: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in rows.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            which, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                own = node - first
                best = np.zeros(width)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = own * self.bins + binned[:, f]
                    g = np.bincount(key, slope, width * self.bins).reshape(width, -1).cumsum(1)
                    h = np.bincount(key, curve, width * self.bins).reshape(width, -1).cumsum(1)
                    value = lambda a, b: a * a / (b + self.ridge)
                    gain = value(g, h) + value(g[:, -1:] - g, h[:, -1:] - h) - value(g[:, -1:], h[:, -1:])
                    at = gain[:, : len(e)].argmax(1)
                    for k in np.flatnonzero(gain[np.arange(width), at] > best + 1e-6):
                        best[k], which[first + k], cut[first + k] = gain[k, at[k]], f, e[at[k]]
                node = 2 * node + 1 + (rows[np.arange(len(y)), which[node]] > cut[node])
            leaf = node - inner
            g, h = np.bincount(leaf, slope, 1 << self.depth), np.bincount(leaf, curve, 1 << self.depth)
            values = self.rate * g / (h + self.ridge)
            self.trees.append((which, cut, values))
            score += values[leaf]
        return self

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, at = np.full(len(rows), self.base), np.arange(len(rows))
        for which, cut, values in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, which[node]] > cut[node])
            out += values[node - len(which)]
        return out


OUTSIDE, INSIDE, CUT = range(3)


def decode(parent: list[int], margins: np.ndarray) -> np.ndarray:
    """The likeliest states of a page's nodes: a child is outside or inside below outside, inside or cut below inside, cut below cut."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    best = [[float(no[k]), float(yes[k]), float(no[k])] for k in range(n)]
    for k in range(n - 1, 0, -1):
        out, inside, cut = best[k]
        up = best[parent[k]]
        up[OUTSIDE] += max(out, inside)
        up[INSIDE] += max(inside, cut)
        up[CUT] += cut
    states = np.zeros(n, np.int8)
    for k in range(1, n):
        out, inside, cut = best[k]
        above = states[parent[k]]
        states[k] = CUT if above == CUT else (INSIDE if inside >= cut else CUT) if above == INSIDE else (INSIDE if inside > out else OUTSIDE)
    return states


@dataclass
class Model:
    tag_odds: dict[str, float]
    word_odds: dict[str, float]
    trees: Trees

    def texts(self, sources: list[str | None]) -> list[str]:
        """The article of each page: its blocks in page order, a line each."""
        pages = [parse(s or "", labels=False) for s in sources]
        margins = self.trees.margins(np.concatenate([features(p, self.tag_odds, self.word_odds) for p in pages]))
        out, at = [], 0
        for p in pages:
            n = len(p.tag)
            states = decode(p.parent, margins[at : at + n])
            at += n
            out.append("\n".join(t for node, t in p.texts if states[node] == INSIDE))
        return out


# Names that sites give the parts of a page.
ARTICLE_NAMES = "article content main post entry story body text blog page news single".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb topnav tabs links".split(),
    "header": "header masthead topbar banner branding logo site head".split(),
    "footer": "footer foot bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget related rail trending recommended popular secondary".split(),
    "notice": "cookie consent notice alert gdpr popup modal newsletter subscribe paywall message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adslot teaser".split(),
    "form": "form login search signup contact feedback".split(),
    "comments": "comment comments discussion replies reply respond reader disqus thread".split(),
    "share": "share social sharing buttons tags meta byline author tools".split(),
}
OTHER_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ul", "ol"], "share": ["div", "ul", "footer"]}


def training_page(draw: random.Random) -> str:
    """A page whose elements carry their label: data-y 1 in the article, 0 elsewhere."""
    word = lambda: "".join(draw.choice("abcdeilnorstu") for _ in range(draw.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(max(1, n))).capitalize() + draw.choice([".", ".", ",", ""])
    prose = lambda: " ".join(sentence(draw.randint(3, 18)) for _ in range(draw.choice([1, 1, 2, 4, 8])))

    def named(names: list[str]) -> str:
        picked = "-".join(draw.sample(names, draw.choice([1, 1, 2])))
        return draw.choice([f' class="{picked}"', f' id="{picked}"', f' class="{picked} {word()}"', f' class="{word()}-{picked}"'])

    def item(kind: str) -> str:
        if kind == "nav" or draw.random() < 0.25:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{sentence(draw.randint(1, 3))}</a></li>' for _ in range(draw.randint(2, 9))) + "</ul>"
        if kind == "header" and draw.random() < 0.7:
            return draw.choice([f"<h1>{sentence(draw.randint(1, 4))}</h1>", f'<h1><a href="/">{sentence(2)}</a></h1>', f'<a href="/">{sentence(2)}</a>', f"<p>{sentence(draw.randint(2, 6))}</p>", f"<h2>{sentence(2)}</h2><p>{sentence(4)}</p>"])
        if kind == "notice" and draw.random() < 0.5:
            return f"<p>{sentence(draw.randint(3, 12))}</p><button>{word()}</button>"
        if kind in ("aside", "comments", "footer") and draw.random() < 0.3:
            return f"<{(h := draw.choice(['h2', 'h3', 'h4']))}>{sentence(draw.randint(1, 3))}</{h}>" + item(kind)
        if kind == "form":
            return f"<p>{sentence(4)}</p><label>{word()}</label><input name=q><button>{word()}</button>"
        if kind == "comments":
            return "".join(draw.choice(["<div{}><p>{}</p></div>", "<p{}>{}</p>", "<li{}>{}</li>"]).format(draw.choice(["", named(OTHER_NAMES[kind])]), prose()) for _ in range(draw.randint(1, 5)))
        return draw.choice([f"<p>{prose()}</p>", prose(), f"<h3>{sentence(3)}</h3><p>{prose()}</p>", f'<a href="/{word()}">{sentence(4)}</a>'])

    def other(kind: str) -> str:
        tag = draw.choice(OTHER_TAGS[kind])
        telling = tag in ("nav", "header", "footer", "aside", "form")
        name = named(OTHER_NAMES[kind]) if not telling or draw.random() < 0.5 else ""
        return f'<{tag}{name} data-y="0">' + "".join(item(kind) for _ in range(draw.choice([1, 1, 2]))) + f"</{tag}>"

    def passage() -> str:
        kind = draw.random()
        if kind < 0.08:
            return "<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(draw.randint(2, 5))) + "</ul>"
        if kind < 0.14:
            return f"<h2>{sentence(draw.randint(2, 6))}</h2>"
        if kind < 0.18:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind < 0.22:
            return f"<table><tr><td>{sentence(2)}</td><td>{sentence(2)}</td></tr></table>"
        if kind < 0.25:
            return f"<pre>{prose()}</pre>"
        if kind < 0.29:
            return f"<section><h3>{sentence(3)}</h3><p>{prose()}</p></section>"
        if kind < 0.32:
            return f"<div><p>{prose()}</p></div>"
        return f"<p>{draw.choice(['', '<b>'])}{prose()}{draw.choice(['</p>', '</p>', '<br>'])}"

    inner = []
    for _ in range(draw.choice([1, 2, 3, 5, 8, 12])):
        inner.append(passage())
        if draw.random() < 0.12:
            inner.append(other(draw.choice(["ad", "share", "aside", "notice", "form"])))
    title = draw.choice(["", f"<h1>{sentence(draw.randint(2, 8))}</h1>", f"<h1>{sentence(draw.randint(2, 8))}</h1>"])
    tail = [other(k) for k in ("share", "comments", "aside") if draw.random() < 0.2]
    style = draw.random()
    plain_name = lambda: draw.choice(["", f' id="{word()}{draw.randint(0, 99)}"', f' class="{word()}"', f' class="{word()} {word()}-{draw.randint(0, 9)}"'])
    bare = style >= 0.88
    if style >= 0.8 and draw.random() < 0.4:
        inner, title, tail = [f"<p>{prose()}</p>"], draw.choice(["", title]), []
    if draw.random() < 0.08:
        tag = draw.choice(["div", "p", "section"])
        hidden = draw.choice(["hidden", 'style="display:none"', 'style="color:red;display: none"', 'aria-hidden="true"'])
        inner.insert(draw.randint(0, len(inner)), f'<{tag} {hidden} data-y="0">{prose()}</{tag}>')
    if style < 0.4:
        middle = f'<article{draw.choice(["", named(ARTICLE_NAMES)])} data-y="1">{title}{"".join(inner + tail)}</article>'
    elif style < 0.55:
        middle = f'<main data-y="1">{title}{"".join(inner + tail)}</main>'
    elif style < 0.78:
        middle = f'<div{named(ARTICLE_NAMES)} data-y="1">{title}{"".join(inner + tail)}</div>'
    elif not bare:
        middle = f'<div{plain_name()} data-y="1">{title}{"".join(inner + tail)}</div>'
    else:
        middle = "".join(p if "data-y" in p.partition(">")[0] else re.sub(r"^<(\w+)", r'<\1 data-y="1"', p) for p in [title, *inner] if p)
    if draw.random() < 0.4 and not bare:
        middle = draw.choice(["<main>{}</main>", "<div{}>{{}}</div>".format(draw.choice(["", ' class="wrapper"', ' class="container"', ' id="wrap"'])), "<section>{}</section>"]).format(middle)
    before = [other(k) for k in ("header", "nav", "notice", "ad", "form", "nav") if draw.random() < 0.4]
    after = [other(k) for k in ("aside", "comments", "ad", "form", "notice", "footer", "share") if draw.random() < 0.35]
    draw.shuffle(before)
    if bare and draw.random() < 0.5:
        before, after = [], []
    if not bare and draw.random() < 0.1:
        # A table lays the page out: a row or cells of menus beside the article's cell.
        cell = lambda parts: f'<td data-y="0">{item("nav") if not parts or draw.random() < 0.5 else "".join(parts)}</td>'
        story = draw.choice([f'<td data-y="0">{middle}</td>', f'<td data-y="1">{title}{"".join(inner + tail)}</td>'])
        row = f'<tr>{cell(before)}{story}{cell(after) if after else ""}</tr>'
        return f'<html><body><table data-y="0">{row}</table></body></html>'
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 1600, seed: int = 5) -> Model:
    """The model trained on so many generated pages, the same for the same seed."""
    draw = random.Random(seed)
    parsed = [parse(training_page(draw)) for _ in range(pages)]

    def odds(units: Iterator[tuple[object, int]]) -> dict:
        seen: dict = {}
        for unit, label in units:
            seen.setdefault(unit, [0, 0])[label] += 1
        return {u: math.log((b + 1) / (a + 1)) for u, (a, b) in seen.items() if a + b >= 20}

    # A name or tag tells by the nodes at which a region begins.
    begins = [[k for k in range(1, len(p.tag)) if p.words[k] or p.label[k] != p.label[p.parent[k]] or p.tag[k] not in ("p", "div", "li", "ul")] for p in parsed]
    tag_odds = odds((p.tag[k], p.label[k]) for p, ks in zip(parsed, begins) for k in ks if p.tag[k] != "body")
    word_odds = odds((w, p.label[k]) for p, ks in zip(parsed, begins) for k in ks for w in set(p.words[k]))
    rows = np.concatenate([features(p, tag_odds, word_odds) for p in parsed])
    return Model(tag_odds, word_odds, Trees().fit(rows, np.concatenate([p.label for p in parsed]).astype(float)))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages (page_id, url, html).

    Null or empty html, and pages without an article, give the empty text.
    Repeated ids keep their rows; extra columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "html", 4 << 20):
            texts = sent.value.texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
