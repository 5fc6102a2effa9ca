"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page becomes a tree of its block elements with runs of inline text as leaves. Every node has one
of three states: content, boilerplate, or mixed (both lie below it; leaves are never mixed). The
model holds a prior for the root, a potential between each parent's and child's states, and
observation potentials for tags, words of class and id attributes, lengths and link shares. Sum-
product messages go up the tree and down again and give each leaf's exact marginal; leaves more
likely content than not make the text. The potentials are counted from labelled pages.

Comments, script, style, title, iframe and template are no text of the page, nor is what a noscript
element with an end holds for browsers without scripts. What svg and math hold
belongs to the run of text around them; a block element ends them, as in the standard.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches

CONTENT, BOILER, MIXED = 0, 1, 2
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd tr td th".split())
OWN_SCOPE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FOREIGN = frozenset(("svg", "math"))
BREAKS_OUT = CLOSE_P | {"body", "head"}
P_SCOPE = frozenset("td th table caption button".split())

RAW = frozenset("script style template iframe title noscript".split())
_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: Attributes up to the tag's end; possessive, so a tag without an end is read once.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARK, _RAW_END = re.compile("[>\"']"), re.compile(r"\s*+>")
_LOWER = {c: c + 32 for c in range(65, 91)}
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _TagEnds:
    """Whether a tag that is open at a place has an end: found once for all places of a page, from its last mark to its first."""

    def __init__(self, page: str) -> None:
        self.marks = [m.start() for m in _MARK.finditer(page)]
        self.ends = [False] * (len(self.marks) + 1)
        following: dict[str, int] = {}  # the next mark of each kind
        for i in range(len(self.marks) - 1, -1, -1):
            mark = page[self.marks[i]]
            self.ends[i] = mark == ">" or (mark in following and self.ends[following[mark] + 1])
            following[mark] = i

    def has(self, at: int) -> bool:
        return self.ends[bisect_left(self.marks, at)]


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, tag, attributes) of every tag, and of comments and elements of raw text with no tag; in linear time.

    A tag without an end is text, and what follows its name is looked at again.
    """
    at, last, ends = 0, page.rfind(">"), None
    lowered: str | None = None
    last_noscript = -1
    while m := _OPENS.search(page, at):
        start, at = m.span()
        if page.startswith("<!--", start):
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        if start > last:  # no tag ends any more; a comment may still open
            if (start := page.find("<!--", at)) >= 0:
                yield start, len(page), False, None, ""
            return
        if m.group(2) is None:
            at = page.find(">", at) + 1
            yield start, at, False, None, ""
            continue
        if ends is not None and not ends.has(at):
            continue
        rest = _REST.match(page, at)
        if rest is None:
            ends = ends or _TagEnds(page)
            continue
        at, tag = rest.end(), m.group(2).lower()
        if tag in RAW and not m.group(1):
            if lowered is None:
                lowered = page.translate(_LOWER)
                last_noscript = lowered.rfind("</noscript")
            if tag == "noscript" and at > last_noscript:  # without an end it hides nothing
                yield start, at, False, None, ""
                continue
            end = lowered.find(f"</{tag}", at)
            while end >= 0 and not (close := _RAW_END.match(page, end + 2 + len(tag))):
                end = lowered.find(f"</{tag}", end + 1)
            at = close.end() if end >= 0 else len(page)
            yield start, at, False, None, ""
            continue
        yield start, at, bool(m.group(1)), tag, rest.group(1)


@dataclass
class Tree:
    """Nodes in page order, parents before children; a leaf has a text, an element a name (tag and attribute words)."""

    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, ...] | None] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, parent: int, name: tuple[str, ...] | None, text: str | None = None, link: int = 0) -> int:
        self.parents.append(parent)
        self.names.append(name)
        self.texts.append(text)
        self.links.append(link)
        return len(self.parents) - 1


_NAMES: dict[str, tuple[str, ...]] = {}


def node_name(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, then the words of its class, id, role, itemprop and aria-label."""
    if not attributes:
        return (tag,)
    key = tag + attributes
    if key not in _NAMES:
        if len(_NAMES) > 50_000:
            _NAMES.clear()
        parts = [p.lower() for m in _ATTR.finditer(attributes) for p in _PART.findall(m.group(1) or m.group(2) or m.group(3) or "")]
        _NAMES[key] = (tag, *dict.fromkeys(p for p in parts if len(p) > 1))
    return _NAMES[key]


def parse(page: str | None) -> Tree:
    """The block tree of a whole page; missing end tags are supplied as the standard does for blocks."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("html", tree.add(-1, ("html",)))]  # an inline element repeats its block's node
    run: list[str] = []
    opened: Counter[str] = Counter()  # open elements by name, so that none is looked for in vain
    linked, in_link, foreign = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                tree.add(stack[-1][1], None, text, min(linked, len(text)))
            run.clear()
            linked = 0

    def inline(depth: int) -> bool:
        return stack[depth][1] == stack[depth - 1][1]

    def pop_to(depth: int) -> None:
        nonlocal in_link, foreign
        if not all(inline(d) for d in range(depth, len(stack))):
            flush()
        opened.subtract(t for t, _ in stack[depth:])
        in_link -= sum(t == "a" for t, _ in stack[depth:])
        foreign -= sum(t in FOREIGN for t, _ in stack[depth:])
        del stack[depth:]

    def words(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if in_link:
                linked += len(text.strip())

    at, page = 0, page or ""
    for start, end, closing, tag, attributes in tokens(page):
        words(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if (foreign or tag in INLINE) and not inline(depth):
                    break
            continue
        if tag == "br":
            run.append(" ")
            continue
        if foreign and tag in BREAKS_OUT:
            pop_to(next(d for d, (t, _) in enumerate(stack) if t in FOREIGN))
        if tag in INLINE or foreign or tag in FOREIGN:
            if foreign and tag in ("text", "desc"):
                run.append(" ")
            if tag not in VOID and not ((foreign or tag in FOREIGN) and attributes.endswith("/")):
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
                in_link += tag == "a"
                foreign += tag in FOREIGN
            continue
        if tag in CLOSE_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in P_SCOPE:
                    break
        if tag in OWN_SCOPE:
            same, within = OWN_SCOPE[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in same) else ():
                if stack[depth][0] in same:
                    pop_to(depth)
                    break
                if stack[depth][0] in within:
                    break
        flush()
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, tree.add(stack[-1][1], node_name(tag, attributes))))
            opened[tag] += 1
    words(page[at:])
    flush()
    return tree


#: Upper ends of the bins of a node's text length, link share and number of leaves below.
LENGTHS, SHARES, LEAVES = np.array([8, 20, 40, 80, 160, 400, 1200]), np.array([0.001, 0.3, 0.7]), np.array([1, 2, 4, 8, 16])


#: Weight of these for elements: what an element holds is told by its leaves already.
INNER = 0.3


@dataclass
class Forest:
    """Many pages' trees as arrays, without elements that hold no text."""

    page: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    leaf: np.ndarray
    names: list[tuple[str, ...] | None]
    texts: list[str | None]
    bins: np.ndarray  # length, link share, leaves below, ends like a sentence


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """Places of each depth, from the roots down."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def forest(trees: Iterable[Tree]) -> Forest:
    page, parent, names, texts, links, depth = [], [], [], [], [], []
    for k, t in enumerate(trees):
        kept = [x is not None for x in t.texts]
        for i in range(len(kept) - 1, 0, -1):
            if kept[i]:
                kept[t.parents[i]] = True
        new: dict[int, int] = {}
        for i, keep in enumerate(kept):
            if keep:
                new[i] = len(parent)
                up = new.get(t.parents[i], -1)
                parent.append(up)
                depth.append(depth[up] + 1 if up >= 0 else 0)
                page.append(k)
                names.append(t.names[i])
                texts.append(t.texts[i])
                links.append(t.links[i])
    par, dep = np.array(parent, np.int64), np.array(depth, np.int64)
    leaf = np.array([t is not None for t in texts], bool)
    length = np.array([len(t) if t else 0 for t in texts], np.float64)
    linked, below = np.array(links, np.float64), leaf.astype(np.float64)
    for at in levels_of(dep)[:0:-1]:
        for sums in (length, linked, below):
            np.add.at(sums, par[at], sums[at])
    ends = np.array([bool(t) and t[-1] in ".!?…:\"'»”)" for t in texts], np.int64)
    bins = np.column_stack([np.searchsorted(LENGTHS, length), np.searchsorted(SHARES, linked / np.maximum(length, 1)), np.searchsorted(LEAVES, below), ends]).astype(np.int64).reshape(len(texts), 4)
    return Forest(np.array(page, np.int64), par, dep, leaf, names, texts, bins)


@dataclass
class Potentials:
    """Log potentials: root state; [leaf][parent state][child state]; words and bins by kind of node and state."""

    root: np.ndarray
    edges: np.ndarray
    words: dict[str, np.ndarray]
    tags: dict[str, np.ndarray]
    bins: list[np.ndarray]

    def observed(self, f: Forest) -> np.ndarray:
        known: dict[tuple[str, ...], np.ndarray] = {}
        out = np.zeros((len(f.leaf), 3))
        for i, name in enumerate(f.names):
            if name is not None:
                if name not in known:
                    known[name] = self.tags.get(name[0], np.zeros(3)) + sum((self.words[w] for w in name[1:] if w in self.words), np.zeros(3))
                out[i] = known[name]
        kind = f.leaf.astype(np.int64)
        for k, table in enumerate(self.bins):
            out += table[kind, f.bins[:, k]] * np.where(f.leaf, 1.0, INNER)[:, None]
        out[f.leaf, MIXED] = -1e9
        return out

    def marginals(self, f: Forest) -> np.ndarray:
        """P(content) of every node: messages from the leaves to the roots, then back."""
        n = len(f.leaf)
        belief = self.observed(f)
        up = np.zeros((n, 3))  # message of each node to its parent
        pair = self.edges[f.leaf.astype(np.int64)]
        levels = levels_of(f.depth)
        for at in levels[:0:-1]:
            up[at] = _logsum(pair[at] + belief[at][:, None, :], 2)
            np.add.at(belief, f.parent[at], up[at])
        if levels:
            belief[levels[0]] += self.root
        for at in levels[1:]:
            rest = belief[f.parent[at]] - up[at]
            belief[at] += _logsum(pair[at] + rest[:, :, None], 1)
        return np.exp(belief[:, CONTENT] - _logsum(belief, 1)) if n else np.zeros(0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit(pages: Iterable[str], content: Iterable[set[str]]) -> Potentials:
    """Count potentials from pages whose content blocks' texts are known."""
    f = forest(map(parse, pages))
    good = list(content)
    state = np.array([(CONTENT if t in good[p] else BOILER) if t is not None else -1 for p, t in zip(f.page, f.texts, strict=True)], np.int64)
    has = np.zeros((len(state), 2), bool)
    has[state == CONTENT, 0] = has[state == BOILER, 1] = True
    for at in levels_of(f.depth)[:0:-1]:
        np.logical_or.at(has, f.parent[at], has[at])
    state = np.where(has.all(1), MIXED, np.where(has[:, 0], CONTENT, BOILER))
    kind = f.leaf.astype(np.int64)
    inner = f.parent >= 0
    root = np.bincount(state[~inner], minlength=3) + 0.5
    edges = np.full((2, 3, 3), 0.2)
    np.add.at(edges, (kind[inner], state[f.parent[inner]], state[inner]), 1)
    totals = np.bincount(state[~f.leaf], minlength=3)
    counts: dict[bool, dict[str, np.ndarray]] = {True: {}, False: {}}
    for name, s in zip(f.names, state, strict=True):
        for k, word in enumerate(name or ()):
            counts[k == 0].setdefault(word, np.zeros(3))[s] += 1
    tables = []
    for k, size in enumerate((len(LENGTHS) + 1, len(SHARES) + 1, len(LEAVES) + 1, 2)):
        table = np.full((2, size, 3), 1.0)
        np.add.at(table, (kind, f.bins[:, k], state), 1)
        tables.append(np.log(table / table.sum(1, keepdims=True)))
    rate = lambda c: np.log((c + 0.3) / (totals + 1.0))
    return Potentials(np.log(root / root.sum()), np.log(edges / edges.sum(2, keepdims=True)), {w: rate(c) - rate(c).mean() for w, c in counts[False].items()}, {w: rate(c) - rate(c).mean() for w, c in counts[True].items()}, tables)


def labelled_pages(number: int = 600, seed: int = 11) -> tuple[list[str], list[set[str]]]:
    """Pages of many layouts, written by rule, with the texts of their content blocks: the training set."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    syllables = "an be co da er fi ga ho in ju ka lo me no or pa qui ra se ti un ve wi xa yo zu".split()

    def word() -> str:
        return "".join(pick(*syllables) for _ in range(int(rng.integers(1, 5))))

    def prose(least: int, most: int) -> str:
        out: list[str] = []
        size = int(rng.integers(least, most + 1))
        while len(out) < size:
            part = [word() for _ in range(int(rng.integers(3, 12)))]
            out += [part[0].capitalize(), *part[1:-1], part[-1] + pick(".", ".", ".", "!", "?")]
        return " ".join(out[: max(1, size)])

    def link() -> str:
        return f'<a href="/{word()}">{" ".join(word() for _ in range(int(rng.integers(1, 4))))}</a>'

    def named(tags: list[str], words: list[str], inside: str, plain: float = 0.25) -> str:
        tag = pick(*tags)
        mark = "" if rng.random() < plain else f' {pick("class", "class", "id", "role")}="{pick(*words)}{pick("", "", "-" + word(), " " + pick(*words))}"'
        return f"<{tag}{mark}>{inside}</{tag}>"

    def links(least: int, most: int) -> str:
        items = [link() for _ in range(int(rng.integers(least, most)))]
        return pick("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", pick(" ", " | ").join(items), "".join(f"<div>{x}</div>" for x in items))

    def boiler(kind: str) -> str:
        if kind == "nav":
            return named(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "main-menu"], links(3, 9), 0.2)
        if kind == "header":
            return named(["header", "header", "div"], ["header", "masthead", "site-header", "banner", "top", "logo"], pick(prose(1, 6), link(), "<h1>" + word() + "</h1>", "<h1>" + prose(1, 3) + "</h1>") + pick("", links(2, 5), "<h2>" + prose(1, 3) + "</h2>"), 0.2)
        if kind == "footer":
            return named(["footer", "footer", "div"], ["footer", "site-footer", "copyright", "contentinfo", "bottom", "legal"], pick("&copy; ", "", "Copyright ") + word() + pick(" &middot; ", " | ", " ") + prose(3, 25) + pick("", links(2, 6)), 0.2)
        if kind == "side":
            return named(["aside", "aside", "div"], ["sidebar", "side", "widget", "related", "complementary", "rail", "recommended", "tags", "popular"], pick("", f"<h3>{prose(1, 4)}</h3>") + pick(links(3, 8), f"<p>{prose(5, 40)}</p>", f"<p>{prose(5, 30)}</p>" + links(2, 5)), 0.15)
        if kind == "ad":
            return named(["div", "div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adbox", "banner-ad"], pick(prose(4, 25), f"<p>{prose(4, 25)}</p>", link()), 0.03)
        if kind == "notice":
            return named(["div", "div", "section", "dialog"], ["cookie", "cookies", "cookie-banner", "consent", "notice", "gdpr", "alert", "modal", "popup", "newsletter", "subscribe", "overlay", "paywall"], pick(prose(6, 30), f"<p>{prose(6, 30)}</p>") + pick("", f"<button>{prose(1, 2)}</button>", link()), 0.03)
        if kind == "form":
            return f'<form action="/{word()}">' + pick("", f"<p>{prose(3, 15)}</p>") + f"<label>{prose(1, 3)}</label><input>" + pick(f"<button>{word()}</button>", f"<select><option>{word()}</option><option>{word()}</option></select>", f"<textarea>{prose(1, 4)}</textarea>") + "</form>"
        if kind == "comments":
            items = [named(["div", "li", "article", "div"], ["comment", "reply", "comment-body", "response"], pick("", f"<span>{word()}</span> ") + pick("<p>{}</p>", "{}", "<div>{}</div>").format(prose(4, 60)), 0.1) for _ in range(int(rng.integers(1, 6)))]
            return named(["div", "section", "ol", "div"], ["comments", "comment-list", "responses", "discussion", "disqus", "replies", "commentlist", "reviews"], pick("", f"<h3>{prose(1, 3)}</h3>") + "".join(items), 0.03)
        return named(["div", "ul", "p"], ["share", "social", "byline", "meta", "author", "pagination", "tags", "post-meta", "pager"], pick(links(2, 5), prose(2, 8)), 0.1)

    pages, answers = [], []
    for _ in range(number):
        good: set[str] = set()

        def block(tag: str, least: int, most: int, good: set[str] = good) -> str:
            text = prose(least, most)
            good.add(text)
            if rng.random() < 0.3:
                first, _, rest = text.partition(" ")
                return f"<{tag}><{pick('b', 'em', 'a href=x', 'span')}>{first}</b></em></a></span> {rest}</{tag}>" if rest else f"<{tag}>{text}</{tag}>"
            return f"<{tag}>{text}</{tag}>" if rng.random() < 0.8 or tag != "p" else f"<{tag}>{text}"

        body = [block(pick("h1", "h1", "h2"), 2, 14)] if rng.random() < 0.8 else []
        if body and rng.random() < 0.15:
            body = [f"<header>{body[0]}</header>"]
        terse = rng.random() < 0.12  # verse, transcripts, lists of short lines
        if terse:
            body += [block("p", 1, 4) for _ in range(int(rng.integers(20, 200)))]
        for _ in range(0 if terse else int(rng.integers(1, 15))):
            kind = rng.random()
            if kind < 0.7:
                body.append(block(pick(*["p"] * 9, "div"), pick(1, 5, 20), pick(22, 40, 160, 900)))
            elif kind < 0.8:
                body.append(block(pick("h2", "h3"), 1, 8))
            elif kind < 0.87:
                body.append("<ul>" + "".join(block("li", 2, 25) for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.92:
                body.append("<blockquote>" + block("p", 5, 50) + "</blockquote>")
            elif kind < 0.95:
                body.append("<table>" + "".join("<tr>" + block("td", 1, 6) + block("td", 1, 6) + "</tr>" for _ in range(int(rng.integers(2, 5)))) + "</table>")
            elif kind < 0.97:
                body.append("<figure><img>" + block("figcaption", 3, 15) + "</figure>")
            else:
                body.append(block("pre", 5, 40))
        for _ in range(int(rng.integers(1, 4)) if rng.random() < 0.4 else 0):  # what does not belong, in the midst
            body.insert(int(rng.integers(0, len(body) + 1)), boiler(pick("ad", "ad", "side", "form", "notice", "meta", "comments", "nav")))
        inside = "".join(body)
        style = rng.random()
        if style < 0.4:
            main = f"<article>{inside}</article>"
        elif style < 0.52:
            main = pick(inside, f"<div>{inside}</div>", f"<div><div>{inside}</div></div>")
        elif style < 0.65:
            main = f"<main>{pick(inside, f'<div>{inside}</div>', f'<article>{inside}</article>')}</main>"
        else:
            main = named(["div", "section", "div", "td"], ["content", "post", "entry", "article", "main", "story", "body", "text", "article-body", "post-content", "entry-content", "page"], inside, 0.15)
        before = [boiler(k) for k in ("notice", "header", "nav", "ad", "side", "form") if rng.random() < 0.4]
        after = [boiler(k) for k in ("meta", "side", "ad", "comments", "form", "nav", "notice", "footer") if rng.random() < 0.4]
        wrap = pick("{}", "<div>{}</div>", '<div id="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>')
        pages.append("<html><head><title>" + prose(2, 6) + "</title></head><body>" + wrap.format("".join(before) + main + "".join(after)) + "</body></html>")
        answers.append(good)
    return pages, answers


@functools.lru_cache(maxsize=1)
def trained() -> Potentials:
    """The default model, fitted on the labelled pages once a process."""
    return fit(*labelled_pages())


def main_texts(pages: list[str | None], model: Potentials) -> list[str]:
    f = forest(map(parse, pages))
    found: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(f.leaf & (model.marginals(f) > 0.5)):
        found[f.page[i]].append(f.texts[i])
    return ["\n".join(x) for x in found]


def extract(pages: DataFrame, model: Potentials | None = None, *, column: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to every row, from the whole page.

    A null or empty page, or one without content, gives an empty text. Every content block is kept
    whole, in page order. Columns named text or n_chars are replaced.
    """
    bounded_batches(pages.sparkSession)
    model = model or trained()
    kept = pages.drop(*[c for c in ("text", "n_chars") if c != column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = main_texts(part.column(column).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*part.schema.names, "text", "n_chars"])

    return kept.withColumn(column, F.col(column).cast("string")).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
