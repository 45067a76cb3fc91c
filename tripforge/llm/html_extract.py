"""Main text of HTML pages by a tree-structured graphical model.

The nodes of the model are a page's block elements and, as their leaves, the runs of
text in them. Each node is content or not. A node has a potential from its own features
(tag, words of class, id and role, length, punctuation; of elements also their share of
the page's text, where they stand in it, their share of link text, paragraphs, headings,
and whether they are or hold a row of elements of the same kind, as comments are), and
each parent-child edge one that depends on the parent's tag. The sum-product
algorithm passes messages from the leaves to the root and back, which gives every node's
exact marginal; leaves with a marginal of at least 1/2 are the text.

Potentials are trained on labelled pages: `labelled_pages` renders a fixed, seeded number
of pages of many layouts, in which each element is known to be content or not. Unary
potentials are logistic weights (relative to the labels' shares), edge potentials are
smoothed counts.

Nulls: a null html is an empty page and has the empty text. Tags, attributes, comments and
unknown entities are read as browsers do, in time linear in the page's length; of tags
left open or stray the text stays. A quote in an attribute that nothing closes ends with
its tag, and a tag that the end of the page cuts off is no text.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import table, tune

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown or belongs to forms.
SKIPPED = frozenset("script style noscript template title textarea select option iframe object svg math canvas audio video head button datalist".split())
RAW = frozenset("script style title textarea noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element, up to the given ancestors.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that may stand in a head; any other ends it.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: What ends the search for an open paragraph.
SCOPE = ("td", "th", "table", "li", "div", "article", "section", "blockquote", "main")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
KEY = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in sorted(RAW)}
WORD = re.compile(r"[a-z]+|\d+")
SPACE = re.compile(r"[\s\x00-\x20]+")
CONTENT = 0.5
#: Log odds of the root, which holds the content if there is any.
ROOT = 8.0
#: Leaves and paragraphs of one page resemble each other; so much of their potentials counts.
LEAF = 0.3
#: Features of fewer nodes of the training pages get no weight.
RARE = 8
#: Together, elements of a kind in a row, or all leaves of one part of a page, count as much
#: as so many: they are no independent evidence.
ALIKE = 4


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    marks: tuple[str, ...] = ()
    label: int | None = None
    text: str | None = None
    links: int = 0
    children: list[int] = field(default_factory=list)


class Tags:
    """The tags of a page, one after the other."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        #: The next place of each mark that was searched for.
        self.next = dict.fromkeys(("-->", "--!>", "]]>"), -1)

    def find(self, mark: str, at: int) -> int:
        """Like str.find, for places that never go back: no part of a page is searched twice."""
        if self.next[mark] < at:
            k = self.page.find(mark, at)
            self.next[mark] = k if k >= 0 else len(self.page)
        return self.next[mark] if self.next[mark] < len(self.page) else -1

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Those of a tag whose name ends there, and where the tag ends; -1 if it doesn't."""
        page, out = self.page, []
        while True:
            at = GAP.match(page, at).end()
            if at >= len(page):
                return out, -1
            if page[at] == ">":
                return out, at + 1
            key = KEY.match(page, at)
            at, value = key.end(), ""
            if (equals := EQUALS.match(page, at)) is not None:
                at = equals.end()
                quote = page[at : at + 1]
                if quote in self.last and at < self.last[quote]:
                    stop = page.index(quote, at + 1)
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.append((key[0].lower(), value))

    def all(self) -> Iterator[tuple[str, str, list, int]]:
        """(text before, name or /name or empty, attributes, where the tag ends)."""
        page, begin, at = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            stop, tag, found, more, start = -1, "", [], "", at
            nxt = page[at + 1 : at + 2]
            if nxt == "!" and page.startswith("<!--", at):
                if page.startswith(("<!-->", "<!--->"), at):
                    stop = page.index(">", at) + 1
                else:
                    ends = [k + len(x) for x in ("-->", "--!>") if (k := self.find(x, at + 4)) >= 0]
                    stop = min(ends, default=-1)
            elif nxt == "!" and page.startswith("<![CDATA[", at):
                k = self.find("]]>", at)
                more = html.escape(page[at + 9 : k if k >= 0 else len(page)])
                stop = k + 3 if k >= 0 else -1
            elif name := NAME.match(page, at + 1 if nxt != "/" else at + 2):
                found, stop = self.attributes(name.end())
                tag = "/" * (nxt == "/") + name[0].lower() if stop >= 0 else ""
            elif nxt in ("!", "?", "/") and nxt:
                stop = page.find(">", at) + 1 or -1
            else:
                at += 1
                continue
            self.at = at = stop if stop >= 0 else len(page)
            yield page[begin:start] + more, tag, found, at
            begin = at = max(at, self.at)
        yield page[begin:], "", [], len(page)


def parse(page: str, labels: bool = False) -> list[Node]:
    """Block elements and text leaves in page order; node 0 is the root. labels: takes the
    attribute x-label of training pages."""
    nodes = [Node("#root", -1, 0)]
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, node that its text belongs to, skipped
    open_: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
    run: list[str] = []
    links, body = 0, -1

    def flush() -> None:
        nonlocal links
        if run:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                at = stack[-1][1]
                nodes.append(Node("#text", at, nodes[at].depth + 1, (), None, text, min(links, len(text))))
                nodes[at].children.append(len(nodes) - 1)
            run.clear()
        links = 0

    def close(k: int) -> None:
        if any(t not in INLINE for t, _, _ in stack[k:]):
            flush()
        for t, _, _ in stack[k:]:
            open_[t].pop()
        del stack[k:]

    def add(text: str) -> None:
        nonlocal links
        if text and not stack[-1][2]:
            run.append(text)
            if open_["a"]:
                links += len(text)

    innermost = lambda names: max((open_[t][-1] for t in names if open_[t]), default=0)
    tags = Tags(page)
    for text, tag, found, at in tags.all():
        add(text)
        if not tag:
            continue
        if tag[0] == "/":
            if open_[tag[1:]]:
                close(open_[tag[1:]][-1])
            continue
        if tag == "br":
            add(" ")
            continue
        if open_["head"] and tag not in HEAD:
            close(open_["head"][-1])
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and innermost(["p"]) > innermost(SCOPE):
            close(open_["p"][-1])
        if tag in ENDS:
            ended, stop = ENDS[tag]
            bound = innermost(stop)
            ends = [open_[t][k] for t in ended if (k := bisect.bisect(open_[t], bound)) < len(open_[t])]
            if ends:
                close(min(ends))
        if tag == "a" and open_["a"] and all(t in INLINE for t, _, _ in stack[max(open_["a"][-1], len(stack) - 8) :]):
            close(open_["a"][-1])
        if tag in VOID:
            continue
        skipped = stack[-1][2] or tag in SKIPPED
        if tag == "body":
            if body >= 0:  # there is one body; a later tag of it goes on in it
                if not open_["body"]:
                    close(1)
                    open_[tag].append(1)
                    stack.append((tag, body, False))
                continue
            skipped = False
            close(1)
            body = len(nodes)
        own = stack[-1][1]
        if tag not in INLINE and not skipped:
            marks, label = [], None
            for key, value in found:
                if key in ("class", "id", "role"):
                    marks += [f"{key[0]}:{w}" for w in WORD.findall(html.unescape(value).lower())]
                elif key == "hidden":
                    marks.append("hidden")
                elif key == "x-label" and labels:
                    label = int(value)
            nodes.append(Node(tag, own, nodes[own].depth + 1, tuple(marks), label))
            nodes[own].children.append(len(nodes) - 1)
            own = len(nodes) - 1
        open_[tag].append(len(stack))
        stack.append((tag, own, skipped))
        if tag in RAW:
            end = CLOSING[tag].search(page, at)
            tags.at = end.start() if end else len(page)
            if not skipped:
                add(page[at : tags.at])
    flush()
    return nodes


#: Elements of which several of a kind in a row are a list of comments, teasers or the like.
ROWS = frozenset("div li article section aside dl".split())
#: Elements that hold parts of pages: their subtrees are measured.
MEASURED = ROWS | frozenset("main form ul ol table".split())


class Measures:
    """Of each node's subtree: text, text in links, paragraphs, headings; the text before
    it; how many children in a row of the same kind it has, or its parent has; and how many
    nodes are as good as the same evidence."""

    def __init__(self, nodes: list[Node]):
        n = len(nodes)
        self.text, self.links = [len(x.text or "") for x in nodes], [x.links for x in nodes]
        self.paras, self.heads = [int(x.tag == "p") for x in nodes], [int(x.tag in ("h1", "h2", "h3", "h4")) for x in nodes]
        self.before, self.rows, self.twins = [0] * n, [0] * n, [0] * n
        total = 0
        for k, x in enumerate(nodes):
            self.before[k] = total
            total += self.text[k]
        for k in range(n - 1, 0, -1):
            up = nodes[k].parent
            for of in (self.text, self.links, self.paras, self.heads):
                of[up] += of[k]
        for k, x in enumerate(nodes):
            kinds: dict[tuple, int] = {}
            for c in x.children:
                y = nodes[c]
                if y.tag in ROWS and self.text[c]:
                    kinds[y.tag, y.marks] = kinds.get((y.tag, y.marks), 0) + 1
            if kinds:
                self.rows[k] = max(kinds.values())
                for c in x.children:
                    self.twins[c] = kinds.get((nodes[c].tag, nodes[c].marks), 0)
        part, leaves = list(range(n)), [0] * n
        for k, x in enumerate(nodes):
            if k and x.tag not in MEASURED:
                part[k] = part[x.parent]
            leaves[part[k]] += x.tag == "#text"
        self.alike = [max(1, self.twins[k] if x.tag in MEASURED else leaves[part[k]]) for k, x in enumerate(nodes)]


def features(nodes: list[Node], k: int, m: Measures) -> list[str]:
    x = nodes[k]
    if x.tag == "#text":
        n, up = len(x.text), nodes[x.parent]
        size = min(7, int(math.log2(n + 1)))
        link = x.links / max(1, n)
        ends = x.text[-1:] in ".!?…:;»”\"" or up.tag[0] == "h"
        out = [f"text:{size}", f"link:{int(3 * link)}", f"in:{up.tag}", f"ends:{ends}"]
        if "©" in x.text[:40] or "all rights reserved" in x.text.lower():
            out.append("rights")
        if x.text.count("|") + x.text.count("·") > 2 and n < 200:
            out.append("bars")
        return out
    out = [f"tag:{x.tag}", *dict.fromkeys(x.marks)]
    out += [f"any:{w.split(':')[-1]}" for w in dict.fromkeys(x.marks)]
    if x.tag in MEASURED:
        whole, own = max(1, m.text[0]), m.text[k]
        rows, twins = min(3, m.rows[k]), min(3, m.twins[k])
        where = "first" if m.before[k] + own < 0.15 * whole else "last" if m.before[k] > 0.5 * whole else "middle"
        out += [f"share:{min(4, int(5 * own / whole))}", f"where:{where}", f"links:{int(3 * m.links[k] / max(1, own))}", f"rows:{rows}:{min(2, m.heads[k])}", f"twins:{twins}:{m.heads[k] > 0}:{where}"]
        out += [f"paras:{min(3, m.paras[k])}", f"mean:{min(8, int(math.log2(own / max(1, m.paras[k]) + 1)))}"]
    return out


class Model:
    def __init__(self, weights: dict[str, float], edges: dict[str, tuple], bias: float):
        self.weights, self.edges, self.bias = weights, edges, bias

    def unary(self, nodes: list[Node]) -> list[float]:
        """The potential of each node, as log odds."""
        n, m = len(nodes), Measures(nodes)
        unary = [self.bias + sum(self.weights.get(f, 0.0) for f in features(nodes, k, m)) for k in range(n)]
        unary = [u * (1 if x.tag in MEASURED else LEAF) * min(1, ALIKE / a) for u, x, a in zip(unary, nodes, m.alike)]
        unary[0] += ROOT
        return unary

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node: messages up, then down (as log odds and log ratios)."""
        n, unary = len(nodes), self.unary(nodes)
        other = self.edges["*"]
        up, belief = [0.0] * n, unary[:]
        exp, log = math.exp, math.log

        def through(e: tuple, odds: float, down: bool) -> float:
            """A message along an edge, as log odds. e: P(child 1 | parent 0), P(child 1 | parent 1)."""
            o = exp(max(-30.0, min(30.0, odds)))
            a, b = e
            if down:
                return log((a + b * o) / ((1 - a) + (1 - b) * o))
            return log(((1 - b) + b * o) / ((1 - a) + a * o))

        for k in range(n - 1, 0, -1):
            p = nodes[k].parent
            up[k] = through(self.edges.get(nodes[p].tag, other), belief[k], False)
            belief[p] += up[k]
        for k in range(1, n):
            p = nodes[k].parent
            belief[k] += through(self.edges.get(nodes[p].tag, other), belief[p] - up[k], True)
        return [1 / (1 + exp(-max(-30.0, min(30.0, b)))) for b in belief]

    def extract(self, page: str | None) -> list[str]:
        """The blocks of the main text, in page order."""
        nodes = parse(page or "")
        if len(nodes) == 1:
            return []
        p = self.marginals(nodes)
        return [x.text for x, q in zip(nodes, p) if x.tag == "#text" and q >= CONTENT]


# Labelled pages

#: Words of class and id names that designers give to parts of pages.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toolbar topbar pagination pager tabs links",
    "header": "header masthead banner top logo site branding hero",
    "footer": "footer bottom copyright legal colophon imprint",
    "aside": "sidebar side aside widget related recommended more teaser trending popular rail tags toc",
    "notice": "cookie consent notice gdpr popup modal overlay alert message warning banner disclaimer newsletter subscribe paywall",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted partner commercial dfp",
    "share": "share sharing social follow like meta byline author",
    "comments": "comment comments reply replies respond discussion disqus thread reader reactions feedback",
    "form": "form search login signup contact input",
    "content": "content article post entry main body story text page prose document",
}
_SYLLABLES = "ba der lin mo ta re si ko the an per ion ul fa ne gri so vel ma ti".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: Some pages lack punctuation, or have much of it.
        self.stops = self.r.choice(["....?!"] * 6 + ["", "%&$*#"])

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        r = self.r
        return " ".join(self.words(1, 16).capitalize() + (r.choice(self.stops) if self.stops and r.random() < 0.85 else "") for _ in range(r.randint(lo, hi)))

    def inline(self, text: str) -> str:
        k = self.r.random()
        if k < 0.1:
            return f"<b>{text}" + self.r.choice(["</b>", "", "<br>"])
        if k < 0.2:
            a, _, b = text.partition(" ")
            return f'{a} <a href="/{self.word()}">{b}</a>' if len(text) < 60 else f'<em>{a}</em> {b} <a href="#">{self.word()}</a>.'
        return text

    def el(self, tag: str, label: int, inner: str, group: str | None = None, close: bool = True) -> str:
        names = ""
        if group and self.r.random() < 0.75:
            names = f' {self.r.choice(["class", "class", "id"])}="{"-".join(self.r.sample(NAMES[group].split(), self.r.randint(1, 2)))}"'
        return f'<{tag}{names} x-label="{label}">{inner}' + (f"</{tag}>" if close else "")

    def links(self, label: int, tag: str = "ul") -> str:
        return self.el(tag, label, "".join(self.el("li", label, f'<a href="/{self.word()}">{self.words(1, 3)}</a>') for _ in range(self.r.randint(2, 8))))

    def boiler(self, group: str) -> str:
        r = self.r
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "aside", "ol"]}.get(group, ["div", "div", "section", "p"])
        tag = r.choice(tag)
        named = group if tag in ("div", "section", "p", "ol", "ul") else (group if r.random() < 0.5 else None)
        if group in ("nav", "share"):
            inner = self.links(0) if r.random() < 0.7 else " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 7)))
        elif group == "footer":
            inner = r.choice(["&copy; " + self.words(2, 6) + " &middot; " + self.sentences(1, 1), self.links(0), self.el("p", 0, "&copy; 2020 " + self.words(1, 5))])
        elif group == "comments":
            kind, named = r.choice(["div", "div", "li", "article", "section"]), r.choice(["comments", None, None])
            who = r.choice([lambda: self.el("p", 0, self.words(1, 2)), lambda: f"<b>{self.word()}</b> <small>{r.randint(1, 12)} {self.word()}</small>", lambda: self.el("div", 0, f'<a href="#">{self.word()}</a>'), lambda: ""])
            names = f' class="{self.word()}-{self.word()}"' if named is None and r.random() < 0.5 else ""
            each = [who() + self.el("p", 0, self.sentences(1, 4)) * r.choice([1, 1, 2]) for _ in range(r.randint(1, 9))]
            inner = "".join(self.el(kind, 0, x, named) if named else f'<{kind}{names} x-label="0">{x}</{kind}>' for x in each)
            inner = (self.el(r.choice(["h2", "h3"]), 0, self.words(1, 2)) if r.random() < 0.8 else "") + inner
            if r.random() < 0.5:
                names = f' {r.choice(["class", "id"])}="{self.word()}-{self.word()}"' if r.random() < 0.7 else ""
                tag = r.choice(["div", "section", "ol", "ul"] if kind == "li" else ["div", "div", "section", "aside"])
                return f'<{tag}{names} x-label="0">{inner}</{tag}>'
        elif group == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.word()}</button>' + (self.el("p", 0, self.sentences(1, 1)) if r.random() < 0.4 else "")
        elif group == "header":
            inner = r.choice([self.el("h1", 0, self.words(1, 3)) + self.links(0), f'<a href="/">{self.words(1, 3)}</a>', self.el("p", 0, self.words(2, 5)), self.sentences(1, 1)])
        elif group == "aside":
            inner = self.el("h3", 0, self.words(1, 4)) + r.choice([self.links(0), self.el("p", 0, self.sentences(1, 3)), "".join(self.el("p", 0, f'<a href="#">{self.words(3, 9)}</a>') for _ in range(3))])
        else:
            inner = r.choice([self.sentences(1, 3), self.el("p", 0, self.sentences(1, 2)), self.words(2, 8)])
        if tag in ("ul", "ol") and not inner.startswith("<"):
            tag = "div"
        return self.el(tag, 0, inner, named or (group if tag in ("div", "section", "p") else None) if group in NAMES else None) if tag not in ("div", "section", "p") or named is None else self._sure(tag, inner, group)

    def _sure(self, tag: str, inner: str, group: str) -> str:
        names = "-".join(self.r.sample(NAMES[group].split(), self.r.randint(1, 2)))
        return f'<{tag} {self.r.choice(["class", "id"])}="{names}" x-label="0">{inner}</{tag}>'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.12:
            short = self.words(1, 4).capitalize() + r.choice([".", ""])
            return self.el("h1", 1, short) + self.el("p", 1, self.inline(r.choice([short, self.sentences(1, 2)])))
        if r.random() < 0.8:
            h = self.el("h1", 1, self.words(2, 9) + r.choice(["", "."]))
            out.append(self.el("header", 1, h) if r.random() < 0.08 else h)
        for _ in range(r.choice([3, 8, 12, 12, r.randint(20, 120)]) if r.random() < 0.5 else r.randint(1, 12)):
            k = r.random()
            if k < 0.78:
                out.append(self.el("p", 1, self.inline(self.sentences(1, 7)), None, r.random() < 0.8))
            elif k < 0.84:
                out.append(self.el(r.choice(["h2", "h3"]), 1, self.words(1, 6)))
            elif k < 0.9:
                out.append(self.el(r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, self.inline(self.sentences(1, 2)), None, r.random() < 0.7) for _ in range(r.randint(2, 5)))))
            elif k < 0.93:
                out.append(self.el("blockquote", 1, self.el("p", 1, self.sentences(1, 3)) if r.random() < 0.6 else self.sentences(1, 2)))
            elif k < 0.94:
                parts = [self.el("h2", 1, self.words(1, 6)) + "".join(self.el("p", 1, self.inline(self.sentences(2, 7))) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 4))]
                kind = r.choice(["section", "div"])
                out.append("".join(self.el(kind, 1, x) for x in parts))
            elif k < 0.955:
                out.append(self.el("table", 1, "".join(self.el("tr", 1, "".join(self.el("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 4)))))
            elif k < 0.97:
                out.append(self.el("figure", 1, self.el("figcaption", 1, self.sentences(1, 1))))
            elif k < 0.98:
                out.append(self.el("pre", 1, self.words(3, 12)))
            else:
                out.append(self.boiler(r.choice(["ad", "share", "aside", "notice"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        tag, group = r.choice([("article", None), ("article", "content"), ("main", None), ("div", "content"), ("section", "content")])
        core = self.el(tag, 1, self.article(), group)
        if r.random() < 0.3:
            core = self.el(r.choice(["main", "div"]), 1, core + (self.boiler("comments") if r.random() < 0.4 else ""), "content")
        before = [g for g in ("header", "nav", "ad", "notice") if r.random() < 0.55]
        after = [g for g in ("share", "aside", "comments", "ad", "form", "footer", "notice") if r.random() < 0.4]
        body = "".join(map(self.boiler, before)) + core + "".join(map(self.boiler, after))
        return f'<html><head><title>{self.words(2, 6)}</title></head><body x-label="1">{body}</body></html>'


def labelled_pages(n: int = 800, seed: int = 5) -> list[str]:
    """Pages in which the attribute x-label says of each element whether it is content."""
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]


def train(pages: list[str], ridge: float = 0.3) -> Model:
    same: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    pairs: dict[str, np.ndarray] = defaultdict(lambda: np.ones((2, 2)) * 0.5)
    for nodes in (parse(page, True) for page in pages):
        m = Measures(nodes)
        for k, x in enumerate(nodes):
            if x.label is None:
                x.label = nodes[x.parent].label if x.parent >= 0 else 1
            if k:
                for tag in (nodes[x.parent].tag, "*"):
                    pairs[tag][nodes[x.parent].label, x.label] += 1
                same[tuple(features(nodes, k, m))][x.label] += 1
    often = Counter(f for r, c in same.items() for f in r for _ in range(sum(c)))
    number = {f: i for i, f in enumerate(f for f, c in often.items() if c >= RARE)}
    x = np.zeros((len(same), len(number) + 1))
    for i, r in enumerate(same):
        x[i, [number[f] for f in r if f in number]] = 1
    x[:, -1] = 1
    count = np.array(list(same.values()), float)
    n, y = count.sum(1), count[:, 1]
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (n * p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    # the shares of the labels are what the edges say already
    bias = w[-1] - math.log(y.sum() / (n.sum() - y.sum()))
    edges = {t: (c[0, 1] / c[0].sum(), c[1, 1] / c[1].sum()) for t, c in pairs.items()}
    return Model({f: float(w[i]) for f, i in number.items()}, edges, bias)


@functools.cache
def trained() -> Model:
    """The model of the generated pages; a driver trains it once."""
    return train(labelled_pages())


def _extracting(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages = (batch.column(c) for c in ("page_id", "url", "html"))
            texts = ["\n\n".join(model.value.extract(p.as_py())) for p in pages]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(model or trained())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracting(sent), "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
