"""Operator 9: main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree of elements, forgiving of tags that are never closed and
of pages that break off. Each block element is described by its tag, the words of its
class, id and role attributes, depth, the density of text, links and elements in its
subtree, and its place among its siblings and under its ancestors. Boosted trees give each node
the log-odds that its text is main text.

Decoding is hierarchical: over the whole tree the best consistent choice is found by
dynamic programming, in which a chosen node takes its subtree with it except for
descendants that are cut out as a whole, so that no node is chosen inside of one
that is left out below a chosen one, and the reverse. Scripts, styles and forms, and what stands in the head, are
never text; formulas, drawings, and what a page hides are judged as any other text.

The trees are trained here, on pages that a seeded generator writes in many layouts,
with every block's role known; TRAIN_PAGES bounds them. No page of the input is
needed for it.

Inside a block, character references are decoded and white space becomes one space;
blocks are joined in page order by one newline, and nothing else is dropped or cut.

Time grows with the length of a page, however deep its elements nest or how many are left open.

Defined cases: null and empty pages, and pages without main text, give an empty text;
a page without any markup is one block of text and is returned as such; very long pages are read whole; a choice whose gain ties with leaving
out is left out; repeated rows give repeated results; a null url or page_id is kept; other columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import slices, table

TRAIN_PAGES, SEED = 500, 5
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32

# Fixed sets of HTML: elements without content, without prose, and those that start a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())
_SILENT = _RAW | frozenset("head form button select option input label fieldset legend datalist output".split())
_MATH = "math maction maligngroup menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml"
_DRAWN = "svg g defs desc path rect circle ellipse line polyline polygon text tspan textpath use symbol marker mask pattern filter foreignobject lineargradient radialgradient stop clippath image"
_FOREIGN = frozenset(f"{_MATH} {_DRAWN}".split())
_INLINE = frozenset(
    f"a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd map mark object picture q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr {_MATH} {_DRAWN}".split()
)
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead tfoot".split())
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
# One attribute after another, from the start of the tag: name, and value if there is one.
_ATTR = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"']\S*)))?")
_NAMED = frozenset("class id role itemprop aria-label".split())
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")

# Words of attributes and tags that tell the role of a node, in groups; each group is a feature.
GROUPS = {
    "main": "article main content story post entry body text prose markdown topic page column",
    "menu": "nav menu navigation breadcrumb breadcrumbs toc sitemap pagination pager tabs links skip",
    "head": "header masthead banner logo topbar branding hero head top",
    "foot": "footer foot bottom copyright colophon legal credits imprint",
    "side": "aside sidebar side rail related recommended widget complementary trending popular more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion affiliate commercial outbrain taboola",
    "note": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup paywall privacy banner toast",
    "comment": "comment comments discussion reply replies respond disqus reader readers feedback thread review reviews",
    "form": "form search login signin register input contact poll",
    "share": "share social sharing follow tags meta byline author tools print",
    "title": "title headline heading",
    "hidden": "",  # by the attributes that hide an element
}
_GROUP_OF = {w: g for g, words in reversed(list(enumerate(GROUPS.values()))) for w in words.split()}
_HIDDEN = len(GROUPS) - 1
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_TAGS = "article main section div p h1 h2 h3 h4 ul ol li table tr td blockquote pre figure nav header footer aside body span dl".split()
_TAG_NO = {t: i for i, t in enumerate(_TAGS)}


@dataclass(eq=False)
class Node:
    tag: str
    words: frozenset[int]
    parent: Node | None
    parts: list[Node | str] = field(default_factory=list)  # child elements and pieces of text
    no: int = -1


def _attributes(text: str) -> frozenset[int]:
    groups = set()
    for m in _ATTR.finditer(text):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in _NAMED:
            groups.update(_GROUP_OF[w] for w in _PARTS.findall(value) if w in _GROUP_OF)
        elif name == "hidden" or (name == "aria-hidden" and value.strip() == "true") or (name == "style" and _UNSEEN.search(value)):
            groups.add(_HIDDEN)
    return frozenset(groups)


class _Open:
    """The open elements of a page while it is read, and where in them each tag stands."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def _last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def close(self, tags, scope=()) -> None:
        """Close the innermost element of one of the tags, with all in it, if no element of `scope` is in between."""
        at = self._last(tags)
        if at and at > self._last(scope):
            for node in self.nodes[at:]:
                self.places[node.tag].pop()
            del self.nodes[at:]


def read(page: str) -> Node:
    """The tree of a page."""
    root = Node("root", frozenset(), None)
    opened, place, size = _Open(root), 0, len(page)
    while place < size:
        m = _TOKEN.search(page, place)
        at = opened.nodes[-1]
        text = page[place : m.start() if m else size]
        if text:
            at.parts.append(text)
        if not m:
            break
        place = m.end()
        if m["cdata"]:
            at.parts.append(m["cdata"])
        elif m["close"]:
            opened.close((m["close"].lower(),))
        elif m["open"]:
            tag = m["open"].lower()
            if tag in _CLOSES_P:
                opened.close(("p",), ("table", "td", "th", "li", "article", "section", "div", "body", "button"))
            if tag in _SAME:
                opened.close(_SAME[tag], _SCOPE[tag])
            at = opened.nodes[-1]
            attrs = m["attrs"] or ""
            node = Node(tag, _attributes(attrs) if attrs.strip(" /") else frozenset(), at)
            at.parts.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, place)
                place = end.end() if end else size
            elif tag not in _VOID and not (tag in _FOREIGN and attrs.endswith("/")):  # elsewhere a slash at the end means nothing
                opened.push(node)
    return root


def _silent(node: Node) -> bool:
    return node.tag in _SILENT


def _nodes(root: Node) -> list[Node]:
    """Nodes that may be chosen, in page order: block elements, and the root."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if _silent(node):
            continue
        if node.tag not in _INLINE:
            node.no = len(found)
            found.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return found


def _totals(root: Node, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For each node: of its subtree and of its own text, [characters, linked characters, elements, blocks, sentences ends, commas]; and its parent's number."""
    own = np.zeros((len(nodes), 6))
    parent = [-1] * len(nodes)
    stack: list[tuple[Node, int, bool]] = [(root, -1, False)]
    while stack:
        node, above, link = stack.pop()
        if _silent(node):
            continue
        if node.no >= 0:
            parent[node.no] = above
            above = node.no
            own[above, 3] += 1
        own[above, 2] += 1
        link = link or node.tag == "a"
        for p in node.parts:
            if isinstance(p, Node):
                stack.append((p, above, link))
            else:
                n = len(p) - p.count(" ") - p.count("\n")
                own[above, 0] += n
                if link:
                    own[above, 1] += n
                own[above, 4] += p.count(". ") + p.count("! ") + p.count("? ") + (p.rstrip()[-1:] in (".", "!", "?"))
                own[above, 5] += p.count(",")
    whole = own.copy()
    for i in range(len(nodes) - 1, 0, -1):
        whole[parent[i]] += whole[i]
    return whole, own, parent


FEATURES = 16 + 3 * len(GROUPS)


def describe(root: Node) -> tuple[list[Node], np.ndarray, list[int], np.ndarray]:
    """Nodes, their features (one row each), their parents, and the characters of their own text."""
    nodes = _nodes(root)
    whole, own, parent = _totals(root, nodes)
    x = np.zeros((len(nodes), FEATURES), np.float32)
    total = max(1.0, whole[0, 0])
    children: list[list[int]] = [[] for _ in nodes]
    place = [0] * len(nodes)  # among its siblings
    alike: Counter[tuple[int, str]] = Counter()  # siblings of one tag
    for i in range(1, len(nodes)):
        place[i] = len(children[parent[i]])
        children[parent[i]].append(i)
        alike[parent[i], nodes[i].tag] += 1
    depth = [0] * len(nodes)
    groups = np.zeros((len(nodes), len(GROUPS)), np.float32)
    above = np.zeros((len(nodes), len(GROUPS)), np.float32)
    for i, node in enumerate(nodes):
        up = parent[i]
        groups[i, list(node.words)] = 1
        if node.tag in _GROUP_OF and node.tag not in ("body", "head"):
            groups[i, _GROUP_OF[node.tag]] = 1
        if up >= 0:
            depth[i] = depth[up] + 1
            above[i] = np.maximum(above[up], groups[up])
            brothers = children[up]
            text, size = whole[i, 0], len(brothers)
            at = place[i]
            near = [whole[brothers[k], 0] for k in (at - 1, at + 1) if 0 <= k < size]
            x[i, 9:13] = (min(size, 100), at / max(1, size - 1), sum(near) / len(near) if near else 0, text / max(1.0, whole[up, 0]))
            x[i, 13] = min(100, alike[up, node.tag])
        c, links, elements, blocks, ends, commas = whole[i]
        x[i, :9] = (_TAG_NO.get(node.tag, -1), depth[i], np.log1p(c), links / max(1.0, c), c / max(1.0, elements), c / max(1.0, blocks), ends, commas / max(1.0, c) * 100, c / total)
        x[i, 14], x[i, 15] = np.log1p(own[i, 0]), own[i, 1] / max(1.0, own[i, 0])
    below = groups.copy()
    for i in range(len(nodes) - 1, 0, -1):
        below[parent[i]] = np.maximum(below[parent[i]], below[i])
    x[:, 16 : 16 + len(GROUPS)] = groups
    x[:, 16 + len(GROUPS) : 16 + 2 * len(GROUPS)] = above
    x[:, 16 + 2 * len(GROUPS) :] = below - groups
    return nodes, x, parent, own[:, 0]


@dataclass
class Boosted:
    """Trees of equal depth: feature and threshold of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    above: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.above, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss with Newton steps, on features cut in BINS bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, aboves, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, choice = np.full(width, 1e-6), [(0, np.inf, BINS)] * width
            for f in range(x.shape[1]):
                key = local * BINS + binned[:, f]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[:, len(cuts[f]) :] = 0
                k = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[n], choice[n] = gain[n, k[n]], (f, cuts[f][k[n]], k[n])
            for n, (f, t, _k) in enumerate(choice):
                feature[first + n], above[first + n] = f, t
            fs = feature[at]
            ks = np.array([c[2] for c in choice])[local]
            at = 2 * at + 1 + (binned[np.arange(len(y)), fs] > ks)
        local = at - inner
        value = -RATE * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + 1)
        margin += value[local]
        features.append(feature)
        aboves.append(above)
        values.append(value)
    return Boosted(start, np.array(features), np.array(aboves), np.array(values))


def decode(parent: list[int], gain: np.ndarray) -> np.ndarray:
    """Whether each node's own text is main text, by the best consistent choice.

    A node is outside (it and, unless a descendant is chosen, its subtree), chosen, or
    cut (left out below a chosen one, with all of its subtree). gain is what a node's own text earns if taken.
    """
    n = len(parent)
    sub = gain.astype(float).copy()  # best of the subtree if the node is chosen
    outside = np.zeros(n)  # best of the subtree if the node is not chosen
    for i in range(n - 1, 0, -1):
        outside[parent[i]] += max(outside[i], sub[i])
        sub[parent[i]] += max(sub[i], 0.0)
    taken = np.zeros(n, bool)
    state = np.zeros(n, np.int8)  # 0 open, 1 chosen, 2 cut
    state[0] = 1 if sub[0] > outside[0] else 0
    taken[0] = state[0] == 1
    for i in range(1, n):
        up = state[parent[i]]
        state[i] = 2 if up == 2 else (1 if sub[i] > 0 else 2) if up == 1 else (1 if sub[i] > outside[i] and sub[i] > 0 else 0)
        taken[i] = state[i] == 1
    return taken


def blocks_of(root: Node, taken: np.ndarray) -> list[str]:
    """The text of the taken nodes, block by block, in page order."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        part, on = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if on:
                run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif not _silent(part):
            if part.no >= 0:
                flush()
                on = bool(taken[part.no])
                stack.append((None, on))
            stack += [(p, on) for p in reversed(part.parts)]
    flush()
    return blocks


def extract(model: Boosted, pages: list[str | None]) -> list[str]:
    """Main text of each page. The pages' nodes are scored together."""
    described = []
    for page in pages:
        if page and "<" not in page:
            described.append(_SPACE.sub(" ", html.unescape(page)).strip())
        else:
            root = read(page or "")
            described.append((root, *describe(root)))
    trees = [d for d in described if not isinstance(d, str)]
    margins = model.margins(np.concatenate([d[2] for d in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for d in described:
        if isinstance(d, str):
            out.append(d)
            continue
        root, nodes, _, parent, own = d
        m = np.clip(margins[at : at + len(nodes)], -6, 6)
        at += len(nodes)
        out.append("\n".join(blocks_of(root, decode(parent, m * np.log1p(own)))))
    return out


def generated(pages: int = TRAIN_PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages in many layouts.

    Main blocks and others are written with words of their own: main words begin
    with m, so the role of each block is known after parsing.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p

    def words(n: int, mark: str) -> str:
        out = [mark + "aeioubdglnrst"[int(k) % 13] * (1 + int(k) % 7) for k in rng.integers(0, 91, n)]
        for k in range(0, n, int(rng.integers(6, 16))):
            out[k] = out[k].capitalize()
            if k:
                out[k - 1] += pick(".", ".", "!", "?")
            if k + 3 < n and chance(0.6):
                out[k + 3] += ","
        return " ".join(out) + pick(".", ".", "")

    def prose(mark: str, low: int = 5, high: int = 120) -> str:
        text = words(int(rng.integers(low, high)), mark)
        if chance(0.2):
            cut = text.find(" ", len(text) // 2) + 1
            text = text[:cut] + f"<{(t := pick('b', 'i', 'em', 'a href=/x', 'strong'))}>" + text[cut:] + f"</{t.split()[0]}>"
        return text

    def named(tag: str, *names: str) -> str:
        return f'<{tag} {pick("class", "class", "id")}="{pick(*names)}">'

    def links(n: int, mark: str = "x") -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(int(rng.integers(1, 5)), mark)}</a></li>' for i in range(n)) + "</ul>"

    def menu() -> str:
        n = int(rng.integers(1, 14))
        plain = pick(" ", " | ", "").join(f'<a href="/{i}">{words(int(rng.integers(1, 4)), "x")}</a>' for i in range(n))
        return pick(f"<nav>{plain}</nav>", f"<nav><div>{plain}</div></nav>", named("div", "menu", "navbar", "links") + plain + "</div>", f"<nav>{links(n)}</nav>", named("div", "menu", "main-nav", "navbar", "breadcrumbs", "toc") + links(n) + "</div>", f"<header><h1>{words(3, 'x')}</h1><nav>{links(n)}</nav></header>", named("header", "site-header", "masthead") + f"<p>{words(5, 'x')}</p>" + "</header>")

    def footer() -> str:
        return pick(f"<footer>{pick('&copy; ', '')}{prose('x', 3, 40)}</footer>", named("div", "footer", "site-footer", "copyright", "legal") + f"<p>{prose('x', 3, 60)}</p></div>", f"<footer>{links(5)}<p>{prose('x', 5, 30)}</p></footer>")

    def aside() -> str:
        inside = pick(links(6), f"<h3>{words(2, 'x')}</h3>{links(5)}", f"<p>{prose('x', 5, 80)}</p>", f"<p>{prose('x')}</p><p>{prose('x')}</p>")
        return pick(f"<aside>{inside}</aside>", named("div", "sidebar", "related", "side-column", "widget", "recommended", "trending") + inside + "</div>", named("section", "related-posts", "more-stories") + inside + "</section>")

    def advert() -> str:
        return named("div", "ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement") + pick(prose("x", 3, 60), f"<p>{prose('x', 3, 60)}</p>", f'<a href="/ad">{words(8, "x")}</a>') + "</div>"

    def notice() -> str:
        return named("div", "cookie-notice", "consent", "newsletter", "notice", "alert", "subscribe", "popup", "privacy-banner", "gdpr") + pick(prose("x", 5, 50), f"<p>{prose('x', 5, 70)}</p><button>OK</button>") + "</div>"

    def form() -> str:
        return f"<form action=/s><label>{words(2, 'x')}</label><input name=q><button>{words(1, 'x')}</button><p>{prose('x', 3, 30)}</p></form>"

    def comments() -> str:
        one = lambda: pick(named("div", "comment", "reply", "reader-comment"), "<li>", "<article class=comment>")
        inside = ""
        for _ in range(int(rng.integers(1, 9))):
            start = one()
            end = "</" + start[1:].split()[0].strip(">") + ">"
            inside += start + pick(f"<p>{prose('x', 4, 100)}</p>", prose("x", 4, 90), f"<b>{words(2, 'x')}</b><p>{prose('x', 4, 90)}</p>") + end
        return pick(named("div", "comments", "discussion", "responses comments", "reader-comments"), named("section", "comments", "comment-list", "discussion")) + f"<h3>{words(2, 'x')}</h3>" * chance(0.6) + inside + "</div>"

    def formula(mark: str) -> str:
        return f"<math><mi>{words(1, mark)}</mi><mo>=</mo><mn>{words(1, mark)}</mn></math>"

    def share() -> str:
        return named("div", "share", "social", "share-tools", "tags", "follow") + links(4) + "</div>"

    def main_blocks() -> str:
        out = f"<{(t := pick('h1', 'h1', 'h2'))}>{words(int(rng.integers(2, 14)), 'm')}</{t}>" if chance(0.85) else ""
        for _ in range(int(rng.integers(1, 16))):
            kind = rng.random()
            if kind < 0.68:
                out += f"<p>{prose('m', 1, 200)}" + "</p>" * (not chance(0.1))
            elif kind < 0.76:
                out += f"<h{(k := int(rng.integers(2, 5)))}>{words(int(rng.integers(1, 9)), 'm')}</h{k}>"
            elif kind < 0.82:
                out += "<ul>" + "".join(f"<li>{prose('m', 2, 30)}</li>" for _ in range(int(rng.integers(2, 7)))) + "</ul>"
            elif kind < 0.86:
                out += f"<blockquote>{pick(prose('m'), '<p>' + prose('m') + '</p>')}</blockquote>"
            elif kind < 0.89:
                out += "<table>" + "".join("<tr>" + "".join(f"<td>{words(2, 'm')}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
            elif kind < 0.91:
                out += f"<pre>{words(12, 'm')}</pre>"
            elif kind < 0.93:
                out += f"<figure><img src=a.png><figcaption>{words(6, 'm')}</figcaption></figure>"
            else:
                out += f"<div>{prose('m', 5, 120)}</div>"
            if chance(0.04):
                out += f"<p>{formula('m')}</p>"
            if chance(0.03):
                out += pick("<div hidden>", '<p style="display:none">', '<div aria-hidden="true">') + prose("m", 5, 60) + "</div>"
            if chance(0.07):
                out += pick(advert, notice, aside, share, form)()
        return out

    for _ in range(pages):
        body = "".join(f() for f in (menu, advert, notice, menu, form) if chance(0.55))
        holder = pick("<article>", "<article>", "<main>", "<main><article>", named("div", "content", "article-body", "post", "entry-content", "story"), named("section", "content", "story"), "<div>", "")
        closing = "".join(f"</{t.split()[0].strip('<>')}>" for t in reversed(holder.replace("><", ">|<").split("|")) if t)
        middle = holder + main_blocks() + "".join(f() for f in (share, comments, form) if chance(0.2)) + closing
        after = "".join(f() for f in (aside, share, comments, advert, notice, footer, footer) if chance(0.4))
        if chance(0.4):
            start = pick('<div class="wrap">', '<div id="page">', "<div>", '<div class="layout"><div class="column">')
            middle = start + middle + pick("", aside()) + "</div>" * start.count("<div")
        page = f"<!DOCTYPE html><html><head><title>{words(5, 'x')}</title><style>p{{}}</style></head><body>{body}{middle}{after}" + "</body></html>" * (not chance(0.1))
        yield page


def labelled(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and characters of the nodes of a generated page that have text."""
    root = read(page)
    nodes, x, _, own = describe(root)
    label, known = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        text, stack = "", [node]
        while stack and not text.strip():
            part = stack.pop()
            if isinstance(part, str):
                text = part
            elif part is node or part.no < 0:
                stack += reversed(part.parts)
        first = re.search(r"[mx][a-z]", text.lower())
        if first and own[i]:
            label[i], known[i] = first[0][0] == "m", True
    return x[known], label[known], own[known]


@lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    """The trees, trained on generated pages alone."""
    found = [labelled(p) for p in generated(pages, seed)]
    return boost(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = extract(shared.value, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    found = pages.mapInArrow(_run(shared), f"page_id {id_type}, url {url_type}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, whole html."""
    return main_text(table(spark, sf_dir, "pages"))
