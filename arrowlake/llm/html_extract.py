"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each element is a row of features: its tag and attribute tokens, depth, the text, links, marks and controls of its
subtree, and how it compares with its siblings, its parent and the block around it. Boosted trees give each node's
log-odds of belonging to the article. They are fitted on a bounded sample of distinct pages, in two ways: pages that
name their article teach as they are, half of the rows with the names taken away; and the paragraphs of any page are
laid out anew in made-up page frames (see ``composed``), where it is known what is article and what isn't. Decoding
picks the likeliest consistent choice in each tree: a node is kept only with its parent. Names of parts are features
only; nothing but elements that show no text (scripts, styles, option lists) is left out by rule.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_PAGES, COMPOSED, TAUGHT_NODES = 250, 3, 150
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25

# Elements by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title button select textarea option iframe svg canvas object video audio".split())
IN_HEAD = set("base basefont bgsound link meta title script style noscript template".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTROLS = set("input button select textarea".split())
CONTENT = {"article", "main"}
FRAME = {"nav", "header", "footer", "aside", "menu", "dialog"}
CELLS = {"tr", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GROUPS = [
    {"p"}, HEADINGS, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"a"}, {"div", "section"}, {"table", "tr", "td", "th", "tbody"},
    {"blockquote", "pre", "figure", "figcaption"}, INLINE, {"form", "fieldset"}, {"html", "body", "#page"},
]
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": CELLS, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GOOD_TOKENS = set("article articlebody body content entry main post story text".split())
BAD_TOKENS = set(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion feedback footer header"
    " login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted rail recommended related replies reply respond share"
    " sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
SPLIT = re.compile(r"[^a-z0-9]+")
HASHED = 8


class Page(HTMLParser):
    """The element tree of a page as lists, and its text pieces by node. Every tag costs constant time, amortised."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.texts = [-1], ["#page"], [()], []
        self.controls: list[int] = []
        self.marks: list[str | None] = [None]
        self._open, self._block, self._hidden = [0], 0, 0
        self._at: dict[str, list[int]] = {}  # places in the open list, by tag
        self._walls: list[int] = []  # of elements that end the reach of an end tag or of an implied one
        self._cells: list[int] = []
        self.feed(html)
        self.close()

    def _top(self, places: list[int] | None) -> int:
        return places[-1] if places else 0

    def _push(self, tag: str, attrs: list) -> None:
        named = [v.lower() for k, v in attrs if v and k in ("class", "id", "role", "itemprop")]
        self.parent.append(self._open[-1])
        self.names.append(tuple(x for v in named for x in v.split()))
        self.marks.append(next((v for k, v in attrs if k == "data-taught"), None))
        self.tag.append(tag)
        at = len(self._open)
        self._open.append(len(self.tag) - 1)
        self._at.setdefault(tag, []).append(at)
        self._hidden += tag in HIDDEN
        if tag in CELLS:
            self._cells.append(at)
        elif tag not in INLINE and tag != "p":
            self._walls.append(at)

    def _cut(self, at: int) -> None:
        """Closes the open elements from place ``at`` on."""
        while len(self._open) > at:
            tag, place = self.tag[self._open.pop()], len(self._open)
            self._at[tag].pop()
            self._hidden -= tag in HIDDEN
            for places in (self._cells, self._walls):
                if places and places[-1] == place:
                    places.pop()

    def _leave_head(self) -> None:
        if self._at.get("head"):
            self._cut(self._at["head"][-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and tag not in ("html", "head") and self._hidden == 1:
            self._leave_head()
        if tag in ("html", "body", "head") and (self._at.get(tag) or self._at.get("body")):
            return
        if tag == "br":
            self.handle_data(" ")
        if tag in CONTROLS and not self._hidden:
            self.controls.append(self._open[-1])
        if tag in VOID:
            self._block += tag == "hr"
            return
        if tag not in INLINE:
            self._block += 1
            closed = CLOSES.get(tag, {"p"} if tag not in HIDDEN else set())
            place = max((self._top(self._at.get(c)) for c in closed), default=0)
            wall = max(self._top(self._walls), 0 if tag in CELLS else self._top(self._cells))
            if place and place >= wall:
                self._cut(place)
        self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._block += 1
        place = self._top(self._at.get(tag))
        if place and (tag not in INLINE or place > max(self._top(self._walls), self._top(self._cells), self._top(self._at.get("p")))):
            self._cut(place)

    def handle_data(self, data: str) -> None:
        if self._hidden == 1 and self.tag[self._open[-1]] == "head" and data.strip():
            self._leave_head()
        if data and not self._hidden:
            self.texts.append((self._open[-1], self._block, data))

    def text(self, kept: np.ndarray) -> str:
        blocks, last = [], None
        for node, block, data in self.texts:
            if kept[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(data)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def _words(page: Page, i: int) -> list[str]:
    return [w for name in page.names[i] for w in SPLIT.split(name) if w]


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for nodes of or around the article, 0 for the rest; None where the page names no article.

    A composed page marks its parts; any other is read by the names of its elements.
    """
    n = len(page.tag)
    inside, out = np.zeros(n, bool), np.zeros(n, np.int8)
    marked = any(page.marks)
    for i in range(1, n):
        if marked:
            begins, ends = page.marks[i] == "in", page.marks[i] == "out"
        else:
            begins = page.tag[i] in CONTENT
            ends = page.tag[i] in FRAME or page.tag[i] in HIDDEN or page.tag[i] == "form" or any(name in BAD_TOKENS for name in page.names[i])
        inside[i] = (inside[page.parent[i]] or begins) and not ends
        out[i] = inside[i]
    if not inside.any():
        return None
    for i in range(n - 1, 0, -1):
        out[page.parent[i]] |= out[i]
    return out


def features(page: Page, names: bool = True) -> np.ndarray:
    """One row a node; without ``names``, tags that name a part and attribute tokens are left out."""
    n, parent, tags = len(page.tag), page.parent, page.tag
    own, marks, signs, controls = ([0.0] * n for _ in range(4))
    begin = [0.0] * n
    at = 0
    for node, _, data in page.texts:
        size = len(data) - data.count(" ")
        own[node] += size
        at += size
        marks[node] += data.count(".") + data.count(",")
        signs[node] += data.count("|") + data.count("·") + data.count("©")
    for node in page.controls:
        controls[node] += 1
    in_link, depth, kids, order, block = [0.0] * n, [0.0] * n, [0] * n, [0.0] * n, [0] * n
    exact, part, good, frame, content = ([0.0] * n for _ in range(5))
    hashed = np.zeros((n, HASHED), np.float32)
    for i in range(1, n):
        p, tag = parent[i], tags[i]
        in_link[i] = 1.0 if tag == "a" else in_link[p]
        depth[i] = depth[p] + 1
        order[i] = kids[p]
        kids[p] += 1
        block[i] = block[p] if tag in INLINE else i
        if names:
            frame[i], content[i] = float(tag in FRAME), float(tag in CONTENT)
            if page.names[i]:
                exact[i] = float(any(x in BAD_TOKENS for x in page.names[i]))
                for w in _words(page, i):
                    part[i] += w in BAD_TOKENS
                    good[i] += w in GOOD_TOKENS
                    hashed[i, zlib.crc32(w.encode()) % HASHED] = 1
    chars, linked, heads, paragraphs, best = own[:], [o * x for o, x in zip(own, in_link, strict=True)], [0.0] * n, [0.0] * n, own[:]
    below, mains = [0.0] * n, content[:]
    for i in range(n):
        heads[i] = float(tags[i] == "h1")
        paragraphs[i] = float(tags[i] == "p")
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        signs[p] += signs[i]
        controls[p] += controls[i]
        paragraphs[p] += paragraphs[i]
        heads[p] += heads[i]
        mains[p] += mains[i]
        below[p] += below[i] + 1
        if best[i] > best[p]:
            best[p] = best[i]
    # names of an element that also holds an article element or the page's heading say little of what is in it
    told, framed, mained = [0.0] * n, [0.0] * n, [0.0] * n
    seen = [0.0] * n
    for i in range(1, n):
        p = parent[i]
        holds = (mains[i] - content[i]) > 0 or heads[i] > 0 and tags[i] != "h1" and paragraphs[i] > 1
        told[i] = told[p] + (0.0 if holds else 2 * exact[i] + (part[i] > exact[i]))
        framed[i] = max(framed[p], 0.0 if holds else frame[i])
        mained[i] = max(mained[p], content[i])
        begin[i] = seen[p]
        seen[p] += chars[i] or 1.0
        seen[i] = begin[i]
    c = np.array
    chars, own, linked, marks, signs, controls, paragraphs, best, below, kids, order, begin = (
        c(x, np.float64) for x in (chars, own, linked, marks, signs, controls, paragraphs, best, below, kids, order, begin)
    )
    total, up, around = max(chars[0], 1.0), np.maximum(c(parent), 0), c(block)
    some, siblings = np.maximum(chars, 1), np.maximum(kids[up], 1)
    kind = np.zeros((n, len(GROUPS)), np.float32)
    for i, t in enumerate(tags):
        for g, members in enumerate(GROUPS):
            if t in members or (g == 5 and not names and (t in FRAME or t in CONTENT)):
                kind[i, g] = 1
    link_share, mark_share = linked / some, marks / some
    mean = chars / np.maximum(paragraphs, 1)
    base = np.column_stack(
        [
            np.log1p(chars), np.log1p(own), chars / total, link_share, mark_share, signs / some, np.log1p(controls), controls / some,
            c(depth), np.log1p(below), chars / (below + 1), kids, order, order / siblings, siblings, chars / some[up],
            begin / total, np.log1p(chars[up]), chars[up] / total, link_share[up], mark_share[up], paragraphs, paragraphs[up], paragraphs[up] / siblings, np.log1p(best), np.log1p(best[up]),
            np.log1p(mean[up]), np.log1p(chars[around]), link_share[around], mark_share[around], c(in_link),
            c(exact), c(part), c(good), c(frame), c(content), c(told), c(framed), c(mained), c(heads), c(mains), c(exact)[up], c(good)[up], c(told)[up],
        ]
    )
    return np.hstack([base.astype(np.float32), kind, hashed])


FEATURES = 44 + len(GROUPS) + HASHED


def paragraphs_of(page: Page) -> list[str]:
    """The page's lines of running text, wherever they stand."""
    lines: dict[tuple, list[str]] = {}
    for node, block, data in page.texts:
        lines.setdefault((block,), []).append(data)
    joined = [" ".join("".join(x).split()) for x in lines.values()]
    return [x for x in joined if len(x) >= 40 and x.count(" ") >= 5]


# Names that page frames give to their parts, for composing pages to learn from.
SHELLS = "page wrapper container layout inner row col-8 site has-sidebar no-comments layout-sidebar-right with-header grid columns header-fixed".split()
CONTENT_NAMES = "post post-content entry-content article-body story article content main-content text blog-post page-body td-post single".split()
PLAIN_NAMES = "lead first intro note-free share-price comment-free lede big drop-cap sidebar-less header-image".split()
PARTS = {
    "nav": "nav menu navbar top-menu main-nav navigation breadcrumbs breadcrumb".split(),
    "side": "sidebar side-bar rail widget-area right-rail related related-posts recommended widget".split(),
    "notice": "notice cookie-notice cookie-banner consent alert banner disclaimer gdpr".split(),
    "advert": "ad ads advert ad-slot ad-box ad-unit ads-top sponsored promo banner-ad advertisement".split(),
    "comments": "comments comment-list reader-comments discussion replies respond comments-area".split(),
    "footer": "footer site-footer page-footer bottom copyright".split(),
    "header": "header site-header masthead top-bar page-header".split(),
    "share": "share social sharing share-buttons social-links tags".split(),
    "form": "newsletter signup subscribe login search-form feedback comment-form".split(),
}


def composed(paragraphs: list[str], spare: list[str], rng: random.Random) -> str:
    """A page of made-up frame around ``paragraphs``, with ``spare`` lines for the text of its other parts.

    Elements marked ``data-taught`` begin (in) or leave (out) the article.
    """
    words = " ".join(spare or paragraphs).split() or ["page"]

    def some(n: int) -> str:
        at = rng.randrange(len(words))
        return escape(" ".join(words[at : at + n]))

    def name(part: str, share: float = 0.85) -> str:
        if rng.random() > share:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(PARTS[part], rng.choice([1, 1, 2])))}"'

    def links(n: int) -> str:
        item = rng.choice(["<li><a href='/{0}'>{0}</a></li>", "<a href='/{0}'>{0}</a> ", "<a href='/{0}'>{0}</a> | ", "<p><a href='/{0}'>{0}</a></p>"])
        body = "".join(item.format(some(rng.randint(1, 5)).replace("'", "")) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def prose() -> str:
        return some(rng.randint(4, 40))

    def part(kind: str) -> str:
        tag = {"nav": "nav", "side": "aside", "footer": "footer", "header": "header"}.get(kind)
        named = name(kind, 0.85 if kind != "comments" else 1.0)
        tag = tag if tag and rng.random() < 0.6 else rng.choice(["div", "div", "section"] if named or kind == "nav" else ["div"])
        if not named and tag in ("div", "section") and kind in ("side", "footer", "header"):
            named = name(kind, 1.0)
        inner = {
            "nav": lambda: links(rng.randint(2, 9)),
            "side": lambda: "".join(rng.choice([f"<h3>{some(3)}</h3>", links(rng.randint(2, 6)), f"<p>{prose()}</p>", f"<div>{prose()}</div>"]) for _ in range(rng.randint(1, 4))),
            "notice": lambda: rng.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(prose()) + rng.choice(["", "<button>ok</button>", "<a href='/x'>more</a>"]),
            "advert": lambda: rng.choice(["{}", "<p>{}</p>", "<a href='/ad'>{}</a>"]).format(some(rng.randint(3, 15))),
            "comments": lambda: f"<h{rng.choice('234')}>{some(2)}</h3>" + "".join(rng.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li>{} <p>{}</p></li>", "<p>{}: {}</p>"]).format(some(1), prose()) for _ in range(rng.randint(1, 6))),
            "footer": lambda: rng.choice(["", links(rng.randint(2, 6))]) + rng.choice(["<p>© {}</p>", "{}", "<small>© {}</small>"]).format(some(rng.randint(2, 20))),
            "header": lambda: rng.choice(["<h1>{}</h1>", "<a href='/'>{}</a>", "<p>{}</p>", "{}"]).format(some(rng.randint(1, 5))) + rng.choice(["", links(3)]),
            "share": lambda: links(rng.randint(1, 4)),
            "form": lambda: f"<label>{some(2)}</label><input name='q'>" + rng.choice(["", f"<p>{prose()}</p>"]) + "<button>go</button>",
        }[kind]()
        if kind == "form":
            tag = "form"
        return f'<{tag}{named} data-taught="out">{inner}</{tag}>'

    body = []
    for i, line in enumerate(paragraphs):
        text = escape(line)
        if rng.random() < 0.15:
            cut = line.split(" ")
            at = rng.randrange(len(cut))
            cut[at] = f"<{(t := rng.choice(['b', 'em', 'a href=/in', 'span class=hl']))}>{escape(cut[at])}</{t.split()[0]}>"
            text = " ".join(x if x.startswith("<") else escape(x) for x in cut)
        plain = f' class="{rng.choice(PLAIN_NAMES)}"' if rng.random() < 0.15 else ""
        form = rng.choice(["p"] * 12 + ["div", "li", "quote", "cell", "raw"])
        body.append({"p": f"<p{plain}>{text}</p>", "div": f"<div{plain}>{text}</div>", "li": f"<ul><li>{text}</li><li>{some(6)}</li></ul>", "quote": f"<blockquote>{text}</blockquote>", "cell": f"<table><tr><td>{some(2)}</td><td>{text}</td></tr></table>", "raw": f"{text}<br><br>"}[form])
        if rng.random() < 0.12:
            body.append(f"<h{rng.choice('2234')}>{some(rng.randint(1, 6))}</h3>")
        if i and rng.random() < 0.12:
            body.append(part(rng.choice(["advert", "share", "side", "form", "notice"])))
    title = f"<h1>{some(rng.randint(1, 8))}</h1>" if rng.random() < 0.8 else ""
    if title and rng.random() < 0.2:
        title = f"<{(t := rng.choice(['header', 'div class=entry-header']))} data-taught='in'>{title}</{t.split()[0]}>"
    holder = rng.choice(["article", "article", "main", "main", "div", "div", "div", "section"])
    named = f' {rng.choice(["class", "class", "id"])}="{rng.choice(CONTENT_NAMES)}"' if rng.random() < (0.9 if holder in ("div", "section") else 0.4) else ""
    article = f'<{holder}{named} data-taught="in">{title}{"".join(body)}</{holder}>'
    if holder == "article" and rng.random() < 0.3:
        article = f"<main>{article}</main>"
    before = [part(k) for k in ("notice", "header", "nav", "advert", "form", "side") if rng.random() < 0.45]
    after = [part(k) for k in ("share", "side", "comments", "advert", "form", "nav", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    inside = rng.randint(0, len(before)), rng.randint(0, len(after))
    page = "".join(before[inside[0] :]) + article + "".join(after[: inside[1]])
    for _ in range(rng.randint(0, 3)):
        page = f'<div{rng.choice(["", f" class={chr(34)}{rng.choice(SHELLS)}{chr(34)}"])}>{page}</div>'
    page = "".join(before[: inside[0]]) + page + "".join(after[inside[1] :])
    if rng.random() < 0.1:
        page = f"<form method=post>{page}<input name=state></form>"
    shell = f' class="{" ".join(rng.sample(SHELLS, 2))}"' if rng.random() < 0.3 else ""
    return f"<html><head><title>{some(4)}</title></head><body{shell}>{page}</body></html>"


class BoostedTrees:
    """Logistic gradient boosting with shallow trees on binned features."""

    def __init__(self) -> None:
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        cuts = [c if len(c) else np.zeros(1) for c in cuts]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut, leaf = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(y), np.int64)
            for level in range(depth):
                found = self._splits(binned, leaf, g, h, 2**level, bins)
                for node, (gain, f, b) in enumerate(found):
                    if gain > 1e-6 and b < len(cuts[f]):
                        feature[2**level - 1 + node], cut[2**level - 1 + node] = f, cuts[f][b]
                leaf = leaf * 2 + (x[np.arange(len(y)), feature[2**level - 1 + leaf]] > cut[2**level - 1 + leaf])
            sums = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
            value = -rate * sums[0] / (sums[1] + 1)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    @staticmethod
    def _splits(binned: np.ndarray, leaf: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int) -> list[tuple[float, int, int]]:
        """The best (gain, feature, bin) of each node of a level."""
        best = [(0.0, 0, 0)] * nodes
        for f, column in enumerate(binned):
            slot = leaf * (bins + 1) + column
            gs, hs = (np.cumsum(np.bincount(slot, w, nodes * (bins + 1)).reshape(nodes, -1), axis=1) for w in (g, h))
            whole = gs[:, -1] ** 2 / (hs[:, -1] + 1)
            gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - whole[:, None]
            at = gain[:, :-1].argmax(axis=1)
            for node in range(nodes):
                if gain[node, at[node]] > best[node][0]:
                    best[node] = (float(gain[node, at[node]]), f, int(at[node]))
        return best

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for level in range(len(value).bit_length() - 1):
                node = 2**level - 1 + leaf
                leaf = leaf * 2 + (x[rows, feature[node]] > cut[node])
            margin += value[leaf]
        return margin


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which every kept node's parent is kept too."""
    parent = page.parent
    gain = margin.tolist()  # of keeping the node, over dropping its subtree
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    kept = [g > 0 for g in gain]
    for i in range(1, len(parent)):
        kept[i] = kept[i] and kept[parent[i]]
    return np.array(kept)


def lessons(html: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) that a page teaches: as it is, without names, and its paragraphs in made-up frames."""
    page, rng = Page(html), random.Random(zlib.crc32(html.encode()))
    labels = weak_labels(page)
    pairs = [] if labels is None else [(features(page), labels), (features(page, names=False), labels)]
    lines = paragraphs_of(page)
    for _ in range(COMPOSED if len(lines) > 1 else 0):
        rng.shuffle(lines)
        at = rng.randint(1, len(lines) - 1)
        other = Page(composed(lines[:at][:12], lines[at:], rng))
        pairs.append((features(other), weak_labels(other)))
    for x, y in pairs:
        taken = rng.sample(range(len(y)), TAUGHT_NODES) if len(y) > TAUGHT_NODES else range(len(y))
        yield x[list(taken)], y[list(taken)]


def _samples():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for html in rows.html:
                for x, y in lessons(html):
                    yield pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()]})

    return run


def _extracted(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = model.value
        for rows in batches:
            texts = []
            for lo in range(0, len(rows), 64):
                pages = [Page(h if h is not None else "") for h in rows.html.iloc[lo : lo + 64]]
                ends = np.cumsum([0] + [len(p.tag) for p in pages])
                margin = trees.log_odds(np.vstack([features(p) for p in pages]))
                texts += [p.text(decode(p, margin[a:b])) for p, a, b in zip(pages, ends[:-1], ends[1:], strict=True)]
            yield rows.assign(text=texts).drop(columns="html")

    return run


def extract_main_text(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """``(doc, text)``: each row of ``pages`` as a struct without its html, and its article as lines of text.

    The trees are fitted on ``sample`` distinct pages, those of the smallest hash of their html, and of each on at most
    ``TAUGHT_NODES`` nodes a layout. Cases: null, empty and tag-free html, and a page without an article, give what
    the trees keep of their text, which may be empty; repeated rows are extracted alike, and a page copied often
    teaches once; if no page has a line of text, every node is kept; extra columns stay in ``doc``, so their names
    cannot clash; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    html = F.col(f"`{html_col}`").cast("string")
    named = [c for c in pages.columns if c != html_col]
    rows = pages.select((F.struct(*[F.col(f"`{c}`") for c in named]) if named else F.struct(F.lit(0).alias("row"))).alias("doc"), html.alias("html"))
    key = F.xxhash64("html")
    distinct = rows.where(F.col("html").isNotNull()).select(key.alias("key")).agg(F.approx_count_distinct("key")).first()[0]
    # the share of the hash range that holds twice the sample, so that few rows are sorted and copies fall together
    bound = min((1 << 63) - 1, int(min(1.0, 2 * sample / max(distinct, 1)) * (1 << 64)) - (1 << 63))
    drawn = rows.where(F.col("html").isNotNull() & (key <= bound)).select(key.alias("key"), "html").dropDuplicates(["key"])
    taught = drawn.orderBy("key").limit(sample).select("html").mapInPandas(_samples(), "x binary, y binary").collect()
    trees = BoostedTrees()
    if taught:
        x = np.vstack([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in taught])
        trees.fit(x, np.concatenate([np.frombuffer(r.y, np.int8) for r in taught]).astype(float))
    else:
        trees.bias = 1.0
    return rows.mapInPandas(_extracted(spark.sparkContext.broadcast(trees)), f"doc {rows.schema['doc'].dataType.simpleString()}, text string")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("doc.page_id", "doc.url", "text", F.length("text").cast("long").alias("n_chars"))
