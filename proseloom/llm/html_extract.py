"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the tree.

Each element is a node. Trees score whether a node belongs to the article, from its tag, its
attribute tokens, its depth and place among its siblings, and how dense its subtree is in text, links
and tags. A child can only be kept if its parent is: decoding finds the labelling of the
whole tree that is likeliest under that rule, so no choice contradicts another above or below it.

The model is trained on pages this module composes itself, whose article nodes are known.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm._words import slices, utf8

# Fixed values of the HTML syntax.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("head script style noscript template svg math iframe object embed canvas audio video form button select textarea input option".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption nav header footer aside form a span b i em strong dl dt dd img label button details summary".split()

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PIECE = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
#: Attribute tokens are hashed to so many columns; the named ones have one of their own besides.
HASHED = 24
GOOD = "article content main body post entry story text prose".split()
BAD = "nav menu header footer sidebar side comment comments reply discussion ad ads advert banner sponsor promo cookie consent notice popup modal newsletter subscribe share social related recommended breadcrumb pagination widget login search form copyright tags meta".split()


class _Tags:
    """Where tags end. Each position is looked at a bounded number of times, whatever is left open."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.unquoted = -1  # up to here quotes mean nothing, as one of them is never closed

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1: none does."""
        if at > self.last[">"]:
            return -1
        start = at
        while start > self.unquoted and (found := _STOP.search(self.source, at)):
            quote = found[0]
            if quote == ">":
                return found.start()
            if found.start() == self.last[quote]:
                self.unquoted = found.start()
                break
            at = self.source.find(quote, found.end()) + 1
        else:
            self.unquoted = max(self.unquoted, len(self.source) if start > self.unquoted else -1)
        return self.source.find(">", start)


class _Open:
    """The open elements, and for each tag, for blocks and for barriers where they stand among them."""

    BARRIERS = frozenset("article section main td th table div body".split())

    def __init__(self):
        self.elements, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {"#block": [], "#barrier": []}

    def _kinds(self, tag: str) -> list[str]:
        return [tag, *(["#block"] if tag not in INLINE else []), *(["#barrier"] if tag in self.BARRIERS else [])]

    def last(self, *kinds: str) -> int:
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=-1)

    def push(self, element: int, tag: str) -> None:
        for k in self._kinds(tag):
            self.places.setdefault(k, []).append(len(self.elements))
        self.elements.append(element)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        """Closes the elements from this place on."""
        while len(self.elements) > place:
            self.elements.pop()
            for k in self._kinds(self.tags.pop()):
                self.places[k].pop()


class Dom:
    """Elements in page order: tag, parent, attribute tokens, and text runs (element, place among all, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.hidden = ["#root"], [-1], [()], [False]
        self.runs: list[tuple[int, str]] = []
        open_, tags = _Open(), _Tags(source)
        at, text, end = 0, 0, len(source)  # text: where the run of text began
        while at < end:
            found = source.find("<", at)
            if found < 0:
                break
            name, stop = None, -1
            if source.startswith("<!--", found):
                stop = source.find("-->", found + 4)
                stop = end if stop < 0 else stop + 3
            elif source.startswith(("<!", "<?"), found):
                stop = source.find(">", found) + 1 if found < tags.last[">"] else -1
            elif name := _NAME.match(source, found):
                stop = tags.end(name.end()) + 1
            if stop <= 0:  # no markup
                at = found + 1
                continue
            self._text(open_, source[text:found])
            at = text = stop
            if not name:
                continue
            tag, attributes = name[2].lower(), source[name.end() : stop - 1]
            if name[1]:
                self._close(open_, tag)
                continue
            self._imply(open_, tag)
            self._add(open_.elements[-1], tag, attributes)
            if tag == "br":
                self.runs.append((open_.elements[-1], "\n"))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                if tag == "textarea":
                    self.runs.append((len(self.tag) - 1, html.unescape(source[at : close.start() if close else end])))
                at = text = (source.find(">", close.end()) + 1 or end) if close else end
            elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "g", "use", "circle", "rect", "line")):
                open_.push(len(self.tag) - 1, tag)
        self._text(open_, source[text:])

    def _text(self, open_: _Open, text: str) -> None:
        if text:
            self.runs.append((open_.elements[-1], html.unescape(text)))

    def _add(self, parent: int, tag: str, attributes: str) -> None:
        tokens: list[str] = []
        hidden = False
        if attributes and not attributes.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                name = name.lower()
                hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(_HIDDEN.search(value))
                if name not in ("style", "hidden", "aria-hidden"):
                    tokens += _PIECE.findall(value)
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tuple(tokens))
        self.hidden.append(hidden)

    def _close(self, open_: _Open, tag: str) -> None:
        place = open_.last(tag)
        if place > 0 and not (tag in INLINE and open_.last("#barrier") > place):
            open_.cut(place)

    def _imply(self, open_: _Open, tag: str) -> None:
        """Ends what a start tag ends: a paragraph before a block, an item before the next, the head before the body."""
        if tag in CLOSES_P:
            if 0 < (place := open_.last("p")) == open_.last("#block"):
                open_.cut(place)
        elif tag in CLOSES:
            ends, within = CLOSES[tag]
            if (place := open_.last(*ends.split())) > open_.last(*within) and place > 0:
                open_.cut(place)
        if tag == "body" and open_.places.get("head"):
            open_.cut(open_.places["head"][0])


NUMBERS = ("depth", "place", "siblings", "same", "children", "chars", "share", "link", "tags", "blocks", "stops", "before", "mean", "good", "bad", "bad_above", "good_above", "article_above", "hidden")
WIDTH = len(NUMBERS) + len(TAGS) + HASHED + 2


def features(dom: Dom) -> np.ndarray:
    """One row of WIDTH numbers for each element."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    chars, links, stops, before = (np.zeros(n) for _ in range(4))
    total = 0
    for element, text in dom.runs:
        if dom.tag[element] in NEVER or dom.tag[element] in RAW:
            continue
        size = len(text) - text.count(" ") - text.count("\n")
        chars[element] += size
        stops[element] += text.count(".") + text.count(",")
        total += size
    in_link = np.zeros(n, bool)
    depth, place, same = np.zeros(n), np.zeros(n), np.zeros(n)
    seen: dict[tuple[int, str], int] = {}
    children, tags = np.zeros(n), np.ones(n)
    good, bad, article = np.zeros(n), np.zeros(n), np.zeros(n)
    above = np.zeros((n, 3))
    out = np.zeros((n, WIDTH), np.float32)
    for i in range(n):
        p = parent[i]
        tokens = dom.tokens[i]
        good[i] = sum(t in GOOD for t in tokens) + (dom.tag[i] in ("article", "main"))
        bad[i] = sum(t in BAD for t in tokens) + (dom.tag[i] in ("nav", "header", "footer", "aside", "form"))
        article[i] = dom.tag[i] in ("article", "main")
        if p >= 0:
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            seen[p, dom.tag[i]] = same[i] = seen.get((p, dom.tag[i]), -1) + 1
            in_link[i] = in_link[p] or dom.tag[i] == "a"
            above[i] = above[p] + (bad[p], good[p], article[p])
        if dom.tag[i] in TAGS:
            out[i, len(NUMBERS) + TAGS.index(dom.tag[i])] = 1
        for t in tokens:
            out[i, len(NUMBERS) + len(TAGS) + zlib.crc32(t.encode()) % HASHED] = 1
        out[i, -2] = len(tokens)
        out[i, -1] = dom.tag[i] in INLINE
    before = np.cumsum(chars) - chars
    links[in_link] = chars[in_link]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
        tags[p] += tags[i]
    up = np.maximum(parent, 0)
    total = max(total, 1)
    numbers = (depth, place, children[up] - 1, np.array([seen.get((p, t), 0) for p, t in zip(dom.parent, dom.tag, strict=True)]), children, np.log1p(chars), chars / total, links / np.maximum(chars, 1), chars / tags, tags, stops / np.maximum(chars, 1) * 100, before / total, chars / np.maximum(children, 1), good, bad, above[:, 0], above[:, 1], above[:, 2], np.array(dom.hidden))
    out[:, : len(NUMBERS)] = np.stack(numbers, 1)
    return out


class Trees:
    """Gradient-boosted regression trees for a logistic loss, over at most 32 bins for each feature."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, leaf: float = 8.0):
        self.rounds, self.depth, self.rate, self.leaf = rounds, depth, rate, leaf
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 32)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        width, size = 33, 1 << self.depth
        self.feature = np.zeros((self.rounds, size), np.int64)
        self.cut = np.full((self.rounds, size), np.inf, np.float32)
        self.value = np.zeros((self.rounds, size))
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                n = 1 << level
                at = ((node[:, None] * x.shape[1] + np.arange(x.shape[1])) * width + bins).ravel()
                of = lambda v: np.bincount(at, np.repeat(v, x.shape[1]), n * x.shape[1] * width).reshape(n, x.shape[1], width).cumsum(2)  # noqa: B023,E731
                gl, hl = of(g), of(h)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.leaf / 8) | (ht - hl < self.leaf / 8)] = 0
                best = gain.reshape(n, -1).argmax(1)
                f, b = best // width, best % width
                useful = gain.reshape(n, -1).max(1) > 1e-9
                self.feature[r, first : first + n] = f
                self.cut[r, first : first + n] = [edges[f_][b_] if ok and b_ < len(edges[f_]) else np.inf for f_, b_, ok in zip(f, b, useful, strict=True)]
                node = 2 * node + (x[np.arange(len(y)), f[node]] > self.cut[r, first + node])
            leaf_g, leaf_h = np.bincount(node, g, size), np.bincount(node, h, size)
            self.value[r] = self.rate * leaf_g / (leaf_h + 1)
            score += self.value[r][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def composed(number: int) -> str:
    """A made-up page; elements that lead to or belong to the article have the attribute ``data-main``."""
    rng = np.random.default_rng(number)
    pick = lambda *x: x[rng.integers(len(x))]
    syllables = "ka lo mi ren tas ul vor ba ni sel dra quo fe hin pol".split()
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.integers(lo, hi)))
    sentence = lambda: words(4, 22).capitalize() + pick(".", ".", ".", "!", "?", "")
    prose = lambda lo, hi: " ".join(sentence() for _ in range(rng.integers(lo, hi)))
    m = " data-main"

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            return pick(f"<nav>{links(rng.integers(2, 9))}</nav>", f'<div class="{pick("menu", "navbar nav", "main-menu", "breadcrumb")}">{links(rng.integers(2, 9))}</div>', f'<div id="nav">{" | ".join(f"<a href=x>{word()}</a>" for _ in range(6))}</div>')
        if kind == "header":
            return pick(f"<header><a href=/>{words(1, 3)}</a><p>{words(3, 9)}</p></header>", f'<div class="site-header">{words(1, 5)}</div>', f'<div id="header"><h1>{words(1, 3)}</h1></div>')
        if kind == "footer":
            return pick(f"<footer>&copy; {words(1, 4)}</footer>", f'<div class="footer"><p>{prose(1, 3)}</p>{links(4)}</div>', f'<div id="footer">{words(3, 12)}</div>')
        if kind == "aside":
            return pick(f"<aside><h3>{words(1, 3)}</h3>{links(5)}</aside>", f'<div class="{pick("sidebar", "related", "widget", "recommended")}"><h3>{words(1, 4)}</h3><p>{prose(1, 4)}</p></div>', f'<aside><p>{prose(1, 6)}</p></aside>')
        if kind == "ad":
            return pick(f'<div class="{pick("ad", "ads", "advert", "banner", "promo", "sponsor")}">{pick(words(2, 12), prose(1, 4))}</div>', f'<div class="ad"><p>{prose(1, 4)}</p></div>', f'<section class="promo-banner"><a href=x>{sentence()}</a></section>')
        if kind == "notice":
            return f'<div class="{pick("cookie-notice", "consent", "notice", "popup modal", "newsletter")}"><p>{prose(1, 4)}</p><button>{word()}</button></div>'
        if kind == "form":
            return f"<form action=x><label>{words(1, 3)}</label><input name=q><button>{word()}</button><p>{words(2, 9)}</p></form>"
        if kind == "share":
            return f'<div class="{pick("share", "social", "tags", "meta", "pagination")}">{links(rng.integers(2, 5))}</div>'
        each = "".join(pick(f'<div class="comment"><b>{word()}</b><p>{prose(1, 6)}</p></div>', f"<li><p>{prose(1, 4)}</p></li>") for _ in range(rng.integers(1, 8)))
        return f'<{pick("section", "div")} {pick("class", "id")}="{pick("comments", "discussion", "comment-list", "reader-comments")}"><h2>{words(1, 3)}</h2>{each}</div>'

    def block() -> str:
        kind = rng.integers(14)
        inline = pick("", "", f" <b{m}>{words(1, 3)}</b> ", f' <a{m} href="/x">{words(1, 4)}</a> ', f"<em{m}>{word()}</em>")
        if kind == 0:
            return f"<h2{m}>{words(1, 7)}</h2>"
        if kind == 1:
            tag = pick("ul", "ol")
            return f"<{tag}{m}>" + "".join(f"<li{m}>{sentence()}</li>" for _ in range(rng.integers(2, 6))) + f"</{tag}>"
        if kind == 2:
            return f"<blockquote{m}><p{m}>{prose(1, 3)}</p></blockquote>"
        if kind == 3:
            return f"<p{m}><b{m}>{words(2, 9)}.<br{m}>"
        if kind == 4:
            return f"<table{m}>" + "".join(f"<tr{m}><td{m}>{word()}</td><td{m}>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == 5:
            return f"<figure{m}><img{m} src=x><figcaption{m}>{sentence()}</figcaption></figure>"
        if kind == 6:
            return f"<div{m}>{prose(1, 5)}</div>"
        if kind == 7:
            return f"<pre{m}>{words(3, 20)}</pre>"
        return f"<p{m}>{sentence() if rng.random() < 0.3 else prose(1, 9)}{inline}</p>"

    title = pick(f"<h1{m}>{words(2, 9)}</h1>", f"<h1{m}>{words(2, 9)}</h1>", f"<header{m}><h1{m}>{words(2, 9)}</h1></header>", "")
    body = [block() for _ in range(rng.integers(1, 18))]
    for kind in ("ad", "share", "aside", "form"):
        if rng.random() < 0.2:
            body.insert(rng.integers(len(body) + 1), boilerplate(kind))
    inner = title + "".join(body)
    end = boilerplate("comments") if rng.random() < 0.4 else ""
    inside = rng.random() < 0.4
    inner += end * inside
    shell = rng.integers(6)
    if shell <= 2:
        article = f"<article{m}>{inner}</article>"
    elif shell == 3:
        article = f'<div{m} class="{pick("content", "post-body", "entry-content", "article-text", "story")}">{inner}</div>'
    elif shell == 4:
        article = f"<main{m}><article{m}>{inner}</article></main>"
    else:
        article = f'<div{m} id="{pick("page", "wrap", "c", "x1")}">{inner}</div>'
    if rng.random() < 0.3:
        article = f"<div{m} class=\"{pick('wrapper', 'container', 'row', 'layout')}\">{boilerplate('aside') if rng.random() < 0.5 else ''}{article}{boilerplate('aside') if rng.random() < 0.4 else ''}</div>"
    chance = lambda kind, p: boilerplate(kind) if rng.random() < p else ""
    return (
        f"<!DOCTYPE html><html{m}><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body{m}>"
        + chance("notice", 0.3) + chance("header", 0.4) + chance("nav", 0.8) + chance("ad", 0.5) + article + chance("aside", 0.3)
        + end * (not inside) + chance("ad", 0.2) + chance("form", 0.2) + chance("share", 0.3) + chance("footer", 0.8) + "</body></html>"
    )


def _marked(source: str) -> tuple[Dom, np.ndarray]:
    dom = Dom(re.sub(r" data-main", " itemprop=zzmain", source))
    is_main = np.array([1.0] + ["zzmain" in t for t in dom.tokens[1:]])
    dom.tokens = [tuple(x for x in t if x != "zzmain") for t in dom.tokens]
    return dom, is_main


@lru_cache(maxsize=2)
def model(pages: int = 500) -> Trees:
    """Trees trained on the first ``pages`` composed pages."""
    x, y = [], []
    for number in range(pages):
        dom, is_main = _marked(composed(number))
        x.append(features(dom))
        y.append(is_main)
    return Trees().fit(np.concatenate(x), np.concatenate(y))


def decoded(dom: Dom, odds: np.ndarray) -> np.ndarray:
    """The likeliest set of kept elements in which every kept element's parent is kept."""
    n = len(odds)
    gain = np.where([dom.tag[i] in NEVER or dom.hidden[i] for i in range(n)], -1e9, odds)
    best = gain.copy()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[dom.parent[i]] += best[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[dom.parent[i]] and best[i] > 0
    return keep


def text_of(dom: Dom, keep: np.ndarray) -> str:
    """Kept text: runs of one block joined, white space made single, blocks in page order joined by a line feed."""
    block_of = list(range(len(dom.tag)))
    for i in range(1, len(dom.tag)):
        if dom.tag[i] in INLINE:
            block_of[i] = block_of[dom.parent[i]]
    last_block, parts, blocks = -1, [], []
    for element, text in dom.runs:
        if not keep[element] or dom.tag[element] in RAW:
            continue
        block = block_of[element]
        if block != last_block:
            blocks.append("".join(parts))
            parts, last_block = [], block
        parts.append(text)
    blocks.append("".join(parts))
    return "\n".join(x for b in blocks if (x := _SPACE.sub(" ", b).strip()))


def extracted(pages: DataFrame, train_pages: int = 500) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``; a null or empty html has an empty text."""
    trees = pages.sparkSession.sparkContext.broadcast(model(train_pages))  # a few thousand numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi in slices(utf8(batch.column(2))[1]):
                doms = [Dom(h) for h in batch.column(2).slice(lo, hi - lo).to_pylist()]
                odds = trees.value.score(np.concatenate([features(d) for d in doms]))
                at = np.cumsum([0, *(len(d.tag) for d in doms)])
                out += [text_of(d, decoded(d, odds[a:b])) for d, a, b in zip(doms, at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return read.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
