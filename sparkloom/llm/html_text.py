"""Main text of web pages by boosted trees over the nodes of the document tree.

A page is read into block elements and the runs of text between block
boundaries.  Every node has features: its tag's kind, tokens of its class, id
and role and those of its ancestors, depth, text, link and tag density of its
subtree, its place and its share among its siblings.  Boosted trees give a
log odds for "holds main text".  Decoding picks the rooted subtree of the
highest total: a node below a dropped one is dropped, and a container without
kept text is too, so ancestor and descendant never contradict each other.

The trees are trained on pages from a seeded generator of layouts, with and
without semantic tags, whose main text is known.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .boosting import BoostedTrees
from .common import chunks, read

#: Generated pages that the trees are trained on, and the generator's seed.
TRAINING_PAGES, SEED = 1200, 7

# HTML's elements by what they do to a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg canvas audio video head title select textarea".split())
#: What an open head may hold; anything else ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"button", "caption", "dd", "dt", "legend", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl menu table select".split())
BARRIERS = frozenset("table ul ol dl menu article section div body html td th".split())

# Words in class, id and role that speak for and against main text.
GOOD = frozenset("article articlebody body content entry hentry main markdown page post prose story text".split())
BAD = frozenset(
    "ad ads advert advertisement aside banner bar bio breadcrumb breadcrumbs byline combx comment comments community consent cookie cookies copyright "
    "credits crumbs dialog discussion disqus disclaimer dropdown foot footer form gdpr head header legal links login masthead menu meta modal nav navbar "
    "navigation newsletter notice pager pagination popup privacy promo recommended register related replies reply respond rss search share shoutbox "
    "sidebar signup social sponsor sponsored subscribe tags toolbar tools topbar widget widgets".split()
)
KINDS = {
    **dict.fromkeys(("article", "main"), 1),
    **dict.fromkeys(("nav", "aside", "footer", "menu", "dialog", "search"), 2),
    "header": 3,
    **dict.fromkeys(("form", "button", "fieldset"), 4),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 5),
    **dict.fromkeys(("p", "pre", "blockquote"), 6),
    **dict.fromkeys(("ul", "ol", "dl", "li", "dt", "dd"), 7),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th"), 8),
    **dict.fromkeys(("div", "section", "center"), 9),
}
TEXT_KIND = 10

#: A tag whose quotes all stand around values; anything else is read attribute by attribute.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"'=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)[^>\"'=]*+)*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_NAME = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?(\s*+=\s*+)?")
_VALUE = re.compile(r"[^\s>]*+")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|aria-label|itemprop)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", re.I)
_TOKEN = re.compile(r"[a-z]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}

#: Attribute texts up to this length are worth keeping with their tokens.
CACHED_ATTRIBUTES = 300


def _name_tokens(attributes: str) -> tuple[int, int]:
    """Good and bad tokens among an element's names."""
    found = set(_TOKEN.findall(" ".join(_NAMES.findall(attributes)).lower()))
    return len(found & GOOD), len(found & BAD)


_cached_tokens = functools.lru_cache(maxsize=50_000)(_name_tokens)


def _tokens(attributes: str) -> tuple[int, int]:
    return _cached_tokens(attributes) if len(attributes) <= CACHED_ATTRIBUTES else _name_tokens(attributes)


def _tag_end(source: str, at: int) -> int:
    """Place after the > that ends a tag whose attributes start at `at`; the text's end if none does.

    A quote opens a value only right after an equals sign, as in HTML.
    """
    while True:
        m = _NAME.match(source, at)
        at = m.end()
        if at >= len(source):
            return at
        if source[at] == ">":
            return at + 1
        if m.group(2) is None:
            continue
        if source[at] in "\"'":
            at = source.find(source[at], at + 1) + 1
            if not at:
                return len(source)
        else:
            at = _VALUE.match(source, at).end()


def markup(source: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """(text, tag, closing, attributes, place after it) for a page's parts; either text or tag is empty.

    Every character is looked at a bounded number of times, whatever is left
    open.  Comments, declarations and a tag that the page ends in are left out.
    The reader may send a place to go on from.
    """
    at, end = 0, len(source)
    while at < end:
        if source[at] != "<":
            stop = source.find("<", at)
            stop = end if stop < 0 else stop
            yield source[at:stop], "", False, "", stop
            at = stop
            continue
        m = _TAG.match(source, at)
        if m:
            at = m.end()
            go = yield "", m.group(2).lower(), bool(m.group(1)), m.group(3), at
            at = at if go is None else go
            continue
        m = _START.match(source, at)
        if m:
            begin, at = m.end(), _tag_end(source, m.end())
            if source[at - 1] != ">" or at == begin:
                return
            go = yield "", m.group(2).lower(), bool(m.group(1)), source[begin : at - 1], at
            at = at if go is None else go
        elif source.startswith("<!--", at):
            short = next((k for k in (">", "->") if source.startswith(k, at + 4)), None)
            stop = at + 4 + len(short) if short else source.find("-->", at + 4) + 3
            at = stop if stop > at + 3 else end
        elif source.startswith(("<!", "<?", "</"), at):
            at = source.find(">", at) + 1 or end
        else:
            yield "<", "", False, "", at + 1
            at += 1


class Forest:
    """The nodes of many pages as columns; parents come before their children."""

    def __init__(self) -> None:
        self.page: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.good: list[int] = []
        self.bad: list[int] = []
        self.linked: list[int] = []
        self.text: list[str | None] = []

    def _node(self, page: int, parent: int, kind: int, names: tuple[int, int], text: str | None = None, linked: int = 0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.good.append(names[0])
        self.bad.append(names[1])
        self.text.append(text)
        self.linked.append(linked)
        return len(self.page) - 1

    def read(self, page: int, source: str) -> None:
        """Add a page's tree."""
        root = self._node(page, -1, 0, (0, 0))
        open_tags, open_nodes = ["html"], [root]
        places: dict[str, list[int]] = {"html": [0]}
        pieces: list[str] = []
        linked = links = silent = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self._node(page, open_nodes[-1], TEXT_KIND, (0, 0), text, min(linked, len(text)))
                pieces.clear()
                linked = 0

        def close(tag: str) -> None:
            """End the innermost open element of that name, and all within it."""
            nonlocal links, silent
            while True:
                top = open_tags.pop()
                places[top].pop()
                if top in BLOCKS:
                    flush()
                    open_nodes.pop()
                links -= top == "a"
                silent -= top in SILENT
                if top == tag:
                    return

        def innermost(tags: frozenset[str] | tuple[str, ...]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        def within(tags: tuple[str, ...], stop: frozenset[str]) -> str | None:
            """The innermost open one of the tags, unless a stop lies inside it."""
            at = innermost(tags)
            return open_tags[at] if at > innermost(stop) else None

        parts, go = markup(source), None
        while True:
            try:
                text, tag, closing, attributes, at = parts.send(go)
            except StopIteration:
                break
            go = None
            if not tag:
                if open_tags[-1] == "head" and text.strip():
                    close("head")
                if not silent:
                    pieces.append(text)
                    linked += len(text) if links else 0
                continue
            if closing:
                if places.get(tag) and tag != "html":
                    close(tag)
                elif tag == "br":
                    pieces.append(" ")
                continue
            if places.get("head") and tag not in HEAD:
                close("head")
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif not silent:
                    pieces.append(" ")
                continue
            if tag in ("html", "body") and places.get(tag):
                continue
            if tag in CLOSES_P and within(("p",), BARRIERS):
                close("p")
            while tag in SAME and (old := within(SAME[tag], LISTS)):
                close(old)
            if tag in RAW:
                stop = _RAW_ENDS[tag].search(source, at)
                go = (source.find(">", stop.start()) + 1 or len(source)) if stop else len(source)
                continue
            if attributes.endswith("/") and tag not in BLOCKS and tag not in SILENT and tag != "a":
                continue
            if tag in BLOCKS:
                flush()
                node = self._node(page, open_nodes[-1], KINDS.get(tag, 0), _tokens(attributes) if attributes else (0, 0))
                open_nodes.append(node)
            places.setdefault(tag, []).append(len(open_tags))
            open_tags.append(tag)
            links += tag == "a"
            silent += tag in SILENT
        flush()

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), np.int64) for k in ("page", "parent", "depth", "kind", "good", "bad", "linked")}


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Rows of each depth, from the roots down."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def node_features(forest: Forest) -> np.ndarray:
    a = forest.arrays()
    n, parent, kind = len(a["page"]), a["parent"], a["kind"]
    up = np.maximum(parent, 0)
    levels = _levels(a["depth"])
    texts = forest.text
    chars = np.fromiter((len(t) if t else 0 for t in texts), np.float64, n)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.float64, n)
    marks = np.fromiter((t.count(".") + t.count(",") if t else 0 for t in texts), np.float64, n)
    sums = np.stack([chars, words, marks, a["linked"].astype(float), (chars > 0).astype(float), np.ones(n), (kind == 6).astype(float)])
    own = np.stack([kind == 1, kind == 2, kind == 3, kind == 4, a["good"] > 0, a["bad"] > 0]).astype(float)
    above = np.zeros_like(own)
    for rows in levels[:0:-1]:
        for s in sums:
            np.add.at(s, parent[rows], s[rows])
    for rows in levels[1:]:
        above[:, rows] = np.maximum(above[:, parent[rows]], own[:, parent[rows]])
    total, word, mark, link, runs, nodes, paragraphs = sums
    root = np.zeros(int(a["page"].max()) + 1 if n else 0, np.int64)
    root[a["page"][levels[0]]] = levels[0]
    page_total = np.maximum(total[root[a["page"]]], 1)
    before = np.cumsum(chars) - chars
    start = (before - before[root[a["page"]]]) / page_total
    siblings = np.bincount(up[parent >= 0], minlength=n)[up]
    order = np.argsort(up, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(up, minlength=n))[:-1]] if n else np.zeros(0, int)
    place = np.empty(n)
    place[order] = np.arange(n) - first[up[order]]
    alike = np.zeros(n)
    for k in np.unique(kind).tolist():
        same = kind == k
        alike[same] = np.bincount(up[same], minlength=n)[up[same]]
    parent_total = np.maximum(total[up], 1)
    one = np.maximum(siblings, 1)
    columns = [np.log1p(total), total / page_total, link / np.maximum(total, 1), np.log1p(word / np.maximum(runs, 1)), mark / np.maximum(word, 1)]
    columns += [np.log1p(nodes), nodes / np.maximum(total, 1), np.log1p(runs), paragraphs / np.maximum(nodes, 1), np.minimum(a["depth"], 30)]
    columns += [start, np.log1p(siblings), place / one, alike / one, total / parent_total, link[up] / parent_total, np.log1p(total[up])]
    columns += [a["good"], a["bad"], *above, (kind[up] == TEXT_KIND), kind[up] == 5, kind[up] == 6, kind[up] == 7]
    columns += [kind == k for k in range(TEXT_KIND + 1)]
    return np.column_stack([np.asarray(c, np.float64) for c in columns]) if n else np.zeros((0, 1))


def decode(forest: Forest, logits: np.ndarray) -> np.ndarray:
    """Nodes of the rooted subtree with the highest sum of log odds; roots are free."""
    a = forest.arrays()
    levels, below = _levels(a["depth"]), np.zeros(len(logits))
    gain = logits.copy()
    if levels:
        gain[levels[0]] = 0
    # a container counts as far as something below it is kept
    text = a["kind"] == TEXT_KIND
    for rows in levels[:0:-1]:
        value = np.where(text[rows] | (below[rows] > 0), gain[rows] + below[rows], 0)
        np.add.at(below, a["parent"][rows], np.maximum(value, 0))
    keep = np.zeros(len(logits), bool)
    for i, rows in enumerate(levels):
        if not i:
            keep[rows] = True
            continue
        wanted = np.where(text[rows], gain[rows] > 0, (below[rows] > 0) & (gain[rows] + below[rows] > 0))
        keep[rows] = keep[a["parent"][rows]] & wanted
    return keep & text


# --- training pages -------------------------------------------------------


@functools.cache
def _pool() -> list[str]:
    r = random.Random(SEED)
    return ["".join(r.choices("abcdefghijklmnoprstuvwy", k=r.randint(1, 9))) for _ in range(3000)]


def _words(r: random.Random, n: int) -> str:
    return " ".join(r.choices(_pool(), k=n))


def _sentences(r: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, r.randint(1, 18))
        out.append(_words(r, k).capitalize() + ".")
        n -= k
    return " ".join(out)


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for its runs of text in order, whether they are main text."""
    parts: list[str] = []
    truth: list[bool] = []
    semantic = r.random() < 0.6
    pick = r.choice

    def put(markup: str, *main: bool) -> None:
        parts.append(markup)
        truth.extend(main)

    def names(bad: bool) -> str:
        if r.random() < 0.15:
            return f' class="{_words(r, 1)}"'
        pool = ("menu nav-bar sidebar ad ads promo-box cookie-notice share related comments footer-links header-top newsletter login".split() if bad else "content post-body article-text entry main story page-content".split())
        return f' {pick(["class", "id"])}="{pick(pool)}"'

    def junk(kind: str) -> None:
        tag = kind if semantic and kind in ("nav", "aside", "footer", "header", "form") else "div"
        attributes = "" if tag != "div" and r.random() < 0.6 else names(True)
        put(f"<{tag}{attributes}>")
        if kind in ("nav", "footer") and r.random() < 0.8:
            put("<ul>")
            for _ in range(r.randint(2, 9)):
                put(f'<li><a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))}</a></li>', False)
            put("</ul>")
        if kind == "form":
            put(f'<label>{_words(r, 2)}</label> <input name="q"><button>{_words(r, 1)}</button>', False, False)
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                put(f'<div class="{pick(["comment", "reply", "user-comment"])}"><p>{_sentences(r, r.randint(2, 40))}</p></div>', False)
        elif kind != "nav" or r.random() < 0.2:
            line = _sentences(r, r.randint(1, 14))
            put(pick([line, f"<p>{line}</p>", f"&copy; {line}", f"<a href='#'>{line}</a>"]), False)
        put(f"</{tag}>")

    title = _words(r, r.randint(1, 12))
    put(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style></head><body>")
    wrap = r.random() < 0.4
    if wrap:
        put(f"<div{pick(['', ' id=page', ' class=wrap'])}>")
    for kind in ("header", "nav", "notice", "ad"):
        if r.random() < 0.6:
            junk(kind)
    if r.random() < 0.25:
        junk("aside")
    tag = pick(["article", "article", "main"]) if semantic else "div"
    put(f"<{tag}{names(False) if tag == 'div' else pick(['', names(False)])}>")
    if r.random() < 0.85:
        put(f"<h1>{title}</h1>", True)
    for i in range(r.choice([1, 1, 2, 3, 5, 8, 14, 30, 60])):
        x = r.random()
        size = r.choice([1, 2, 4, 8, 20, 40, 80, 160, 160, 400, 1000])
        if x < 0.72:
            line = _sentences(r, size)
            if r.random() < 0.1:
                line = f'{line} <a href="/x">{_words(r, 2)}</a> {_words(r, 3)}.'
            put(pick([f"<p>{line}</p>", f"<p>{line}</p>", f"<p>{line}", f"<p><b>{line}<br>", f"<p><b>{line}</b></p>"]) if i else f"<p>{line}</p>", True)
        elif x < 0.8:
            put(f"<h{pick('23')}>{_words(r, r.randint(1, 6))}</h2>", True)
        elif x < 0.87:
            n = r.randint(1, 5)
            put("<ul>" + "".join(f"<li>{_words(r, r.randint(1, 12))}</li>" for _ in range(n)) + "</ul>", *[True] * n)
        elif x < 0.91:
            put(f"<blockquote>{_sentences(r, size)}</blockquote>", True)
        elif x < 0.94:
            n = r.randint(1, 3)
            put("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 1)}</td></tr>" for _ in range(n)) + "</table>", *[True] * 2 * n)
        else:
            junk(pick(["ad", "share", "aside", "related", "form"]))
    if r.random() < 0.15:
        junk("comments")
    put(f"</{tag}>")
    for kind in ("comments", "related", "aside", "form", "ad"):
        if r.random() < 0.25:
            junk(kind)
    if r.random() < 0.8:
        junk("footer")
    if wrap:
        put("</div>")
    put("</body></html>")
    return "".join(parts), truth


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> BoostedTrees:
    """Trees from generated pages; a container is positive if it holds main text."""
    r, forest, truth = random.Random(seed), Forest(), []
    for i in range(pages):
        source, main = training_page(r)
        forest.read(i, source)
        truth += main
    label = np.zeros(len(forest.page))
    label[[i for i, t in enumerate(forest.text) if t]] = truth
    parent = np.array(forest.parent)
    for rows in _levels(np.array(forest.depth))[:0:-1]:
        np.maximum.at(label, parent[rows], label[rows])
    return BoostedTrees().fit(node_features(forest), label)


def main_texts(model: BoostedTrees, pages: list[str | None]) -> list[str]:
    forest = Forest()
    for i, source in enumerate(pages):
        forest.read(i, source or "")
    keep = decode(forest, model.logits(node_features(forest)))
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(keep).tolist():
        out[forest.page[i]].append(forest.text[i])
    return ["\n".join(x) for x in out]


def extract_main_text(pages: DataFrame, training_pages: int = TRAINING_PAGES, seed: int = SEED) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    text: the kept blocks in page order, each with its character references
    decoded and white space turned into single spaces, joined by a line
    break; empty if there are none.  n_chars: its code points.  A null or
    empty html gives an empty text; broken markup is read as HTML parsers do,
    and a tag that the page ends in is no text.  Long pages are read whole, in
    time that follows their length.  Equal rows get equal results.  Null ids
    and urls stay.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    state = pages.sparkSession.sparkContext.broadcast(train(training_pages, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text="html", most=2 << 20):
            text = main_texts(state.value, part.column("html").to_pylist())
            columns = [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), "html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))
