"""Main text of HTML pages by a tree-structured graphical model.

The nodes are a page's block elements, each with a binary state: content or not.  A node
potential is linear in its tag, class and id words, text length, link share and place; a
parent-child potential is a 2 x 2 table by the kind of the child.  Sum-product messages run
once from the leaves to the root and once back and give each node's exact content marginal.
The weights are trained on labelled pages by stochastic gradient ascent of the conditional
likelihood (observed minus expected statistics, the expectations from the same messages),
held towards a prior that knows what common markup means, so that markup which the labelled
pages lack is still understood.
"""

from __future__ import annotations

import html
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import batches, column_of, free_name
from listforge.session import ship_package

SAMPLE_PAGES = 300        # expected labelled pages the weights are fitted on

SAMPLE_NODES = 5000       # pages of more nodes are not among them (their text is still extracted)

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^ \t\n\r\f/>]*+))")
#: the end of a tag, or one attribute; a quote counts right after the equals sign only
_NEXT = re.compile(r"""[ \t\n\r\f/]*+(?:(>)|([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)"""
                   r"""(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>]*+)))?+)""")
_LONG_NUMBER = re.compile(r"&#(\d{9,})")
_PART = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript textarea title iframe xmp".split())
#: off content, but ordinary nodes: their end tags may be missing
CONTROLS = frozenset("button select datalist optgroup option svg math object".split())
_PAIRED = frozenset("button select datalist object svg math template".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body main article section nav aside header footer form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt "
                  "dd table thead tbody tfoot tr td th blockquote pre figure figcaption fieldset legend details "
                  "summary address dialog center menu head hgroup search".split())
#: an open element of the first kind ends when one of the others starts
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table body article main section div td th nav aside header footer form".split())
TAGS = ("html", "body", "main", "article", "section", "nav", "aside", "header", "footer", "form", "div", "p", "h1",
        "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", "details", "dialog", "head", "other",
        "control")
NOISE = ("nav", "menu", "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "footer",
         "header", "masthead", "sidebar", "aside", "widget", "notice", "cookie", "cookies", "consent", "gdpr", "popup",
         "modal", "overlay", "alert", "newsletter", "subscribe", "signup", "login", "form", "search", "share",
         "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment",
         "comments", "respond", "responses", "reply", "replies", "discussion", "disqus", "copyright", "legal", "toolbar", "tags", "skip")
#: these begin the names that templates give to a text's own category, tag or kind
TAXONOMY = frozenset("category cat tag type status format author".split())
GOOD = ("article", "content", "main", "post", "entry", "body", "story", "text", "prose", "page")
_NOISE = frozenset(NOISE)
_BASE = 8
N_FEATURES = _BASE + len(TAGS) + len(NOISE) + len(GOOD)
_TAG = {t: _BASE + i for i, t in enumerate(TAGS)}
_TAG.update(dict.fromkeys(CONTROLS, _TAG["control"]))
_WORD = {w: _BASE + len(TAGS) + i for i, w in enumerate(NOISE + GOOD)}
#: of a child, for the pair potentials; what stands right under html or body is free of it
_KINDS = ("frame", "content frame", "off content", "other", "top")
_OFF = CONTROLS | {"nav", "aside", "footer", "form", "dialog", "menu", "search", "header", "head"}


@dataclass
class Page:
    parent: np.ndarray            # of each node, -1 for the root; parents come before children
    x: np.ndarray                 # node x feature
    kind: np.ndarray
    runs: list[tuple[int, str]]   # (node, text) in page order
    label: np.ndarray | None = None


class _Scanner:
    """The tags of a page, each character looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source = source
        self.quotes = True                 # until a tag runs to the page's end inside its quotes
        self.endless: set[str] = set()     # raw-text elements that no later end tag closes

    def next(self, at: int):
        """(start, end, closing, tag, attributes) of the next tag; tag is None for comments and the
        like.  What is begun and never ends is markup up to the page's end, as in a browser."""
        s = self.source
        m = _OPENING.search(s, at)
        if m is None:
            return None
        if m[2] is None:
            end = s.find("-->", m.start() + 2) + 3 if m[0] == "<!--" else s.find(">", m.end()) + 1
            if end == (2 if m[0] == "<!--" else 0):
                end = len(s)
            return m.start(), end, False, None, ()
        tag, attributes, at = m[2].lower(), [], m.end()
        while self.quotes:
            a = _NEXT.match(s, at)
            if a is None:
                self.quotes = False
                break
            at = a.end()
            if a[1]:
                return m.start(), at, bool(m[1]), tag, attributes
            attributes.append((a[2].lower(), next((v for v in a.groups()[2:] if v is not None), "")))
        at = s.find(">", m.end()) + 1 or len(s)
        return m.start(), at, bool(m[1]), tag, [(k.lower(), v.strip("\"'")) for k, v in
                                                re.findall(r"(?<!\S)([^\s=]++)=(\S++)", s[m.end():at - 1])]

    def after_raw(self, tag: str, at: int) -> int | None:
        """Where a raw-text element ends, None if nothing ends it."""
        if tag in self.endless:
            return None
        end = _RAW_END[tag].search(self.source, at)
        if end is None:
            self.endless.add(tag)
            return None
        return end.end()

    def self_closed(self, end: int) -> bool:
        return self.source[max(0, end - 60):end - 1].rstrip().endswith("/")


def _ends(source: str) -> dict[int, int]:
    """Where the element ends whose start tag ends here, of the paired tags that have their end tag."""
    out, open_, scanner, at = {}, {}, _Scanner(source), 0
    while (found := scanner.next(at)) is not None:
        _, at, closing, tag, _ = found
        if tag in RAW and not closing:
            at = scanner.after_raw(tag, at) or at
        elif tag in _PAIRED:
            starts = open_.setdefault(tag, [])
            if not closing:
                if not (tag in ("svg", "math") and scanner.self_closed(at)):
                    starts.append(at)
            elif starts:
                out[starts.pop()] = at
    return out


def class_words(attributes) -> frozenset:
    """Words of the class, id and role values: each name whole, and the first and last word of a
    compound one (``comment-list``, ``site-footer``), unless it names a category or kind of the
    text (``category-social``)."""
    out = set()
    for key, value in attributes:
        if key in ("class", "id", "role"):
            for name in value.lower().split():
                parts = _PART.findall(name)
                if parts and (len(parts) == 1 or parts[0] not in TAXONOMY):
                    out.update((name, parts[0], parts[-1]))
    return frozenset(out)


def parse(source: str | None) -> Page:
    """A tolerant tree: raw-text elements are skipped whole, what is left open closes with its parent.

    Buttons, selects, options, pictures and formulas are nodes inside the text around them,
    which goes on after them; one without its end tag closes where the next block starts.
    """
    source = source or ""
    scanner = _Scanner(source)
    tags, words, parent, depth = ["html"], [frozenset()], [-1], [0]
    open_at: dict[str, list[int]] = {}   # places in the stack by tag, and of what bounds an implied end
    bounds: list[int] = []
    text_len, link_len = [0], [0]
    runs: list[tuple[int, str]] = []
    stack, links = [0], 0
    parts: list[str] = []
    held: list[list] = []      # (place of a control in the stack, the text before it, its links)
    put_out = 0                # so many of them hold no text any more
    ends: dict[int, int] | None = None
    unended: set[int] = set()  # controls without their end tag

    def put(node: int, pieces: list[str]):
        t = "".join(pieces)
        if "&" in t:  # a number of thousands of digits is no code point, but Python refuses to read it
            t = html.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), t))
        t = " ".join(t.split())
        if t:
            runs.append((node, t))
            text_len[node] += len(t)

    def flush():
        nonlocal parts, put_out
        for h in held[put_out:]:
            put(stack[h[0] - 1], h[1])
            h[1] = []
        put_out = len(held)
        put(stack[-1], parts)
        parts = []

    def close_to(n: int):
        """Close what stands from n; after a control the text around it goes on."""
        nonlocal parts, links, put_out
        while len(stack) > n:
            node = stack.pop()
            open_at[tags[node]].pop()
            if bounds and bounds[-1] == len(stack):
                bounds.pop()
            put(node, parts)
            parts, links = [], 0
            if held and held[-1][0] == len(stack):
                _, parts, links = held.pop()
                put_out = min(put_out, len(held))

    def add(tag: str, attributes):
        tags.append(tag)
        words.append(class_words(attributes) if attributes else frozenset())
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE or tag in CONTROLS:
            bounds.append(len(stack))
        parent.append(stack[-1])
        depth.append(depth[stack[-1]] + 1)
        text_len.append(0)
        link_len.append(0)
        stack.append(len(tags) - 1)

    at = 0
    while at < len(source):
        found = scanner.next(at)
        text = source[at:found[0] if found else len(source)]
        if text:
            parts.append(text)
            if links:
                link_len[stack[-1]] += len(text.strip())
        if found is None:
            break
        _, at, closing, tag, attributes = found
        if tag is None:
            continue
        if closing:
            if open_at.get(tag):
                close_to(open_at[tag][-1])
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag in RAW:
            empty = scanner.self_closed(at)
            if empty and tags[stack[-1]] in ("svg", "math"):
                continue
            at = scanner.after_raw(tag, at) or (at if empty else len(source))
            continue
        if tag == "template" or tag in CONTROLS:
            if tag in ("svg", "math") and scanner.self_closed(at):
                continue
            ends = _ends(source) if ends is None else ends
            if tag == "template":
                at = ends.get(at, at)
                continue
            n = len(stack)
            while tag in ("option", "optgroup") and tags[stack[n - 1]] in ("option", tag):
                n -= 1
            if tag in ("button", "select") and tags[stack[n - 1]] == tag and stack[n - 1] in unended:
                n -= 1
            close_to(n)
            held.append([len(stack), parts, links])
            parts, links = [], 0
            add(tag, attributes)
            if at not in ends:
                unended.add(stack[-1])
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            n = len(stack)
            while stack[n - 1] in unended:
                n -= 1
            close_to(n)
            flush()
            if tags[stack[-1]] == "p" or tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                n -= 1
            begun = max((open_at[t][-1] for t in _CLOSES.get(tag, ()) if open_at.get(t)), default=0)
            if begun and begun >= (bounds[-1] if bounds else 0):
                n = min(n, begun)
            close_to(n)
            links = 0
            add(tag, attributes)
    close_to(1)
    flush()
    n = len(tags)
    below, below_links, children = list(text_len), list(link_len), [0] * n
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
        below_links[parent[i]] += below_links[i]
        children[parent[i]] += 1
    x = np.zeros((n, N_FEATURES))
    kind = np.full(n, 3)
    total = max(1, below[0])
    for i in range(n):
        share = min(1.0, below_links[i] / below[i]) if below[i] else 0.0
        if text_len[i]:  # a node without own text says nothing by its size and place
            x[i, :_BASE] = (1, min(3.0, np.log10(1 + text_len[i])), min(4.0, np.log10(1 + below[i])), share, share > 0.5,
                            below[i] / total, min(depth[i], 10) / 10, min(children[i], 10) / 10)
        x[i, _TAG.get(tags[i], _TAG["other"])] = 1
        frame = tags[i] in ("article", "main")  # no class makes one of these off content
        for w in words[i]:
            if w in _WORD and not (frame and w in _NOISE):
                x[i, _WORD[w]] = 1
        noisy = tags[i] in _OFF or (not frame and not _NOISE.isdisjoint(words[i]))
        good = frame or any(w in GOOD for w in words[i])
        top = parent[i] >= 0 and tags[parent[i]] in ("html", "body")
        kind[i] = 2 if noisy else 1 if good else 0 if tags[i] in ("html", "body") else 4 if top else 3
    return Page(np.array(parent), x, kind, runs)


def marked_label(page: Page) -> np.ndarray | None:
    """Labels that a page's own markup gives: inside an article or main element and not inside
    a part of it that is off content; None if the page has neither element."""
    main = (page.x[:, _TAG["article"]] + page.x[:, _TAG["main"]]) > 0
    if not main.any():
        return None
    out = np.zeros(len(page.parent), dtype=np.int64)
    for i, p in enumerate(page.parent):
        out[i] = (main[i] or (p >= 0 and out[p])) and page.kind[i] != 2
    return out


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Weights before training: (per feature, pair tables by kind as log potentials [kind, parent, child])."""
    w = np.zeros(N_FEATURES)
    w[[0, 1, 3, 4]] = (-0.5, 0.4, -1.0, -1.0)
    for t, v in (("nav", -4), ("aside", -4), ("footer", -4), ("header", -3), ("form", -4), ("dialog", -4),
                 ("head", -5), ("control", -4), ("article", 2), ("main", 2), ("p", 0.5), ("html", -1), ("body", -1)):
        w[_TAG[t]] = v
    for v in NOISE:
        w[_WORD[v]] = -3.5
    for v in GOOD:
        w[_WORD[v]] = 0.7
    pair = np.zeros((len(_KINDS), 2, 2))
    pair[0] = [[0.5, -0.5], [0, 0]]
    pair[1] = [[0.0, 1.0], [-0.5, 1.5]]
    pair[2] = [[2.0, -3.0], [2.0, -3.0]]
    pair[3] = [[2.0, -1.5], [-1.5, 2.0]]
    pair[4] = [[0.2, -0.2], [0, 0]]
    return w, pair


def marginals(page: Page, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: content probability of each node, and of each (parent, child) state pair."""
    n = len(page.parent)
    unary = np.stack([np.zeros(n), page.x @ w], axis=1)
    up, gathered = np.zeros((n, 2)), unary.copy()
    for i in range(n - 1, 0, -1):  # leaves first: children come after parents
        m = np.logaddexp(pair[page.kind[i], :, 0] + gathered[i, 0], pair[page.kind[i], :, 1] + gathered[i, 1])
        up[i] = m - m.max()
        gathered[page.parent[i]] += up[i]
    down, belief, both = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
    belief[0] = gathered[0]
    for i in range(1, n):
        p = page.parent[i]
        rest = gathered[p] + down[p] - up[i]
        t = pair[page.kind[i]] + rest[:, None]
        m = np.logaddexp(t[0], t[1])
        down[i] = m - m.max()
        belief[i] = gathered[i] + down[i]
        j = t + gathered[i][None, :]
        j = np.exp(j - j.max())
        both[i] = j / j.sum()
    belief -= belief.max(axis=1, keepdims=True)
    e = np.exp(belief)
    return e[:, 1] / e.sum(axis=1), both


def fit(pages: list[Page], epochs: int = 4, rate: float = 0.05, pull: float = 0.02, seed: int = 3):
    """Weights from labelled pages.  Half the time a page is seen without its tag and class
    features and without content frames, so that length, links and place learn to speak too."""
    w, pair = prior()
    w0, pair0 = w.copy(), pair.copy()
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            page = pages[k]
            x, kind = page.x.copy(), page.kind
            if rng.random() < 0.5:
                x[:, _BASE:] = 0
                kind = np.where(kind == 1, 4, kind)
            seen = Page(page.parent, x, kind, [])
            p, both = marginals(seen, w, pair)
            y = page.label
            g = x.T @ (y - p) / len(y)
            w += rate * g * 10 - rate * pull * (w - w0)
            gp = np.zeros_like(pair)
            for i in range(1, len(y)):
                gp[kind[i]] -= both[i]
                gp[kind[i], y[page.parent[i]], y[i]] += 1
            pair += rate * gp * 10 / len(y) - rate * pull * (pair - pair0)
    return w, pair


def content_text(page: Page, w: np.ndarray, pair: np.ndarray) -> str:
    """The runs of nodes that are more likely content than not, joined by one space."""
    if not page.runs:
        return ""
    p, _ = marginals(page, w, pair)
    return " ".join(t for i, t in page.runs if p[i] >= 0.5)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
          sample_nodes: int = SAMPLE_NODES):
    """Fit on a bounded sample of the pages that ``marked_label`` can label.

    The sample is those whose id hash falls below a share of the range chosen so that
    ``sample_pages`` are expected, without those of more than ``sample_nodes`` nodes; the driver
    gets node features of the sample only.
    """
    ship_package(pages.sparkSession)
    rows = pages.where(F.col(html_col).isNotNull())
    n = rows.count()
    if n > sample_pages:
        place = F.shiftrightunsigned(F.xxhash64(F.lit("page"), F.col(id_col)), 24)
        rows = rows.where(place < int(sample_pages / n * (1 << 40)))

    def label(parts):
        make = batches({"id": pa.int64(), "page": pa.binary()})
        for batch in parts:
            out = []
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parse(source.as_py())
                page.label = marked_label(page)
                if page.label is not None and len(page.label) <= sample_nodes:
                    out.append((name, pickle.dumps((page.parent, page.x, page.kind, page.label))))
            yield make(out)

    got = rows.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(
        label, "id long, page binary").collect()
    got.sort(key=lambda r: (r["id"] is None, r["id"] or 0))
    pages_ = []
    for r in got:
        parent, x, kind, y = pickle.loads(bytes(r["page"]))
        pages_.append(Page(parent, x, kind, [], y))
    return fit(pages_)


def main_text(pages: DataFrame, model, html_col: str = "html") -> DataFrame:
    """The input with a string ``_text`` (``_text_`` and so on, if the input has that column): empty
    for null, empty or textless pages.

    Character references are decoded; white space inside a block becomes one space; blocks
    are joined by one space in page order.  Nothing is cut, whatever the length; the work is linear
    in the page, also for unclosed tags and quotes and for stray end tags.
    """
    ship_package(pages.sparkSession)
    w, pair = model

    def extract(source):
        return content_text(parse(source), w, pair)

    return pages.withColumn(free_name(pages, "_text"), column_of(pages, html_col, lambda: extract, "string"))
