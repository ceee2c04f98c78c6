"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: text between block-level tags, with where it lies in the
document. A logistic classifier gives each block a cost for being called content and one for
being called boilerplate; these are the capacities of its edges to the two terminals. Blocks
that follow each other are joined by an edge that is the stronger the nearer they lie in the
document tree, and so are a parent's blocks that others part: the smoothness. The maximum
flow through this graph gives the minimum cut, which separates content from boilerplate with
the least sum of costs; a page's flow is found in its task, and no page meets another.

The classifier sees the landmarks a block lies in (elements, roles, words of class and id),
its own tag, its text and its neighbours. It starts from PRIOR, weights set by hand, and
is fitted around them on blocks of a bounded sample of pages: at most `max_pages` different
ones, by hash. Blocks inside landmarks label themselves; each counts once with all features
and once without its landmarks and tag, so that the text's own features are learnt as well and
serve pages that have no landmarks.

The text is decoded, white space in a block is one space, blocks are joined in page order by
one space; nothing else is dropped or cut. White space is what Unicode calls so, no-break
spaces included. Scripts, styles, comments and other contents that are no text make no block.

Null html is empty, and empty pages have the text ''. Repeated rows are judged alike; columns
with the results' names are replaced. An empty table gives an empty result, and fits nothing
beyond PRIOR.
"""

from __future__ import annotations

import pickle
import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sampling import hash_sample
from millrace.llm._store import keep_columns, share, small_batches, stash
from millrace.llm._text import with_columns

MAX_PAGES = 2000
NEW = ["text", "n_chars"]

# --- what a page is made of (fixed values: names of HTML elements, and words that sites use in class and id)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|audio|video|datalist"
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("nav aside footer form dialog menu search button select option optgroup label fieldset legend".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs sidebar side rail widget widgets footer foot bottom toolbar cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay dialog share sharing social follow subscribe subscription newsletter signup login related recommended recommendations recommend trending popular teaser teasers pagination pager paging tags tagcloud copyright legal disclaimer search searchbox form outbrain taboola skip".split()
)
HEADER_WORDS = frozenset("header topbar masthead".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentary-list reply replies respond discussion disqus responses".split())
CONTENT_WORDS = frozenset("article articlebody body-text content entry entrytext post postbody story storybody main maincontent text hentry prose".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BLOCK_TAGS - {"button", "label", "option", "optgroup", "select", "summary", "legend", "caption", "html", "body", "head"}

#: Comments, elements without text, tags, and what only looks like one. Outside quotes a tag ends at the next "<" at the latest, and quotes reach so far, so no place is read again and again.
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({NO_TEXT})\b[^<>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][^\s/<>]*)((?:[^<>"']++|"[^"]{{0,4096}}"|'[^']{{0,4096}}'){{0,300}}+)>|<(/?)([a-z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|aria-hidden|aria-modal|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BESIDE = frozenset("with has no without".split())  # a name's words behind these tell what else the page has


def words_of(value: str) -> set[str]:
    """The words of class and id names."""
    out = set()
    for name in value.split():
        out.add(name.lower())
        for w in map(str.lower, WORD.findall(name)):
            if w in BESIDE:
                break
            out.add(w)
    return out


# --- landmarks of an element, as bits
ARTICLE, OUTSIDE, WORDS_OUT, WORDS_IN, HEADER, COMMENT = 1, 2, 4, 8, 16, 32


def landmarks(tag: str, attributes: str) -> int:
    """What an element says of the text in it."""
    bits = ARTICLE if tag in ("article", "main") else OUTSIDE if tag in OUTSIDE_TAGS else HEADER if tag == "header" else 0
    if not attributes:
        return bits
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = words_of(value)
            if words & HEADER_WORDS:
                bits |= HEADER
            if words & COMMENT_WORDS:
                bits |= COMMENT
            if words & OUTSIDE_WORDS:
                bits |= WORDS_OUT
            elif words & CONTENT_WORDS:
                bits |= WORDS_IN
        elif name == "role":
            bits |= ARTICLE if value.lower() in ("main", "article") else OUTSIDE if value.lower() in OUTSIDE_ROLES else 0
        elif name == "itemprop":
            bits |= ARTICLE if value.lower() == "articlebody" else 0
        elif name == "hidden" or (name in ("aria-hidden", "aria-modal") and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            bits |= OUTSIDE
    if bits & (COMMENT | WORDS_OUT | OUTSIDE) and tag != "main":
        bits &= ~(ARTICLE | WORDS_IN)
    return 0 if tag in ("html", "body") else bits


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    article: bool  # whether it lies in an article
    within: int  # bits of the elements from the article on, or of all where there is none
    around: int  # bits of the elements outside the article


@dataclass
class Block:
    text: str
    element: Element  # the innermost around it
    linked: int  # characters inside links


@dataclass
class Reader:
    """Reads a page's tags in order and keeps the elements that are open."""

    blocks: list[Block] = field(default_factory=list)
    open: list[Element] = field(default_factory=lambda: [Element("html", None, 0, False, 0, 0)])
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False

    def said(self, piece: str) -> None:
        self.pieces.append(piece)
        if self.link:
            self.linked += len(piece)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append(Block(text, self.open[-1], self.linked))
            self.pieces, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "p" or tag in P_ENDS:
            self.close({"p"}, P_ENDS - {"p"})
        if tag in CLOSES:
            self.close(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        up, bits = self.open[-1], landmarks(tag, attributes)
        new = bits & ARTICLE and not up.article
        within = bits if new else up.within | bits
        self.open.append(Element(tag, up, up.depth + 1, bool(up.article or bits & ARTICLE), within, up.within | up.around if new else up.around))

    def close(self, tags: set[str], walls: set[str] | frozenset[str]) -> None:
        """End the innermost open one of these elements, unless a wall stands before it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in walls:
                return

    def read(self, html: str) -> list[Block]:
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.said(html[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                if m[1] is not None and m[1].lower() == "title":
                    self.end_block()
                continue
            tag, closing = tag.lower(), m[2] or m[5]
            if tag in BLOCK_TAGS:
                self.end_block()
                if closing:
                    self.link = False
                    self.close({tag}, frozenset() if tag in ("body", "html", "article", "main") else {"article", "main", "body"} - {tag})
                elif tag not in EMPTY_TAGS:
                    self.start(tag, m[4] or m[7] or "")
            elif tag == "br":
                self.pieces.append("\n")
            elif tag == "a":
                self.link = not closing
        if at < len(html):
            self.said(html[at:])
        self.end_block()
        return self.blocks


def read_blocks(html: str | None) -> list[Block]:
    return Reader().read(html) if html else []


# --- the classifier

#: Features and the weights that fitting starts from and stays near; the first LANDMARKS ones say where a block lies and what its element is.
PRIOR = {
    "article": 5.0, "outside": -12.0, "words_out": -12.0, "words_out_around": -1.5, "words_in": 2.0, "header": -5.0, "comments": -12.0,
    "paragraph": 1.0, "heading": 4.0, "item": -0.3, "length": 0.8, "links": -3.0, "ends_sentence": 1.0, "marks": 0.5, "symbols": -1.5, "few_words": -0.7, "digits": -1.0,
    "links_before": -0.7, "links_behind": -0.7, "length_around": 0.3, "bias": -0.5,
}
LANDMARKS = 10
MARKS, SYMBOLS, END_MARKS = re.compile(r"[.,;:!?…。，；：！？]"), re.compile(r"[|·•»«©®™←→›‹]"), ".!?…:。！？\"”»)"


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    out = np.zeros((len(blocks), len(PRIOR)))
    for i, b in enumerate(blocks):
        e, n, tag = b.element, len(b.text), b.element.tag
        bits, words = e.within, b.text.count(" ") + 1
        out[i, :18] = (
            e.article, bool((bits | e.around) & OUTSIDE), bool(bits & WORDS_OUT), bool(e.around & WORDS_OUT), bool(bits & WORDS_IN), bool((e.around if e.article else bits) & HEADER), bool((bits | e.around) & COMMENT),
            tag in ("p", "blockquote", "pre"), tag[0] == "h" and tag[1:].isdigit(), tag in ("li", "dd", "dt", "td", "th"), np.log1p(n) - 4, min(1.0, b.linked / n), b.text[-1] in END_MARKS, min(1.0, 5 * len(MARKS.findall(b.text)) / words),
            bool(SYMBOLS.search(b.text)), words < 4, sum(map(b.text.count, "0123456789")) / n, 0,
        )
    out[1:, 17], out[:-1, 18] = out[:-1, 11], out[1:, 11]
    longest = np.full(len(blocks), -4.0 if len(blocks) > 1 else 0.0)
    for k in (1, 2):  # the longest of two blocks to either side
        longest[k:] = np.maximum(longest[k:], out[:-k, 10])
        longest[:-k] = np.maximum(longest[:-k], out[k:, 10])
    out[:, 19], out[:, 20] = longest, 1
    return out


def own_labels(x: np.ndarray) -> np.ndarray:
    """Labels that landmarks give: 1 in an article, 0 outside of it or in one of its parts that are no content, -1 unknown."""
    outside = (x[:, 1] + x[:, 2] + x[:, 5] + x[:, 6]) > 0
    return np.where(outside, 0, np.where(x[:, 0] > 0, 1, -1))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, strength: float = 10.0, html_col: str = "html") -> np.ndarray:
    """Weights fitted on at most max_pages different pages, around PRIOR. strength: how firmly they are held there; the sample weighs 1000 rows in all."""
    small_batches(pages.sparkSession)
    prior = np.array(list(PRIOR.values()))
    keyed = pages.where(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("key"), F.col(html_col).alias("html"))
    keys = hash_sample(keyed.select("key").distinct(), max_pages, "key")
    sample = keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.min("html").alias("html"))  # at most max_pages keys, and one page each

    def run(batches):
        for batch in batches:
            for html in batch.column("html").to_pylist():
                x = features(read_blocks(html))
                y = own_labels(x)
                known = y >= 0
                yield pa.RecordBatch.from_arrays([pa.array([x[known].astype(np.float32).tobytes()], pa.binary()), pa.array([y[known].astype(np.int8).tobytes()], pa.binary())], names=["x", "y"])

    rows = stash(sample.mapInArrow(run, "x binary, y binary"), "labelled-pages").collect()
    rows.sort(key=lambda r: (bytes(r.x), bytes(r.y)))  # the same weights whatever the order of arrival
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, len(PRIOR)).astype(np.float64)
    y = np.frombuffer(b"".join(r.y for r in rows), np.int8).astype(np.float64)
    if len(set(y.tolist())) < 2:
        return prior
    bare = x.copy()
    bare[:, :LANDMARKS] = 0
    x, y = np.concatenate((x, bare)), np.concatenate((y, y))
    weight = 1000 * np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = prior.copy()
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + strength * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


# --- the cut

UNIT, MOST, NEAR, PARTED = 1024, 12.0, 1.2, 0.6  # capacities are whole numbers of 1/UNIT; the largest cost; edges of neighbours, and of a parent's blocks that others part


def capacities(blocks: list[Block], logits: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """What calling each block boilerplate costs more than calling it content, and the edges (i, j, capacity)."""
    cost = np.rint(np.clip(logits, -MOST, MOST) * UNIT).astype(np.int64).tolist()
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            x, y, steps = blocks[i - 1].element, b.element, 0
            while x is not y:  # as many steps as elements were closed and opened between
                if x.depth >= y.depth:
                    x = x.parent
                else:
                    y = y.parent
                steps += 1
            edges.append((i - 1, i, round(NEAR * UNIT * 0.5 ** (max(0, steps - 2) / 2))))
        parent = id(b.element.parent)
        j = last.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, round(PARTED * UNIT)))
        last[parent] = i
    return cost, edges


def min_cut(cost: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of the minimum cut (the smallest such side): the source gives each node its positive cost, the sink takes the negative ones.

    Maximum flow by shortest augmenting paths, a layer at a time (Dinic).
    """
    n = len(cost)
    give, take = [max(c, 0) for c in cost], [max(-c, 0) for c in cost]
    to, room, out = [], [], [[] for _ in range(n)]
    for i, j, c in edges:
        if c > 0:
            out[i].append(len(to))
            to.append(j)
            room.append(c)
            out[j].append(len(to))
            to.append(i)
            room.append(c)
    while True:
        level, wave, found = [-1] * n, deque(), False
        for i in range(n):
            if give[i]:
                level[i] = 0
                wave.append(i)
        while wave:
            i = wave.popleft()
            found = found or take[i] > 0
            for e in out[i]:
                j = to[e]
                if room[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    wave.append(j)
        if not found:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in range(n):
            while give[s]:
                path, i = [], s
                while True:  # walk down the layers to a node that the sink takes from
                    if take[i]:
                        break
                    own = out[i]
                    while at[i] < len(own) and not (room[own[at[i]]] and level[to[own[at[i]]]] == level[i] + 1):
                        at[i] += 1
                    if at[i] < len(own):
                        path.append(own[at[i]])
                        i = to[own[at[i]]]
                    elif path:
                        e = path.pop()
                        i = to[e ^ 1]
                        at[i] += 1
                    else:
                        i = -1
                        break
                if i < 0:
                    break
                flow = min(give[s], take[i], *(room[e] for e in path)) if path else min(give[s], take[i])
                give[s] -= flow
                take[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks of a page are content."""
    return min_cut(*capacities(blocks, features(blocks) @ weights)) if blocks else []


def text_of(html: str | None, weights: np.ndarray) -> str:
    blocks = read_blocks(html)
    return " ".join(b.text for b, own in zip(blocks, label(blocks, weights), strict=True) if own)


def _held(pages: DataFrame, kept: list[str], html_col: str) -> DataFrame:
    """(doc, html): the columns that stay in a struct, so that none clashes with ours."""
    others = [F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]
    return pages.select(F.struct(*others).alias("doc"), F.col(f"`{html_col}`").alias("html"))


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """pages with text and n_chars (code points); html_col goes unless it is to be kept."""
    pages = keep_columns(pages, NEW, html_col)
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if keep_html or c != html_col]
    shared = share(pages.sparkSession, weights)

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            texts = [text_of(h, own) for h in batch.column("html").to_pylist()]
            yield with_columns(batch.select(["doc"]), set(), {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    x = _held(pages, kept, html_col)
    schema = T.StructType([x.schema["doc"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return x.mapInArrow(run, schema).select(*[F.col(f"doc.`{c}`") for c in kept], *NEW)


def label_blocks(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """pages without html_col, a row for each block: block (from 0), tag, block_text, score (the classifier's logit) and content (the cut's label)."""
    new = ["block", "tag", "block_text", "score", "content"]
    pages = keep_columns(pages, new, html_col)
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html_col]
    shared = share(pages.sparkSession, weights)

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            for r, html in enumerate(batch.column("html").to_pylist()):
                blocks = read_blocks(html)
                if blocks:
                    score = features(blocks) @ own
                    content = min_cut(*capacities(blocks, score))
                    doc = batch.column("doc").take(pa.array(np.full(len(blocks), r)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(range(len(blocks)), pa.int64()), pa.array([b.element.tag for b in blocks]), pa.array([b.text for b in blocks]), pa.array(score), pa.array(content)], names=["doc", *new])

    x = _held(pages, kept, html_col)
    schema = T.StructType([x.schema["doc"], *T._parse_datatype_string("block long, tag string, block_text string, score double, content boolean").fields])
    return x.mapInArrow(run, schema).select(*[F.col(f"doc.`{c}`") for c in kept], *new)
