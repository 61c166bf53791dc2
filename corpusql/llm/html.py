"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of elements (name, id and
classes, digits masked) that holds text of its own.  Its content features are the sentences
of that text.  A feature that stands on n of the m pages which have the node has the entropy
ln n / ln m: 0 on one page, 1 on all.  A node's content importance is one less the mean
entropy of its features; its presentation importance is the entropy, over pages, of the
sequence of elements around it (the children of its parent).  Short texts are noisy alone, so
a node's evidence is half its own and half that of all text whose nodes have the same parent,
and a tenth of it is presentation.

What mark-up says of a node (an article; a menu, footer, form or advert by its element or
name; text beside an article) is a prior, weighed as a number of pages, and importance is the
mean of both:

    importance = (w * prior + pages * evidence) / (w + pages)

with the evidence stretched so that ``LEVEL`` is one half and ``FULL`` is one.  Entropy can't tell reader comments
or an advert that is new on every page from an article, as all of them differ; so ``w`` grows
with the pages for what mark-up names as an aside, the more the less of a page's text it
holds, and for the bulk of an article, which near copies of pages would make look shared.
Unnamed text and the small parts of an article are left to the evidence.  Text of nodes whose
importance is under one half is taken out of each page, and nothing else decides.  Without the
prior (``prior=False``) the entropies decide alone.

Pages are parsed twice and never grouped.  Nodes are 64-bit hashes made from that of the node
above, and sums go up when an element closes, so a page's cost grows with its length and not
with its nesting.
"""

from __future__ import annotations

import html as htmllib
import re
import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusql.llm.common import fits, materialise

# Elements by what they are.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math", "canvas", "object"])
UNSEEN = RAW | frozenset(("head", "title"))
ASIDES = frozenset(["nav", "footer", "aside", "form", "button", "select", "option", "optgroup", "textarea", "input", "label", "datalist", "dialog", "menu", "audio", "video", "map", "area"])
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"])
#: An opening tag ends an open element of its kind; inside the second set it doesn't reach further up.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "optgroup", "datalist")),
}
#: Block elements that end an open paragraph.
ENDS_P = BLOCKS - frozenset(["body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"])
#: Words of class, id and role that name what is not the article: a prior, as the elements in ASIDES are.
ASIDE_WORDS = frozenset(
    [
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsors",
        "sponsored", "promo", "promotion", "promotions", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts",
        "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "sidebars", "side", "widget",
        "widgets", "aside", "complementary", "menu", "menus", "nav", "navbar", "navigation", "navigations", "breadcrumb", "breadcrumbs",
        "toolbar", "topbar", "pagination", "pager", "footer", "foot", "colophon", "copyright", "legal", "disclaimer", "masthead", "header",
        "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "share", "sharing", "social", "related",
        "recommended", "recommendations", "trending", "popular", "tags", "search", "skip", "skiplink", "form", "contentinfo", "dialog",
    ]
)
#: Of these words some name parts of an article too and count only outside it.
OUTSIDE_ONLY = frozenset(["header", "side", "tags", "form", "legal", "popular", "discussion"])
#: Classes that say what a page has or lacks, and not what the element is.
_ABOUT_PAGE = re.compile(r"(?<!\S)(?:has|with|without|no|is|js|supports)[-_]\S*")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW | {"title", "textarea"}}
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    path: int  # of the style tree: a hash of the one above and its name; of an element that is no branch, its parent's
    above: "Node | None"
    branch: bool  # a block, or an element that mark-up names: a node of the tree
    aside: bool  # mark-up names it as no part of the article
    under: bool  # it or an element above it is an aside
    main: bool  # inside an article and not under an aside
    unseen: bool  # never shown
    parent: int = 0  # the path of the branch above
    holder: int = 0  # the path of the nearest aside that it is in, 0 if none
    shown: list[str] | None = None  # of a branch: its children so far


def _says(tag: str, attributes: str, above: Node) -> Node:
    """The node of an opening tag."""
    main, name, hidden = above.main, tag, False
    words: set[str] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("hidden", "aria-hidden"):
                hidden |= value.lower() != "false"
            elif key == "style":
                hidden |= bool(_HIDDEN.search(value))
            else:
                low = _ABOUT_PAGE.sub("", _CAMEL.sub("-", htmllib.unescape(value)).lower())
                if key == "role" and low in ("main", "article") or key == "itemprop" and low == "articlebody":
                    main = True
                words.update(_WORD.findall(low))
                if key != "itemprop":
                    name += ("#" if key == "id" else "." if key == "class" else "@") + _DIGITS.sub("9", low.strip()).replace("/", "_")
    named = words & ASIDE_WORDS
    if above.main:
        named -= OUTSIDE_ONLY
    aside = tag in ASIDES or tag == "header" and not above.main
    aside |= bool(named) and tag not in ("body", "html", "main") and not (tag == "article" and named <= OUTSIDE_ONLY)
    under = above.under or aside
    branch = aside or tag in BLOCKS
    path = step(above.path, name) if branch else above.path
    node = Node(tag, path, above, branch, aside, under, (main or tag in MAIN) and not under, above.unseen or tag in UNSEEN or hidden)
    node.parent, node.holder = (above.path if branch else above.parent), (path if aside else above.holder)
    node.shown = [] if branch else above.shown
    if above.shown is not None and not node.unseen:
        above.shown.append(name if branch else tag)
    return node


def step(above: int, name: str) -> int:
    """The path one step further down, a signed 64-bit hash."""
    return _signed(xxhash.xxh64_intdigest(name, above & _ALL))


_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse(page: str, host: str = "") -> Iterator[tuple[str, Node, str]]:
    """``("open", node, "")``, ``("close", node, "")``, ``("text", node, text)``, ``("break", node, tag)`` in page order.

    Where elements of a kind are open is kept beside the stack, so no tag walks through it.
    """
    stack = [Node("", step(0, host), None, False, False, False, False, False)]
    where: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    at, n = 0, len(page)

    def close(k: int):
        while len(stack) > k:
            node = stack.pop()
            where[node.tag].pop()
            if node.tag in BLOCKS:
                blocks.pop()
            yield "close", node, ""

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", stack[-1], page[at:]
            break
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if where[tag]:
                yield from close(where[tag][-1])
            continue
        if tag in ENDS_P and blocks and stack[blocks[-1]].tag == "p":
            yield from close(blocks[-1])
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            stop = max((where[t][-1] for t in stops if where[t]), default=0)
            above = [where[t][bisect_right(where[t], stop)] for t in ends if where[t] and where[t][-1] > stop]
            if above:
                yield from close(min(above))
        above = stack[-1]
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img"):
                yield "break", above, tag
            continue
        node = _says(tag, m[3], above)
        yield "open", node, ""
        if tag in _END_RAW and not m[3].endswith("/"):
            end = _END_RAW[tag].search(page, at)
            stop = end.start() if end else n
            yield "text", node, page[at:stop]
            at = page.find(">", stop) + 1 if end else n
            at = at or n
            yield "close", node, ""
            continue
        where[tag].append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(node)
        if m[3].endswith("/") and tag in ("svg", "path"):
            yield from close(len(stack) - 1)
    yield from close(1)


def clean(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def has_article(events: list[tuple[str, Node, str]]) -> bool:
    return any(kind == "text" and node.main and not node.unseen and text.strip() for kind, node, text in events)


def _key(node: Node, article: bool) -> int:
    """The tree's node of a text: text beside an article is apart from text of the same path in pages without one."""
    return step(node.path, BESIDE) if article and not node.main else node.path


def extract(page: str | None, low: frozenset[int] | set[int] = frozenset(), host: str = "") -> str:
    """The text of all nodes but ``low`` (of the host's tree): blocks in page order, joined by blank lines."""
    if not page:
        return ""
    events = list(parse(page, host))
    article = has_article(events)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = clean(htmllib.unescape("".join(held)))
            if text:
                blocks.append(text)
            held.clear()

    for kind, node, text in events:
        if kind == "text":
            if not node.unseen and not (low and _key(node, article) in low):
                held.append(text)
        elif kind == "break":
            if text == "hr":
                flush()
            elif text == "br":
                held.append(" ")
        elif node.tag in BLOCKS:
            flush()
    flush()
    return "\n\n".join(blocks)


#: The last step in the path of text that stands outside the article in a page that has one.
BESIDE = "#beside"
#: Priors: that a node is main text, as mark-up has it.
IN_ARTICLE, OPEN, NAMED_ASIDE = 1.0, 0.75, 0.0
_SENTENCE = re.compile(r"(?<=[.!?\u2026\u3002])\s+|\s[\u00b7|]\s")


@dataclass(slots=True)
class Held:
    """What a page's texts at one node come to."""

    parent: int
    prior: float
    share: float  # of the page's characters: its own, or those of the aside that it is in
    style: int  # hash of the elements around it
    features: set[int]  # hashes of sentences


def nodes_of(page: str, host: str = "") -> dict[int, Held]:
    """The nodes of a page that hold text, same-path siblings as one; plain inline elements are part of the block they are in."""
    events = list(parse(page, host))
    article = has_article(events)
    found: dict[int, Held] = {}
    chars: dict[int, int] = defaultdict(int)
    aside: dict[int, int] = defaultdict(int)
    holder: dict[int, int] = {}
    around: dict[int, list[str]] = {}
    total = 0
    for kind, node, text in events:
        if kind != "text" or node.unseen:
            continue
        t = clean(htmllib.unescape(text))
        if not t:
            continue
        key = _key(node, article)
        at = found.get(key)
        if at is None:
            prior = IN_ARTICLE if node.main else NAMED_ASIDE if article or node.under else OPEN
            at = found[key] = Held(node.parent, prior, 0.0, 0, set())
            holder[key] = node.holder
            branch = node
            while branch.above is not None and not branch.branch:  # as far as inline elements go
                branch = branch.above
            around[key] = (branch.above.shown if branch.above is not None else None) or []
        at.features.update(_signed(xxhash.xxh64_intdigest(x)) for x in _SENTENCE.split(t) if x)
        chars[key] += len(t)
        if node.holder:
            aside[node.holder] += len(t)
        total += len(t)
    for key, at in found.items():
        at.share = (aside[holder[key]] if holder[key] else chars[key]) / total
        at.style = _signed(xxhash.xxh64_intdigest(" ".join(around[key])))
    return found


def host_of(url):
    """The host in lower case without port and user; empty for null and for what is no URL."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


NODE = "node long, content boolean, value long, page long, parent long, prior double, share double"


def _page(html_col: str, url_col: str) -> list[Column]:
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    return [host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), html.alias("html")]


def _nodes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """For each node of each page a row with its presentation and a row for each feature."""
    rows = pages.select(*_page(html_col, url_col)).select("host", "html", F.xxhash64("host", "html").alias("page"))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, page, h in zip(*(c.to_pylist() for c in b.columns)):
                for node, x in nodes_of(page, host).items():
                    out.append((node, False, x.style, h, x.parent, x.prior, x.share))
                    out.extend((node, True, v, h, None, None, None) for v in x.features)
                if len(out) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, NODE)


#: Evidence that speaks neither way, and evidence that speaks wholly for main text.
LEVEL, FULL = 0.85, 0.95


def importance(pages: Column, evidence: Column, prior: Column, share: Column) -> Column:
    """The mean of prior and stretched evidence, the prior weighed as a number of pages.

    It weighs 8 pages, and besides: where it speaks for the node, 4 for each page, by how
    sure it is and by the share of a page's text that the node holds; where it speaks
    against, 2 for each page, by how sure it is and by the share that its aside doesn't hold.
    """
    sure = F.abs(2 * prior - 1)
    w = 8 + pages * F.when(prior >= 0.5, 4 * sure * share).otherwise(2 * sure * (1 - share))
    return (w * prior + pages * stretched(evidence)) / (w + pages)


def stretched(evidence: Column) -> Column:
    return F.when(evidence < LEVEL, evidence / (2 * LEVEL)).otherwise(F.least(F.lit(1.0), 0.5 + (evidence - LEVEL) / (2 * (FULL - LEVEL))))


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", prior: bool = True) -> DataFrame:
    """``node, parent, pages, style, content, family, prior, share, importance`` for each node of the hosts' trees.

    ``style`` and ``content`` are importances by entropy over the host's distinct pages (1 for
    a node seen on one page), ``family`` is that of all text under the same parent, ``prior``
    and ``share`` are means.  Without ``prior`` importance is the stretched evidence alone.
    """
    seen = _nodes(pages, url_col, html_col)
    # Copies of a page count once; then each (node, feature) is one row with its count.
    keys = ["node", "content", "value"]
    seen = seen.groupBy(*keys, "page").agg(*(F.max(c).alias(c) for c in ("parent", "prior", "share")))
    seen = seen.groupBy(*keys).agg(F.count("*").alias("n"), F.max("parent").alias("parent"), F.sum("prior").alias("prior"), F.sum("share").alias("share"))
    of = lambda kind, x: F.sum(F.when(F.col("content") == kind, x).otherwise(0.0))
    l = F.col("n") * F.ln("n")  # noqa: E741
    tree = seen.groupBy("node").agg(
        F.max("parent").alias("parent"),
        of(False, F.col("n")).cast("long").alias("pages"),
        of(False, l).alias("ls"),
        of(True, F.col("n")).alias("f"),
        of(True, l).alias("lf"),
        F.sum("prior").alias("prior"),
        F.sum("share").alias("share"),
    )
    m = F.ln("pages")
    tree = tree.select(
        "node",
        "parent",
        "pages",
        F.when(F.col("pages") > 1, 1 - F.col("ls") / F.col("pages") / m).otherwise(1.0).alias("style"),
        F.when(F.col("pages") > 1, 1 - F.col("lf") / F.col("f") / m).otherwise(1.0).alias("content"),
        "f",
        (F.col("prior") / F.col("pages")).alias("prior"),
        (F.col("share") / F.col("pages")).alias("share"),
    )
    tree = materialise(tree, "style-nodes")  # read twice, and the pages only once for it
    families = tree.groupBy("parent").agg((F.sum(F.col("f") * F.col("content")) / F.sum("f")).alias("family"))
    tree = tree.join(families, "parent").select("node", "parent", "pages", "style", "content", "family", "prior", "share")
    evidence = 0.1 * F.col("style") + 0.45 * (F.col("content") + F.col("family"))
    weighed = importance(F.col("pages"), evidence, F.col("prior"), F.col("share")) if prior else stretched(evidence)
    return tree.withColumn("importance", weighed)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, prior: bool = True, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars`` (code points), ``text`` empty if there is none.

    Text of nodes of importance under ``threshold`` goes.  The set of these nodes is sent to
    all executors if it is within ``broadcast_bytes``; else each page's own nodes are joined
    with it and only those that it has are listed beside the page, so no list is longer than
    a page.  Null and empty pages have no text, null urls are one host, equal rows give equal
    rows; other columns are not read.
    """
    spark = pages.sparkSession
    tree = style_tree(pages, url_col=url_col, html_col=html_col, prior=prior)
    low = materialise(tree.where(F.col("importance") < threshold).select("node"), "style-tree")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), *_page(html_col, url_col))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:2]]
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"

    def texts(b: pa.RecordBatch, lows) -> pa.RecordBatch:
        found = [extract(h, x, host) for host, h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), lows)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if fits(low, F.lit(128), broadcast_bytes):
        shared = spark.sparkContext.broadcast(frozenset(r["node"] for r in low.collect()))  # within broadcast_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, (shared.value for _ in range(b.num_rows)))

        return rows.mapInArrow(run, schema)

    own = _nodes(pages, url_col, html_col).where("not content").select("node", "page").distinct()
    listed = own.join(low, "node").groupBy("page").agg(F.collect_list("node").alias("low"))
    rows = rows.withColumn("page", F.xxhash64("host", "html")).join(listed, "page", "left").select("page_id", "url", "host", "html", "low")

    def run_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield texts(b, (frozenset(x or ()) for x in b.column(4).to_pylist()))

    return rows.mapInArrow(run_listed, schema)
