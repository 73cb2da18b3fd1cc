"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: elements that stand at the same path of tags, classes, ids and roles (digits
count as alike) are one node of the host's tree, whatever they are. A node on m pages has
- a presentation importance: the entropy, to the base m, of the child sequences that it shows on them;
- a content importance: 1 - mean over its distinct texts of log(pages with the text) / log(m), weighted over the text
  nodes in it. Texts that recur on all pages give 0, texts of one page only give 1.
Its entropy importance is (1 - GAMMA) * presentation + GAMMA * content; on one page alone it is 1, for want of evidence.
Its importance is that times what its markup leads to expect:
- MARKED for what HTML or a plain class name says is no part of an article: menus, footers, side matter, forms, adverts,
  notices, comments, hidden elements, and page headers outside an article (heads of posts and texts are unmarked);
- down to OUTSIDE by the share of its pages on which an article or main element stands elsewhere; else 1.
Branches of importance below LEAST are cut from each page. MARKED is below it, so marked branches go on hosts of one page
too; unmarked ones go if their texts recur over the host's pages.

The tree is counted by (host, node, text) after each task has counted its own pages, so a host with a
third of all pages spreads over all tasks. The list of cut nodes is broadcast if it is short.

Defined results
- null or empty html, or none left: empty text, n_chars 0. If the entropies leave nothing of a page's unmarked text, its
  unmarked text is kept (all of its host's pages are alike).
- null or unparsable url: pages of one nameless host. null page_id, repeated rows: kept as they are.
- markup that doesn't end: what follows `<name` without any `>` is no text; nor is a comment, script or style without an end.
- elements nested deeper than DEPTH stand at that depth, as in browsers.
- inline elements that are marked are left out of their block; a drawing (svg) ends where a block begins, if it has no end.
- an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import bounded_batches
from pagewright.sources.session import checkpoint, prepare_workers, table

GAMMA = 0.9
LEAST = 0.2
MARKED, OUTSIDE = 0.15, 0.45
DEPTH = 512
BROADCAST_ROWS = 100_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
# Elements of HTML by their part in a page.
RAW = frozenset("script style textarea noscript template title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())
MARKED_TAGS = frozenset("nav footer aside form button select option input svg dialog menu head object embed canvas audio video map".split())
#: Elements that hold the page: their class names don't mark them.
WHOLE = frozenset("html body main".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class names and ids that name page furniture, and words that may stand beside them in one name without changing that.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs footer sidebar "
    "widget cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "comment comments respond reply replies disqus pagination pager skip toolbar".split()
)
# Words that name a head, and words beside them that make it the head of an article or of a part of it.
HEADS = frozenset("header masthead".split())
PARTS = frozenset("post posts article articles stories text body content title section item items list lists".split())
BESIDE = frozenset(
    "site page main global top bottom left right upper lower primary secondary mobile desktop sticky fixed box bar list lists item items link links area block container wrapper wrap inner outer "
    "section row col column panel slot unit button buttons icon icons text body form thread user reader posts post articles stories content head title and the of to for in on".split()
)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _digest(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def furniture(name: str) -> bool:
    """Whether a class name or id names page furniture, and nothing else.

    >>> [furniture(x) for x in ("ad", "site-footer", "cookieNotice", "related-work", "share-price", "article-header")]
    [True, True, True, False, False, False]
    """
    words = _words(name)
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in HEADS or w in BESIDE for w in words)


def head_of(name: str) -> bool:
    """Whether a class name or id names the head of a page, if it stands outside an article; that of a post, a text or a section is the article's.

    >>> [head_of(x) for x in ("header", "siteHeader", "masthead", "post-header", "content-header", "header-image")]
    [True, True, True, False, False, False]
    """
    words = _words(name)
    return any(w in HEADS for w in words) and all(w in HEADS or w in BESIDE for w in words) and not any(w in PARTS for w in words)


def _words(name: str) -> list[str]:
    return [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]


class Element:
    """An open element; its node is that of its path."""

    __slots__ = ("tag", "parent", "node", "depth", "marked", "main", "inline")

    def __init__(self, tag: str, parent: Element | None, shown: str = "", marked: bool = False, inline: bool = False) -> None:
        self.tag, self.parent, self.inline = tag, parent, inline
        self.depth = parent.depth + 1 if parent else 0
        self.marked = marked or bool(parent and parent.marked)
        self.main = tag in ("article", "main") or bool(parent and parent.main)
        self.node = 0 if not parent else parent.node if inline or self.depth > DEPTH else _digest(parent.node, shown)


class Block:
    """A stretch of text in the element that holds it."""

    __slots__ = ("of", "text")

    def __init__(self, of: Element, text: str) -> None:
        self.of, self.text = of, text


_NAMES: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _shown(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """How an element is shown in the tree, whether its own markup marks it, and whether it is a page's head if it stands outside an article."""
    known = _NAMES.get((tag, attrs))
    if known is None:
        found = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(attrs)} if attrs else {}
        names = sorted({_DIGITS.sub("#", n) for k in ("class", "id") for n in found.get(k, "").split()})
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        marked = tag in MARKED_TAGS or hidden or tag not in WHOLE and (role in MARKED_ROLES or any(map(furniture, names)))
        known = ".".join([tag, *names, role, "hidden" * hidden]), marked, tag == "header" or tag not in WHOLE and any(map(head_of, names))
        if len(_NAMES) >= 20_000:
            _NAMES.clear()
        if len(attrs) < 500:
            _NAMES[tag, attrs] = known
    return known


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, ""), (tag, "", attributes) and ("/tag", "", "") in their order, in time linear in the page."""
    at, quoted, n = 0, True, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "", page[at:lt], ""
        if lt + 1 >= n:
            if lt < n:
                yield "", "<", ""
            return
        c = page[lt + 1]
        if c in "!?" or (c == "/" and not page[lt + 2 : lt + 3].isalpha()):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 2)
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        if not ("a" <= c <= "z" or "A" <= c <= "Z" or c == "/"):
            yield "", "<", ""
            at = lt + 1
            continue
        m = _TAG.match(page, lt) if quoted else None
        if m is None:
            quoted = False  # a quote that doesn't end: from here on, tags end at the next >
            m = _PLAIN.match(page, lt)
            if m is None:
                if page.find(">", lt) < 0:
                    return
                yield "", "<", ""
                at = lt + 1
                continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            yield "/" + tag, "", ""
            continue
        yield tag, "", m[3]
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None:
                return
            at = end.end()


def blocks(page: str | None) -> tuple[list[Block], dict[int, list[str]]]:
    """The page's text blocks, and for each node its child sequence; runs of equal children count once."""
    out: list[Block] = []
    children: dict[int, list[str]] = {}
    stack = [Element("", None)]
    opened: Counter = Counter()
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                at = stack[-1]
                while at.inline:
                    at = at.parent
                out.append(Block(at, text))

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    for tag, text, attrs in _tokens(page or ""):
        if text:
            if not (stack[-1].inline and stack[-1].marked and not _block_of(stack[-1]).marked):
                buffer.append(text)
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in RAW or tag in VOID and tag != "hr":
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag] <= 0:
                continue
            block, barrier = tag in BLOCKS, tag not in CONTAINERS
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if block:
                        flush()
                    cut(i)
                    break
                if barrier and stack[i].tag in CONTAINERS or not block and not stack[i].inline:
                    break
            continue
        shown, marked, head = _shown(tag, attrs.strip())
        if tag not in BLOCKS:
            if not attrs.endswith("/"):
                stack.append(Element(tag, stack[-1], shown, marked, True))
                opened[tag] += 1
            continue
        flush()
        if opened["svg"] > 0:  # a drawing ends where a block begins
            cut(next(i for i, e in enumerate(stack) if e.tag == "svg"))
        while stack[-1].inline:  # a block ends the inline elements before it, but for what they mark
            if stack[-1].marked and not _block_of(stack[-1]).marked:
                break
            cut(len(stack) - 1)
        closes = _CLOSED_BY.get(tag, set()) | {"p"}
        if any(opened[t] > 0 for t in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    cut(i)
                    if tag not in _CLOSED_BY:
                        break
                elif stack[i].tag in CONTAINERS and stack[i].tag not in closes:
                    break
        parent = stack[-1]
        element = Element(tag, parent, shown, marked or head and not parent.main)
        if element.depth <= DEPTH:
            sequence = children.setdefault(parent.node, [])
            if not sequence or sequence[-1] != shown:
                sequence.append(shown)
        if tag not in VOID:
            stack.append(element)
            opened[tag] += 1
    flush()
    return out, children


def _block_of(e: Element) -> Element:
    while e.inline:
        e = e.parent
    return e


_PRESENTATION, _CONTENT, _INSIDE, _OUTSIDE, _MARKED = range(5)
COUNTS = "host string, node long, kind int, value long, pages long"


def _facts(page: str | None) -> set[tuple[int, int, int]]:
    """(node, kind, value) of a page: what is counted, by pages."""
    parts, children = blocks(page)
    own: set[tuple[int, int, int]] = set()
    around: dict[int, list[Element]] = {}
    article = any(b.of.main and not b.of.marked for b in parts)
    holds_main: set[int] = set()
    for b in parts:
        leaf = b.of.node
        own.add((leaf, _CONTENT, _digest(b.text)))
        if leaf not in around:
            chain, e = [], b.of
            while e is not None and e.parent is not None:
                if not e.inline and (not chain or chain[-1].node != e.node):
                    chain.append(e)
                e = e.parent
            around[leaf] = chain
            if b.of.main:
                holds_main.update(x.node for x in chain)
    for leaf, chain in around.items():
        for e in chain:
            own.add((e.node, _INSIDE, leaf))
            own.add((e.node, _PRESENTATION, _digest(*children.get(e.node, []))))
            if e.marked:
                own.add((e.node, _MARKED, 0))
            if article and e.node not in holds_main:
                own.add((e.node, _OUTSIDE, 0))
    return own


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update((host, *fact) for fact in _facts(page))
        keys = list(zip(*found, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds, strict=True)), pa.array(list(found.values()), pa.int64())], ["host", "node", "kind", "value", "pages"])


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__host", F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))


def style_tree(pages: DataFrame) -> DataFrame:
    """(url, html) -> (host, node, pages, presentation, content, marked, importance) of all nodes of the hosts' trees that hold text."""
    prepare_workers(pages.sparkSession)
    bounded_batches(pages)
    counts = with_host(pages).select("__host", F.col("html").cast("string")).mapInArrow(_counted, COUNTS)
    counts = checkpoint(counts.groupBy("host", "node", "kind", "value").agg(F.sum("pages").alias("pages")))
    k, kind = F.col("pages"), F.col("kind")
    of = lambda x: F.coalesce(F.sum(F.when(kind == x, k)), F.lit(0))
    nodes = counts.where(kind.isin(_PRESENTATION, _OUTSIDE, _MARKED)).groupBy("host", "node").agg(
        of(_PRESENTATION).alias("m"), F.sum(F.when(kind == _PRESENTATION, k * F.log(k.cast("double")))).alias("klogk"), (of(_OUTSIDE)).alias("outside"), (of(_MARKED) > 0).alias("marked")
    )
    base = F.log(F.greatest("m", F.lit(2)).cast("double"))
    one = F.col("m") < 2
    nodes = nodes.select("host", "node", "m", "marked", (F.col("outside") / F.col("m")).alias("outside"), F.when(one, 1.0).otherwise((F.log("m") - F.col("klogk") / F.col("m")) / base).alias("presentation"))
    texts = counts.where(kind == _CONTENT).groupBy("host", "node").agg(F.avg(F.log(k.cast("double"))).alias("spread"))
    leaves = nodes.join(texts, ["host", "node"]).select(F.col("host").alias("h"), F.col("node").alias("leaf"), F.when(one, 1.0).otherwise(1 - F.col("spread") / base).alias("own"))
    inside = counts.where(kind == _INSIDE).select("host", "node", F.col("value").alias("leaf_of"), "pages")
    inside = inside.join(leaves, (inside["host"] == leaves["h"]) & (inside["leaf_of"] == leaves["leaf"]), "left")
    content = inside.groupBy("host", "node").agg((F.sum(F.col("pages") * F.coalesce("own", F.lit(1.0))) / F.sum("pages")).alias("content"))
    expected = F.when(F.col("marked"), F.lit(MARKED)).otherwise(1 - (1 - OUTSIDE) * F.col("outside"))
    importance = expected * ((1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content"))
    return nodes.join(content, ["host", "node"]).select("host", "node", F.col("m").alias("pages"), "presentation", "content", "marked", importance.alias("importance"))


def main_text(page: str | None, cut: frozenset[int] = frozenset()) -> str:
    """The text of a page without its marked branches, which are below LEAST on every host, and without the nodes in cut."""
    parts = [b for b in blocks(page)[0] if not b.of.marked]
    gone: dict[int, bool] = {}

    def inside_cut(e: Element) -> bool:
        chain = []
        while e is not None and id(e) not in gone:
            chain.append(e)
            e = e.parent
        found = gone[id(e)] if e is not None else False
        for x in reversed(chain):
            found = found or x.node in cut
            gone[id(x)] = found
        return gone[id(chain[0])] if chain else found

    left = [b.text for b in parts if not inside_cut(b.of)] if cut else []
    return "\n\n".join(left or [b.text for b in parts])


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars)."""
    prepare_workers(pages.sparkSession)
    bounded_batches(pages)
    cut = style_tree(pages).where((F.col("importance") < least) & ~F.col("marked"))
    cut = checkpoint(cut.groupBy(F.col("host").alias("of")).agg(F.collect_list("node").alias("cut")))
    if cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cut = F.broadcast(cut)
    rows = with_host(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    rows = rows.join(cut, rows["__host"] == cut["of"], "left").select("page_id", "url", "html", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, frozenset(cut or ())) for page, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
