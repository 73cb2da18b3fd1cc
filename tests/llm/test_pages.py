import html
import re

import time
from collections import Counter, defaultdict
from math import log

import pytest

from pagewright.llm import pages as P
from pagewright.llm.pages import extract, furniture, main_text, op6_html_extraction, style_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- <p>x</p> --><div class="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p><b>First
 para&nbsp;graph.<br>same <i>bl</i>ock</b><p>Second &lt;one&gt;<ul><li>item one<li>item two</ul>
<div class="share">Tell</div><form><p>Mail</p></form><blockquote>Quote<p>inner</blockquote>tail text<div class="comments"><p>me too</p></div></article>
<aside>Side</aside><footer><p>&copy; x</p></footer></body></html>"""


def test_one_page():
    assert main_text(PAGE) == "Title & more\n\nFirst para graph. same block\n\nSecond <one>\n\nitem one\n\nitem two\n\nQuote\n\ninner\n\ntail text"
    assert main_text("plain <b>te</b>xt &eacute; <p>two") == "plain text é\n\ntwo"
    assert main_text("<div><p>a</div><p>b<script>x") == "a\n\nb"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""


def test_class_names_that_only_look_like_furniture():
    body = '<article class="post sidebar-story"><div class="article-header"><h1>Head</h1></div><div class="share-price">12 up</div><div class="related-work"><p>Others did.</p></div><header><h2>Part</h2></header></article>'
    assert main_text(f"<body class='sidebar-right'>{body}") == "Head\n\n12 up\n\nOthers did.\n\nPart"
    assert main_text('<p>Hello <span class="advert">Buy <b>now</b></span>world <i hidden>secret</i>again') == "Hello world again"
    assert main_text('<p>a<p>b<div class="commentList">no</div><div aria-hidden="true">no</div><div role=navigation>no</div><div style="display: none">no</div>c') == "a\n\nb\n\nc"
    assert main_text('<div class="lead"><p>Lead.</p></div><article><p>Text.</p></article><section class="user-comments"><p>first!</p></section>') == "Lead.\n\nText."
    assert [furniture(x) for x in ("main-nav", "ad-1", "content", "header-image", "related_posts")] == [True, True, False, False, True]


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<a href=\"x " * 100_000, "<p>a" + "<a '\"> b" * 60_001, "<h1>" * 50_000 + "x", "<p>" + "<h1>" * 30_000 + "</section>" * 30_000, "<b>" * 60_000 + "</i>" * 60_000 + "x", "<span class=ad>" * 40_000 + "<p>x", "<!--" * 50_000, "<script>" * 50_000, "<li>x" * 50_000, "<ul><li>x" * 20_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    blocks = P.blocks(page)[0]
    P._facts(page)
    main_text(page, frozenset([1]))
    assert time.process_time() - began < 20
    assert len(blocks) <= 100_000


def test_heads_of_articles_drawings_and_labels_stay():
    for name in ("text-header", "post-header", "content-header", "entry-header", "header"):
        assert main_text(f'<article><div class="{name}">Title</div><p>a</p></article>') == "Title\n\na"
    assert main_text('<div class="post-header">Title</div><p>a</p>') == "Title\n\na" and main_text('<div class="site-header">Site</div><header>x</header><p>a</p>') == "a"
    assert main_text("<article><p>a<svg><path/></p><p>b important</p></article>") == main_text("<article><p>a<svg><path>t</svg></p><p>b important</p></article>") == "a\n\nb important"
    assert main_text("<p>a <svg><title>t</title><text>drawn</text></svg>b<svg><g><div>c</div>") == "a b\n\nc"
    assert main_text("<p>use <label>Name</label> here</p><form><label>Mail</label></form>") == "use Name here"


def test_recurring_heads_go_by_their_texts(spark):
    """A name that could be a site's head or an article's: what its pages have there decides."""
    make = lambda i, text: f"<div class='text-header'><p>{text}</p></div><div class='t'><p>Story {i}.</p></div>"
    rows = [(i, "http://a/x", make(i, "Our site")) for i in range(6)] + [(10 + i, "http://b/x", make(i, f"Title {i}")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3." and got[13] == "Title 3\n\nStory 3."


def test_markup_that_does_not_end():
    assert main_text("<p>one<p>two<a href='x>three</a> four</p><p>five") == "one\n\ntwothree four\n\nfive"
    assert main_text("<p>a < b and 1<2 <p>c<!-- d") == "a < b and 1<2\n\nc" and main_text("<p>a<div class=") == "a"


def brute_tree(pages):
    """(url host, html) -> {(host, node): importance}, page by page from the definition."""
    seen = defaultdict(lambda: defaultdict(list))
    for host, page in pages:
        for node, kind, value in P._facts(page):
            seen[host, node][kind].append(value)
    out = {}
    for (host, node), facts in seen.items():
        m = len(facts[P._PRESENTATION])
        presentation = -sum(k / m * log(k / m, m) for k in Counter(facts[P._PRESENTATION]).values()) if m > 1 else 1.0

        def own(leaf, host=host):
            on, times = len(seen[host, leaf][P._PRESENTATION]), Counter(seen[host, leaf][P._CONTENT]).values()
            return 1.0 if on < 2 else 1 - sum(log(k) / log(on) for k in times) / len(times)

        inside = Counter(facts[P._INSIDE])
        content = sum(k * own(leaf) for leaf, k in inside.items()) / sum(inside.values())
        expected = P.MARKED if facts[P._MARKED] else 1 - (1 - P.OUTSIDE) * len(facts[P._OUTSIDE]) / m
        out[host, node] = expected * ((1 - P.GAMMA) * presentation + P.GAMMA * content)
    return out


def test_tree_agrees_with_brute_force(spark, sf):
    rows = [(r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(f"http://x.example/{i}", f"<div class=a><p>same</p></div><div class=b{i}><p>text {i}</p><p>{i % 3}</p></div><nav>{i}</nav>") for i in range(9)]
    want = brute_tree([(u.split("/")[2].lower(), p) for u, p in rows])
    got = {(r["host"], r["node"]): r["importance"] for r in style_tree(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert len({k[0] for k in want}) > 5


def test_entropies_cut_unmarked_furniture(spark, sf):
    """The pages of the table, their furniture stripped of its marks: what recurs goes by the entropies alone."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    plain = [(i, f"http://one.example/{i}", "<div class='q'><p>Read all our stories here</p></div>" + r["html"].replace("<footer>", "<div class='z'><p>All rights with us</p></div><footer>")) for i, r in enumerate(rows)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()}
    changed = 0
    for i, _, page in plain:
        without_tree = main_text(page)
        assert "Read all our stories" in without_tree and "All rights with us" in without_tree
        assert got[i] == main_text(rows[i]["html"])
        changed += got[i] != without_tree
    assert changed == len(rows)


def test_site_style_tree_cuts_what_recurs(spark):
    make = lambda i: f"<body><div class='top'><p>Welcome to our site</p></div><div class='text'><p>Story {i} is told here.</p><p>And goes on {i * 7}.</p></div><div class='box-{i}'>Call us today</div></body>"
    rows = [(i, f"http://a.example/{i}", make(i)) for i in range(8)] + [(100, "http://b.example/x", make(100)), (101, None, None), (None, "::", ""), (102, "http://c.example/", "<p>" + "word " * 100000)]
    rows += [(200 + i, f"http://same.example/{i}", "<article><p>All alike.</p></article>") for i in range(6)] + [(200, "http://same.example/0", "<article><p>All alike.</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host", "2 as node")
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert got[3] == "Story 3 is told here.\n\nAnd goes on 21."
    assert got[100] == "Welcome to our site\n\nStory 100 is told here.\n\nAnd goes on 700.\n\nCall us today"
    assert got[101] == got[None] == "" and len(got[102]) == 499999 and got[205] == "All alike."
    assert extract(df).count() == len(rows) and extract(df.limit(0)).collect() == []
    tree = style_tree(df).where("host = 'a.example'").collect()
    assert tree and all(-1e-9 <= r["importance"] <= 1 + 1e-9 for r in tree)


def test_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op6_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[i]["text"] == "\n\n".join(p for p in parts if p) and got[i]["n_chars"] == len(got[i]["text"])
