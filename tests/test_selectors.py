import random
import time

import pytest

from pagewright.functions import html_tree as H
from pagewright.functions.selectors import Automaton, Query, answers
from pagewright.operators.extraction import Options, Page, _from_dom, _json_ld, _microdata, dom_css

TAGS = ["div", "p", "span", "li", "ul", "a", "td", "tr", "table", "b", "script", "style", "br", "img", "section", "body", "option", "select"]
ATTRS = ['class="x"', 'class="y x"', 'class="z"', 'id="i"', 'id="j"', 'content="c"', "itemscope", 'itemprop="n"', 'itemprop="m"', 'itemprop=""', 'data-k="one two"', "class=''"]


def page(r: random.Random, n: int) -> str:
    """Markup with unclosed, crossed and implied ends, leaves, comments and stray ends."""
    out = []
    for _ in range(n):
        tag = r.choice(TAGS)
        kind = r.random()
        if kind < 0.5:
            out.append(f"<{tag} {' '.join(r.sample(ATTRS, r.randint(0, 3)))}{'/' if r.random() < 0.05 else ''}>")
        elif kind < 0.75:
            out.append(f"</{tag}>")
        else:
            out.append(r.choice([" a &amp; b ", "\n", "text", "<!-- no -->", "&#233;", " t<1 "]))
    return "".join(out)


def compound(r: random.Random) -> str:
    parts = [r.choice([*TAGS, "*", ""]), r.choice(["", "", ".x", ".y.x", "#i"]), r.choice(["", "", "", "[itemprop]", '[class="x"]', "[data-k~=two]", "[class^='y']", '[id$="i"]', "[class*=z]"])]
    return "".join(parts) or "p"


def selector(r: random.Random) -> str:
    one = lambda: "".join(compound(r) + r.choice([" ", " > ", ">"]) for _ in range(r.randint(0, 2))) + compound(r)
    return r.choice([", ", ","]).join(one() for _ in range(r.choice([1, 1, 1, 2])))


@pytest.mark.parametrize("seed", range(150))
def test_equal_to_the_tree(seed):
    r = random.Random(seed)
    html, fields, scopes = page(r, r.choice([5, 40, 200])), [selector(r) for _ in range(4)], [selector(r) for _ in range(r.randint(0, 2))]
    root = H.parse(html)
    given = [n for css in scopes for n in H.select(root, css)]
    found = answers(html, {"first": Query(fields, scopes), "all": Query(fields, scopes, every=True, fallback=False), "raw": Query(fields, every=True, raw=True)})
    per = lambda scope, css: [(n.attrs, H.value_of(n)) for n in H.select(scope, css)]
    for name, within in (("first", given or [root]), ("all", given if scopes else [root])):
        assert len(found[name]) == len(within)
        for hits, scope in zip(found[name], within, strict=True):
            for i, css in enumerate(fields):
                want = per(scope, css)
                assert [h[1:] for h in hits if h.selector == i] == (want[:1] if name == "first" else want)
    for i, css in enumerate(fields):
        assert [h.value for h in found["raw"][0] if h.selector == i] == [n.raw_text() for n in H.select(root, css)]


def tree_records(html, selectors, containers):
    root = H.parse(html)
    out = []
    for scope in [n for css in containers for n in H.select(root, css)] or [root]:
        values = {k: H.value_of(hits[0]) for k, css in selectors.items() if (hits := H.select(scope, css))}
        if values := {k: v for k, v in values.items() if v}:
            out.append(values)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_tiers(seed):
    r = random.Random(1000 + seed)
    html = page(r, 150) + '<script type="application/ld+json">[{"a": "<b>1</b>"}]</script><script type="application/ld+json">{"b": 2}'
    selectors, containers = {k: selector(r) for k in "abc"}, [selector(r) for _ in range(r.randint(0, 2))]
    one = Page("u", html, profile={"selectors": selectors, "containers": containers})
    assert _from_dom(one) == tree_records(html, selectors, containers)
    assert (dom_css(selectors).extract(one, Options())[0] or []) == tree_records(html, selectors, [])
    root = H.parse(html)
    micro = [{n.attrs["itemprop"]: H.value_of(n) for n in H.select(s, "[itemprop]") if n.attrs["itemprop"]} for s in H.select(root, "[itemscope]")]
    assert _microdata(one, Options())[0] == [m for m in micro if m]
    scripts = [n.raw_text() for n in H.select(root, 'script[type="application/ld+json"]')]
    assert len(_json_ld(one, Options())[0]) == sum(s.startswith(("[", "{")) for s in scripts)


def test_same_selectors_for_scopes_and_fields():
    got = answers("<div>a<div>b</div></div>", {"q": Query(("div",), ("div",))})["q"]
    assert [[h.value for h in hits] for hits in got] == [["b"], []]


def test_odd_input():
    query = {"q": Query(("p", "", ",", "> b"))}
    assert answers(None, query) == answers("", query) == {"q": [[]]}
    assert [h.value for h in answers("<p> a <b> c</b>", query)["q"][0]] == ["ac", "c"]
    for bad in ("a:hover", "p::before", "a + b"):
        with pytest.raises(ValueError):
            Automaton([bad])
    html = '<h1>x</h1><script type="application/ld+json">{"k": 1}</script>'
    broken = Page("u", html, profile={"selectors": {"t": "h1:first-child"}})
    with pytest.raises(ValueError):
        _from_dom(broken)
    assert _json_ld(broken, Options())[0] == [{"k": 1}]  # the other tiers go on


def test_linear_in_the_page():
    """Deep nesting, stray ends and implied ends cost no more for each token than a flat page."""
    query = {"q": Query(("div > p.x span", "#none"), ("ul.l",))}
    for part in ("<span>", "<i></b>", "<p><b>", "<ul class=m><li>"):
        took = []
        for n in (4_000, 32_000):
            start = time.process_time()
            answers("<body>" + part * n, query)
            took.append(time.process_time() - start)
        assert took[1] < 8 * 4 * max(took[0], 0.01), (part, took)
