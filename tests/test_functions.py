import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html_tree, json_records as J
from pagewright.functions import predicates as P
from pagewright.functions import text as X


def one(spark, **columns):
    df = spark.range(1).select(*[c.alias(k) for k, c in columns.items()])
    return df.first().asDict()


def test_captcha_and_platforms(spark):
    got = one(
        spark, a=P.is_captcha(F.lit('<div class="g-reCAPTCHA">')), b=P.is_captcha(F.lit("<p>hCaptcha</p>")), c=P.is_captcha(F.lit("plain")), d=P.is_captcha(F.lit(None).cast("string")),
        w=X.detect_platform(F.lit("x /WP-content/ y"), F.lit("")), n=X.detect_platform(F.lit("__NEXT_DATA__"), F.lit("u")), o=X.detect_platform(F.lit("no"), F.lit("u")),
        m=X.detect_platform(F.lit("image/png"), F.lit("")), j=X.detect_platform(F.lit("wp-cont"), F.lit("ent")), s=X.platform_scores(F.lit("static.wixstatic.com mage/"), F.lit("")),
    )
    assert (got["a"], got["b"], got["c"], got["d"]) == (True, True, False, False)
    assert got["w"] == "wordpress" and got["n"] == "nextjs" and got["o"] is None
    assert got["m"] == "magento" and got["j"] == "wordpress"  # a known false hit, and html and url read as one
    assert got["s"] == {"wix": 0.5, "magento": pytest.approx(1 / 3)}


def test_endpoints(spark):
    u = lambda s: F.lit(s)
    got = one(
        spark, a=P.is_api_endpoint(u("https://x/v2/listings.json")), b=P.is_api_endpoint(u("https://x/p"), F.lit(" Application/JSON; charset=x")), c=P.is_api_endpoint(u("https://x/about"), F.lit(None).cast("string")),
        d=P.is_data_api(u("https://x/API/promotions"), None, ("api",), ("PROMO",)), e=P.is_data_api(u("https://x/odd"), None, ("ODD", ""), ("",)), f=P.is_data_api(u("https://x/api/")),
        g=P.not_blocked(u("https://x/promotions/1"), F.array(F.lit("/promotions"))), h=P.not_blocked(u("https://x/1"), F.array(F.lit(""))), i=P.not_blocked(u("https://x/1"), F.lit(None).cast("array<string>")),
    )
    assert list(got.values()) == [True, True, False, False, True, True, False, True, True]


def test_outcomes(spark):
    rows = [(403, None), (407, None), (200, "captcha_detected"), (500, None), (0, "timeout"), (301, None), (None, "Auth failed")]
    df = spark.createDataFrame(rows, "s int, e string").select(P.failure_severity(F.col("s"), F.col("e")).alias("x"), P.outcome_delta(F.col("s"), F.col("e")).alias("d"), P.fetch_success(F.col("s"), F.col("e")).alias("ok"))
    got = df.collect()
    assert [r["x"] for r in got] == ["hard", "hard", "hard", "soft", "soft", "soft", "hard"]
    assert [r["d"] for r in got] == [-0.25, -0.25, -0.25, -0.05, -0.05, 0.05, -0.25]
    assert not any(r["ok"] for r in got)


BASES = ["https://a.example/x/y.html?q=1#f", "https://a.example", "http://u:p@a.example:80/x/"]
REFS = ["/abs?x=1", "rel", "../up", "./here/", "?only=q", "#frag", "//other.example/p", "https://z.example/q", "mailto:x@y", "", "a/../b", "..", "/a/./b/../c?x=../y"]


def test_joining_urls_agrees_with_the_standard_library(spark):
    df = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string")
    for row in df.withColumn("u", X.url_join(F.col("b"), F.col("r"))).collect():
        assert row["u"] == urljoin(row["b"], row["r"]), row


def test_names_and_hashes(spark):
    u = F.lit("https://u:p@a.example:80/x y")
    got = one(
        spark, a=X.normalize_key(F.lit(" Price USD ")), b=X.normalize_key(F.lit("item-name")), c=X.normalize_key(F.lit("__é__")), d=X.netloc(u), e=X.domain(F.lit("nowhere")), f=X.resolve_endpoint(F.lit("/api/{id}/?"), F.lit("https://a.example/p")),
        g=X.fill_template("a {x} {y} b", {"x": F.lit("1")}), h=X.render_keywords(F.array().cast("array<string>")), i=X.render_keywords(F.array(F.lit("a"), F.lit("b"))), j=X.api_signature(F.array(F.lit("b"), F.lit("a"))),
        k=X.proxy_parts(F.lit("http://me:p%40ss@h.example:80")), m=X.proxy_url(F.lit("http://h.example:80"), F.lit("me"), F.lit("p@ s")), n=F.length(X.fingerprint(F.lit("x"))), o=X.identity_bucket(u, 8),
        p=X.session_user("u", u, country="US"), q=X.session_user("u", u, sticky=False),
    )
    assert [got[k] for k in "abcdefghij"] == ["price_usd", "item_name", "", "u:p@a.example:80", "nowhere", "https://a.example/api", "a 1 {y} b", "(none)", "a, b", "a|b"]
    assert got["k"].asDict() == {"server": "http://h.example:80", "username": "me", "password": "p@ss"} and got["m"] == "http://me:p%40%20s@h.example:80"
    assert got["n"] == 32 and 0 <= got["o"] < 8 and got["p"].startswith("u-country-us-session-") and got["q"] == "u"


def test_json_records():
    assert J.find_records({"z": [1], "b": {"items": [{"Name": 1}]}, "c": [{"name": 2}]}, ["name"]) == [{"Name": 1}]
    assert J.find_records([{"x": 1}], ["name"]) == [] and J.find_records([{"x": 1}]) == [{"x": 1}]
    assert J.has_records('{"a": [{"unit_name": 1}]}', ["name"]) and not J.has_records('{"name": 1}', ["name"]) and not J.has_records("x", ["name"]) and not J.has_records("[{}]", [])
    assert J.matches_negative({"a": ["x MODULE_1"]}, ["MODULE_"]) and not J.matches_negative({"MODULE_": "a", "n": 5}, ["MODULE_", ""]) and not J.matches_negative(["MODULE_"], ["MODULE_"])
    assert J.rename({"Property Title": "House", "Other-Key": 1, "title": "last"}, {"title": ["Property Title", "name"]}) == {"title": "last", "other_key": 1}
    assert J.walk({"a": [{"b": 5}]}, "a[0].b") == 5 and J.walk({"a": [1]}, "a/0") == 1 and J.walk({"a": 1}, "a.b") is None and J.walk({"a": [1]}, "a[*]") is None and J.walk({"$": 1}, "$") == 1
    assert J.unwrap({"data": {"units": [1, 2]}}, "data.units") == [1, 2] and J.unwrap({"a": 1}, "b") == [] and J.unwrap({"t": 1, "r": [{"x": 1}]}, None) == [{"x": 1}] and J.unwrap({"x": 1}, None) == [{"x": 1}]
    assert J.project([{"id": 1, "p": {"m": 2}}, {}], {"rent": "p.m", "unit": "id"}) == [{"rent": 2, "unit": 1}]
    assert J.render_metadata({}) == "(none provided)" and json.loads(J.render_metadata({"b": 1, "a": 2})) == {"a": 2, "b": 1} and J.parse("[" * 100000) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9}, "b": {"enum": ["x"]}, "c": {"type": ["string", "null"], "pattern": "^z", "maxLength": 3}, "d": {"type": "array", "items": {"anyOf": [{"const": 1}, {"const": 2}]}}}}
    assert J.conforms({"a": 3, "b": "x", "c": None, "d": [1, 2]}, schema)
    for bad in ({}, {"a": 9}, {"a": 1.5}, {"a": True}, {"a": 3, "b": "y"}, {"a": 3, "c": "abc"}, {"a": 3, "c": "zabc"}, {"a": 3, "d": [3]}, []):
        assert not J.conforms(bad, schema), bad


def test_html_tree():
    root = html_tree.parse('<div id="m" class="a b"><p>one<p>two<ul><li>x<li data-k="v">y</ul><img src="i"><br></div><div><p class="q">three &amp; <b>four</b></p></div>')
    texts = lambda css: [n.text() for n in html_tree.select(root, css)]
    assert texts("#m > p") == ["one", "two"] and texts("li") == ["x", "y"] and texts("[data-k=v]") == ["y"] and texts("div p.q, .b li") == ["x", "y", "three &four"]
    assert texts("div.a.b ul > li[data-k^='v']") == ["y"] and texts("*[src$=i]") == [""]
    with pytest.raises(ValueError):
        html_tree.select(root, "p:first-child")
    assert html_tree.markdown("<h2>T</h2><p>a <b>b</b> <a href='x'>link</a></p><ul><li>1<li>2</ul><pre>c\n d</pre>") == "## T\n\na **b** link\n\n* 1\n* 2\n\n```\nc\n d\n```"
    assert html_tree.markdown("<p><b>open <p>x") and html_tree.markdown(None) == ""


def test_fixed_decimals_as_printf_has_them(spark):
    some = [0.625, 0.375, 0.615, 0.495, 1.005, 99.995, -0.125, -0.001, 0.0, 2.5, 123456789012345.67, 2251403475511.5818, 1e300] + [i / 200 for i in range(-99, 400)]
    got = spark.createDataFrame([(x,) for x in some], "x double").select("x", X.fixed(F.col("x"), 2).alias("two"), X.fixed(F.col("x"), 4).alias("four")).collect()
    assert [(r["two"], r["four"]) for r in got if r["x"] < 1e15] == [("%.2f" % x, "%.4f" % x) for x in some if x < 1e15]
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),)], "x double").select(X.fixed(F.col("x"), 2).alias("t")).collect()
    assert [r["t"] for r in odd] == ["NaN", "-Infinity"]
