import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import discovery as D
from pagewright.operators import extraction as E
from pagewright.operators import learning as L
from pagewright.operators import proxies as Z
from pagewright.operators import records as R
from pagewright.operators import reports as T
from pagewright.operators import responses as A
from pagewright.plans import crawl

HTML = '<A class="x" HREF="/a?x=1&amp;y=2">1</A><a href=\'rel\'>2</a><a href="https://other.example/z">3</a><a href="javascript:x">4</a><a href="#s">5</a><a href=" mailto:m@x ">6</a><a name="n">7</a><a href="/a?x=1&amp;y=2">8</a><!-- <a href="/no"> --><script>"<a href=\'/no\'>"</script>'


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def test_links(spark):
    got = [r["link"] for r in D.extract_links(pages(spark, ("https://x.example/d/p", HTML), ("https://y.example", None), ("https://z.example", ""))).orderBy("pos").collect()]
    assert got == ["https://x.example/a?x=1&y=2", "https://x.example/d/rel", "https://other.example/z", "https://x.example/a?x=1&y=2"]


def test_ranking_is_stable_and_drops_negatives(spark):
    df = spark.createDataFrame([("p", i, u) for i, u in enumerate(["https://x/admin/articles", "https://x/b", "https://x/articles/1/2/3/4/5", "https://x/ARTICLES", "https://x/c"])], "url string, pos int, link string")
    got = [(r["link"], round(r["score"], 2)) for r in D.rank_links(df, ["articles"], ["ADMIN"], 0.0).orderBy("rank").collect()]
    assert got == [("https://x/articles/1/2/3/4/5", 1.0), ("https://x/ARTICLES", 1.0), ("https://x/b", 0.05), ("https://x/c", 0.05)]
    assert {r["score"] for r in df.withColumn("score", D.score_url(F.col("link"), (), ("",))).collect()} == {-1.0}
    assert {r["score"] for r in df.withColumn("score", D.score_url(F.col("link"))).collect()} == {0.1}
    assert D.top_links(D.rank_links(df, ["articles"]), 1).count() == 1


def test_discovery_and_candidates(spark):
    html = HTML + """<script>f("/v/api/list"); f('/x/data/a.json'); f("/api/items"); f("/v/api/list")</script>"""
    p = pages(spark, ("https://x.example/d", html)).withColumn("content_type", F.lit("text/html"))
    links, apis = D.discover(p, ["rel"], threshold=0.4)
    assert [r["link"] for r in links.collect()] == ["https://x.example/rel"] and [r["api_url"] for r in apis.orderBy("pos").collect()] == ["https://x.example/v/api/list", "https://x.example/x/data/a.json"]
    got = D.api_candidates(p, ["X/DATA"], ["nothing"]).orderBy("rank").collect()
    assert [(r["score"], r["api_url"]) for r in got] == [(0.95, "https://x.example/x/data/a.json"), (0.5, "https://x.example/v/api/list")]
    got = D.link_candidates(p, ["REL"], ["rel", "y"]).orderBy("rank").collect()
    assert [(round(r["score"], 2), r["link"]) for r in got] == [(0.9, "https://x.example/rel"), (0.3, "https://x.example/a?x=1&y=2")]
    ranked = D.rank_links(D.extract_links(p)).withColumn("link", F.when(F.col("rank") == 1, F.lit("https://x/api/1")).otherwise(F.col("link")))
    assert D.crawl_candidates(ranked, 2).count() == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_pages_of_one_url(spark, parts):
    """Endpoints are ranked page by page; links of the url's pages tie in page order, however the pages are dealt."""
    page = lambda i: (i, "https://x.example/d", f'<a href="/same{9 - i}">a</a><a href="/later{9 - i}">b</a><script>f("/v/api/{i}"); f("/v/api/all")</script>', "text/html")
    p = spark.createDataFrame([page(i) for i in (3, 1, 2)], "page_id long, url string, html string, content_type string").repartition(parts)
    got = D.api_candidates(p, ["api/all"], page=["page_id"]).collect()
    assert sorted((r["page_id"], r["rank"], r["api_url"][-5:]) for r in got) == [(i, k, u) for i in (1, 2, 3) for k, u in ((1, "i/all"), (2, f"api/{i}"))]
    names = [f"https://x.example/{n}{9 - i}" for n in ("same", "later") for i in (1, 2, 3)]
    links = D.discover(p, threshold=0.1, page=["page_id"])[0].where(~F.col("link").contains("api")).orderBy("rank")
    assert [r["link"] for r in links.collect()] == names
    assert [r["link"] for r in D.rank_links(D.extract_links(p, ["page_id"]), page=["page_id"]).orderBy("rank").collect()] == names
    assert [r["link"] for r in D.link_candidates(p, page=["page_id"]).orderBy("rank").collect()] == names


LD = '<script type="application/ld+json">{"@type":"Product","name":"Widget","price":"9.99"}</script>'
MICRO = '<div itemscope><span itemprop="name">Gadget</span><span itemprop="price" content="19.99">x</span></div>'


def records(df):
    return [(r["tier_used"], json.loads(r["record_json"]) if r["record_json"] else None) for r in df.orderBy("url", "rec_idx").collect()]


def test_tiers(spark):
    nested = 'window.__NUXT__ = {"a": {"b": 1}; };</script><script>window.__APOLLO_STATE__ = {"rows":[{"title":"T"}]};</script>'
    p = spark.createDataFrame(
        [("1", LD, ""), ("2", MICRO, "text/html"), ("3", '[{"title":"A"},{"title":"B"},3]', "application/json"), ("4", nested, ""), ("5", "<p>none", ""), ("6", None, None), ("7", '<script id="__NEXT_DATA__" type="x">{"p":{"items":[{"title":"N"}]}}</script>', ""), ("8", '<script type="application/ld+json">{bad</script>' + LD + MICRO, "")],
        "url string, html string, content_type string",
    )
    got = records(E.extract(p))
    widget = {"@type": "Product", "name": "Widget", "price": "9.99"}
    assert got == [("json_ld", widget), ("microdata", {"name": "Gadget", "price": "19.99"}), ("api_json", {"title": "A"}), ("api_json", {"title": "B"}), ("embedded_blob:apollo", {"title": "T"}), (None, None), (None, None), ("embedded_blob:next_data", {"title": "N"}), ("json_ld", widget)]
    assert records(E.extract(p.where("url = 3"), ["title"])) == [("known_api", {"title": "A"}), ("known_api", {"title": "B"})]
    assert records(E.extract(p.where("url = 3"), ["nope"])) == [("api_json", {"title": "A"}), ("api_json", {"title": "B"})]


def test_replay(spark):
    maps = [{"field": "rent", "pattern": "/units", "paths": {"rent": "pricing.monthly"}, "envelope": "data.units"}, {"field": "unit_id", "pattern": "/units", "hint": "id"}, {"field": "x", "pattern": "/gone", "paths": {"x": "x"}}]
    body = '{"data":{"units":[{"id":"A","pricing":{"monthly":1000}},{"id":"B"},{}]}}'
    df = spark.createDataFrame([("1", LD, json.dumps({"mappings": maps}), {"/units": body, "/gone": "404"}), ("2", "<ul><li><b>n1</b></li><li><i>x</i></li></ul>", json.dumps({"selectors": {"n": "b"}, "containers": ["li"]}), {}), ("3", LD, json.dumps({"selectors": {"n": "em"}}), None)], "url string, html string, profile_json string, payloads map<string,string>")
    assert records(E.extract(df)) == [("profile_replay", {"rent": 1000, "unit_id": "A"}), ("profile_replay", {"unit_id": "B"}), ("profile_replay", {"n": "n1"}), ("json_ld", {"@type": "Product", "name": "Widget", "price": "9.99"})]
    blocked = spark.createDataFrame([("https://x/api/promotions", '[{"a":1}]', '{"blocked": ["/promotions"]}'), ("https://x/api/units", '[{"a":1}]', '{"blocked": ["/promotions"]}')], "url string, html string, profile_json string")
    assert records(E.extract(blocked, ["a"])) == [(None, None), ("known_api", {"a": 1})]


def test_plug_in_tiers(spark):
    registry = E.Registry()
    registry.register(E.dom_css({"t": "title"}, 4))
    registry.register(E.Tier("own", 0.5, 1.0, lambda p, o: "own" in p.html, lambda p, o: ([{"k": 1}], "own")))
    registry.register(E.Tier("broken", 0.1, 1.0, lambda p, o: True, lambda p, o: 1 / 0))
    assert [t.name for t in registry.tiers] == ["broken", "own", "dom_css"] and len(registry.by_rank(4)) == 1 and E.MODEL_TIER.extract(None, None) == ([], "llm")
    got = records(E.extract(pages(spark, ("1", "own" + LD), ("2", "<title>x</title>" + LD)), tiers=registry.resolved()))
    assert got == [("own", {"k": 1}), ("dom_css", {"t": "x"})]


def rows(spark, *items):
    return spark.createDataFrame([(u, i, json.dumps(r) if r is not None else None) for u, i, r in items], "url string, rec_idx int, record_json string")


def test_cleaning_and_identity(spark):
    df = rows(spark, ("a", 0, {"Property Title": "House", "x": "ok"}), ("a", 1, {"unit": "MODULE_9"}), ("a", 2, {"deep": [{"v": "xMODULE_"}]}), ("b", 0, None))
    assert R.drop_negative(df, ["MODULE_", ""]).count() == 2 and R.drop_negative(df, [""]).count() == 4
    got = df.select(R.rename_keys(F.col("record_json"), {"title": ["Property Title"]}).alias("r"), R.rename_keys(F.col("record_json"), {"title": []}).alias("same"), "record_json").collect()
    assert json.loads(got[0]["r"]) == {"title": "House", "x": "ok"} and got[0]["same"] == got[0]["record_json"] and got[3]["r"] is None
    ids = rows(spark, ("a", 0, {"title": "A"}), ("a", 1, {"title": "B"}), ("a", 2, {"id": 0}), ("a", 3, {"id": "k"})).select(R.assign_identity(F.col("record_json"), "id").alias("r"), R.identity_of(F.col("record_json")).alias("h")).collect()
    got = [json.loads(r["r"]) for r in ids]
    assert got[0]["_id"] != got[1]["_id"] and "_id" in got[2] and "_id" not in got[3] and got[0]["_id"] == ids[0]["h"]
    m = spark.range(1).select(R.rename_map(F.create_map(F.lit("A b"), F.lit(1), F.lit("C"), F.lit(2)), {"q": ["a-b"]}).alias("m"), R.keep_fields(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ["b"]).alias("k")).first()
    assert m["m"] == {"q": 1, "c": 2} and m["k"] == {"b": 2}


def test_gates(spark):
    df = rows(spark, ("a", 0, {"t": 1, "price": None}), ("a", 1, {"t": 1}), ("b", 0, {"t": 1}), ("c", 0, None))
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    got = {r["url"]: (r["passed"], r["reason"]) for r in R.schema_gate(df, ["t", "price"], inputs=inputs).collect()}
    assert got == {"a": (True, None), "b": (False, "insufficient_fields: 0%"), "c": (False, "no_records")}
    got = {r["url"]: r["reason"] for r in R.schema_gate(df, [], {"properties": {"t": {"type": "string"}}}).collect()}
    assert got == {"a": "insufficient_json_schema_pass: 0%", "b": "insufficient_json_schema_pass: 0%"}
    keyed = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, None), ("a", 3, "y"), ("a", 4, "y"), ("a", 5, "x"), ("b", 0, "x")], "url string, rec_idx int, k string")
    assert [tuple(r) for r in R.repeated_keys(keyed, "k").collect()] == [("a", "y", 4)]
    missing = R.missing_fields(keyed.withColumn("z", F.lit("")), ["k", "z"], inputs).collect()
    assert {r["url"]: r["missing"] for r in missing} == {"a": ["z"], "b": ["z"], "c": ["k", "z"]}
    n = lambda *x: spark.createDataFrame(list(x), "url string, n long")
    got = {r["url"]: (r["passed"], r["reason"]) for r in R.sanity_check(n(("a", 30), ("b", 50), ("d", 4)), n(("a", 100), ("b", 100), ("c", 9))).collect()}
    assert got == {"a": (False, "record_count_drop"), "b": (True, None), "c": (False, "empty"), "d": (True, None)}


def test_merging(spark):
    old = rows(spark, ("u", 0, {"id": "A", "price": 10, "k": 1}), ("u", 1, {"id": "A", "price": 11}), ("u", 2, {"id": "C"}))
    new = rows(spark, ("u", 0, {"id": "A", "price": 12}), ("u", 1, {"id": "B"}), ("u", 2, {"id": "D"}), ("v", 0, {"id": "E"}), ("u", 3, {"id": "C", "z": 1}))
    picks = spark.createDataFrame([("u", 0, 0, True, "A"), ("u", 1, 1, True, "nope"), ("u", 2, 3, False, None), ("v", 0, 0, False, None)], "url string, seq int, new_index int, merge boolean, target_id string")
    got = R.merge_records(old, new, picks, "id").orderBy("url", "rec_idx").collect()
    assert [json.loads(r["record_json"]) for r in got] == [{"id": "A", "price": 12}, {"id": "C", "z": 1}, {"id": "B"}, {"id": "E"}]
    assert {(r["url"], r["added"], r["updated"]) for r in got} == {("u", 2, 1), ("v", 1, 0)}
    ids = spark.createDataFrame([("x", "a", "b"), (None, "a", None), ("", "", ""), ("", "a", "b")], "id string, k string, m string")
    fields = {c: F.col(c) for c in ids.columns}
    assert [r[0] for r in ids.select(R.record_id(fields, "id", ["k", "m"])).collect()] == ["x", "a::", "", "a::b"]


def test_drift_and_demotion(spark):
    runs = spark.createDataFrame([("a", 1, 10, False, "STABLE"), ("a", 2, 3, False, "STABLE"), ("a", 3, 3, True, "WARM"), ("a", 4, 0, False, "WARM"), ("b", 1, 10, False, "COLD"), ("b", 2, 5, False, "COLD"), ("c", 1, 0, False, "COLD"), ("c", 2, 0, False, "COLD")], "url string, run int, n_records long, all_missing boolean, maturity string")
    got = {(r["url"], r["run"]): (r["reasons"], r["suggested"]) for r in L.detect_drift(runs).collect()}
    assert got == {("a", 2): (["record_count_drop:0.70"], "WARM"), ("a", 3): (["all_minimum_fields_missing"], "LEARNING"), ("a", 4): (["record_count_drop:1.00", "no_records"], "LEARNING"), ("b", 2): (["record_count_drop:0.50"], "COLD"), ("c", 2): ([], "COLD")}


def test_clusters(spark):
    df = spark.createDataFrame([("https://a/1", "wp", None, [], {"x": "t"}, "COLD", 0), ("https://a/2", None, "p", ["/b", "/a"], {"x": "d", "y": "d"}, "STABLE", 1), ("https://a/3", "wix", None, ["/a"], {}, "STABLE", 2), ("https://b/1", "wp", None, ["/a", "/b"], {}, "WARM", 3)], "url_pattern string, platform string, pagination_style string, confirmed_patterns array<string>, selectors map<string,string>, maturity string, pos int")
    pairs = {tuple(r) for r in L.find_clusters(df, df).collect()}
    assert pairs == {("https://a/1", "https://a/2"), ("https://a/2", "https://a/1")}
    assert {tuple(r) for r in L.find_similar(df, df).collect()} == {("https://a/1", "https://b/1"), ("https://b/1", "https://a/1")}
    got = L.bootstrap(df, L.donors(L.find_clusters(df, df), df)).where("url_pattern = 'https://a/1'").first()
    assert (got["platform"], got["pagination_style"], got["confirmed_patterns"], got["selectors"], got["maturity"]) == ("wp", "p", ["/a", "/b"], {"x": "t", "y": "d"}, "WARM")
    assert {r["domain"]: r["n"] for r in L.cluster_by_domain(df).collect()} == {"a": 3, "b": 1}


def test_signals(spark):
    p = spark.createDataFrame([("u", ["/old"], [], {"t": "#1", "k": "#k"}, "wp", 4), ("v", [], [], {}, None, 9)], "url_pattern string, confirmed_patterns array<string>, noise_selectors array<string>, selectors map<string,string>, platform string, total_crawls int")
    s = spark.createDataFrame([("u", 3, "api_pattern", "", "/new", None), ("u", 1, "api_pattern", "", "/x", None), ("u", 2, "api_pattern", "", "/old", None), ("u", 4, "dom_selector", "t", "#2", None), ("u", 5, "dom_selector", "t", "#3", None), ("u", 6, "platform", "", "", "wix"), ("u", 7, "noise", "", ".ad", None), ("u", 8, "odd", "", "z", None)], "url_pattern string, seq long, signal_type string, field_name string, hint string, platform string")
    got = {r["url_pattern"]: r for r in L.apply_signals(p, s).collect()}
    u, v = got["u"], got["v"]
    assert (u["confirmed_patterns"], u["noise_selectors"], u["selectors"], u["platform"], u["maturity"]) == (["/old", "/x", "/new"], [".ad"], {"t": "#3", "k": "#k"}, "wix", "WARM")
    assert (v["confirmed_patterns"], v["platform"], v["maturity"]) == ([], None, "STABLE")
    b = spark.createDataFrame([("u", ["/p"])], "url_pattern string, blocked array<string>")
    raw = spark.createDataFrame([("u", 1, '{"misleading_patterns": ["/q", "/p", ""]}'), ("new", 2, '{"misleading_patterns": ["/q"]}'), ("u", 3, "bad")], "url_pattern string, seq long, raw_context string")
    assert [tuple(r) for r in L.blocked_endpoints(b, raw).collect()] == [("u", ["/p", "/q"])]


def test_crystallizing(spark):
    m = spark.createDataFrame([("u", "rent", "old", ["n0"], 0.9, "/a", "x", "env", None, 3)], "url_pattern string, field_name string, hint string, synonyms array<string>, confidence double, api_pattern string, json_path string, envelope string, selector string, success_count int")
    r = spark.createDataFrame([("u", "note", json.dumps({"api": {"url_pattern": "/b", "response_envelope": "data", "json_paths": {"rent": "p.m", "unit": "id"}}, "dom": {"container": "li", "selectors": {"name": "b"}}})), ("w", "", "{}")], "url_pattern string, note string, field_mappings string")
    got = {x["field_name"]: x for x in L.crystallize(m, r).collect()}
    assert set(got) == {"rent", "unit", "name"}
    assert (got["rent"]["hint"], got["rent"]["synonyms"], got["rent"]["confidence"], got["rent"]["api_pattern"], got["rent"]["envelope"], got["rent"]["success_count"]) == ("p.m", ["n0", "note"], 0.9, "/b", "env", 3)
    assert (got["unit"]["confidence"], got["unit"]["envelope"], got["unit"]["success_count"]) == (0.7, "data", 0) and got["name"]["selector"] == "b"
    bumped = spark.range(1).select(L.bump_mappings(F.array(F.struct(F.lit(1).alias("success_count"), F.lit(0.93).alias("confidence")))).alias("m")).first()["m"][0]
    assert (bumped["success_count"], bumped["confidence"]) == (2, 0.95)


def test_consolidation(spark):
    s = spark.createDataFrame([("s", i, "wix" if i < 3 else "wp", 0.6 if i % 2 else 0.4, "external_rank" if i == 1 else "extraction") for i in range(5)], "skill string, seq long, platform string, confidence double, signal_type string")
    known = spark.createDataFrame([("s", "wp")], "skill string, platform string")
    fresh = L.new_platforms(s, known)
    assert fresh.first()["most"] == 3
    pending = s.groupBy("skill").agg(F.count("*").alias("n"))
    assert L.triggers(pending, fresh).first()["trigger"] == "smart" and L.triggers(pending, fresh, 5).first()["trigger"] == "batch"
    assert L.triggers(pending, fresh, 50, 9).first()["trigger"] is None and L.triggers(pending, fresh, 50, 9, True).first()["trigger"] == "run_end"
    assert tuple(L.batch_stats(s).first()) == ("s", 5, 1, ["wix", "wp"]) and L.signal_types(s).count() == 2
    memory = spark.createDataFrame([("s", 1, '{"known_noise_patterns": ["ads"], "navigation_wisdom": "w"}')], "skill string, version int, memory string")
    answers = spark.createDataFrame([("s", 0, '{"known_noise_patterns": [], "summary": "x", "field_extraction_hints": {"a": "b"}}', 0.5, None), ("s", 1, None, None, "timeout")], "skill string, batch long, content string, cost_usd double, error string")
    got = L.consolidate(memory, s, answers, ["admin", ""], 3).orderBy("batch").collect()
    assert [(r["version_before"], r["version_after"], r["signal_count"], r["cost_usd"], r["summary"]) for r in got] == [(1, 2, 3, 0.5, "x"), (2, 3, 2, 0.0, "")]
    last = json.loads(got[1]["memory"])
    assert last["known_noise_patterns"] == ["admin"] and last["navigation_wisdom"] == "w" and last["field_extraction_hints"] == {"a": "b"}
    assert L.updated_memory({}, {"api_patterns": ["/a"], "field_hints": {"f": "h"}}, ["n"], warm=True) | {"navigation_wisdom": ""} == L.updated_memory({}, {"high_confidence_api_patterns": ["/a"], "field_extraction_hints": {"f": "h"}}, ["n"], warm=True)


def test_responses(spark):
    c = [
        ("discovery", "u", json.dumps({"ranked_apis": ["/a"], "platform_guess": "wp", "improvement_signal": {"misleading_patterns": ["/m"]}}), 0.1, None), ("discovery", "bad", "{x", None, None), ("discovery", "err", None, 0.2, "timeout"),
        ("extraction", "u", json.dumps({"records": [{"a": 1, "confidence": 0.8}, {"a": 2}], "platform": "p", "field_mappings": {"api": {}}, "improvement_signal": {"api_patterns_that_worked": ["/w"]}}), 0.0, None),
        ("external_rank", "u", json.dumps({"ranked_external_links": ["https://z"], "improvement_signal": {"free_text_observation": "t", "confidence": 0.9}}), 0.0, None),
    ]
    answers = spark.createDataFrame(c, "stage string, url string, content string, cost_usd double, error string")
    urls = spark.createDataFrame([("u",), ("bad",), ("err",)], "url string")
    d = {r["url"]: r for r in A.parse_discovery(A.join_responses(urls, answers, "discovery")).collect()}
    assert (d["u"]["platform"], d["u"]["hint"], d["u"]["confidence"], d["u"]["ranked_apis"]) == ("wp", "/m", 0.5, ["/a"]) and d["bad"]["error"] == "invalid_json" and d["err"]["error"] == "timeout"
    x = A.parse_extraction(A.join_responses(urls.where("url = 'u'"), answers, "extraction")).first()
    assert (x["confidence"], x["platform"], x["hint"], x["signal_confidence"], len(x["records"])) == (0.4, "p", "/w", 0.4, 2)
    e = A.parse_external(A.join_responses(urls.where("url = 'u'"), answers, "external_rank")).first()
    assert (e["ranked_external_links"], e["hint"], e["confidence"]) == (["https://z"], "t", 0.9)
    need = spark.createDataFrame([("a", ["l"], ["m"]), ("b", [], ["m"]), ("c", ["l"], [])], "url string, links array<string>, missing array<string>")
    assert [r["url"] for r in A.needs_external(need, 1).collect()] == ["a"] and A.needs_external(need, 0).count() == 0


def test_proxies(spark):
    o = spark.createDataFrame([("a", i, -0.25) for i in range(4)] + [("a", 4, 0.05), ("b", 0, -0.05), ("c", 0, -0.25), ("c", 1, -0.25), ("c", 2, -0.25), ("c", 3, -0.25)] + [("c", 4 + i, 0.05) for i in range(11)], "proxy string, seq int, delta double")
    got = {r["proxy"]: (round(r["health"], 2), r["quarantined"]) for r in Z.proxy_health(o).collect()}
    assert got == {"a": (0.05, True), "b": (0.95, False), "c": (0.55, False)}
    pool = spark.createDataFrame([("a", 0), ("b", 1), ("d", 2), ("e", 3)], "proxy string, pos int")
    assert Z.best_proxy(Z.proxy_health(o), pool).first()["proxy"] == "d"
    r = spark.createDataFrame([("s", i) for i in range(3)], "shard string, seq int")
    assert [x["proxy"] for x in Z.round_robin(r, ["p", "q"]).orderBy("seq").collect()] == ["p", "q", "p"]
    t = spark.createDataFrame([("d", i, 0.0) for i in range(5)] + [("e", 9, 5.0)], "domain string, seq long, at double")
    assert [x["wait"] for x in Z.rate_limit(t, 1.0, 3).where("domain = 'd'").orderBy("seq").collect()] == [0.0, 0.0, 0.0, 1.0, 2.0]
    assert Z.throttle_state(None, iter([0.0, 0.0, 5.0]), 0.0, 0)[1] == [0.0, 100.0, 195.0]


def test_reports(spark):
    results = spark.createDataFrame([("a", "SUCCESS", "json_ld", 0.9, 3, 0.1, ["e1"] * 7), ("b", "FAILED", None, 0.0, 0, 0.0, None), ("c", "CARRY_FORWARD", "", 0.0, 1, 0.0, []), ("d", "EMPTY", "json_ld", 0.3, 0, 0.0, [])], "url string, status string, tier_used string, confidence double, n_records long, llm_cost_usd double, errors array<string>")
    m = T.crawl_metrics(results).first()
    assert (m["succeeded"], m["carried_forward"], m["failed"], m["records"], round(m["mean_confidence"], 2)) == (1, 1, 2, 4, 0.3)
    assert [tuple(r) for r in T.tier_histogram(results).collect()] == [("(none)", 2), ("json_ld", 2)]
    ledger = spark.createDataFrame([("p2", 0.3, "u2", "s", "m2"), ("p1", 0.05, "u1", "s", "m1")], "stage string, cost_usd double, url string, skill string, model string")
    log = spark.createDataFrame([(i, "batch", 50, i + 1) for i in range(7)], "seq int, triggered_by string, signal_count int, version_after int")
    text = T.run_report(results, ledger, log)
    assert "- SUCCESS: 1" in text and "$0.3500 in 2 calls" in text and text.index("- p2") < text.index("- p1") and "version 7" in text and "version 2" not in text
    assert T.crawl_metrics(results.limit(0)).first()["records"] == 0 and T.total_cost(ledger, "none").first()[0] == 0.0
    assert T.url_report(results).where("url = 'a'").first()["report"].count("e1") == 5 and T.report_rows(results).where("url = 'a'").first()["line"].count("e1") == 3


def test_crawl(spark):
    inputs = spark.createDataFrame([("https://x/1", None, None), ("https://x/2", ['{"name":"old"}'], None), ("https://x/3", None, None), ("https://x/4", [], ['{"name":"prev"}']), ("https://x/5", None, None)], "url string, carry_json array<string>, previous_json array<string>")
    fetched = spark.createDataFrame([("https://x/1", LD, "", 200, None), ("https://x/2", "x", "", 500, None), ("https://x/3", "<p>", "", 200, None), ("https://x/5", MICRO.replace("name", "nm"), "", 200, None)], "url string, html string, content_type string, status_code int, error string")
    out = crawl.run(inputs, fetched, crawl.Skill("s", fields=("name",), minimum_fields=("name",), aliases={"name": ["Name"]}))
    got = {r["url"][-1]: (r["status"], r["n_records"], r["carry_forward_days"]) for r in out["results"].collect()}
    assert got == {"1": ("SUCCESS", 1, 0), "2": ("CARRY_FORWARD", 1, 7), "3": ("EMPTY", 0, 0), "4": ("CARRY_FORWARD", 1, 7), "5": ("PARTIAL", 1, 0)}
    assert {r["url"][-1] for r in out["records"].collect()} == {"1", "2", "4", "5"} and out["dead_letters"].count() == 0
    strict = crawl.run(inputs, fetched, crawl.Skill("s", carry_forward=False))
    assert {r["url"][-1]: r["error"] for r in strict["dead_letters"].collect()} == {"2": "HTTP 500", "4": "HTTP 0"}


def test_merging_by_answers(spark):
    old = rows(spark, ("u", 0, {"id": "A", "p": 1}), ("e", 0, {"id": "A"}), ("k", 0, {"id": "K"}))
    new = rows(spark, ("u", 0, {"id": "A", "p": 2}), ("e", 0, {"id": "B"}), ("n", 0, {"id": "N"}), ("n", 1, {"id": "N"}))
    answers = spark.createDataFrame([("u", '{"merge_decisions": [{"new_record_index": 0, "existing_record_id": "A", "merge": true}]}', None), ("e", "{broken", None), ("n", None, "timeout")], "url string, content string, error string")
    got = {}
    for r in R.merge_answers(old, new, answers, "id").orderBy("url", "rec_idx").collect():
        got.setdefault(r["url"], []).append((json.loads(r["record_json"]), r["added"], r["updated"]))
    assert got == {"u": [({"id": "A", "p": 2}, 0, 1)], "e": [({"id": "A"}, 0, 0), ({"id": "B"}, 0, 0)], "k": [({"id": "K"}, 0, 0)], "n": [({"id": "N"}, 2, 0), ({"id": "N"}, 2, 0)]}


def test_warm_up():
    fresh = L.warm_up(None, "s", "1", {"content": '{"api_patterns": ["/a"], "prompt1_context": null}', "cost_usd": 0.2}, ["admin", "admin"])
    assert fresh["high_confidence_api_patterns"] == ["/a"] and fresh["known_noise_patterns"] == ["admin"] and fresh["warmup_cost_usd"] == 0.2 and fresh["prompt1_context"] == ""
    assert L.warm_up(fresh, "s", "1", None) is fresh and L.is_stale(fresh, "s", "2") and L.is_stale(None, "s", "1")
    assert L.warm_up(fresh, "s", "2", {"error": "timeout", "content": "{}"}, ["n"])["known_noise_patterns"] == ["n"]
    assert L.schema_parts({"confirmed_field_synonyms": {"a": ["b"], "x": []}}, ["a"]) == ({"a": ["b"]}, {})


def test_identities_and_providers(spark):
    df = spark.createDataFrame([("https://a", "s", 0), ("https://b", "s", 1)], "url string, shard string, seq int")
    h = [r["h"] for r in df.select(Z.request_headers(F.col("url"), {"X": "1", "Accept": "no"}).alias("h")).collect()]
    assert all(x["X"] == "1" and x["Accept"] == Z.ACCEPT and x["User-Agent"] in Z.USER_AGENTS and x["Accept-Language"] == Z.LANGUAGES[Z.USER_AGENTS.index(x["User-Agent"]) % 3] for x in h)
    assert [Z.proxy_kind(s) for s in ({}, {"enabled": False, "server": "x"}, {"customer_id": "c", "zone": "z", "password": "p", "servers": ["s"]}, {"servers": ["s"], "server": "x"}, {"server": "x"})] == ["none", "none", "session", "rotating", "static"]
    proxies = lambda s: [r["proxy"] for r in Z.assign_proxies(df, s).orderBy("seq").collect()]
    assert proxies({}) == [None, None] and proxies({"servers": ["p", "q"]}) == ["p", "q"] and proxies({"server": "http://h:1", "username": "u"}) == ["http://u@h:1"] * 2
    got = proxies({"customer_id": "c", "zone": "z", "password": "p", "host": "h"})
    assert got[0] != got[1] and all(p.startswith("http://c-zone-z-session-") and p.endswith(":p@h:22225") for p in got)


def test_markdown_batches_are_bounded_in_bytes(spark):
    """A batch of long pages was as large as 10,000 of them."""
    from pagewright.operators.extraction import fit_markdown, page_markdown

    pages = spark.range(1000, numPartitions=1).select("id", F.concat(F.lit("<p>"), F.col("id"), F.lit("</p>" + "<!-- -->" * 2_500)).alias("html"))
    markdown = fit_markdown(F.col("html"))

    @F.arrow_udf("long")
    def held(html):
        import pyarrow as pa

        return pa.array([html.nbytes] * len(html), pa.int64())

    got = pages.select("id", markdown.alias("markdown"), held("html").alias("held")).collect()
    assert max(r["held"] for r in got) < 6 << 20
    assert [r["markdown"] for r in got] == [page_markdown(f"<p>{i}</p>") for i in range(1000)]
