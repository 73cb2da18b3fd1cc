import re

import pytest

from pagewright.llm import columns
from pagewright.llm.url_filters import FILTERS, RULES, compiled, indexed, judged


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(rows, rules, filters):
    made = [x for x in map(compiled, filters) if x]
    out = []
    for page, url in rows:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[2:] if fits else (None, None)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), url) if url is not None else None
        hit = [blocks for regex, blocks, _ in made if low is not None and re.search(regex, low)]
        pattern = ("block" if all(hit) else "allow") if hit else None
        out.append((page, host, path, rule[0], rule[1] or pattern or "allow", pattern))
    return sorted(out, key=str)


HOSTS = ["example.com", "www.example.com", "WWW.Example.com", "a.b.example.net", "notexample.com", "com", "net", "casino-win.example.org", "x.ads.example.org", "ads", "example.org", "user@example.com:80", ""]
PATHS = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/2?x=/en/", "/banner/a/img", "/banner/a/img2", "/robots.txt", "/casino-x/robots.txt", "?q=1", "#top", "/en/#é", "/track/pixel.gif", "/a/spam.html"]
URLS = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in HOSTS for p in PATHS] + [None, "", "://", "://x", "no scheme/en/", "/spam./", "http://a://b/c", "http://example.com/" + "ads-" * 30000, "http://a\nb.com/x"]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_every_rule_on_every_url(spark, monkeypatch, broadcast):
    monkeypatch.setattr(columns, "BROADCAST_ROWS", broadcast)
    rows = [(i % 50 if i % 7 else None, u) for i, u in enumerate(URLS + URLS[:40])]
    rules = RULES + [("b.example.net", "/es/", "allow"), ("example.com", "/en/", "allow"), ("example.com", "", "block"), (None, "/", "block")]
    filters = FILTERS + [None, "", "! note", "example.com##.ad", "||example.org^$third-party", "/^https?:..com./", "|http://ads/", "*pam*", "gif|", "@@||ads^", "||example.org^"]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as rule", "2 as token", "3 as __of").repartition(3)
    got = judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(f,) for f in filters], "filter string"))
    want = brute(rows, [("example.com", "/en/", "block") if r[:2] == ("example.com", "/en/") else r for r in rules if None not in r], filters)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://example.com/ads/{i}",) for i in range(5)] + [("http://example.com/rare/ads",)], "url string")
    filters = spark.createDataFrame([("/ads/rare/",), ("||example.com/ads/",), ("*ads*",), ("/never/ads/",)], "filter string")
    got = {r["regex"]: r["token"] for r in indexed(filters, urls).collect()}
    assert got[compiled("/ads/rare/")[0]] == "rare" and got[compiled("/never/ads/")[0]] == "never" and got[compiled("*ads*")[0]] == ""
    assert got[compiled("||example.com/ads/")[0]] in ("ads", "com", "example")


def test_empty_tables(spark):
    none, rules, lines = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "filter string")
    assert judged(none, rules, lines).collect() == []
    assert judged(spark.createDataFrame([(1, "http://a.com/x")], none.schema), rules, lines).collect() == [(1, "a.com", "/x", None, "allow", None)]
