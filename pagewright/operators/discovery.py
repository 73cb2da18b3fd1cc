"""Links and endpoints of pages: extraction, scoring, ranking.

Where pages repeat a url, `page` names the columns that tell them apart: they are kept, and what ties otherwise goes by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.patterns import needles_in
from pagewright.functions.predicates import MANY, contains_any, is_api_endpoint, is_data_api
from pagewright.functions.text import SCHEME, netloc, url_join, url_path

ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
QUOTED_API = r"""(?U)["'](/[\w\-./]+(?:api|v\d|json|data|feed)[\w\-./]*)["']"""
SKIPPED = ("#", "javascript:", "mailto:", "tel:")
THRESHOLD = 0.4


def extract_links(pages: DataFrame, page: Sequence[str] = ()) -> DataFrame:
    """(url, html) -> (url, *page, pos, link): absolute http(s) links in page order, repeats kept."""
    # comments and raw text aren't markup
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    href = lambda tag: F.replace(F.trim(F.regexp_replace(tag, ANCHOR, "$1$2$3")), F.lit("&amp;"), F.lit("&"))  # noqa: E731  one of the groups is there
    found = _listed(pages, F.transform(F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(0)), href), "href", page).where("href <> ''")
    for start in SKIPPED:
        found = found.where(~F.col("href").startswith(start))
    # told from the parts: a filter on the joined link would be pushed down, and the link be built twice
    http = "(?i)^https?:"
    found = found.where(F.col("href").rlike(http) | ~F.col("href").rlike(SCHEME) & F.col("url").rlike(http))
    return found.select("url", *page, "pos", url_join(F.col("url"), F.col("href")).alias("link"))


def _listed(pages: DataFrame, values: Column, name: str, page: Sequence[str]) -> DataFrame:
    """(url, *page, pos, name), one row for each value. explode() would add a filter on the array, which is then built twice."""
    return pages.select("url", *page, F.posexplode_outer(values).alias("pos", name)).where(F.col("pos").isNotNull())


def extract_api_urls(pages: DataFrame, page: Sequence[str] = ()) -> DataFrame:
    """(url, html) -> (url, *page, pos, api_url): quoted root-relative data paths, once each, in order."""
    paths = F.array_distinct(F.regexp_extract_all("html", F.lit(QUOTED_API), F.lit(1)))
    return _listed(pages, paths, "path", page).select("url", *page, "pos", url_join(F.col("url"), F.col("path")).alias("api_url"))


def score_url(url: Column, keywords: Sequence[str] = (), negative: Sequence[str] = ()) -> Column:
    """-1 with a negative keyword (an empty one is in every url), else keyword hits and a bonus for deep paths."""
    bad = contains_any(url, negative, skip_empty=False)
    if not keywords:
        return F.when(bad, -1.0).otherwise(0.1)
    lower = F.lower(url)
    if len(keywords) > MANY:
        hits = F.size(needles_in(lower, [k.lower() for k in keywords])) + sum(not k for k in keywords)
    else:
        hits = sum((lower.contains(k.lower()).cast("int") for k in keywords[1:]), lower.contains(keywords[0].lower()).cast("int"))
    path = url_path(url)
    depth = F.least(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), F.lit(4))
    return F.when(bad, -1.0).otherwise(F.least(F.lit(1.0), hits / F.lit(len(keywords)) + depth * F.lit(0.05)))


def rank_links(links: DataFrame, keywords: Sequence[str] = (), negative: Sequence[str] = (), threshold: float = 0.0, link: str = "link", page: Sequence[str] = ()) -> DataFrame:
    """(url, pos, link) -> with score and rank of each url's links at or above the threshold; ties in page order."""
    scored = links.withColumn("score", score_url(F.col(link), keywords, negative)).where(F.col("score") >= threshold)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "pos", *page)))


def top_links(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def discover(pages: DataFrame, keywords: Sequence[str] = (), negative: Sequence[str] = (), learned: Sequence[str] = (), threshold: float = THRESHOLD, page: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(url, html, content_type) -> ranked links and endpoints together, and the confirmed endpoints."""
    apis = extract_api_urls(pages, page)
    both = extract_links(pages, page).withColumn("of", F.lit(0)).union(apis.withColumn("of", F.lit(1)))
    both = both.withColumn("pos", F.row_number().over(Window.partitionBy("url").orderBy("of", "pos", *page)) - 1).drop("of")
    types = pages.select("url", "content_type").dropDuplicates(["url"])
    confirmed = apis.join(types, "url").where(is_api_endpoint(F.col("api_url"), F.col("content_type")) | contains_any(F.col("api_url"), learned, ignore_case=False))
    return rank_links(both, keywords, negative, threshold), confirmed.select("url", "pos", "api_url")


def _first_match(url: Column, needles: Sequence[str]) -> Column:
    lower = F.lower(url)
    if len(needles) > MANY:
        return F.try_element_at(F.array(*map(F.lit, needles)), F.try_element_at(needles_in(lower, [n.lower() for n in needles]), F.lit(1)) + 1)
    return F.coalesce(*[F.when(lower.contains(n.lower()), F.lit(n)) for n in needles if n], F.lit(None).cast("string"))


def api_candidates(pages: DataFrame, learned: Sequence[str] = (), noise: Sequence[str] = (), limit: int = 25, page: Sequence[str] = ()) -> DataFrame:
    """(url, *page, pos, api_url, score, reason, rank): 0.95 with a learned pattern, else 0.5; each page is ranked for itself."""
    hit = _first_match(F.col("api_url"), learned)
    rows = extract_api_urls(pages, page).where(is_data_api(F.col("api_url"), None, learned, noise))
    rows = rows.withColumn("score", F.when(hit.isNotNull(), 0.95).otherwise(0.5)).withColumn("reason", F.coalesce(F.concat(F.lit("learned pattern: "), hit), F.lit("endpoint by shape")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("url", *page).orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= limit)


def link_candidates(pages: DataFrame, keywords: Sequence[str] = (), fields: Sequence[str] = (), noise: Sequence[str] = (), limit: int = 50, page: Sequence[str] = ()) -> DataFrame:
    """(url, pos, link, score, reason, rank): each link of the url's own host once, where it comes first; 0.6 for a keyword, 0.3 for a field."""
    word, named = _first_match(F.col("link"), keywords), _first_match(F.col("link"), fields)
    rows = extract_links(pages, page).groupBy("url", "link").agg(F.min(F.struct("pos", *page)).alias("__at")).select("url", "link", "__at.*")
    rows = rows.where((netloc(F.col("link")) == netloc(F.col("url"))) & ~contains_any(F.col("link"), noise))
    score = F.when(word.isNull() & named.isNull(), 0.1).otherwise(F.when(word.isNotNull(), 0.6).otherwise(0.0) + F.when(named.isNotNull(), 0.3).otherwise(0.0))
    reason = F.concat_ws("; ", F.concat(F.lit("learned keyword: "), word), F.concat(F.lit("schema field: "), named))
    rows = rows.withColumn("score", score).withColumn("reason", F.coalesce(F.nullif(reason, F.lit("")), F.lit("nothing learned")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "pos", *page, "link"))).where(F.col("rank") <= limit)


def crawl_candidates(ranked: DataFrame, limit: int = 25) -> DataFrame:
    """The best ranked links, then without those that look like endpoints: the order of the two steps matters."""
    return ranked.where(F.col("rank") <= limit).where(~is_api_endpoint(F.col("link")))


def api_pattern_score(urls: DataFrame, pattern: str) -> DataFrame:
    """One row: the share of urls with the pattern, 0 of none."""
    return urls.agg(F.coalesce(F.avg(F.col("url").contains(pattern).cast("double")), F.lit(0.0)).alias("score"))
