"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a line of a filter list: plain text that a URL holds, with * for any characters, ^ for a separator or
the end, | for the start or end, || for the start of a host name or of one of its labels' names, @@ in front for an
exception, and /.../ for a regular expression. Case doesn't count (A-Z).

1. A rule's literal tokens are its runs of [a-z0-9%] that must be whole tokens of any URL that it fits. How many different
   URLs hold each is counted over all URLs, and the rule is indexed by the rarest.
2. Each different URL's tokens fetch candidate rules by a join on the token, and only those run their regular expression.
   Rules without such a token are fetched by the empty token, which every URL has.
3. Host and path rules are looked up by their whole text: a URL's host suffixes fetch the lengths of the paths that rules of
   that host have, and its path cut to these lengths the rule itself. So a host with many rules costs a look-up for
   each different length, not for each rule.
4. The longest host and path rule (host and path together, then the host) decides; without one a pattern that blocks and isn't excepted blocks; all else is allowed.

The work is on different URLs; candidates stay where their URL was shuffled to. Rules are broadcast if they are few
(columns.small counts them), else joined by a shuffle.

Defined results
- null url, or none of `://`: host and path are empty and fit no rule; patterns are tried on the url as it is.
- an empty path (no slash behind the host) begins with no rule's path but an empty one.
- null page_ids and repeated rows: every row has its own result row.
- equal host and path rules of both verdicts: block. Rules with a null are left out.
- filter lines that are null, empty, comments (!, [), element rules (##, #@#) or that carry options ($...) judge no URL and
  are left out.
- an empty table of pages gives an empty result; no rules or no filters leave the other part to decide. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import small
from pagewright.sources.session import checkpoint, prepare_workers, table

_TOKEN = re.compile(r"[a-z0-9%]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_SEPARATOR = r"(?:[^0-9a-z_.%-]|$)"
_HOST_START = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"


def compiled(line: str | None) -> tuple[str, bool, list[str]] | None:
    """A filter line -> (regular expression for lower-cased URLs, blocks, literal tokens); None if it judges no URL.

    >>> compiled("||ads.example^*banner|")
    ('^[a-z][a-z0-9+.-]*://(?:[^/?#]*\\\\.)?ads\\\\.example(?:[^0-9a-z_.%-]|$).*banner$', True, ['ads', 'example'])
    """
    text = (line or "").strip().translate(_LOWER)
    if not text or text[0] in "![" or "##" in text or "#@#" in text:
        return None
    blocks = not text.startswith("@@")
    text = text if blocks else text[2:]
    if len(text) > 2 and text[0] == text[-1] == "/" and re.search(r"[\\^$|()\[\]{}?+*]", text):
        return text[1:-1], blocks, []
    if not text or re.search(r"\$[a-z~,=|._-]+$", text):
        return None
    start, end = "", ""
    if text.startswith("||"):
        start, text = _HOST_START, text[2:]
    elif text.startswith("|"):
        start, text = "^", text[1:]
    if text.endswith("|"):
        end, text = "$", text[:-1]
    text = text.lstrip("*") if not start else text  # a search begins and ends anywhere
    text = text.rstrip("*") if not end else text
    shown = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in text)
    bounded = lambda i, open_end: (text[i] != "*") if 0 <= i < len(text) else open_end
    tokens = [m[0] for m in _TOKEN.finditer(text) if bounded(m.start() - 1, bool(start)) and bounded(m.end(), bool(end))]
    return start + shown + end, blocks, tokens


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Behind the first :// up to /, ? or #, and from there up to ? or #; empty without."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(url), F.lit("[a-z0-9%]+"), F.lit(0)))


def indexed(filters: DataFrame, urls: DataFrame) -> DataFrame:
    """(filter), (url) -> (token, regex, blocks): each filter by its token that the fewest of the urls hold."""
    prepare_workers(filters.sparkSession)

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            found = [x for x in map(compiled, lines["filter"]) if x]
            yield pd.DataFrame(found, columns=["regex", "blocks", "tokens"])

    lines = filters.select(F.col("filter").cast("string")).distinct()
    rules_ = checkpoint(lines.mapInPandas(rules, "regex string, blocks boolean, tokens array<string>"))
    named = rules_.select("regex", "blocks", F.explode_outer("tokens").alias("token"))
    wanted = small(named.select(F.col("token").alias("wanted")).where("wanted is not null").distinct())
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    counts = seen.join(wanted, seen["token"] == wanted["wanted"], "left_semi").groupBy("token").count()
    rare = named.join(counts, "token", "left").groupBy("regex", "blocks").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("least"))
    return rare.select(F.coalesce("least.token", F.lit("")).alias("token"), "regex", "blocks")


def pattern_verdicts(urls: DataFrame, filters: DataFrame) -> DataFrame:
    """(url) without repeats -> (url, verdict) of those that a pattern blocks or excepts; only candidates run their pattern."""
    index = small(checkpoint(indexed(filters, urls)).withColumnRenamed("token", "key"))
    tokens = urls.select("url", F.explode(F.array_union(url_tokens(F.col("url")), F.array(F.lit("")))).alias("token"))
    hits = tokens.join(index, tokens["token"] == index["key"]).where(F.rlike(lower_ascii(F.col("url")), F.col("regex")))
    return hits.groupBy("url").agg(F.when(F.bool_and("blocks"), "block").otherwise("allow").alias("pattern_verdict"))


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url) without repeats, (host, path, verdict) -> (url, rule, verdict): the longest rule that fits, where one does."""
    kept = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").na.drop()
    kept = checkpoint(kept.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")))
    labels = kept.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0))).first()[0]
    host, path = host_and_path(F.col("url"))
    rows = urls.select("url", host.alias("host"), path.alias("path")).where("host != ''").withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(labels))), lambda n: F.array_join(F.slice("labels", -n, n), "."))
    rows = rows.select("url", "path", F.explode(suffixes if labels else F.array().cast("array<string>")).alias("suffix"))
    lengths = small(kept.groupBy(F.col("rule_host").alias("of")).agg(F.collect_set(F.length("rule_path")).alias("lengths")))
    rows = rows.join(lengths, rows["suffix"] == lengths["of"]).select("url", "path", "suffix", F.explode("lengths").alias("n"))
    rows = rows.where(F.length("path") >= F.col("n")).select("url", "suffix", F.left("path", F.col("n")).alias("start"))
    kept = small(kept)
    fits = rows.join(kept, (rows["suffix"] == kept["rule_host"]) & (rows["start"] == kept["rule_path"]))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule), F.length("rule_host"), rule.alias("rule"), "verdict"))
    return fits.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def judged(pages: DataFrame, rules: DataFrame, filters: DataFrame) -> DataFrame:
    """(page_id, url) -> (page_id, host, path, rule, verdict, pattern_verdict), one row for each row.

    rules: (host, path, verdict allow or block); filters: (filter). pattern_verdict is what the patterns alone say, null where none fits.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.where("url is not null").select("url").distinct()
    by = pattern_verdicts(urls, filters).join(rule_verdicts(urls, rules), "url", "full_outer").withColumnRenamed("url", "__of")
    host, path = host_and_path(F.col("url"))
    verdict = F.coalesce("rule_verdict", "pattern_verdict", F.lit("allow"))
    return rows.join(by, rows["url"] == by["__of"], "left").select("page_id", host.alias("host"), path.alias("path"), "rule", verdict.alias("verdict"), "pattern_verdict")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: What names of unwanted sites are made of.
WORDS = ("adserver", "ads", "adult", "bets", "casino", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: A word that stands alone between separators of names; advertising and tracking paths; what is excepted.
FILTERS = [f"{a}{w}{b}" for w in WORDS for a in "/.-" for b in ".-"] + ["/banner/*/img^", "/popunder.", "||doubleclick.", "/track/pixel.gif|", "@@/robots.txt|", "@@||example.org/help^"]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    filters = spark.createDataFrame([(f,) for f in FILTERS], "filter string")
    return judged(table(spark, sf_dir, "pages"), rules, filters)


#: Every pattern on every URL.
OP12_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), best AS (
  SELECT page_id, host, path, arg_max(h || rules.p, 1000 * length(h || rules.p) + length(h)) AS rule, arg_max(v, 1000 * length(h || rules.p) + length(h)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id, host, path
), said AS (
  SELECT page_id, u, host, path,
    CASE WHEN regexp_matches(u, '/robots\.txt$') OR regexp_matches(u, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?example\.org/help([^0-9a-z_.%-]|$)') THEN 'allow'
      WHEN regexp_matches(u, '[/.-]({"|".join(WORDS)})[.-]') OR regexp_matches(u, '/banner/.*/img([^0-9a-z_.%-]|$)') OR contains(u, '/popunder.')
        OR regexp_matches(u, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?doubleclick\.') OR ends_with(u, '/track/pixel.gif') THEN 'block' END AS pattern_verdict
  FROM p
)
SELECT said.page_id, said.host, said.path, rule, coalesce(v, pattern_verdict, 'allow') AS verdict, pattern_verdict
FROM said LEFT JOIN best USING (page_id)
"""
