"""Queries of stores, prompts, model answers, learning, proxies and reports over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import json_records as J
from pagewright.functions import text as X
from pagewright.operators import discovery as D
from pagewright.operators import extraction as E
from pagewright.operators import learning as L
from pagewright.operators import memory as Y
from pagewright.operators import payloads as V
from pagewright.operators import proxies as Z
from pagewright.operators import records as R
from pagewright.operators import reports as T
from pagewright.operators import responses as A
from pagewright.plans.queries import _LINKS, _PARTS, _PROFILES, _RESULTS, _SIGNALS, KEYWORDS, NEGATIVE, _fields, ledger, pages, part_pages, parts, profiles, query, results, signals
from pagewright.sources import stores
from pagewright.sources.session import shared_path, table



def _window(key: str, order: str):  # noqa: ANN202
    return Window.partitionBy(key).orderBy(order)


# ---- stores ---------------------------------------------------------------------------------------


@query("""SELECT 'https://s' || s_suppkey AS url, left(sha256('https://s' || s_suppkey), 16) AS key, CASE WHEN s_suppkey % 7 = 0 THEN 'own' WHEN s_suppkey % 3 = 0 THEN 'v2' WHEN s_suppkey % 5 > 0 THEN 'v1' END AS profile
FROM supplier""")
def profile_store(s, d):  # noqa: ANN001, ANN201
    """Profiles are written, changed, loaded, one in five is deleted, and looked up by url; an input's own profile comes first."""
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("https://s"), k).alias("url_pattern"), F.lit("v1").alias("profile"), k)
    first, second = shared_path(s, "profiles"), shared_path(s, "profiles")
    stores.save_profiles(None, p, first)
    stores.save_profiles(stores.load_profiles(s, first).drop("key"), p.where("s_suppkey % 3 = 0").withColumn("profile", F.lit("v2")), second)
    stored = stores.delete_profiles(stores.load_profiles(s, second), p.where("s_suppkey % 5 = 0 and s_suppkey % 3 > 0").select(F.col("url_pattern").alias("url")))
    inputs = p.select(F.col("url_pattern").alias("url"), F.when(k % 7 == 0, "own").alias("own_profile"))
    got = stores.lookup_profiles(inputs, stored)
    return stores.with_profile_key(got.withColumnRenamed("url", "url_pattern")).select(F.col("url_pattern").alias("url"), "key", "profile")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 4 > 0")
def profile_import(s, d):  # noqa: ANN001, ANN201
    """A JSON document for each profile, a quarter of them broken, many to a file."""
    path = shared_path(s, "profile-json")
    whole = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    stores.export_documents(table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 4 > 0, whole).otherwise(F.lit('{"id": 1, "name')).alias("value")), path)
    return stores.import_profiles(s, path, "id bigint, name string").select("id", "name")


@query("SELECT event_type AS stage, count(*) AS calls, sum(event_id % 50)::BIGINT AS input_tokens, round(sum(value), 4) AS cost_usd FROM events GROUP BY 1")
def ledger_store(s, d):  # noqa: ANN001, ANN201
    path = shared_path(s, "ledger")
    e = table(s, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("url"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("skill"), F.lit("m").alias("model"),
        (F.col("event_id") % 50).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.col("value").alias("cost_usd"), F.col("ts").cast("timestamp").alias("at"),
    )
    for half in (0, 1):
        stores.append_ledger(e.where(F.col("seq") % 2 == half), path)
    return stores.read_ledger(s, path).groupBy("stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'tier_won' ELSE 'llm_called' END AS kind, CAST(user_id AS VARCHAR) AS url, count(*) AS n FROM events GROUP BY ALL")
def trace_store(s, d):  # noqa: ANN001, ANN201
    path = shared_path(s, "trace")
    e = table(s, d, "events").select(F.when(F.col("event_type") == "click", "tier_won").otherwise("odd").alias("kind"), F.lit("t").alias("timestamp"), F.col("user_id").cast("string").alias("url"), F.lit(None).cast("string").alias("skill"), F.lit("{}").alias("payload"))
    stores.append_trace(e.where("kind = 'tier_won'"), path)
    stores.append_trace(e.where("kind <> 'tier_won'"), path)
    return stores.read_trace(s, path).groupBy("kind", "url").agg(F.count("*").alias("n"))


# ---- prompts and records --------------------------------------------------------------------------


@query("SELECT s_suppkey, left(sha256(s_name || '::2'), 16) AS hash, s_suppkey % 2 = 1 AS stale FROM supplier")
def memory_staleness(s, d):  # noqa: ANN001, ANN201
    """Stored memories of version 1 for odd keys, 2 for even ones, against skills of version 2."""
    stored = X.skill_hash(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 1, "1").otherwise("2"))
    now = X.skill_hash(F.col("s_name"), F.lit("2"))
    return table(s, d, "supplier").select("s_suppkey", now.alias("hash"), (stored != now).alias("stale"))


@query("SELECT p_partkey, list_sort(CASE WHEN p_partkey % 2 = 0 THEN ['brand', 'name'] ELSE ['name'] END) AS keys FROM part")
def schema_projection(s, d):  # noqa: ANN001, ANN201
    m = F.map_filter(F.create_map(F.lit("name"), "p_name", F.lit("brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit("other"), "p_type"), lambda _, v: v.isNotNull())
    return table(s, d, "part").select("p_partkey", F.array_sort(F.map_keys(R.keep_fields(m, ("name", "brand")))).alias("keys"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN left(body, 12000) || chr(10) || '...[truncated]' ELSE body END AS markdown FROM (
  SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || CASE WHEN p_partkey % 50 = 0 THEN repeat('word ', 3000) ELSE '' END || '**' || p_brand || '** and *' || p_type || '* link' || chr(10) || chr(10) || '* ' || p_type || chr(10) || '* `' || p_size || '`' || chr(10) || chr(10) || '> ' || p_brand || chr(10) || chr(10) || '1. x' AS body FROM part)""")
def markdown_of_parts(s, d):  # noqa: ANN001, ANN201
    long = F.when(F.col("p_partkey") % 50 == 0, F.repeat(F.lit("word "), F.lit(3000))).otherwise("")
    html = F.concat(
        F.lit("<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><!-- c --><h1>"), "p_name", F.lit("</h1><p>"), long, F.lit("<b>"), "p_brand", F.lit("</b> and\n <em>"), "p_type",
        F.lit('</em> <a href="/x">link</a></p><ul><li>'), "p_type", F.lit("<li><code>"), "p_size", F.lit("</code></ul><script>var x</script><blockquote>"), "p_brand", F.lit("</blockquote><ol><li>x</ol><footer>f</footer></body>"),
    )
    return parts(s, d).select("p_partkey", E.fit_markdown(html).alias("markdown"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '(none provided)' ELSE '{' || chr(10) || '  "a": ' || s_suppkey || ',' || chr(10) || '  "name": "' || s_name || '"' || chr(10) || '}' END AS metadata,
  CASE WHEN s_suppkey % 3 = 0 THEN '(none)' ELSE s_name || ', x' END AS words, 'Task ' || s_name || ' {unknown} ' || s_suppkey AS filled,
  CASE WHEN s_suppkey % 3 = 0 THEN '(no records)' ELSE '4 record(s); sample: [{"a": ' || s_suppkey || '}, {"a": ' || s_suppkey || '}, {"a": ' || s_suppkey || '}]' END AS sample FROM supplier""")
def prompt_parts(s, d):  # noqa: ANN001, ANN201
    some = F.col("s_suppkey") % 3 > 0
    meta = F.when(some, F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("a"))))
    many = F.when(some, F.to_json(F.array_repeat(F.struct(F.col("s_suppkey").alias("a")), 4))).otherwise(F.lit("[]"))
    return table(s, d, "supplier").select(
        "s_suppkey", R.text_of(meta, J.render_metadata).alias("metadata"), X.render_keywords(F.when(some, F.array("s_name", F.lit("x"))).otherwise(F.array().cast("array<string>"))).alias("words"),
        X.fill_template("Task {name} {unknown} {key}", {"name": F.col("s_name"), "key": F.col("s_suppkey").cast("string")}).alias("filled"), R.text_of(many, J.summarise).alias("sample"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN c_mktsegment || '::' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END ELSE '' END AS id FROM customer")
def record_ids(s, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    fields = {"id": F.when(k % 3 == 0, k).cast("string"), "a": F.when(k % 3 < 2, F.col("c_mktsegment")), "b": F.when((k % 2 == 0) & (k % 3 < 2), F.col("c_name"))}
    return table(s, d, "customer").select("c_custkey", R.record_id(fields, "id", ("a", "b")).alias("id"))


@query("""SELECT 'n' || s_nationkey AS url, list_sort(list(CASE WHEN s_nationkey % 3 = 2 AND s_suppkey % 2 = 0 THEN s_suppkey || ':9' ELSE s_suppkey || ':1' END)) AS records FROM supplier GROUP BY 1""")
def merge_by_answers(s, d):  # noqa: ANN001, ANN201
    """Nations by key: no previous records, broken answers, and answers that merge even keys into themselves. Records: id and version."""
    n = F.col("s_nationkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("n"), n).alias("url"), n.alias("n"), F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("id"))
    even = p.where("k % 2 = 0").withColumn("i", F.row_number().over(_window("url", "k")) - 1)
    old = p.where("(n % 3 = 1 and k % 2 = 1) or n % 3 = 2").select("url", F.col("k").cast("int").alias("rec_idx"), F.to_json(F.struct("id", F.lit(1).alias("v"))).alias("record_json"))
    new = even.where("n % 3 > 0").select("url", F.col("i").alias("rec_idx"), F.to_json(F.struct("id", F.when(F.col("n") % 3 == 2, 9).otherwise(1).alias("v"))).alias("record_json"))
    new = new.union(p.where("n % 3 = 0").select("url", F.col("k").cast("int"), F.to_json(F.struct("id", F.lit(1).alias("v")))))
    picks = even.where("n % 3 = 2").groupBy("url").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("i").alias("new_record_index"), F.col("id").alias("existing_record_id"), F.lit(True).alias("merge"))).alias("merge_decisions"))).alias("content"))
    answers = picks.select("url", "content", F.lit(None).cast("string").alias("error")).union(p.where("n % 3 = 1").select("url", F.lit("{broken"), F.lit(None).cast("string")).distinct())
    got = R.merge_answers(old, new, answers, "id")
    return got.groupBy("url").agg(F.array_sort(F.collect_list(F.concat(F.get_json_object("record_json", "$.id"), F.lit(":"), F.get_json_object("record_json", "$.v")))).alias("records"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'T' WHEN s_suppkey % 4 = 1 THEN s_name WHEN s_suppkey % 4 = 2 THEN NULL ELSE 'new' END AS title, s_suppkey % 4 < 3 AS kept_old FROM supplier WHERE s_suppkey % 4 IN (0, 1, 2, 3)""")
def merge_null_and_missing(s, d):  # noqa: ANN001, ANN201
    """Decisions on one record each: into its id with a new title; an answer not to merge under another id leaves the old; an explicit null
    overwrites; a merge that names no target inserts over the record of the same id."""
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("u"), k).alias("url"), k.alias("k"), F.col("s_name").alias("name"))
    old = p.select("url", F.lit(0).alias("rec_idx"), F.to_json(F.struct(F.lit("A").alias("id"), F.col("name").alias("title"), F.lit(1).alias("x"))).alias("record_json"))
    body = F.when(F.col("k") % 4 == 0, '{"id": "A", "title": "T"}').when(F.col("k") % 4 == 2, '{"id": "A", "title": null}').when(F.col("k") % 4 == 3, '{"id": "A", "title": "new"}')
    new = p.where(body.isNotNull()).select("url", F.lit(0).alias("rec_idx"), body.alias("record_json"))
    picks = p.select("url", F.lit(0).alias("seq"), F.lit(0).alias("new_index"), F.lit(True).alias("merge"), F.when(F.col("k") % 4 < 3, "A").alias("target_id"))
    got = R.merge_records(old, new, picks, "id")
    j = F.col("record_json")
    return got.select(F.substring("url", 2, 20).cast("long").alias("s_suppkey"), F.get_json_object(j, "$.title").alias("title"), F.get_json_object(j, "$.x").isNotNull().alias("kept_old"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END ELSE s_name END AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS nation FROM supplier")
def merge_snapshot_nulls(s, d):  # noqa: ANN001, ANN201
    p = table(s, d, "supplier")
    old = p.select("s_suppkey", F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).alias("nation"))
    return R.merge_snapshots(old, p.where("s_suppkey % 3 > 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 > 0, F.col("s_name")).alias("name")), "s_suppkey")



# ---- discovery and tiers --------------------------------------------------------------------------

_FOUND = f"""SELECT url, pos, link FROM (SELECT url, row_number() OVER (PARTITION BY url ORDER BY part, i) - 1 AS pos, link FROM (SELECT url, 0 AS part, pos AS i, link FROM ({_LINKS})
  UNION ALL SELECT url, 1, v.i, regexp_extract(url, '^(https?://[^/?#]*)', 1) || CASE v.i WHEN 0 THEN '/x/data/' || page_id || '.json' ELSE '/en/page/api/a' END FROM pages, (VALUES (0), (1)) v(i)))"""
_HITS = "(" + " + ".join(f"contains(lower(link), '{k}')::INT" for k in KEYWORDS) + ")"


def _with_apis(s: SparkSession, d: str) -> DataFrame:
    html = F.concat("html", F.lit('<script>fetch("/x/data/'), "page_id", F.lit(".json\");get('/en/page/api/a');get('/en/page/api/a')</script>"))
    return pages(s, d).select("url", "page_id", html.alias("html"), F.lit("text/html").alias("content_type"))


@query(f"""SELECT url, CAST(pos AS INT) AS pos, link, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, pos) AS rank FROM (
  SELECT *, CASE WHEN contains(lower(link), 'html') THEN -1.0::DOUBLE ELSE least(1.0::DOUBLE, {_HITS} / {len(KEYWORDS)}::DOUBLE + least(len(p) - len(replace(p, '/', '')), 4) * 0.05::DOUBLE) END AS score
  FROM (SELECT *, regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM ({_FOUND}))) WHERE score >= 0.2)""")
def discover_links(s, d):  # noqa: ANN001, ANN201
    """Links and endpoints of a page ranked together."""
    return D.discover(_with_apis(s, d), KEYWORDS, NEGATIVE, threshold=0.2, page=["page_id"])[0].select("url", "pos", "link", "score", "rank")


@query("""SELECT url, CAST(i AS INT) AS pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || CASE i WHEN 0 THEN '/x/data/' || page_id || '.json' ELSE '/en/page/api/a' END AS api_url, CASE i WHEN 1 THEN 0.95 ELSE 0.5 END::DOUBLE AS score,
  CASE i WHEN 1 THEN 'learned pattern: PAGE/api' ELSE 'endpoint by shape' END AS reason, CASE i WHEN 1 THEN 1 ELSE 2 END::INT AS rank FROM pages, (VALUES (0), (1)) v(i) WHERE i = 1 OR page_id % 10 <> 8""")
def api_candidates(s, d):  # noqa: ANN001, ANN201
    return D.api_candidates(_with_apis(s, d), ("PAGE/api",), ("8.JSON", ""), page=["page_id"]).select("url", "pos", "api_url", "score", "reason", "rank")


@query(f"SELECT url, CASE WHEN kind = 1 THEN 'mine' WHEN kind = 0 THEN 'json_ld' WHEN kind = 2 THEN 'embedded_blob:initial_state' WHEN kind = 3 THEN 'known_api' END AS tier_used, CASE WHEN kind < 4 THEN name END AS name, CASE WHEN kind < 4 AND kind <> 1 THEN brand END AS brand, CASE WHEN kind < 4 AND kind <> 1 THEN price END AS price FROM ({_PARTS})")
def registered_tiers(s, d):  # noqa: ANN001, ANN201
    """Plug-in tiers come before the built-in ones, by rank; one that fails and one that never handles are passed over."""
    registry = E.Registry()
    broken = E.Tier("broken", 0.1, 1.0, lambda page, options: True, lambda page, options: [][0])
    never = E.Tier("never", 0.2, 1.0, lambda page, options: False, lambda page, options: ([{"name": "x"}], "never"))
    mine = E.dom_css({"name": "b[itemprop=name]"}, 0.3)
    mine = E.Tier("mine", 0.3, 0.6, mine.handles, lambda page, options: (mine_found(page, options), "mine"))
    find = E.dom_css({"name": "b[itemprop=name]"}).extract

    def mine_found(page, options):  # noqa: ANN001, ANN202
        return find(page, options)[0]

    for tier in (mine, never, broken):
        registry.register(tier)
    return _fields(E.extract(part_pages(s, d), ("name", "price"), tiers=registry.resolved()))


@query(f"SELECT url, CASE WHEN kind = 1 THEN 'dom_css' END AS tier_used, CASE WHEN kind = 1 THEN name END AS name, CAST(NULL AS VARCHAR) AS brand, CASE WHEN kind = 1 THEN price END AS price, CASE WHEN kind = 1 THEN 0.6 ELSE 0 END::DOUBLE AS confidence FROM ({_PARTS})")
def dom_css_tier(s, d):  # noqa: ANN001, ANN201
    """One record for each page from a selector map, then the tier of a model that isn't there."""
    got = E.extract(part_pages(s, d), tiers=(E.dom_css({"name": "b[itemprop=name]", "price": "[itemprop=price]", "none": "em"}), E.MODEL_TIER))
    return got.select("url", "tier_used", *[F.get_json_object("record_json", f"$.{f}").alias(f) for f in ("name", "brand", "price")], "confidence")


@query(f"SELECT url, 'profile_replay' AS tier_used, name, brand, price FROM ({_PARTS}) WHERE kind = 3")
def profile_replay_inline(s, d):  # noqa: ANN001, ANN201
    """A page whose content type is JSON is read by its profile's tier, after selectors and endpoints have found nothing."""
    rows = part_pages(s, d).withColumn("profile_json", F.lit('{"endpoints": ["/nowhere"]}'))
    return _fields(E.extract(rows).where("tier_used = 'profile_replay'"))


@query("SELECT p_partkey, p_name AS a, p_brand AS b, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS c FROM part")
def json_walk(s, d):  # noqa: ANN001, ANN201
    """Paths of keys and list positions, by either separator, some of which lead nowhere."""
    p = table(s, d, "part")
    third = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("t"), "p_type"))
    body = F.to_json(F.struct(F.struct(F.array("p_name", "p_brand").alias("xs"), F.array(third).alias("ys")).alias("data")))
    take = lambda path: F.variant_get(V.walk(V.parsed(body), F.lit(path)), "$", "string")
    return p.select("p_partkey", take("data.xs[0]").alias("a"), take("data/xs/1").alias("b"), take("data.ys[0].t").alias("c"))


@query(r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'https://api.example/v1/items' WHEN 1 THEN 'https://shop.example/api/x' WHEN 2 THEN 'https://shop.example/a/b/list' ELSE 'https://shop.example/a/api' END AS endpoint FROM supplier""")
def endpoint_resolve(s, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey") % 4
    pattern = F.when(k == 0, "https://api.example/v1/items/{id}?").when(k == 1, "/api/x?{query}").when(k == 2, "list/{page}/").otherwise("../api&")
    return table(s, d, "supplier").select("s_suppkey", X.resolve_endpoint(pattern, F.lit("https://shop.example/a/b/c")).alias("endpoint"))


# ---- model answers --------------------------------------------------------------------------------

_ANSWERS = "SELECT s_suppkey AS k, 'u' || s_suppkey AS url, s_name AS name FROM supplier"


def _answers(s: SparkSession, d: str, content) -> DataFrame:  # noqa: ANN001
    """One in five is an error, one in five isn't JSON."""
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select(F.concat(F.lit("u"), k).alias("url"), F.when(k % 5 == 1, "{broken").otherwise(content).alias("content"), F.when(k % 5 > 0, 0.25).alias("cost_usd"), F.when(k % 5 == 0, "timeout").alias("error"))
    return rows


_ERROR = "CASE k % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'invalid_json' END AS error, CASE WHEN k % 5 > 0 THEN 0.25 ELSE 0 END::DOUBLE AS cost_usd"


@query(f"""SELECT url, CASE WHEN k % 5 > 1 THEN '/a|' || name ELSE '' END AS apis, CASE WHEN k % 5 > 1 THEN 'hop' ELSE '' END AS navigation_hint, CASE WHEN k % 5 > 1 THEN CASE WHEN k % 2 = 0 THEN 'seen' ELSE 'guess' END END AS platform,
  CASE WHEN k % 5 < 2 THEN '' WHEN k % 3 = 0 THEN 'text' ELSE 'bad' END AS hint, CASE WHEN k % 5 > 1 AND k % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, {_ERROR} FROM ({_ANSWERS})""")
def discovery_answers(s, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey")
    signal = F.struct(F.when(k % 2 == 0, "seen").alias("platform_observed"), F.when(k % 3 == 0, "text").alias("free_text_observation"), F.array(F.lit("bad")).alias("misleading_patterns"), F.when(k % 3 == 0, 0.9).alias("confidence"))
    content = F.to_json(F.struct(F.array(F.lit("/a"), "s_name").alias("ranked_apis"), F.lit("guess").alias("platform_guess"), F.lit("hop").alias("navigation_hint"), signal.alias("improvement_signal")))
    got = A.parse_discovery(_answers(s, d, content))
    return got.select("url", F.array_join("ranked_apis", "|").alias("apis"), "navigation_hint", "platform", "hint", "confidence", "error", "cost_usd")


@query(f"""SELECT url, CASE WHEN k % 5 < 2 THEN 0 WHEN k % 2 = 0 THEN 2 ELSE 0 END AS n_records, CASE WHEN k % 5 < 2 THEN 0 WHEN k % 2 = 0 THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN k % 5 > 1 THEN name END AS platform,
  CASE WHEN k % 5 < 2 THEN '' WHEN k % 3 = 0 THEN '/w' ELSE 'note' END AS hint, CASE WHEN k % 5 < 2 THEN 0.5 WHEN k % 2 = 0 THEN 0.4 ELSE 0.7 END::DOUBLE AS signal_confidence, {_ERROR} FROM ({_ANSWERS})""")
def extraction_answers(s, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey")
    record = F.when(k % 2 == 0, F.array(F.struct(F.lit(0.8).alias("confidence")), F.struct(F.lit(None).cast("double").alias("confidence"))))
    signal = F.struct(F.when(k % 3 == 0, F.array(F.lit("/w"))).alias("api_patterns_that_worked"), F.lit("note").alias("free_text_observation"))
    content = F.to_json(F.struct(record.alias("records"), F.lit(0.7).alias("confidence"), F.col("s_name").alias("platform"), signal.alias("improvement_signal")))
    got = A.parse_extraction(_answers(s, d, content))
    return got.select("url", F.size("records").alias("n_records"), F.round("confidence", 6).alias("confidence"), "platform", "hint", F.round("signal_confidence", 6).alias("signal_confidence"), "error", "cost_usd")


@query(f"SELECT url, CASE WHEN k % 5 > 1 THEN 'https://o/' || name ELSE '' END AS links, CASE WHEN k % 5 < 2 THEN '' WHEN k % 2 = 0 THEN 'm' ELSE 'free' END AS hint, {_ERROR} FROM ({_ANSWERS}) WHERE k % 3 > 0 AND k % 7 > 0")
def external_answers(s, d):  # noqa: ANN001, ANN201
    """Outside links are ranked where links are there, a field is missing, and the depth allows."""
    k = F.col("s_suppkey")
    signal = F.struct(F.when(k % 2 == 0, F.array(F.lit("m"))).alias("misleading_patterns"), F.lit("free").alias("free_text_observation"))
    content = F.to_json(F.struct(F.array(F.concat(F.lit("https://o/"), "s_name")).alias("ranked_external_links"), signal.alias("improvement_signal")))
    answers = _answers(s, d, content).withColumn("stage", F.lit("external_rank"))
    none = F.array().cast("array<string>")
    rows = table(s, d, "supplier").select(F.concat(F.lit("u"), k).alias("url"), F.when(k % 3 > 0, F.array(F.lit("l"))).otherwise(none).alias("links"), F.when(k % 7 > 0, F.array(F.lit("f"))).otherwise(none).alias("missing"))
    asked = A.needs_external(rows, 1).union(A.needs_external(rows, 0)).select("url")
    got = A.parse_external(A.join_responses(asked, answers, "external_rank"))
    return got.select("url", F.array_join("ranked_external_links", "|").alias("links"), "hint", "error", "cost_usd")


# ---- learning -------------------------------------------------------------------------------------


@query("""SELECT url_pattern, CASE k % 4 WHEN 0 THEN 'GET /new' ELSE '' END AS added, 'old' AS noise, CASE WHEN k % 4 = 1 THEN '#n2' ELSE '#n' END AS name_selector, CASE WHEN k % 4 = 2 THEN 'wp' END AS platform, CAST(k % 12 + 1 AS INT) AS crawls,
  CASE WHEN k % 12 + 1 >= 10 THEN 'STABLE' WHEN k % 12 + 1 >= 5 THEN 'WARM' WHEN k % 12 + 1 >= 2 THEN 'LEARNING' ELSE 'COLD' END AS maturity FROM (SELECT s_suppkey AS k, 'u' || s_suppkey AS url_pattern FROM supplier)""")
def signal_updates(s, d):  # noqa: ANN001, ANN201
    """Signals of each profile in arrival order: the same endpoint twice, a field's selector twice, a platform."""
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("u"), k).alias("url_pattern"), k)
    stored = p.select("url_pattern", F.array(F.lit("/a")).alias("confirmed_patterns"), F.array(F.lit("old")).alias("noise_selectors"), F.create_map(F.lit("name"), F.lit("#n")).alias("selectors"), F.lit(None).cast("string").alias("platform"), (k % 12).cast("int").alias("total_crawls"))
    row = lambda where, seq, kind, name, hint, platform=None: p.where(where).select("url_pattern", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("signal_type"), F.lit(name).cast("string").alias("field_name"), F.lit(hint).cast("string").alias("hint"), F.lit(platform).cast("string").alias("platform"))
    sig = row("s_suppkey % 4 = 0", 2, "api_pattern", None, "GET /new").union(row("s_suppkey % 4 = 0", 1, "api_pattern", None, "GET /new")).union(row("s_suppkey % 4 = 3", 1, "api_pattern", None, "/a")).union(row("s_suppkey % 4 = 1", 1, "dom_selector", "name", "#n1"))
    sig = sig.union(row("s_suppkey % 4 = 1", 9, "dom_selector", "name", "#n2")).union(row("s_suppkey % 4 = 2", 1, "platform", None, None, "wp")).union(row("s_suppkey % 4 = 3", 4, "noise", None, "old"))
    got = L.apply_signals(stored, sig)
    return got.select("url_pattern", F.array_join(F.slice("confirmed_patterns", 2, 9), "|").alias("added"), F.array_join("noise_selectors", "|").alias("noise"), F.col("selectors")["name"].alias("name_selector"), "platform", F.col("total_crawls").alias("crawls"), "maturity")


@query("""SELECT url_pattern, field_name, hint, synonyms, confidence, api_pattern, json_path, envelope, selector, success_count FROM (
  SELECT 'u' || s_suppkey AS url_pattern, f AS field_name, CASE WHEN f = 'name' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'css' ELSE 'a.b' END ELSE 'p' END AS hint,
  CASE WHEN s_suppkey % 3 = 0 AND f = 'name' THEN 'old|note' ELSE 'note' END AS synonyms, CASE WHEN s_suppkey % 3 = 0 AND f = 'name' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence, '/api' AS api_pattern, CASE WHEN f = 'name' THEN 'a.b' ELSE 'p' END AS json_path,
  CASE WHEN s_suppkey % 3 = 0 AND f = 'name' THEN 'mine' ELSE 'data' END AS envelope, CASE WHEN f = 'name' AND s_suppkey % 2 = 0 THEN 'css' END AS selector, CASE WHEN s_suppkey % 3 = 0 AND f = 'name' THEN 4 ELSE 0 END AS success_count
  FROM supplier, (VALUES ('name'), ('price')) v(f))""")
def crystallized(s, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("u"), k).alias("url_pattern"), k)
    some = lambda c, t="string": F.lit(c).cast(t)
    stored = p.where("s_suppkey % 3 = 0").select("url_pattern", F.lit("name").alias("field_name"), some("h").alias("hint"), F.array(F.lit("old")).alias("synonyms"), F.lit(0.8).alias("confidence"), some(None).alias("api_pattern"), some(None).alias("json_path"), F.lit("mine").alias("envelope"), some(None).alias("selector"), F.lit(4).alias("success_count"))
    body = '{"api": {"url_pattern": "/api", "response_envelope": "data", "json_paths": {"name": "a.b", "price": "p", "gone": ""}}%s}'
    told = p.select("url_pattern", F.lit("note").alias("note"), F.when(k % 2 == 0, body % ', "dom": {"container": "ul", "selectors": {"name": "css"}}').otherwise(body % "").alias("field_mappings"))
    return L.crystallize(stored, told).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("SELECT s_suppkey, CAST(s_suppkey % 3 + 1 AS INT) AS successes, round(least(0.95, 0.8 + (s_suppkey % 4) * 0.05 + 0.05), 6)::DOUBLE AS confidence FROM supplier")
def mapping_bumps(s, d):  # noqa: ANN001, ANN201
    m = F.array(F.struct((F.col("s_suppkey") % 3).cast("int").alias("success_count"), (F.lit(0.8) + (F.col("s_suppkey") % 4) * 0.05).alias("confidence")))
    got = L.bump_mappings(m)[0]
    return table(s, d, "supplier").select("s_suppkey", got["success_count"].alias("successes"), F.round(got["confidence"], 6).alias("confidence"))


@query("SELECT 'u' || s_suppkey AS url_pattern, CASE WHEN s_suppkey % 2 = 0 THEN '/old|/ads|/track' ELSE '/old' END AS blocked FROM supplier")
def blocked_by_signals(s, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("u"), k).alias("url_pattern"), F.array(F.lit("/old")).alias("blocked"), k)
    sig = p.where("s_suppkey % 2 = 0").select("url_pattern", F.lit(2).alias("seq"), F.lit('{"misleading_patterns": ["/track", "", "/old"]}').alias("raw_context")).union(p.where("s_suppkey % 2 = 0").select("url_pattern", F.lit(1), F.lit('{"misleading_patterns": ["/ads"]}')))
    sig = sig.union(p.select(F.lit("no profile"), F.lit(1), F.lit('{"misleading_patterns": ["/x"]}'))).union(p.select("url_pattern", F.lit(3), F.lit("{}")))
    return L.blocked_endpoints(p, sig).select("url_pattern", F.array_join("blocked", "|").alias("blocked"))


@query(f"""SELECT skill, CASE WHEN n >= 700 THEN 'batch' WHEN most >= 20 THEN 'smart' WHEN n > 0 THEN 'run_end' END AS "trigger" FROM (SELECT skill, count(*) AS n FROM ({_SIGNALS}) GROUP BY 1)
  LEFT JOIN (SELECT skill, max(c) AS most FROM (SELECT skill, platform, count(*) AS c FROM ({_SIGNALS}) WHERE platform <> 'click' GROUP BY 1, 2) GROUP BY 1) USING (skill)""")
def trigger_kinds(s, d):  # noqa: ANN001, ANN201
    sig = signals(s, d)
    known = sig.select("skill", F.lit("click").alias("platform")).distinct()
    return L.triggers(sig.groupBy("skill").agg(F.count("*").alias("n")), L.new_platforms(sig, known), 700, 20, ended=True)


@query(f"""SELECT skill, batch, CAST(1 + batch AS INT) AS version_before, CAST(2 + batch AS INT) AS version_after, n AS signal_count, 0.25::DOUBLE AS cost_usd, CASE WHEN batch % 5 = 4 THEN '' ELSE 'b' || batch END AS summary,
  '{{"known_noise_patterns": ["ads", "admin"]' || CASE WHEN batch >= 0 THEN ', "navigation_wisdom": "w' || (CASE WHEN batch % 5 = 4 THEN batch - 1 ELSE batch END) || '"' ELSE '' END || '}}' AS memory
  FROM (SELECT skill, batch, count(*) AS n FROM (SELECT skill, (row_number() OVER (PARTITION BY skill ORDER BY seq) - 1) // 50 AS batch FROM ({_SIGNALS})) GROUP BY 1, 2)""")
def consolidate_memory(s, d):  # noqa: ANN001, ANN201
    """Batches of signals fold into memories: an answer's parts replace, an error's batch counts but changes nothing."""
    sig = signals(s, d)
    memories = sig.select("skill").distinct().select("skill", F.lit(1).alias("version"), F.lit('{"known_noise_patterns": ["ads"]}').alias("memory"))
    answers = L.batches(sig).select("skill", "batch").distinct().select("skill", "batch", F.concat(F.lit('{"summary": "b'), "batch", F.lit('", "navigation_wisdom": "w'), "batch", F.lit('"}')).alias("content"), F.lit(0.25).alias("cost_usd"), F.when(F.col("batch") % 5 == 4, "timeout").alias("error"))
    return Y.consolidate(memories, sig, answers, ("admin",))


@query("SELECT skill, n, CAST(n // 50 AS BIGINT) AS full_batches FROM (SELECT 's' || user_id % 7 AS skill, count(*) AS n FROM events GROUP BY 1)")
def pending_signals(s, d):  # noqa: ANN001, ANN201
    numbered = L.batches(signals(s, d))
    return numbered.groupBy("skill").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("full"), F.col("batch"))).alias("full_batches"))


@query("""SELECT s_name AS skill, s_suppkey % 3 <> 1 AS warmed, CASE s_suppkey % 3 WHEN 1 THEN '["/k"]' WHEN 0 THEN '["/a", "/' || s_nationkey || '"]' ELSE '[]' END AS apis,
  CASE WHEN s_suppkey % 3 = 1 THEN '[]' WHEN s_suppkey % 3 = 0 THEN '["x", "no"]' ELSE '["no"]' END AS noise, CASE WHEN s_suppkey % 3 = 0 THEN 'wise ' || s_name ELSE '' END AS wisdom, CASE WHEN s_suppkey % 3 = 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS cost FROM supplier""")
def warmed_memories(s, d):  # noqa: ANN001, ANN201
    """A third of the skills have a fresh memory, a third a stale one whose warm-up fails, the rest none: theirs is made from an answer."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    old = F.concat(F.lit('{"skill_hash": "'), Y.skill_hash(name, F.when(k % 3 == 1, "2").otherwise("1")), F.lit('", "high_confidence_api_patterns": ["/k"], "known_noise_patterns": [], "navigation_wisdom": "", "warmup_cost_usd": 0.0}'))
    p = table(s, d, "supplier")
    stored = p.select(name.alias("skill"), F.lit("2").alias("version"), F.when(k % 3 > 0, old).alias("memory"))
    content = F.concat(F.lit('{"api_patterns": ["/a", "/'), "s_nationkey", F.lit('"], "known_noise_patterns": ["x"], "navigation_wisdom": "wise '), name, F.lit('"}'))
    said = p.select(name.alias("skill"), content.alias("content"), F.lit(0.5).alias("cost_usd"), F.when(k % 3 == 2, "timeout").alias("error"))
    get = lambda path: F.get_json_object("memory", f"$.{path}")
    listed = lambda path: F.concat(F.lit("["), F.array_join(F.transform(F.from_json(get(path), "array<string>"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    return Y.warm(stored, said, ("no",)).select("skill", "warmed", listed("high_confidence_api_patterns").alias("apis"), listed("known_noise_patterns").alias("noise"), get("navigation_wisdom").alias("wisdom"), get("warmup_cost_usd").cast("double").alias("cost"))


@query("""SELECT skill, field, synonyms, hint FROM (SELECT s_name AS skill, 'name' AS field, 'title|label' || s_suppkey AS synonyms, 'in h1' AS hint FROM supplier UNION ALL SELECT s_name, 'price', '', 'digits ' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)""")
def schema_hints(s, d):  # noqa: ANN001, ANN201
    """What stored memories know of a schema's two fields; a third field isn't asked for."""
    hints = F.to_json(F.map_concat(F.create_map(F.lit("name"), F.lit("in h1"), F.lit("other"), F.lit("y")), F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("price"), F.concat(F.lit("digits "), "s_nationkey"))).otherwise(F.create_map().cast("map<string,string>"))))
    synonyms = F.to_json(F.create_map(F.lit("name"), F.array(F.lit("title"), F.concat(F.lit("label"), "s_suppkey")), F.lit("other"), F.array(F.lit("x"))))
    stored = table(s, d, "supplier").select(F.col("s_name").alias("skill"), F.concat(F.lit('{"confirmed_field_synonyms": '), synonyms, F.lit(', "field_extraction_hints": '), hints, F.lit("}")).alias("memory"))
    return Y.schema_parts(stored, ("name", "price")).select("skill", "field", F.array_join("synonyms", "|").alias("synonyms"), "hint")


_DONORS = f"""SELECT t.pos AS t, c.pos AS c FROM (SELECT target, member FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY m DESC, pos) AS n FROM (SELECT t.url AS target, c.url AS member, c.m, c.pos FROM ({_PROFILES}) t JOIN ({_PROFILES}) c ON t.nat = c.nat AND t.url <> c.url AND (t.platform IS NULL OR c.platform IS NULL OR t.platform = c.platform) AND (t.sig IS NULL OR c.sig IS NULL OR t.sig = c.sig))) WHERE n = 1) d
  JOIN ({_PROFILES}) t ON t.url = d.target JOIN ({_PROFILES}) c ON c.url = d.member"""


@query(f"""SELECT t, c AS donor, CASE WHEN t % 2 = 0 OR c % 2 = 0 THEN 'offset' END AS pagination_style, CASE WHEN t % 3 = 0 THEN 'json' || t WHEN c % 3 = 0 THEN 'json' || c ELSE '' END AS response_format, t % 7 = 0 OR c % 7 = 0 AS auth_required,
  CASE WHEN t % 4 = 0 AND c % 4 = 0 THEN '' ELSE '/a|/b' END AS patterns, array_to_string(list_sort(['e' || t, 'e' || c]), '|') AS endpoints, array_to_string(list_sort(list_distinct(['n' || t % 2, 'n' || c % 2])), '|') AS noise, '#' || t AS name_selector, '#d' || (CASE WHEN t % 5 = 0 THEN t ELSE c END) AS other_selector,
  CASE WHEN t % 3 = 1 THEN 'w' || t WHEN c % 3 = 1 THEN 'w' || c ELSE '' END AS waits, CASE WHEN t % 3 <> 1 AND c % 3 = 1 THEN c ELSE t END AS wait_ms, 'WARM' AS maturity FROM ({_DONORS}) WHERE t % 5 = 0 OR c % 5 = 0""")
def bootstrap_profiles(s, d):  # noqa: ANN001, ANN201
    """All that a profile takes over from the most mature of its cluster."""
    k = F.col("pos")
    of = lambda c: F.concat(F.lit(c), k)
    p = profiles(s, d)
    p = p.withColumn("response_format", F.when(k % 3 == 0, of("json")).otherwise("")).withColumn("auth_required", k % 7 == 0).withColumn("confirmed_endpoints", F.array(of("e"))).withColumn("noise_selectors", F.array(F.concat(F.lit("n"), k % 2)))
    p = p.withColumn("selectors", F.when(k % 5 == 0, F.create_map(F.lit("name"), of("#"), F.lit("other"), of("#d"))).otherwise(F.create_map(F.lit("name"), of("#"))))
    p = p.withColumn("navigation", F.struct(F.lit(True).alias("requires_interaction"), F.lit(None).cast("boolean").alias("scroll_for_content"), F.when(k % 3 == 1, of("w")).otherwise("").alias("wait_for_selector"), k.cast("int").alias("wait_ms"), F.array().cast("array<string>").alias("external_sources"), F.array().cast("array<string>").alias("pre_crawl_steps")))
    got = L.bootstrap(p, L.all_donors(p))
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    got = got.select(
        number("url_pattern").alias("t"), number("donor").alias("donor"), "pagination_style", "response_format", "auth_required", F.array_join("confirmed_patterns", "|").alias("patterns"), F.array_join("confirmed_endpoints", "|").alias("endpoints"), F.array_join("noise_selectors", "|").alias("noise"),
        F.col("selectors")["name"].alias("name_selector"), F.col("selectors")["other"].alias("other_selector"), F.col("navigation.wait_for_selector").alias("waits"), F.col("navigation.wait_ms").cast("long").alias("wait_ms"), "maturity",
    )
    return got.where("other_selector is not null")


@query(r"SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS domain, url AS url_pattern FROM pages")
def domain_groups(s, d):  # noqa: ANN001, ANN201
    return L.domain_members(pages(s, d).select(F.col("url").alias("url_pattern"))).select("domain", "url_pattern")


# ---- reports --------------------------------------------------------------------------------------


@query(f"SELECT url, '| ' || url || ' | ' || status || ' | ' || tier_used || ' | ' || n_records || ' | ' || printf('%.2f', confidence) || ' | e1; e2; e3 |' AS line FROM ({_RESULTS})")
def report_rows(s, d):  # noqa: ANN001, ANN201
    return T.report_rows(results(s, d))


@query(f"SELECT CAST(sum(n_records) AS BIGINT) AS records, round(sum(llm_cost_usd), 2) AS cost_usd, count(*) AS with_errors FROM ({_RESULTS})")
def report_totals(s, d):  # noqa: ANN001, ANN201
    return T.report_totals(results(s, d)).withColumn("cost_usd", F.round("cost_usd", 2))


@query(f"SELECT url, status, tier_used, confidence, llm_cost_usd, n_records, 'e1|e2|e3|e4' AS errors FROM ({_RESULTS})")
def result_fields(s, d):  # noqa: ANN001, ANN201
    return T.result_fields(results(s, d)).withColumn("errors", F.array_join("errors", "|"))


@query(f"""SELECT url, '# ' || url || chr(10) || 'status: ' || status || chr(10) || 'tier: ' || tier_used || chr(10) || 'confidence: ' || printf('%.2f', confidence) || chr(10) || 'cost: $' || printf('%.4f', llm_cost_usd) || chr(10) || 'records: ' || n_records || chr(10) || 'errors: e1; e2; e3; e4' AS report FROM ({_RESULTS})""")
def url_reports(s, d):  # noqa: ANN001, ANN201
    return T.url_report(results(s, d))


@query(f"""SELECT count(*) FILTER (status = 'SUCCESS') || '/' || count(*) || ' succeeded, ' || count(*) FILTER (status = 'CARRY_FORWARD') || ' carried forward, ' || count(*) FILTER (status = 'PARTIAL') || ' failed; ' || CAST(sum(n_records) AS BIGINT) || ' records; $' || printf('%.4f', sum(llm_cost_usd)) || '; mean confidence ' || printf('%.2f', avg(confidence)) AS summary FROM ({_RESULTS})""")
def metrics_summary(s, d):  # noqa: ANN001, ANN201
    return T.metrics_line(T.crawl_metrics(results(s, d)))


@query("""WITH l AS (SELECT event_type AS stage, CAST(user_id AS VARCHAR) AS url, 'm' || (event_id % 3) AS model, value AS cost FROM events)
SELECT 'total' AS section, 'calls: ' || count(*) AS name, round(sum(cost), 4) AS cost_usd FROM l UNION ALL SELECT 'stage', stage, round(sum(cost), 4) FROM l GROUP BY ALL UNION ALL SELECT 'model', model, round(sum(cost), 4) FROM l GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'url', url, round(sum(cost), 4) FROM l GROUP BY ALL ORDER BY sum(cost) DESC, url LIMIT 10)""")
def cost_sections(s, d):  # noqa: ANN001, ANN201
    return T.cost_sections(ledger(s, d)).withColumn("cost_usd", F.round("cost_usd", 4))


@query(f"SELECT round(sum(llm_cost_usd), 2) AS results_usd, 1.5::DOUBLE AS consolidation_usd, 0.25::DOUBLE AS warmup_usd, round(sum(llm_cost_usd) + 1.75, 2) AS total_usd FROM ({_RESULTS})")
def run_costs(s, d):  # noqa: ANN001, ANN201
    log = s.createDataFrame([(0.5,), (1.0,)], "cost_usd double")
    return T.run_costs(results(s, d), log, 0.25).withColumns({c: F.round(c, 2) for c in ("results_usd", "total_usd")})


# ---- proxies --------------------------------------------------------------------------------------


@query("SELECT proxy, CAST(pos AS INT) AS pos, health FROM (SELECT 'p' || s_suppkey AS proxy, s_suppkey AS pos, (s_suppkey % 5) / 4.0::DOUBLE AS health FROM supplier WHERE s_suppkey % 5 <> 4 OR s_suppkey > 5) ORDER BY health DESC, pos LIMIT 1")
def best_of_pool(s, d):  # noqa: ANN001, ANN201
    """Health by key modulo five; the healthiest is quarantined if its key is below six."""
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("p"), k).alias("proxy"), k.cast("int").alias("pos"), ((k % 5) / F.lit(4.0)).alias("health"), ((k % 5 == 4) & (k <= 5)).alias("quarantined"))
    return Z.best_proxy(p.drop("pos"), p.select("proxy", "pos"))


def _agents(name: str) -> str:
    agents = ", ".join("'" + a.replace("'", "''") + "'" for a in Z.USER_AGENTS)
    languages = ", ".join(f"'{x}'" for x in Z.LANGUAGES)
    k = "(('0x' || left(sha256(url), 8))::BIGINT % 8)"
    return {"agent": f"[{agents}][{k} + 1]", "language": f"[{languages}][{k} % 3 + 1]"}[name]


@query(f"SELECT page_id, {_agents('agent')} AS agent, {_agents('language')} AS language, 'v' AS extra FROM pages")
def identity_headers(s, d):  # noqa: ANN001, ANN201
    h = Z.request_headers(F.col("url"), {"X-Extra": "v", "User-Agent": "none"})
    return pages(s, d).select("page_id", h["User-Agent"].alias("agent"), h["Accept-Language"].alias("language"), h["X-Extra"].alias("extra"))


@query("SELECT s_suppkey, 'http://h' || s_suppkey || ':80' AS server, 'a b' AS username, CASE WHEN s_suppkey % 2 = 0 THEN 'p@ss' END AS password, 'http://a%20b' || CASE WHEN s_suppkey % 2 = 0 THEN ':p%40ss' ELSE '' END || '@h' || s_suppkey || ':80' AS again FROM supplier")
def proxy_urls(s, d):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey")
    url = F.concat(F.lit("http://a%20b"), F.when(k % 2 == 0, ":p%40ss").otherwise(""), F.lit("@h"), k, F.lit(":80"))
    rows = table(s, d, "supplier").select("s_suppkey", X.proxy_parts(url).alias("p"))
    return rows.select("s_suppkey", "p.server", "p.username", "p.password", X.proxy_url(F.col("p.server"), F.col("p.username"), F.col("p.password")).alias("again"))


@query("""SELECT event_id, kind, CASE kind WHEN 'static' THEN 'http://u:p@h:1' WHEN 'rotating' THEN CASE (row_number() OVER (PARTITION BY kind, user_id % 4 ORDER BY ts, event_id) - 1) % 2 WHEN 0 THEN 'http://a:1' ELSE 'http://b:2' END
  WHEN 'session' THEN 'http://brd-customer-c-zone-z-country-us-session-' || left(sha256('u' || user_id), 16) || ':pw@brd.superproxy.io:22225' END AS proxy FROM events, (VALUES ('static'), ('rotating'), ('session'), ('none')) v(kind)""")
def proxy_assignment(s, d):  # noqa: ANN001, ANN201
    """Providers by the environment's settings."""
    r = table(s, d, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("url"), (F.col("user_id") % 4).alias("shard"), F.struct("ts", "event_id").alias("seq"))
    kinds = {
        "static": {"PROXY_SERVER": "http://h:1", "PROXY_USERNAME": "u", "PROXY_PASSWORD": "p"}, "rotating": {"PROXY_PROVIDER": "Rotating", "PROXY_POOL_URLS": "http://a:1, http://b:2,"}, "none": {"PROXY_PROVIDER": "rotating"},
        "session": {"PROXY_PROVIDER": "brightdata", "PROXY_USERNAME": "c", "PROXY_BRIGHTDATA_ZONE": "z", "PROXY_PASSWORD": "pw", "PROXY_BRIGHTDATA_COUNTRY": "US"},
    }
    out = None
    for kind, environment in kinds.items():
        got = Z.assign_proxies(r, Z.settings_from(environment)).select("event_id", F.lit(kind).alias("kind"), "proxy")
        out = got if out is None else out.union(got)
    return out


@query("""WITH RECURSIVE r AS (SELECT 'd' || user_id % 9 AS domain, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS t0, row_number() OVER (PARTITION BY user_id % 9 ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT domain, seq, t0, n, 2.0::DOUBLE AS tokens, t0 AS stand, 0.0::DOUBLE AS wait FROM r WHERE n = 1
  UNION ALL SELECT domain, seq, t0, n, CASE WHEN t < 1 THEN 0.0::DOUBLE ELSE t - 1 END, CASE WHEN t < 1 THEN moment + (1 - t) / 0.01::DOUBLE ELSE moment END, CASE WHEN t < 1 THEN moment + (1 - t) / 0.01::DOUBLE ELSE moment END - t0
    FROM (SELECT r.*, greatest(r.t0, f.stand) AS moment, least(3.0::DOUBLE, f.tokens + (greatest(r.t0, f.stand) - f.stand) * 0.01::DOUBLE) AS t FROM f JOIN r ON r.domain = f.domain AND r.n = f.n + 1))
  SELECT domain, seq, round(wait, 2) AS wait FROM f""")
def rate_limit_fold(s, d):  # noqa: ANN001, ANN201
    r = table(s, d, "events").select(F.concat(F.lit("d"), F.col("user_id") % 9).alias("domain"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return Z.rate_limit(r, 0.01, 3).select("domain", "seq", F.round("wait", 2).alias("wait"))
