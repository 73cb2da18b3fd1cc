"""What runs teach: profiles, drift, clusters of alike sites, signals and the memory that they fold into."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import json_records as J
from pagewright.functions.text import api_signature, domain, fixed
from pagewright.operators import clusters
from pagewright.operators.clusters import find_clusters, find_similar  # noqa: F401
from pagewright.operators.scans import places

#: Maturity steps: crawls from which each holds, the highest first.
MATURITY = (("STABLE", 10), ("WARM", 5), ("LEARNING", 2))
BATCH_SIZE, SMART_COUNT = 50, 3
HINT_LISTS = ("confirmed_endpoints", "confirmed_patterns", "list_container_selectors", "pagination_selectors", "noise_selectors")
NAVIGATION = "struct<requires_interaction:boolean,scroll_for_content:boolean,wait_for_selector:string,wait_ms:int,external_sources:array<string>,pre_crawl_steps:array<string>>"


def maturity(total_crawls: Column) -> Column:
    out = None
    for name, least in MATURITY:
        out = F.when(total_crawls >= least, name) if out is None else out.when(total_crawls >= least, name)
    return out.otherwise("COLD")


def maturity_rank(name: Column) -> Column:
    return F.when(name == "STABLE", 3).when(name == "WARM", 2).when(name == "LEARNING", 1).otherwise(0)


def demote(name: Column, drifted: Column) -> Column:
    """One step down if drifted."""
    down = F.when(name == "STABLE", "WARM").when(name == "WARM", "LEARNING").otherwise("COLD")
    return F.when(drifted, down).otherwise(name)


def record_success(crawls: DataFrame) -> DataFrame:
    """(url, n_records, confidence, latency_ms, at) of successes -> the profiles' statistics."""
    return crawls.groupBy("url").agg(
        F.count("*").alias("successful_crawls"), F.sum("n_records").alias("total_records"), F.avg("confidence").alias("avg_confidence"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.max("at").alias("last_crawl"),
    )


def running_means(crawls: DataFrame, value: str, key: str = "url", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The mean up to and including each crawl."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return crawls.withColumn("mean", F.avg(value).over(w))


def drift_reasons(last: Column, now: Column, all_missing: Column, state: Column, drop: float = 0.5) -> Column:
    """Reasons for which a page counts as drifted; none, none."""
    fall = (last - now) / last
    return F.array_compact(
        F.array(
            F.when((last > 0) & (fall >= drop), F.concat(F.lit("record_count_drop:"), fixed(fall, 2))),
            F.when((now > 0) & all_missing, F.lit("all_minimum_fields_missing")),
            F.when((now == 0) & state.isin("WARM", "STABLE"), F.lit("no_records")),
        )
    )


def detect_drift(runs: DataFrame, drop: float = 0.5) -> DataFrame:
    """(url, run, n_records, all_missing, maturity) -> each run after a url's first against the one before."""
    w = Window.partitionBy("url").orderBy("run")
    rows = runs.withColumn("last_count", F.lag("n_records").over(w)).where(F.col("last_count").isNotNull())
    rows = rows.withColumn("reasons", drift_reasons(F.col("last_count"), F.col("n_records"), F.col("all_missing"), F.col("maturity"), drop))
    return rows.withColumn("drifted", F.size("reasons") > 0).withColumn("suggested", demote(F.col("maturity"), F.col("drifted")))


def cluster_by_domain(profiles: DataFrame) -> DataFrame:
    """(domain, n, first): groups of url patterns; domain_members() has their members as rows, as a host can have any number."""
    return profiles.groupBy(domain(F.col("url_pattern")).alias("domain")).agg(F.count("*").alias("n"), F.min("url_pattern").alias("first"))


def domain_members(profiles: DataFrame) -> DataFrame:
    """The profiles with their domain, one row for each member of a group."""
    return profiles.withColumn("domain", domain(F.col("url_pattern")))


def donors(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(target, donor): the most mature member of each target's cluster, the first of equals."""
    return clusters.donors(pairs, profiles, maturity_rank(F.col("maturity")))


def all_donors(profiles: DataFrame) -> DataFrame:
    """The same for all profiles among themselves, by classes instead of pairs."""
    return clusters.class_donors(profiles, maturity_rank(F.col("maturity")))


def bootstrap(profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """Profiles with (target, donor) -> the targets' profiles, WARM.

    Lists of hints are united and sorted; the target's selectors stand over the donor's; pagination style, response format and
    platform are the donor's where the target has none; either's need of authentication counts; the navigation is the
    donor's where only the donor waits for a selector. What a profile lacks as a column counts as empty; blocked endpoints aren't kept.
    """
    names = ("platform", "pagination_style", "response_format", "auth_required", "selectors", "navigation", *HINT_LISTS)
    kinds = {"selectors": "map<string,string>", "navigation": NAVIGATION, "auth_required": "boolean", **dict.fromkeys(HINT_LISTS, "array<string>")}
    full = profiles.select("url_pattern", *[(F.col(c) if c in profiles.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names])
    donor = full.select(*[F.col(c).alias(f"d_{c}") for c in full.columns])
    rows = full.join(chosen, F.col("url_pattern") == F.col("target")).join(donor, F.col("donor") == F.col("d_url_pattern"))
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    own = F.coalesce("selectors", empty)
    theirs = F.map_filter(F.coalesce("d_selectors", empty), lambda k, _: ~F.map_contains_key(own, k))
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), f"d_{c}")
    waits = lambda c: F.coalesce(F.col(f"{c}.wait_for_selector"), F.lit("")) != ""
    return rows.select(
        "url_pattern", "donor", *[some(c).alias(c) for c in ("platform", "pagination_style", "response_format")], (F.coalesce("auth_required", F.lit(False)) | F.coalesce("d_auth_required", F.lit(False))).alias("auth_required"),
        *[F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"d_{c}", none))).alias(c) for c in HINT_LISTS],
        F.map_concat(theirs, own).alias("selectors"), F.when(~waits("navigation") & waits("d_navigation"), F.col("d_navigation")).otherwise(F.col("navigation")).alias("navigation"), F.lit("WARM").alias("maturity"),
    )


def apply_signals(profiles: DataFrame, signals: DataFrame) -> DataFrame:
    """(url_pattern, confirmed_patterns, noise_selectors, selectors, platform, total_crawls) and (url_pattern, seq,
    signal_type, field_name, hint, platform) -> updated profiles: lists appended once in arrival order, selectors and
    platform by the last signal, one more crawl."""
    hint = F.nullif("hint", F.lit(""))
    keyed = F.when((F.col("signal_type") == "dom_selector") & (F.col("field_name") != "") & hint.isNotNull(), F.struct("seq", F.col("field_name").alias("k"), hint.alias("v")))
    platform = signals.groupBy("url_pattern").agg(
        F.max_by(F.when(F.col("signal_type") == "platform", F.col("platform")), F.when((F.col("signal_type") == "platform") & F.col("platform").isNotNull(), F.col("seq"))).alias("new_platform"),
    )
    # a hint's first signal: one row for each profile and hint before they meet
    once = signals.where(F.col("signal_type").isin("api_pattern", "noise") & hint.isNotNull()).groupBy(F.col("url_pattern").alias("h_url"), "signal_type", hint.alias("v")).agg(F.min("seq").alias("seq"))
    agg = once.groupBy("h_url").agg(F.array_sort(F.collect_list(F.when(F.col("signal_type") == "api_pattern", F.struct("seq", "v")))).alias("apis"), F.array_sort(F.collect_list(F.when(F.col("signal_type") == "noise", F.struct("seq", "v")))).alias("noises"))
    # a field's last selector; one row for each profile and field before they meet
    last = signals.where(keyed.isNotNull()).groupBy("url_pattern", "field_name").agg(F.max_by(hint, "seq").alias("v"))
    maps = last.groupBy(F.col("url_pattern").alias("m_url")).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "v"))).alias("found"))
    none = F.array().cast("array<string>")
    values = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<seq:bigint,v:string>>")), lambda x: x["v"])
    rows = profiles.join(platform, "url_pattern", "left").join(agg, F.col("url_pattern") == F.col("h_url"), "left").join(maps, F.col("url_pattern") == F.col("m_url"), "left")
    own = F.coalesce("selectors", F.create_map().cast("map<string,string>"))
    final = F.coalesce("found", F.create_map().cast("map<string,string>"))
    return rows.select(
        "url_pattern", F.array_distinct(F.concat(F.coalesce("confirmed_patterns", none), values("apis"))).alias("confirmed_patterns"),
        F.array_distinct(F.concat(F.coalesce("noise_selectors", none), values("noises"))).alias("noise_selectors"),
        F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(final, k)), final).alias("selectors"),
        F.coalesce("new_platform", "platform").alias("platform"), (F.col("total_crawls") + 1).alias("total_crawls"), maturity(F.col("total_crawls") + 1).alias("maturity"),
    )


def bump_mappings(mappings: Column) -> Column:
    """After a replay that worked: one more success, a little more confidence, up to 0.95."""
    return F.transform(mappings, lambda m: m.withField("success_count", m["success_count"] + 1).withField("confidence", F.when(m["confidence"] < 0.95, F.least(F.lit(0.95), m["confidence"] + 0.05)).otherwise(m["confidence"])))


def crystallize(mappings: DataFrame, responses: DataFrame) -> DataFrame:
    """Fold a model's field mappings into the stored ones.

    mappings: (url_pattern, field_name, hint, synonyms, confidence, api_pattern, json_path, envelope, selector, success_count);
    responses: (url_pattern, note, field_mappings JSON: {"api": {url_pattern, response_envelope, json_paths}, "dom": {container, selectors}}).
    A new field starts at confidence 0.7 and no successes; an envelope is set only where there is none.
    """
    schema = "api struct<url_pattern:string,response_envelope:string,json_paths:map<string,string>>, dom struct<container:string,selectors:map<string,string>>"
    rows = responses.select("url_pattern", "note", F.from_json("field_mappings", schema).alias("m"))
    api = rows.select("url_pattern", "note", F.explode("m.api.json_paths").alias("field_name", "json_path"), F.col("m.api.url_pattern").alias("api_pattern"), F.col("m.api.response_envelope").alias("envelope")).where("json_path <> ''")
    dom = rows.select("url_pattern", "note", F.explode("m.dom.selectors").alias("field_name", "selector"))
    found = api.join(dom.withColumnRenamed("note", "dom_note"), ["url_pattern", "field_name"], "full_outer").select(
        "url_pattern", "field_name", F.coalesce("note", "dom_note").alias("n_note"), F.coalesce("selector", "json_path").alias("n_hint"),
        F.nullif("api_pattern", F.lit("")).alias("n_api"), F.col("json_path").alias("n_path"), F.nullif("envelope", F.lit("")).alias("n_envelope"), F.col("selector").alias("n_selector"),
    )
    both = mappings.join(found, ["url_pattern", "field_name"], "full_outer")
    note = F.when(F.coalesce("n_note", F.lit("")) != "", F.array("n_note")).otherwise(F.array().cast("array<string>"))
    return both.select(
        "url_pattern", "field_name", F.coalesce("n_hint", "hint").alias("hint"), F.array_distinct(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), note)).alias("synonyms"),
        F.coalesce("confidence", F.lit(0.7)).alias("confidence"), F.coalesce("n_api", "api_pattern").alias("api_pattern"), F.coalesce("n_path", "json_path").alias("json_path"),
        F.coalesce("envelope", "n_envelope").alias("envelope"), F.coalesce("n_selector", "selector").alias("selector"), F.coalesce("success_count", F.lit(0)).alias("success_count"),
    )


def blocked_endpoints(profiles: DataFrame, signals: DataFrame) -> DataFrame:
    """Append the misleading patterns of signals' raw context to existing profiles' blocked endpoints; new urls get none."""
    found = signals.select("url_pattern", "seq", F.posexplode(F.from_json("raw_context", "misleading_patterns array<string>")["misleading_patterns"]).alias("i", "p")).where("p <> ''")
    lists = found.groupBy("url_pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "p"))), lambda x: x["p"]).alias("more"))
    none = F.array().cast("array<string>")
    return profiles.join(lists, "url_pattern", "left").withColumn("blocked", F.array_distinct(F.concat(F.coalesce("blocked", none), F.coalesce("more", none)))).drop("more")


def batches(signals: DataFrame, size: int = BATCH_SIZE, key: str = "skill", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Number each signal's consolidation batch, and whether the batch is full."""
    rows = places(signals, key, order).withColumn("batch", F.floor(F.col("place") / size)).drop("place")
    return rows.withColumn("full", F.count("*").over(Window.partitionBy(key, "batch")) == size)


def new_platforms(signals: DataFrame, known: DataFrame) -> DataFrame:
    """(skill, most): the count of the most frequent platform among pending signals that the memory doesn't know."""
    fresh = signals.where(F.coalesce("platform", F.lit("")) != "").join(known.select("skill", "platform").distinct(), ["skill", "platform"], "left_anti")
    return fresh.groupBy("skill", "platform").agg(F.count("*").alias("n")).groupBy("skill").agg(F.max("n").alias("most"))


def triggers(pending: DataFrame, fresh: DataFrame, batch_size: int = BATCH_SIZE, smart: int = SMART_COUNT, ended: bool = False) -> DataFrame:
    """(skill, n pending) and new_platforms() -> (skill, trigger): batch first, then smart, run_end for what is left."""
    rows = pending.join(fresh, "skill", "left")
    kind = F.when(F.col("n") >= batch_size, "batch").when(F.coalesce("most", F.lit(0)) >= smart, "smart")
    return rows.select("skill", (kind.when(F.col("n") > 0, "run_end") if ended else kind).alias("trigger"))


def batch_stats(signals: DataFrame, by: Sequence[str] = ("skill",)) -> DataFrame:
    """Successes (confidence of 0.5 or more, external ranks aside) and platforms seen, sorted."""
    ok = (F.coalesce("confidence", F.lit(0.0)) >= 0.5) & (F.col("signal_type") != "external_rank")
    return signals.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("successes"), F.array_sort(F.collect_set(F.nullif("platform", F.lit("")))).alias("platforms"))


def signal_types(signals: DataFrame, by: Sequence[str] = ("skill",)) -> DataFrame:
    return signals.groupBy(*by, "signal_type").agg(F.count("*").alias("n"))


MEMORY_LISTS = ("high_confidence_api_patterns", "high_confidence_link_keywords", "known_noise_patterns")
MEMORY_MAPS = ("field_extraction_hints", "platform_fingerprints", "confirmed_field_synonyms")
MEMORY_TEXTS = ("navigation_wisdom", "prompt1_context", "prompt2_context", "prompt4_context")
#: Other names under which a warm-up response may give a part of the memory.
WARMUP_NAMES = {"high_confidence_api_patterns": "api_patterns", "high_confidence_link_keywords": "link_keywords", "field_extraction_hints": "field_hints"}


def updated_memory(memory: dict, response: dict | None, negative: Sequence[str] = (), warm: bool = False) -> dict:
    """The memory with the parts that a response has (warm: all parts, by either name), and the negative
    keywords always among its noise patterns."""
    out = dict(memory)
    if isinstance(response, dict):
        for names, kind in ((MEMORY_LISTS, list), (MEMORY_MAPS, dict), (MEMORY_TEXTS, str)):
            for name in names:
                if warm:
                    out[name] = kind(response.get(name) or response.get(WARMUP_NAMES.get(name, ""), None) or kind())
                elif name in response:
                    out[name] = kind(response[name] or kind())
    noise = list(out.get("known_noise_patterns") or [])
    out["known_noise_patterns"] = noise + [k for k in dict.fromkeys(negative) if k and k not in noise]
    return out


def consolidate(memories: DataFrame, signals: DataFrame, responses: DataFrame, negative: Sequence[str] = (), batch_size: int = BATCH_SIZE) -> DataFrame:
    """See memory.consolidate()."""
    from pagewright.operators import memory

    return memory.consolidate(memories, signals, responses, negative, batch_size)


def new_memory(name: str, version: str) -> dict:
    empty = {**{k: [] for k in MEMORY_LISTS}, **{k: {} for k in MEMORY_MAPS}, **{k: "" for k in MEMORY_TEXTS}}
    return {"skill_name": name, "skill_version": version, "skill_hash": hashlib.sha256(f"{name}::{version}".encode()).hexdigest()[:16], "memory_version": 1, "warmup_cost_usd": 0.0, **empty}


def is_stale(memory: dict | None, name: str, version: str) -> bool:
    """A memory is of a skill's name and version; other changes of the skill don't count."""
    return memory is None or memory.get("skill_hash") != new_memory(name, version)["skill_hash"]


def warm_up(memory: dict | None, name: str, version: str, answer: dict | None, negative: Sequence[str] = ()) -> dict:
    """The memory if it is fresh, else a new one from the answer's row (content, cost_usd, error)."""
    if not is_stale(memory, name, version):
        return memory
    answer = answer or {}
    content = None if answer.get("error") else J.parse(answer.get("content"))
    out = updated_memory(new_memory(name, version), content, negative, warm=isinstance(content, dict))
    return out | {"warmup_cost_usd": float(answer.get("cost_usd") or 0.0)}


def schema_parts(memory: dict, fields: Sequence[str]) -> tuple[dict, dict]:
    """Synonyms and hints of the schema's fields only; of all fields if none are named."""
    keep = lambda d: {k: v for k, v in (d or {}).items() if not fields or k in fields}
    return keep(memory.get("confirmed_field_synonyms")), keep(memory.get("field_extraction_hints"))
