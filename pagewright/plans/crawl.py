"""The crawl as one plan: inputs and pages in, records and results out.

inputs (url[, profile_json, carry_json array<string>, previous_json array<string>]), pages (url, html,
status_code, content_type, error[, attempt, latency_ms, at]). Pages, payloads and model responses are tables: a run fetches and
asks nothing. Where a step of a url would ask a model, its answer is looked up by stage and url in
responses (stage, url, content, cost_usd, error): discovery and extraction for pages whose tiers found nothing, external_rank
where minimum fields are missing, merge where a url has previous and new records. What isn't there was answered with nothing.
Of a skill as a whole, url is the skill's name for the warm-up, and name#batch for the consolidation of a batch of signals.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.predicates import fetch_success, is_captcha
from pagewright.operators import extraction, learning, records
from pagewright.operators import memory as memories
from pagewright.operators import responses as answers
from pagewright.operators.discovery import crawl_candidates, discover
from pagewright.sources.session import checkpoint, stored
from pagewright.sources.stores import bounded_queue, lookup_profiles, trace_rows

RESPONSES = "stage string, url string, content string, cost_usd double, error string"
MAPPINGS = "url_pattern string, field_name string, hint string, synonyms array<string>, confidence double, api_pattern string, json_path string, envelope string, selector string, success_count int"


@dataclass(frozen=True)
class Skill:
    """What a run looks for."""

    name: str
    version: str = "1"
    fields: tuple[str, ...] = ()
    minimum_fields: tuple[str, ...] = ()
    primary_key: str = ""
    merging_keys: tuple[str, ...] = ()
    json_schema: dict | None = None
    aliases: dict[str, list[str]] = field(default_factory=dict)
    negative_keywords: tuple[str, ...] = ()
    link_keywords: tuple[str, ...] = ()
    carry_forward: bool = True
    carry_days: int = 7
    max_external_depth: int = 0


@dataclass(frozen=True)
class Memory:
    """What earlier runs of a skill taught."""

    api_patterns: tuple[str, ...] = ()
    link_keywords: tuple[str, ...] = ()
    noise_patterns: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def of(memory: dict) -> Memory:
        """From a stored memory."""
        get = lambda k: tuple(memory.get(k) or ())
        return Memory(get("high_confidence_api_patterns"), get("high_confidence_link_keywords"), get("known_noise_patterns"), dict(memory.get("confirmed_field_synonyms") or {}))


def status_of(fetched: Column, has_records: Column, passed: Column, has_carry: Column, carry: bool = True) -> Column:
    """EMPTY, SUCCESS or PARTIAL of a fetched page; CARRY_FORWARD or FAILED of one that wasn't."""
    failed = F.when(F.lit(carry) & has_carry, "CARRY_FORWARD").otherwise("FAILED")
    return F.when(~fetched, failed).when(~has_records, "EMPTY").when(passed, "SUCCESS").otherwise("PARTIAL")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """One fetch of each url: its first success, else its last attempt; a challenge page is an error with status 403."""
    have = set(pages.columns)
    rows = pages.select("url", "html", "status_code", "content_type", "error", *[(F.col(c) if c in have else F.lit(d)).cast(t).alias(c) for c, d, t in (("attempt", 0, "long"), ("latency_ms", None, "double"), ("at", None, "timestamp"))])
    blocked = is_captcha(F.col("html"))
    rows = rows.withColumns({"error": F.when(blocked, "captcha_detected").otherwise(F.col("error")), "status_code": F.when(blocked, 403).otherwise(F.col("status_code"))})
    rows = rows.withColumn("fetched", fetch_success(F.col("status_code"), F.col("error")) & F.col("html").isNotNull())
    order = Window.partitionBy("url").orderBy(F.desc("fetched"), F.when(F.col("fetched"), F.col("attempt")).otherwise(-F.col("attempt")), F.sha2("html", 256))
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth", "attempt")


def endpoint_payloads(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """(url, profile_json), (url, pattern, body) -> (url, payloads): a map of the bodies for the endpoint patterns that the url's profile
    maps fields of, and no others; of repeated ones the least."""
    patterns = F.from_json("profile_json", "mappings array<struct<pattern:string>>")["mappings"]["pattern"]
    wanted = rows.where("profile_json is not null").select(F.col("url").alias("w_url"), F.explode(F.array_distinct(patterns)).alias("w_pattern")).distinct()
    found = payloads.join(wanted, (F.col("url") == F.col("w_url")) & (F.col("pattern") == F.col("w_pattern"))).groupBy("url", "pattern").agg(F.min("body").alias("body"))
    return found.groupBy(F.col("url").alias("e_url")).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "body"))).alias("payloads"))  # a profile's patterns


def bumped(mappings: DataFrame, produced: DataFrame) -> DataFrame:
    """Stored mappings after a run: those whose field a replay of their url's profile produced, (url, field), have one more success and a little more confidence."""
    won = produced.select(F.col("url").alias("__url"), F.col("field").alias("__field"), F.lit(True).alias("__won")).distinct()
    rows = mappings.join(won, (F.col("url_pattern") == F.col("__url")) & (F.col("field_name") == F.col("__field")), "left")
    one = learning.bump_mappings(F.array(F.struct("success_count", "confidence")))[0]
    return rows.withColumns({c: F.when(F.col("__won"), one[c]).otherwise(F.col(c)) for c in ("success_count", "confidence")}).select(*mappings.columns)


def warmed(skill: Skill, stored_memory: str | None, responses: DataFrame) -> tuple[str, bool]:
    """A skill's memory as JSON ahead of a run, and whether it was warmed up: the stored one while it is fresh, else a new one from the warm-up's answer.
    One row, for the plan is made from it."""
    spark = responses.sparkSession
    row = spark.createDataFrame([(skill.name, skill.version, stored_memory)], "skill string, version string, memory string")
    said = responses.where((F.col("stage") == "warmup") & (F.col("url") == skill.name)).select(F.col("url").alias("skill"), "content", "cost_usd", "error").limit(1)
    found = memories.warm(row, said, skill.negative_keywords).first()
    return found["memory"], found["warmed"]


def consolidated(signals: DataFrame, skill: Skill, memory: str, version: int, responses: DataFrame, batch_size: int = learning.BATCH_SIZE) -> DataFrame:
    """A run's signals, in the order of url and kind, folded into the skill's memory batch by batch; the last batch is what is left at the end."""
    one = signals.sparkSession.createDataFrame([(skill.name, version, memory)], "skill string, version int, memory string")
    named = F.regexp_extract("url", r"#(\d+)$", 1)
    said = responses.where((F.col("stage") == "consolidation") & F.col("url").startswith(f"{skill.name}#") & (named != "")).select(F.lit(skill.name).alias("skill"), named.cast("long").alias("batch"), "content", "cost_usd", "error")
    ordered = signals.select("skill", F.struct("url", "signal_type", "hint").alias("seq"))
    return memories.consolidate(one, ordered, said, skill.negative_keywords, batch_size)


def _listed(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("url", F.posexplode(column).alias("rec_idx", "record_json"))


def run(
    inputs: DataFrame, pages: DataFrame, skill: Skill, tiers: Sequence[extraction.Tier] = extraction.CASCADE, *,
    responses: DataFrame | None = None, profiles: DataFrame | None = None, mappings: DataFrame | None = None, payloads: DataFrame | None = None,
    memory: Memory = Memory(), stored_memory: str | None = None, warm: bool = False, memory_version: int = 1, batch_size: int = learning.BATCH_SIZE,
) -> dict[str, DataFrame]:
    """profiles: stored (url_pattern, profile JSON); mappings: stored field mappings; payloads: (url, pattern, body) of endpoints.

    warm: the run's memory is stored_memory, warmed up if it is stale, and its signals are consolidated into it at the end; else it is `memory`. ->

    records (url, rec_idx, record_json), results (url, status, tier_used, ...), dead_letters, ranked links and apis, candidates,
    external (url, links), signals, profiles (statistics), mappings, blocked (url, blocked), triggers, ledger, trace; with warm also memory.
    """
    spark = inputs.sparkSession
    responses = spark.createDataFrame([], RESPONSES) if responses is None else responses
    was_warmed = False
    if warm:
        stored_memory, was_warmed = warmed(skill, stored_memory, responses)
        memory = Memory.of(json.loads(stored_memory))
    none = F.array().cast("array<string>")
    have = set(inputs.columns)
    rows = inputs.select("url", *[(F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in (("profile_json", "string"), ("carry_json", "array<string>"), ("previous_json", "array<string>"))])
    if profiles is not None:
        rows = lookup_profiles(rows.withColumnRenamed("profile_json", "own_profile"), profiles).withColumnRenamed("profile", "profile_json").drop("own_profile")
    joined = rows.join(fetched_pages(pages), "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    if payloads is not None:
        bodies = endpoint_payloads(rows, payloads)
        joined = joined.join(bodies, joined["url"] == bodies["e_url"], "left").drop("e_url")
    joined = stored(joined, "crawl-pages")
    good = joined.where("fetched")

    # the tiers, then a model's answers for pages in which they find nothing
    source = good.select("url", "html", "content_type", "profile_json", *(["payloads"] if payloads is not None else []))
    found = stored(extraction.extract(source, skill.fields, memory.api_patterns, memory.noise_patterns, tiers), "crawl-found")
    empty = found.where("record_json is null").select("url")
    discovered = checkpoint(answers.parse_discovery(answers.join_responses(empty, responses, "discovery")))
    extracted = checkpoint(answers.parse_extraction(answers.join_responses(empty, responses, "extraction")))
    told = _listed(extracted, "records").where(F.col("record_json").startswith("{"))
    named = found.where("record_json is not null").select("url", "rec_idx", "record_json").union(told)
    named = named.withColumn("record_json", records.rename_keys(F.col("record_json"), {**skill.aliases, **memory.synonyms}))
    kept = stored(records.drop_negative(named, skill.negative_keywords), "crawl-kept")
    tier = found.where("record_json is not null").groupBy("url").agg(F.max("tier_used").alias("tier_used"), F.max("confidence").alias("confidence"))
    tier = tier.union(extracted.select("url", F.lit("llm_extraction"), "confidence"))
    produced = found.where("tier_used = 'profile_replay'").select("url", F.explode(F.json_object_keys("record_json")).alias("field"))
    produced = produced.where(F.col("field").isin(*skill.fields)) if skill.fields else produced

    # outside links where minimum fields are missing
    links, apis = discover(good, memory.link_keywords or skill.link_keywords, skill.negative_keywords, memory.api_patterns)
    values = kept.select("url", *[F.get_json_object("record_json", f"$['{f}']").alias(f) for f in skill.minimum_fields])
    missing = records.missing_fields(values, skill.minimum_fields, good)
    best = links.where("rank <= 25").groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "link"))), lambda x: x["link"]).alias("links"))  # at most 25 of a url
    wanted = answers.needs_external(missing.join(best, "url"), skill.max_external_depth).select("url")
    wanted = checkpoint(wanted) if skill.max_external_depth > 0 else spark.createDataFrame([], "url string")
    ranked = answers.parse_external(answers.join_responses(wanted, responses, "external_rank"))

    # merge with previous records
    before = _listed(joined.where(F.size(F.coalesce("previous_json", none)) > 0).join(kept.select("url").distinct(), "url", "left_semi"), "previous_json")
    before = checkpoint(before)
    both = before.select("url").distinct()
    said = answers.join_responses(both, responses, "merge")
    merged = records.drop_negative(records.merge_answers(before, kept.join(both, "url", "left_semi"), said, skill.primary_key, skill.merging_keys), skill.negative_keywords)
    final = kept.join(both, "url", "left_anti").union(merged.select("url", "rec_idx", "record_json"))
    final = stored(final.withColumn("record_json", records.assign_identity(F.col("record_json"), skill.primary_key)), "crawl-records")

    # every answered call, once
    asked = empty.select("url", F.explode(F.array(F.lit("discovery"), F.lit("extraction"))).alias("stage")).union(wanted.select("url", F.lit("external_rank"))).union(both.select("url", F.lit("merge")))
    extra = [(F.col(c) if c in responses.columns else F.lit(None)).cast(t).alias(c) for c, t in (("model", "string"), ("input_tokens", "long"), ("output_tokens", "long"))]
    ledger = asked.distinct().join(responses.select("stage", "url", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), "error", *extra), ["url", "stage"])
    ledger = checkpoint(ledger.select("stage", "url", F.lit(skill.name).alias("skill"), "model", "input_tokens", "output_tokens", "cost_usd", "error"))
    paid = ledger.groupBy("url").agg(F.sum("cost_usd").alias("llm_cost_usd"))

    gate = records.schema_gate(final, skill.minimum_fields, skill.json_schema)
    carried = F.coalesce(F.when(F.size("carry_json") > 0, F.col("carry_json")), F.col("previous_json"), none)
    results = joined.select("url", "fetched", "error", "status_code", "latency_ms", "at", "profile_json", carried.alias("carried"))
    results = results.join(gate, "url", "left").join(tier, "url", "left").join(paid, "url", "left").na.fill(0, ["n_records", "llm_cost_usd", "confidence"])
    status = status_of(F.col("fetched"), F.col("n_records") > 0, F.coalesce("passed", F.lit(False)), F.size("carried") > 0, skill.carry_forward)
    error = F.when(~F.col("fetched"), F.coalesce("error", F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("0")))))
    results = stored(results.withColumn("status", status).withColumn("errors", F.array_compact(F.array(error))), "crawl-results")
    over = F.col("status") == "CARRY_FORWARD"
    old = results.where(over).select("url", F.posexplode("carried").alias("rec_idx", "record_json"))

    # what the run teaches
    signal = lambda rows, *more: rows.where("error is null").select("url", "signal_type", *more, "hint")
    signals = signal(discovered.where("answered"), "platform", "confidence").union(signal(extracted.where("answered"), "platform", F.col("signal_confidence").alias("confidence")))
    signals = signals.union(signal(ranked.where("answered"), F.lit(None).cast("string").alias("platform"), "confidence")).withColumn("skill", F.lit(skill.name))
    noisy = joined.where("profile_json is not null").select("url", F.coalesce(F.from_json("profile_json", "blocked array<string>")["blocked"], none).alias("blocked"))
    noisy = noisy.join(discovered.where(F.size("misleading") > 0).select("url", "misleading"), "url")
    fetched = results.where("fetched")
    learned = extracted.where("field_mappings is not null").select(F.col("url").alias("url_pattern"), "note", "field_mappings")
    known = spark.createDataFrame([], MAPPINGS) if mappings is None else bumped(mappings, produced)
    pending = signals.groupBy("skill").agg(F.count("*").alias("n"))
    event = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.lit("").alias("timestamp"), "url", F.lit(skill.name).alias("skill"), F.lit("{}").alias("payload"))
    trace = event(fetched, "tier_attempted").union(event(fetched, "tier_won")).union(event(fetched, "profile_updated")).union(event(results.where(over), "carry_forward")).union(event(both, "merge_invoked"))
    trace = trace.union(event(discovered, "discovery_llm_invoked")).union(event(ranked.where(F.size("ranked_external_links") > 0), "external_rank_invoked")).union(event(results.where("status = 'FAILED'"), "dlq_push"))
    trace = trace.union(ledger.select(F.lit("llm_called"), F.lit(""), "url", "skill", F.to_json(F.struct("stage", "cost_usd"))))
    folded = {}
    if warm:
        folded["memory"] = checkpoint(consolidated(signals, skill, stored_memory or "{}", memory_version, responses, batch_size))
        fired = folded["memory"].select(F.concat(F.lit(f"{skill.name}#"), "batch").alias("url"))
        trace = trace.union(event(fired, "consolidation_fired")).union(event(spark.createDataFrame([(skill.name,)] * was_warmed, "url string"), "warmup_complete"))
    return folded | {
        "records": final.select("url", "rec_idx", "record_json").union(old),
        "results": results.select(
            "url", "status", "tier_used", "confidence", F.when(over, F.size("carried")).otherwise(F.col("n_records")).cast("long").alias("n_records"),
            F.when(over, skill.carry_days).otherwise(0).alias("carry_forward_days"), "llm_cost_usd", "errors", "reason",
        ),
        "dead_letters": bounded_queue(results.where("status = 'FAILED'").select("url", F.try_element_at("errors", F.lit(1)).alias("error")), order=("url",)),
        "links": links, "apis": apis, "candidates": crawl_candidates(links), "external": ranked.select("url", "ranked_external_links"), "signals": signals,
        "profiles": learning.record_success(fetched.select("url", "n_records", "confidence", "latency_ms", "at")),
        "mappings": learning.crystallize(known, learned),
        "blocked": noisy.select("url", F.array_distinct(F.concat("blocked", F.filter("misleading", lambda x: x != ""))).alias("blocked")),
        "triggers": learning.triggers(pending, learning.new_platforms(signals, spark.createDataFrame([], "skill string, platform string")), ended=True),
        "ledger": ledger, "trace": trace_rows(trace),
    }
