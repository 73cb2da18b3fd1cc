"""Model responses are an input table (stage, url, content, cost_usd, error): parsed here, never asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGNAL = "improvement_signal struct<platform_observed:string,free_text_observation:string,misleading_patterns:array<string>,confidence:double,api_patterns_that_worked:array<string>>"
DISCOVERY = f"ranked_apis array<string>, ranked_links array<string>, platform_guess string, navigation_hint string, {_SIGNAL}"
EXTERNAL = f"ranked_external_links array<string>, {_SIGNAL}"
EXTRACTION = f"records array<string>, platform string, platform_confirmed string, confidence double, field_mappings string, field_mapping_notes string, {_SIGNAL}"


def join_responses(rows: DataFrame, responses: DataFrame, stage: str) -> DataFrame:
    """The stage's response of each url: content, cost_usd, error."""
    return rows.join(responses.where(F.col("stage") == stage).select("url", "content", "cost_usd", "error"), "url", "left")


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    good = F.when(F.col("error").isNull(), F.col("content"))
    bad = F.col("error").isNull() & F.try_parse_json("content").isNull()
    rows = rows.withColumn("answered", F.coalesce(F.col("content").isNotNull() & ~bad, F.lit(False)))
    return rows.withColumn("d", F.from_json(good, schema)).withColumn("error", F.when(bad, "invalid_json").otherwise(F.col("error"))).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))


def _or_first(text: Column, items: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.try_element_at(items, F.lit(1)), F.lit(""))


def parse_discovery(rows: DataFrame) -> DataFrame:
    s = F.col("d.improvement_signal")
    none = F.array().cast("array<string>")
    return _parsed(rows, DISCOVERY).select(
        "url", F.coalesce("d.ranked_apis", none).alias("ranked_apis"), F.coalesce("d.ranked_links", none).alias("ranked_links"), F.col("d.platform_guess").alias("platform_guess"),
        F.coalesce("d.navigation_hint", F.lit("")).alias("navigation_hint"), F.lit("discovery").alias("signal_type"), F.coalesce(F.nullif(s["platform_observed"], F.lit("")), F.col("d.platform_guess")).alias("platform"),
        _or_first(s["free_text_observation"], s["misleading_patterns"]).alias("hint"), F.coalesce(s["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(s["misleading_patterns"], none).alias("misleading"), "cost_usd", "error", "answered",
    )


def parse_external(rows: DataFrame) -> DataFrame:
    s = F.col("d.improvement_signal")
    return _parsed(rows, EXTERNAL).select(
        "url", F.coalesce("d.ranked_external_links", F.array().cast("array<string>")).alias("ranked_external_links"), F.lit("external_rank").alias("signal_type"),
        F.coalesce(F.try_element_at(s["misleading_patterns"], F.lit(1)), s["free_text_observation"], F.lit("")).alias("hint"), F.coalesce(s["confidence"], F.lit(0.5)).alias("confidence"), "cost_usd", "error", "answered",
    )


def parse_extraction(rows: DataFrame) -> DataFrame:
    """Records as JSON texts; confidence: the records' mean, or the response's own where no record has one."""
    s, own = F.col("d.improvement_signal"), F.coalesce("d.confidence", F.lit(0.0))
    records = F.coalesce("d.records", F.array().cast("array<string>"))
    each = F.transform(F.filter(records, lambda r: r.startswith("{")), lambda r: F.coalesce(F.get_json_object(r, "$.confidence").cast("double"), F.lit(0.0)))
    mean = F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)).otherwise(own)
    return _parsed(rows, EXTRACTION).select(
        "url", records.alias("records"), mean.alias("confidence"), F.coalesce(F.nullif("d.platform_confirmed", F.lit("")), F.col("d.platform")).alias("platform"), F.col("d.field_mappings").alias("field_mappings"),
        F.coalesce("d.field_mapping_notes", F.lit("")).alias("note"), F.lit("extraction").alias("signal_type"), _or_first(F.try_element_at(s["api_patterns_that_worked"], F.lit(1)), F.array(s["free_text_observation"])).alias("hint"),
        F.coalesce(s["confidence"], F.nullif(mean, F.lit(0.0)), F.lit(0.5)).alias("signal_confidence"), "cost_usd", "error", "answered",
    )


def needs_external(rows: DataFrame, depth: int) -> DataFrame:
    """(url, links, missing) for which outside links are ranked: depth allows, links are there, a field is missing."""
    return rows.where(F.lit(depth > 0) & (F.size("links") > 0) & (F.size("missing") > 0))
