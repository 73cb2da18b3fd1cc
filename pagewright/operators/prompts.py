"""Requests to a model, rendered from a run's tables: (stage, url, prompt). Nothing is sent; answers come back as a table.

What is listed in a request is bounded there: SLICE records of either side of a merge, 50 links and 25 endpoints of a page, 25 outside
links, a batch of signals. The first ones in order are kept, by a rank that Spark prunes before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import fill_template, render_keywords
from pagewright.operators import learning
from pagewright.sources.stores import TEMPLATES

#: Records of each side that a merge request shows.
SLICE = 50


def _first(rows: DataFrame, by: str, order: Sequence[str], most: int, value: Column, name: str) -> DataFrame:
    """The first values of each key, in order, as a list."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    kept = rows.withColumn("__nth", nth).where(F.col("__nth") <= most)
    return kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", value.alias("v")))), lambda x: x["v"]).alias(name))


def _lines(values: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(values, "\n"), F.lit("")), F.lit("(none)"))


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.coalesce(values, F.array().cast("array<string>")), ", "), F.lit("]"))


def _rendered(rows: DataFrame, stage: str, parts: dict[str, Column], key: str = "url") -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), F.col(key).alias("url"), fill_template(TEMPLATES[stage], parts).alias("prompt"))


def shared_parts(instructions: str = "", fields: Sequence[str] = (), negative: Sequence[str] = (), noise: Sequence[str] = (), metadata: str = "(none provided)", contexts: dict[str, str] | None = None) -> dict[str, Column]:
    """What all requests of a skill share."""
    words = lambda x: render_keywords(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))
    named = {f"prompt{n}_context": F.lit((contexts or {}).get(f"prompt{n}_context") or "(nothing yet)") for n in (1, 2, 4)}
    return {"general_instructions": F.lit(instructions), "output_fields": words(fields), "negative_keywords": words(negative), "noise": words(noise), "metadata": F.lit(metadata), **named}


def merge_requests(existing: DataFrame, new: DataFrame, primary_key: str = "", limit: int = SLICE) -> DataFrame:
    """(url, rec_idx, record_json) twice -> a request for each url with records on both sides, showing the first `limit` of each."""
    old = _first(existing, "url", ["rec_idx"], limit, F.col("record_json"), "old")
    fresh = _first(new, "url", ["rec_idx"], limit, F.col("record_json"), "fresh")
    return _rendered(old.join(fresh, "url"), "merge", {"primary_key": F.lit(primary_key or "(none)"), "existing": _json_list(F.col("old")), "new": _json_list(F.col("fresh"))})


def discovery_requests(pages: DataFrame, links: DataFrame, apis: DataFrame, shared: dict[str, Column], page: str = "url") -> DataFrame:
    """(url), (url, pos, link), (url, pos, api_url) -> a request for each page. Where pages repeat a url, all three have `page`, which tells them apart."""
    rows = pages.select(*{"url": 0, page: 0}).distinct().join(_first(links, page, ["pos"], 50, F.col("link"), "links"), page, "left").join(_first(apis, page, ["pos"], 25, F.col("api_url"), "apis"), page, "left")
    return _rendered(rows, "discovery", {**shared, "url": F.col("url"), "apis": _lines(F.col("apis")), "links": _lines(F.col("links"))})


def extraction_requests(pages: DataFrame, shared: dict[str, Column]) -> DataFrame:
    """(url, markdown) -> a request for each page."""
    return _rendered(pages, "extraction", {**shared, "url": F.col("url"), "markdown": F.coalesce("markdown", F.lit(""))})


def external_requests(missing: DataFrame, records: DataFrame, links: DataFrame, shared: dict[str, Column]) -> DataFrame:
    """(url, missing array), (url, rec_idx, record_json), (url, pos, link) -> a request for each url that lacks a field and has links."""
    lacking = missing.where(F.size("missing") > 0).join(_first(links, "url", ["pos"], 25, F.col("link"), "links"), "url")
    rows = lacking.join(_first(records, "url", ["rec_idx"], 3, F.col("record_json"), "shown"), "url", "left").join(records.groupBy("url").agg(F.count("*").alias("n")), "url", "left")
    said = F.when(F.coalesce("n", F.lit(0)) == 0, "(no records)").otherwise(F.concat("n", F.lit(" record(s); sample: "), _json_list(F.col("shown"))))
    return _rendered(rows, "external_rank", {**shared, "url": F.col("url"), "missing": render_keywords(F.col("missing")), "records": said, "links": _lines(F.col("links"))})


def consolidation_requests(memories: DataFrame, signals: DataFrame, batch_size: int = learning.BATCH_SIZE) -> DataFrame:
    """(skill, memory), (skill, seq, signal_type, hint, platform, confidence) -> a request for each batch of signals, its url skill#batch."""
    rows = learning.batches(signals, batch_size).withColumn("__of", F.concat("skill", F.lit("#"), "batch"))
    said = F.to_json(F.struct("signal_type", "hint", "platform"))
    lists = rows.groupBy("__of", "skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", said.alias("v")))), lambda x: x["v"]).alias("signals"))  # batch_size at most
    stats = learning.batch_stats(rows, ["__of"])
    both = lists.join(stats, "__of").join(memories.select("skill", "memory"), "skill")
    parts = {"current_memory": F.col("memory"), "signal_count": F.col("n").cast("string"), "success_count": F.col("successes").cast("string"), "signals": _json_list(F.col("signals")), "platforms_seen": render_keywords(F.col("platforms"))}
    return _rendered(both, "consolidation", parts, "__of")
