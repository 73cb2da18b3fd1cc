"""Answers by the names that a template asks for are what its parser reads."""

import json
import re

from pyspark.sql import functions as F

from pagewright.operators import memory as Y
from pagewright.operators import prompts as M
from pagewright.operators import records as R
from pagewright.operators import responses as A
from pagewright.sources.stores import TEMPLATES


def names(stage):
    return re.findall(r"[a-z0-9_]+", TEMPLATES[stage].split("Answer with JSON: ")[1])


def answered(spark, stage, content):
    return spark.createDataFrame([(stage, "u", json.dumps(content), 0.5, None)], "stage string, url string, content string, cost_usd double, error string")


def test_merge_by_the_templates_names(spark):
    whole, index, target, merge = (n for n in names("merge") if n in ("merge_decisions", "new_record_index", "existing_record_id", "merge"))
    rows = lambda *r: spark.createDataFrame([("u", i, json.dumps(x)) for i, x in enumerate(r)], "url string, rec_idx int, record_json string")
    old, new = rows({"id": "A", "x": 1}), rows({"id": "A", "x": 2}, {"id": "B"})
    said = answered(spark, "merge", {whole: [{index: 0, target: "A", merge: True}, {index: 1, target: None, merge: False}]})
    got = R.merge_answers(old, new, said, "id").orderBy("rec_idx").collect()
    assert [json.loads(r["record_json"]) for r in got] == [{"id": "A", "x": 2}, {"id": "B"}]


def test_discovery_extraction_and_external_by_the_templates_names(spark):
    page = spark.createDataFrame([("u",)], "url string")
    values = {"ranked_apis": ["/a"], "ranked_links": ["/l"], "platform_guess": "wp", "navigation_hint": "n", "improvement_signal": {"free_text_observation": "seen"}}
    assert set(values) == set(names("discovery"))
    got = A.parse_discovery(A.join_responses(page, answered(spark, "discovery", values), "discovery")).first()
    assert (got["ranked_apis"], got["ranked_links"], got["platform"], got["navigation_hint"], got["hint"]) == (["/a"], ["/l"], "wp", "n", "seen")
    values = {"records": [{"a": 1}], "confidence": 0.5, "field_mappings": {"dom": {}}, "field_mapping_notes": "note", "platform": "wix", "improvement_signal": {"free_text_observation": "seen"}}
    assert set(values) == set(names("extraction"))
    got = A.parse_extraction(A.join_responses(page, answered(spark, "extraction", values), "extraction")).first()
    assert (len(got["records"]), got["platform"], got["note"], json.loads(got["field_mappings"])) == (1, "wix", "note", {"dom": {}})
    assert set(names("external_rank")) == {"ranked_external_links", "improvement_signal"}


def test_warm_up_by_the_templates_names(spark):
    values = {n: ["x"] if n in Y.KINDS and Y.KINDS[n] == "list" else {"k": "v"} if Y.KINDS[n] == "map" else "t" for n in names("warmup")}
    assert set(values) == set(Y.KINDS)
    said = spark.createDataFrame([("s", json.dumps(values), 0.1, None)], "skill string, content string, cost_usd double, error string")
    got = json.loads(Y.warm(spark.createDataFrame([("s", "1", None)], "skill string, version string, memory string"), said).first()["memory"])
    assert {k: got[k] for k in values} == values


def test_requests_are_bounded_and_filled(spark):
    rows = spark.range(130).select(F.lit("u").alias("url"), F.col("id").alias("rec_idx"), F.concat(F.lit("{"), "id", F.lit("}")).alias("record_json"))
    got = M.merge_requests(rows, rows.union(rows.withColumn("url", F.lit("v"))), "id").collect()
    assert [r["url"] for r in got] == ["u"] and got[0]["prompt"].count("{49}") == 2 and "{50}" not in got[0]["prompt"]
    shared = M.shared_parts("task", ("name",), ("ads",), ("x",), "m", {"prompt2_context": "c2"})
    page = spark.createDataFrame([("u", "text"), ("v", None)], "url string, markdown string")
    links = page.select("url", F.lit(0).alias("pos"), F.lit("l").alias("link"), F.lit("a").alias("api_url"))
    missing = spark.createDataFrame([("u", ["name"]), ("v", [])], "url string, missing array<string>")
    signals = spark.createDataFrame([("s", i, "discovery", "h", "wp", 0.9) for i in range(7)], "skill string, seq long, signal_type string, hint string, platform string, confidence double")
    memories = spark.createDataFrame([("s", "{}")], "skill string, memory string")
    made = [M.extraction_requests(page, shared), M.discovery_requests(page, links, links, shared), M.external_requests(missing, rows, links, shared), M.consolidation_requests(memories, signals, 3)]
    assert [m.count() for m in made] == [2, 2, 1, 3]
    assert all(not re.search(r"\{[a-z_0-9]+\}", r["prompt"]) or "{0}" in r["prompt"] for m in made for r in m.collect())
    assert "130 record(s); sample: [{0}, {1}, {2}]" in made[2].first()["prompt"]


def test_discovery_requests_of_pages_with_one_url(spark):
    p = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "page_id long, url string")
    links = p.select("page_id", F.lit(0).alias("pos"), F.concat(F.lit("l"), "page_id").alias("link"), F.lit("a").alias("api_url"))
    got = M.discovery_requests(p, links, links.limit(0), M.shared_parts("task"), page="page_id").collect()
    assert sorted((r["url"], re.findall(r"\bl\d", r["prompt"])) for r in got) == [("u", ["l1"]), ("u", ["l2"]), ("v", ["l3"])]
