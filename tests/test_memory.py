"""Memories in DataFrames against the same rules on dictionaries, one answer after another."""

import json

import numpy as np
import pytest

from pagewright.operators import learning as L
from pagewright.operators import memory as Y


def answer(r):
    if r.random() < 0.1:
        return str(r.choice(["nonsense", "[1]", "", "null"]))
    out = {"summary": f"s{r.integers(9)}"} if r.random() < 0.7 else {}
    for name in r.permutation([*L.MEMORY_LISTS, *L.MEMORY_MAPS, *L.MEMORY_TEXTS]):
        if r.random() < 0.2:
            kind = L.MEMORY_LISTS if name in L.MEMORY_LISTS else L.MEMORY_MAPS if name in L.MEMORY_MAPS else None
            values = ([], ["a", "é\"\\"], ["ads", 1, None], None) if kind is L.MEMORY_LISTS else ({}, {"k\"": "v", "n": [1, 2]}, None) if kind else ("", "wise \"\n", None)
            out[str(name)] = values[r.integers(len(values))]
    return json.dumps(out, ensure_ascii=bool(r.random() < 0.5))


@pytest.mark.parametrize("skills", [1, 4])
def test_consolidation_in_any_number_of_batches(spark, skills):
    r = np.random.default_rng(skills)
    n = 90
    signals = [(f"s{r.integers(skills)}", i) for i in range(n)]
    memories = {f"s{k}": {"x": 1, "navigation_wisdom": "old", "known_noise_patterns": ["ads"], "y": None} if k % 2 == 0 else {} for k in range(skills)}
    answers = [(s, b, None if r.random() < 0.1 else answer(r), 0.5 if r.random() < 0.8 else None, "timeout" if r.random() < 0.1 else "" if r.random() < 0.5 else None) for s in memories for b in range(30) if r.random() < 0.9]
    said = {(s, b): (c, k, e) for s, b, c, k, e in answers}
    want = {}
    for s, memory in memories.items():
        count = sum(x[0] == s for x in signals)
        for b in range(-(-count // 4)):
            content, cost, error = said.get((s, b), (None, None, None))
            try:
                found = None if error else json.loads(content)
            except (TypeError, ValueError):
                found = None
            memory = L.updated_memory(memory, found, ["admin", "ads", ""])
            summary = str(found.get("summary", "")) if isinstance(found, dict) else ""
            want[s, b] = (3 + b, 4 + b, min(4, count - 4 * b), cost or 0.0, summary, memory)
    got = Y.consolidate(
        spark.createDataFrame([(s, 3, json.dumps(m)) for s, m in memories.items()], "skill string, version int, memory string"), spark.createDataFrame(signals, "skill string, seq long").repartition(3),
        spark.createDataFrame(answers, "skill string, batch long, content string, cost_usd double, error string"), ["admin", "ads", ""], 4,
    )
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(x["skill"], x["batch"]): (*[x[c] for c in ("version_before", "version_after", "signal_count", "cost_usd", "summary")], json.loads(x["memory"])) for x in got.collect()}
    assert found == want


def test_warm_up_and_staleness(spark):
    r = np.random.default_rng(7)
    kept = {**L.new_memory("a", "1"), "high_confidence_api_patterns": ["/k"]}
    memories = [("a", "1", json.dumps(kept)), ("a2", "2", json.dumps({**kept})), ("b", "1", None), ("c", "1", "nonsense"), ("d", "1", None), ("none", "1", None)] + [(f"x{i}", "1", None) for i in range(20)]
    answers = [("a", "{}", 0.2, None), ("a2", '{"api_patterns": ["/z"], "field_hints": {"f": "h"}, "prompt1_context": null}', 0.25, None), ("b", '{"known_noise_patterns": ["no"]}', 0.5, "timeout"), ("c", "[]", None, ""), ("d", None, 0.1, None)] + [(f"x{i}", answer(r), 0.5, None) for i in range(20)]
    by = {a[0]: dict(zip(("content", "cost_usd", "error"), a[1:], strict=True)) for a in answers}
    got = Y.warm(spark.createDataFrame(memories, "skill string, version string, memory string"), spark.createDataFrame(answers, "skill string, content string, cost_usd double, error string"), ["no", "no"])
    for row in got.collect():
        old = next((json.loads(m) if m and m[0] == "{" else None) for s, _, m in memories if s == row["skill"])
        assert json.loads(row["memory"]) == L.warm_up(old, row["skill"], row["version"], by.get(row["skill"]), ["no", "no"]), row
        assert row["warmed"] == L.is_stale(old, row["skill"], row["version"])


def test_parts_of_a_schema(spark):
    memory = {"confirmed_field_synonyms": {"a": ["b"], "x": []}, "field_extraction_hints": {"x": "h", "z": "i"}}
    df = spark.createDataFrame([("s", json.dumps(memory)), ("t", "{}"), ("u", None)], "skill string, memory string")
    assert sorted(map(tuple, Y.schema_parts(df, ["a", "x", "q"]).collect())) == [("s", "a", ["b"], ""), ("s", "x", [], "h")]
    assert Y.schema_parts(df).count() == 3
