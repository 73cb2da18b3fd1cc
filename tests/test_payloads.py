"""Payloads as Variant against the same rules on Python values."""

import json

import numpy as np
from pyspark.sql import functions as F

from pagewright.functions import json_records as J
from pagewright.operators import payloads as V


def value(r, depth=0):
    k = r.integers(8) if depth < 4 else r.integers(5)
    if k < 5:
        return [None, 3, "te\"xt", True, 1.5][k]
    if k < 6:
        return [value(r, depth + 1) for _ in range(r.integers(0, 4))]
    return {str(r.choice(["a", "b", "0", "x y", "é"])): value(r, depth + 1) for _ in range(r.integers(0, 4))}


def path(r):
    return "".join(str(r.choice(["a", "b", "0", "x y", "é", "[0]", "[1]", "7"])) + str(r.choice([".", "/", ""])) for _ in range(r.integers(0, 5)))


def test_walks(spark):
    r = np.random.default_rng(2)
    rows = [(i, json.dumps(value(r)), path(r)) for i in range(600)] + [(600, "nope", "a"), (601, None, "a"), (602, "[1]", None)]
    got = spark.createDataFrame(rows, "i long, body string, path string").select("i", F.to_json(V.walk(V.parsed(F.col("body")), F.col("path"))).alias("v"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for i, v in got.collect():
        want = J.walk(J.parse(rows[i][1]), rows[i][2])
        assert (json.loads(v) if v is not None else None) == want, rows[i]


def test_envelopes_and_fields(spark):
    bodies = [
        '{"meta": [1], "z": [{"n": 1, "p": {"q": [5]}}, {"x": 2}], "a": [{"n": 9}]}', '[{"n": 1}, 5, {"n": null}]', '{"n": 3}', '{"data": {"rows": [{"n": 4}]}}', '{"data": {"rows": {"n": 6}}}', '{"data": {"rows": 7}}', "broken", None, "7",
    ]
    for envelope in (None, "data.rows", ""):
        rows = [(f"u{i}", "/api", b) for i, b in enumerate(bodies)]
        maps = [(f"u{i}", "/api", f, p, envelope) for i in range(len(bodies)) for f, p in (("name", "n"), ("deep", "p.q[0]"), ("none", ""))] + [("u0", "/other", "name", "n", None)]
        got = V.endpoint_records(spark.createDataFrame(rows, "url string, pattern string, body string"), spark.createDataFrame(maps, "url string, pattern string, field string, path string, envelope string"))
        found = {}
        for r in got.orderBy("url", "item").collect():
            found.setdefault(r["url"], []).append({k: json.loads(v) for k, v in r["record"].items()})
        want = {u: x for u, _, b in rows if J.parse(b) is not None and (x := J.project(J.unwrap(J.parse(b), envelope), {"name": "n", "deep": "p.q[0]"}))}
        assert found == want, envelope
