import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.functions.predicates import contains_any
from pagewright.operators import discovery as D
from pagewright.operators import keywords as K


@pytest.mark.parametrize("segment", [1024, 3])
def test_automaton_against_substring_tests(monkeypatch, segment):
    monkeypatch.setattr(P, "SEGMENT", segment)
    r = np.random.default_rng(segment)
    for _ in range(20):
        needles = ["".join(r.choice(list("abcé"), int(r.integers(0, 6)))) for _ in range(int(r.integers(0, 40)))]
        texts = ["".join(r.choice(list("abcéx"), int(r.integers(0, 40)))) for _ in range(30)] + [None, ""]
        data, offsets = P.text_bytes(pa.array(texts, pa.string()))
        text, number = P.Automaton([n.encode() for n in needles]).matches(data, offsets)
        want = [(i, k) for i, t in enumerate(texts) for k, n in enumerate(needles) if t and n and n in t]
        assert list(zip(text.tolist(), number.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [200_000, 40])
def test_table_of_keywords(spark, monkeypatch, most):
    monkeypatch.setattr(K, "AUTOMATON_BYTES", most)
    texts = [(1, "Straße AND path"), (2, None), (3, ""), (None, "and"), (3, "pathpath"), (3, "pathpath")]
    words = ["AND", "path", "hp", "straße", "", None, "nope", "path", "aß"]
    rows = spark.createDataFrame(texts, "id long, body string").withColumn("keyword", F.lit("x"))
    got = K.keyword_hits(rows, spark.createDataFrame([(w,) for w in words], "keyword string"), "id", "body").collect()
    low = {w.lower() for w in words if w}
    assert sorted(map(tuple, got), key=str) == sorted(((i, w) for i, t in texts for w in low if t and w in t.lower()), key=str)
    assert K.keyword_hits(rows, spark.createDataFrame([], "keyword string"), "id", "body").collect() == []


@pytest.mark.parametrize("bits", [20, 6])
def test_large_table_is_one_pass(spark, monkeypatch, bits):
    """Also where most candidates of a full bitmap are false, and texts are longer than the places walked at a time."""
    monkeypatch.setattr(K, "AUTOMATON_BYTES", 40)
    monkeypatch.setattr(K, "TRIE_BITS", bits)
    monkeypatch.setattr(K, "PLACES", 7)
    monkeypatch.setattr(K, "RUN", 50)
    r = np.random.default_rng(bits)
    words = sorted({"".join(r.choice(list("abcé漢"), int(r.integers(1, 7)))) for _ in range(400)})
    texts = ["".join(r.choice(list("abcéx漢"), int(r.integers(0, 60)))) for _ in range(40)] + [None, "", "漢" * 50]
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id int, body string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = K.keyword_hits(rows, table, "id", "body")
    assert sorted(map(tuple, got.collect())) == sorted((i // 2, w) for i, t in enumerate(texts) for w in words if t and w in t)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_plan_does_not_grow_with_keywords(spark):
    rows = spark.createDataFrame([("Some Text",), (None,), ("other",)], "t string")
    few, many = [f"w{i}" for i in range(40)], [f"w{i}" for i in range(10_000)] + ["TEXT"]
    plans = [rows.select(contains_any(F.col("t"), n).alias("hit"))._jdf.queryExecution().executedPlan().toString() for n in (few, many)]
    assert abs(len(plans[0]) - len(plans[1])) < 50
    assert [r[0] for r in rows.select(contains_any(F.col("t"), many)).collect()] == [True, None, False]
    assert [r[0] for r in rows.select(contains_any(F.col("t"), ["text"])).collect()] == [True, None, False]


def test_scores_and_first_matches_of_many_keywords(spark, monkeypatch):
    urls = spark.createDataFrame([(f"https://a/{i}/W{i % 7}/w1{i}",) for i in range(40)] + [(None,)], "url string")
    words = [f"w{i}" for i in range(60)] + ["", "w1", "W3"]
    read = lambda: [tuple(r) for r in urls.select(D.score_url(F.col("url"), words, ["w33"]), D._first_match(F.col("url"), words)).collect()]
    many = read()
    monkeypatch.setattr(D, "MANY", 10**6)
    assert many == read()
