from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import proxies as Z
from pagewright.operators import scans

D = Decimal


def outcomes(seed, n, hot):
    r = np.random.default_rng(seed)
    return [(None if r.random() < 0.05 else "hot" if r.random() < hot else f"p{r.integers(3)}", int(i), float(r.choice([0.05, -0.25, -0.05, 0.3, -1.5]))) for i in r.permutation(n)]


def health(rows):
    out = {}
    for proxy, _, delta in sorted(rows, key=lambda x: x[1]):
        h, q = out.get(proxy, (D(1), False))
        h = min(D(1), max(D(0), h + D(str(delta))))
        out[proxy] = h, True if h < D("0.25") else False if h >= D("0.5") else q
    return {p: (float(h), q) for p, (h, q) in out.items()}


@pytest.mark.parametrize(("n", "hot"), [(0, 0), (1, 1), (700, 0.3), (1500, 1)])
def test_health_as_a_scan(spark, n, hot):
    rows = outcomes(n, n, hot)
    df = spark.createDataFrame(rows, "proxy string, seq long, delta double").repartition(5)
    assert {r["proxy"]: (r["health"], r["quarantined"]) for r in Z.proxy_health(df).collect()} == health(rows)


@pytest.mark.parametrize("block", [2, 4])
def test_blocks_of_blocks(spark, block):
    """Many levels; every prefix counts, not only the last."""
    rows = outcomes(3, 90, 0.8)
    df = spark.createDataFrame(rows, "proxy string, seq long, delta double").repartition(4)
    got = scans.running(df, "proxy", ["seq"], Z.clamped(F.col("delta")), Z.then, block=block).withColumn("h", Z.health_after(F.col("scan")))
    for r in got.collect():
        ahead = [x for x in rows if x[0] == r["proxy"] and x[1] <= r["seq"]]
        assert (float(r["h"]), r["place"]) == (health(ahead)[r["proxy"]][0], len(ahead) - 1)


def test_hot_key_fills_many_tasks(spark):
    df = spark.range(20000).select(F.lit("one").alias("proxy"), F.col("id").alias("seq"), F.lit(0.05).alias("delta"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        assert scans.ranged(df, "proxy", ["seq"]).select("__part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = Z.proxy_health(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan and Z.proxy_health(df).first() == ("one", 1.0, False)


@pytest.mark.parametrize(("rate", "burst"), [(1.0, 3), (0.25, 1), (0.0, 0)])
def test_throttling_as_a_running_maximum(spark, rate, burst):
    r = np.random.default_rng(5)
    rows = [("hot" if i % 3 else f"d{i % 5}", i, float(round(r.exponential(40 if i % 50 else 4000) * (i % 7 > 0) + i / 10, 2))) for i in range(400)] + [(None, 400, 1.0), (None, 401, 1.0), ("hot", 402, None)]
    df = spark.createDataFrame(rows, "domain string, seq long, at double").repartition(6)
    want = {402: None}
    for domain in {x[0] for x in rows}:
        own = sorted(((at, seq) for d, seq, at in rows if d == domain and at is not None))
        want |= dict(zip([seq for _, seq in own], Z.throttle_state(None, iter([at for at, _ in own]), rate, burst)[1], strict=True))
    got = Z.rate_limit(df, rate, burst)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {x["seq"]: x["wait"] for x in got.collect()}
    assert found.keys() == want.keys() and all(w is found[k] if w is None else abs(w - found[k]) < 1e-6 for k, w in want.items())


def test_turns_of_a_hot_shard(spark):
    df = spark.range(500).select(F.lit(None).cast("string").alias("shard"), (F.lit(500) - F.col("id")).alias("seq"))
    assert {(r["seq"] - 1) % 3: r["proxy"] for r in Z.round_robin(df, ["a", "b", "c"]).collect()} == {0: "a", 1: "b", 2: "c"}
