from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import clusters as C
from pagewright.operators import learning as L


def profiles(seed, n, domains):
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    rows = [(f"https://d{r.integers(domains)}/{i}", pick(None, "wp", "wix", "x"), pick(None, [], ["/a"], ["/a", "/b"], ["/b", "/a"], ["/c"]), pick("COLD", "WARM", "STABLE"), i) for i in range(n)]
    return rows + rows[:5] + [(None, "wp", None, "COLD", 900), ("", None, None, "COLD", 901)]


SCHEMA = "url_pattern string, platform string, confirmed_patterns array<string>, maturity string, pos int"


def pairs(rows):
    sig = lambda x: "|".join(sorted(x)) if x else None
    side = [(u, u.split("/")[2] if "//" in u else u, p, sig(s)) for u, p, s, _, _ in rows if u is not None]
    free = lambda a, b: a is None or b is None or a == b
    return [(a[0], b[0]) for a in side for b in side if a[1] == b[1] and a[0] != b[0] and free(a[2], b[2]) and free(a[3], b[3])]


@pytest.mark.parametrize(("seed", "domains"), [(1, 1), (2, 9)])
def test_classes_say_what_pairs_say(spark, seed, domains):
    rows = profiles(seed, 60, domains)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sig", F.lit("x")).repartition(3)
    assert Counter(map(tuple, C.find_clusters(df, df).collect())) == Counter(pairs(rows))
    counted, _ = C.cluster_membership(df)
    times = Counter(r[0] for r in rows)
    want = Counter(a for a, _ in pairs(rows))
    assert {r["url_pattern"]: r["n_links"] * times[r["url_pattern"]] for r in counted.collect()} == {u: want[u] for u in times if u is not None}
    rank = {"STABLE": 3, "WARM": 2, "COLD": 0}
    best = {u: (-rank[m], pos) for u, _, _, m, pos in reversed(rows)}
    near = {}
    for a, b in pairs(rows):
        near.setdefault(a, set()).add((*best[b], b))
    assert {r["target"]: r["donor"] for r in L.all_donors(df).collect()} == {a: min(x)[2] for a, x in near.items()}


def test_one_domain_stays_linear(spark):
    """4,000 profiles of one domain have some 16 million pairs and 12 classes."""
    df = spark.range(4000).select(
        F.concat(F.lit("https://one/"), "id").alias("url_pattern"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("p"), F.col("id") % 4)).alias("platform"),
        F.when(F.col("id") % 3 > 0, F.array(F.concat(F.lit("/"), F.col("id") % 3))).otherwise(F.array().cast("array<string>")).alias("confirmed_patterns"), F.lit("COLD").alias("maturity"), F.col("id").cast("int").alias("pos"),
    )
    counted, links = C.cluster_membership(df)
    assert counted.count() == 4000 and links.count() < 12 * 12
    assert L.all_donors(df).where("target = 'https://one/0'").first()["donor"] == "https://one/1"
    assert {r["platform"]: (r["n_members"], r["n"]) for r in C.similar_counts(df).collect()} == {f"p{i}": (1000, 999000) for i in (1, 2, 3)}


def test_matches_stay_one_row_for_each_profile(spark):
    rows = profiles(3, 60, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    class_of = {(u, u.split("/")[2] if "//" in u else u, p, "|".join(sorted(s)) if s else None) for u, p, s, _, _ in rows if u is not None}
    times, links = Counter(r[0] for r in rows), Counter(a for a, _ in pairs(rows))
    want = {(u, min(x[0] for x in class_of if x[1:] == c), links[u] // times[u]) for u, *c in class_of for c in [tuple(c)] if links[u]}
    got = C.matched(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
