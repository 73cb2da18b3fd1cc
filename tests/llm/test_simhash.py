import itertools

import numpy as np
import xxhash

from pagewright.llm.components import components
from pagewright.llm.simhash import covering_masks, fingerprints, links, near_duplicates, op9_simhash_dedup


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{index: smallest index reachable}, by comparing all fingerprints."""
    x = np.array(prints, np.uint64)
    label = list(range(len(x)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    return [root(i) for i in range(len(x))]


def test_masks_cover_every_pair_of_bits():
    masks = covering_masks()
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m & (1 << a | 1 << b) for m in masks)


def test_crowds_and_chains(spark):
    r = np.random.default_rng(3)
    centre, out = int(r.integers(1 << 63)), []
    for k in range(150):
        x = centre
        for b in r.integers(0, 64, k % 6):
            x ^= 1 << int(b)
        out.append(x)
    chain = 0
    for b in range(0, 60, 2):
        out.append(chain)
        chain ^= 3 << b
    out += [int(v) for v in r.integers(1 << 63, size=100)] + [(1 << 64) - 1, (1 << 64) - 2, out[0]]
    df = spark.createDataFrame([(i, int(np.array(x, np.uint64).view(np.int64))) for i, x in enumerate(out)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(out))] == brute_components(out)
    assert links(df.select("fp").limit(0)).count() == 0


def test_components_of_a_path_and_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(path).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert components(path.limit(0)).collect() == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (None, "one TWO"), (6, "x " * 40000), (6, "x " * 40000), (8, "Ünï cödé É words"), (9, "a\x0bb\x0cc d\x1ce")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = fingerprints(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64) for r in got) == sorted((a is None, a or 0, brute_print(t)) for a, t in rows)
    found = {(r["doc_id"], r["component_id"]) for r in near_duplicates(fingerprints(df)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (6, 6)} <= found
    assert near_duplicates(fingerprints(df.limit(0))).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(d["text"]) for d in docs]
    roots = brute_components(prints)
    want = {(d["doc_id"], f"{p:016x}", docs[r]["doc_id"]) for d, p, r in zip(docs, prints, roots)}
    assert {tuple(r) for r in op9_simhash_dedup(spark, sf).collect()} == want
