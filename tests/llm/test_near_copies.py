import itertools

import numpy as np

import corpus_pipeline as cp
from pagewright.llm.near_copies import near_copies


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """{id: smallest id reachable} by comparing all pairs."""
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in texts}


def test_edited_copies_at_every_similarity(spark):
    r, texts = np.random.default_rng(5), {}
    notice = [f"notice{i}" for i in range(40)]
    for base in range(12):
        words = [f"w{x}" for x in r.integers(0, 400, int(r.integers(3, 200)))]
        for edits in range(10):
            own = list(words)
            for at in r.integers(0, len(words), edits):
                own[at] = f"x{r.integers(9)}"
            texts[len(texts)] = " ".join(own + (notice if base % 2 else []))
    texts |= {500: None, 501: "", 502: " \n", 503: "One two", 504: "one TWO", 505: texts[3].upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert {x["doc_id"]: x["component_id"] for x in near_copies(df).collect()} == want
    assert len({want[i] for i in range(120)}) not in (12, 120)
    assert near_copies(df.limit(0)).collect() == []


def test_stage_drops_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute({x["doc_id"]: x["text"] for x in docs.collect()})
    assert want[177] == want[1] and want[145] == want[6]  # edited copies that SimHash at 2 bits doesn't link
    assert {x["doc_id"] for x in cp.near_dedup(spark, docs, sf).collect()} == set(want.values())
