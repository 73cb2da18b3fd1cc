import itertools
import zlib

import numpy as np

from pagewright.llm.toxicity import Machine, fit, op4_toxicity, score, terms_of, train


def test_scores_are_the_sum_over_terms_and_pairs():
    r = np.random.default_rng(1)
    m = Machine(0.3, np.arange(6), r.normal(size=6), r.normal(size=(6, 8)))
    rows = [[], [2], [0, 3, 5], [0, 1, 2, 3, 4, 5]]
    want = [1 / (1 + np.exp(-(0.3 + sum(m.weight[i] for i in x) + sum(m.vector[i] @ m.vector[j] for i, j in itertools.combinations(x, 2))))) for x in rows]
    assert np.allclose(m.scores(rows), want)


def test_pairs_are_learned_that_no_sum_of_weights_can_tell():
    rows = [[], [0], [1], [0, 1]] * 50
    labels = [1, 0, 0, 1] * 50  # only together, or neither
    got = fit(rows, labels, np.arange(2), shrink=0).scores([[], [0], [1], [0, 1]])
    assert (got > 0.5).tolist() == [True, False, False, True]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("you utter idiot " if i % 3 == 0 else "a fine day ") + f"n{i}") for i in range(120)] + [(500, None), (501, ""), (None, "idiot"), (502, "idiot " * 50000)], "doc_id long, text string").selectExpr("*", "'z' as y", "0.5 as score")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    m = train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in score(docs, m, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(120)) and got[None] > 0.5 and got[502] > 0.5 and got[500] == got[501] < 0.5
    assert train(docs, labels.limit(0)).scores([[]])[0] < 1e-9
    assert train(docs, labels.where("toxic = 1")).scores([[]])[0] > 0.999
    assert score(docs.limit(0), m, ["doc_id"]).collect() == [] and len(terms_of("ab")) == 1


def test_words_that_tell_only_together(spark):
    """Toxic with both words or neither: each alone is as frequent in either kind."""
    r, rows = np.random.default_rng(3), []
    for i in range(600):
        a, b = i % 2, i // 2 % 2
        words = [f"w{x}" for x in r.integers(0, 300, 12)] + ["quorl"] * a + ["zimby"] * b
        rows.append((i, " ".join(words[:4] + words[12:] + words[4:12]), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    m = train(df.where("doc_id % 5 > 0").select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {x["doc_id"]: x["score"] for x in score(df, m, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i % 5 == 0]) > 0.95


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert len(toxic) >= 5 and np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.03, (len(toxic), np.mean(toxic), np.mean(clean))
