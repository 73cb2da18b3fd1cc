import zlib

import numpy as np

from pagewright.llm import language
from pagewright.llm.language import SEGMENT, Model, automaton, cleaned, identify, op7_language_id, train


def brute_phrases(text, sample):
    """One greedy pass over the whole text."""
    count = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += k
        count += 1
    return count


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcabbabcab"
    moves = automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}

    def walk(state, word):
        for c in word:
            state = moves[state].get(c, -1) if state >= 0 else -1
        return state >= 0

    assert all(walk(0, s) for s in subs)
    assert not any(walk(0, s + bytes([c])) for s in subs for c in b"abcx" if s + bytes([c]) not in subs)


def test_phrases_agree_with_brute_force(monkeypatch):
    monkeypatch.setattr(language, "GROUP", 2 * SEGMENT)
    r = np.random.default_rng(2)
    samples = {k: bytes(r.choice(list(b"abc d"), 400)) for k in "xyz"}
    texts = [bytes(r.choice(list(b"abc dq"), int(n))) for n in (1, 2, 255, 256, 257, 1500, 40, 513, 512)]
    texts += [samples["x"], samples["y"] * 5, samples["x"][:300] + samples["z"] * 3, b"q" * 700]  # phrases longer than a segment
    got = Model(samples).phrases(texts)
    assert got.tolist() == [[brute_phrases(t, samples[k]) for k in "xyz"] for t in texts]


def test_train_takes_whole_texts(spark):
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * (1 + i % 90), "en") for i in range(300)] + [(900, "lang " * 9000, "xx"), (901, "lung " * 8000, "xx"), (902, None, "yy"), (903, "x", None), (904, "12", "zz")]
    got = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert sorted(got) == ["en", "xx"] and got["xx"] == cleaned("lung " * 8000)  # only longer texts: the shortest, whole
    assert language.SAMPLE_BYTES * 0.8 < len(got["en"]) <= language.SAMPLE_BYTES
    lengths = {cleaned(t).split()[0]: len(t.split()) for _, t, x in rows if x == "en"}
    words = got["en"].split()
    assert all(words.count(w) == lengths[w] for w in set(words)) and len(set(words)) > 20


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 -- 😀 ½", "b"), (None, "hello there", None), (5, "hola hola", "b"), (5, "hola hola", "b"), (6, "ÉTÉ " * 70000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "1 as lang_pred")
    samples = {"en": b"hello there my friend", "es": b"hola amigo"}
    got = sorted((r["doc_id"] or 0, r["lang_pred"], round(r["score"], 3)) for r in identify(df, samples, ["doc_id"]).collect())
    assert got[:4] == [(0, "en", got[0][2]), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[4][1] == got[5][1] == "es"
    assert {r["lang_pred"] for r in identify(df, {}, ["doc_id"]).collect()} == {"und"}
    assert identify(df.limit(0), samples, ["doc_id"]).collect() == [] and train(df.limit(0)) == {}
    assert cleaned("Ça,va 12 BIEN_") == "ça va bien".encode()


def test_query_and_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_no_language_is_lost(spark):
    """Long texts beside a short one without a letter; many tiny texts fill a sample."""
    from pagewright.llm import language as L

    rows = [(i, "palavra " * 1500, "xx") for i in range(20)] + [(20, "12 34", "xx"), (21, "!", "zz")]
    rows += [(100 + i, f"ab{chr(97 + i % 26)}c{chr(97 + i // 26 % 26)}de", "yy") for i in range(20_000)]
    samples = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert samples.keys() == {"xx", "yy"} and b"palavra" in samples["xx"]
    assert L.SAMPLE_BYTES * 0.9 < len(samples["yy"]) <= L.SAMPLE_BYTES
