import math
import re
import zlib
from hashlib import md5

import numpy as np
import public_tokenizers as P
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pagewright.llm.language import Model, cleaned, train
from pagewright.llm.mixing import share_targets
from test_near_copies import brute as brute_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile(r"[^\W_]+")


def shingles(text):
    w = RUN.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, benchmark, samples):
    """Plain Python for run(): rows in, (doc_id, start, n_tokens, crc) out."""
    model, kept = Model(samples), []
    for d in docs:
        t = cleaned(d["text"])
        if t:
            phrases = model.phrases([t])[0]
            best, second = sorted(phrases * model.cost)[:2]
            n = phrases[(phrases * model.cost).argmin()]
            if not (len(t) >= cp.LETTERS and (len(t) < cp.PHRASE * n or 1 - best / second < cp.MARGIN)):
                kept.append(d)
    roots = brute_groups({d["doc_id"]: d["text"] for d in kept})
    kept = [d for d in kept if roots[d["doc_id"]] == d["doc_id"]]
    items = [s for s in (shingles(b["text"]) for b in benchmark) if s]
    kept = [d for d in kept if not any(5 * len(s & own) >= 4 * len(s) for own in [shingles(d["text"])] for s in items)]
    sources = sorted({d["source"] for d in kept}, key=lambda s: (s is None, s or ""))
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in kept}
    sums = [sum(size[d["doc_id"]] for d in kept if d["source"] == s) for s in sources]
    targets = share_targets(sums, [i % 3 + 1 for i in range(len(sources))])
    out = []
    for s, total, target in zip(sources, sums, targets):
        budget = math.floor(target + 0.5)
        own = sorted((d for d in kept if d["source"] == s), key=lambda d: md5(str(d["doc_id"]).encode()).hexdigest())
        while budget > 0 and total:
            for d in own:
                n = min(budget, size[d["doc_id"]])
                budget -= n
                if n:
                    out.append((d["doc_id"], d["text"] if n == size[d["doc_id"]] else " ".join(WORD.findall(d["text"])[:n])))
    t, rows, start = Tokenizer.from_file(P.path(cp.TOKENIZER)), [], 0
    by_hash = lambda x: xxhash.xxh64_intdigest(x, 42) - (1 << 64) * (xxhash.xxh64_intdigest(x, 42) >> 63)
    for doc_id, text in sorted(out, key=lambda x: (x[0], by_hash(x[1]))):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_run_agrees_with_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    samples = train(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(tuple(r) for r in cp.run(spark, sf).collect()) == sorted(brute(docs, benchmark, samples))


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, "hello there my friend", "en", "a", 21), (1, "hello there my friend", "en", "a", 21), (None, None, None, None, None), (2, "", "en", None, 0), (None, "another text of some words", "en", None, 26), (3, "12345 --", None, "b", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema).selectExpr("*", "'x' as __rid", "1 as part"), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            if name != "token_output":
                assert docs.columns == cp.COLUMNS
                docs = spark.createDataFrame(docs.collect(), schema)
    language = cp.language(spark, spark.createDataFrame(rows, schema), sf).collect()
    junk = "x#q zv!k jw?y qk;z vx-j wq*z kz=x jq+v " * 20
    mixed = [(50 + i, t, x, "a", len(t)) for i, (t, x) in enumerate([("the cat sat on the mat and looked at the dog again " * 5, "en"), ("el gato se sienta en la alfombra y mira al perro otra vez " * 5, "es"), (junk, None), ("the dog sat on the mat and looked at the cat again " * 5, None), ("el perro mira al gato y se sienta en la alfombra otra vez " * 5, "en")])]
    said = {r["doc_id"]: r["lang"] for r in cp.language(spark, spark.createDataFrame(mixed, schema), sf).collect()}
    assert said == {50: "en", 51: "es", 53: "en", 54: said[54]}
    assert sorted(r["text"] for r in language) == ["another text of some words", "hello there my friend", "hello there my friend"]
    assert len(cp.near_dedup(spark, spark.createDataFrame(rows, schema), sf).where("doc_id = 1").collect()) == 1
