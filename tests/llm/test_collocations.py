import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import collocations as K
from pagewright.llm import columns


def brute(rows, least, cover=100, top=2000, depth=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for key, a in f.items():
        lang, w = key[0], key[1:]
        if len(w) < 2 or a < least:
            continue
        if any(len(o) > len(key) and o[0] == lang and c >= least and 100 * c >= cover * a and any(o[i : i + len(w)] == w for i in range(1, len(o))) for o, c in f.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    seen = Counter()
    ranked = []
    for x in out:
        seen[x[0]] += 1
        if seen[x[0]] <= top:
            ranked.append((x[0], seen[x[0]], *x[1:]))
    return ranked


def texts(seed, n, words="the of a an New york é ß ﬁ x".split()):
    r = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(words) + 1)
    return [(str(r.choice(["en", "de", "zz"])) if r.random() < 0.9 else None, "".join(str(r.choice(words, p=p / p.sum())) + str(r.choice([" ", "  ", "\t", ", ", ".\n", "!?", "\r\n"], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02])) for _ in range(int(r.integers(0, 60))))) for _ in range(n)]


ODD = [(None, None), ("en", ""), ("en", " .,;\n\t "), ("", "empty lang lang lang"), ("en", "word"), ("en", "\u2028nbsp\u00a0in one word"), ("en", "one two one two one two one two one two " * 30)]


@pytest.mark.parametrize(("n", "cover", "slice_"), [(1, 100, 4 << 20), (7, 100, 4 << 20), (40, 60, 300)])
def test_random_texts(spark, monkeypatch, n, cover, slice_):
    monkeypatch.setattr(columns, "SLICE", slice_)
    monkeypatch.setattr(K, "RANGE_SAMPLE", 5)
    rows = texts(n, 150) + ODD + ODD
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("1L as doc_id", "*", "1 as phrase", "2 as f", "3 as edge").repartition(5)
    got = sorted(map(tuple, K.collocations(docs, 4, cover, top=30, n=n).collect()), key=lambda x: (x[0], x[1]))
    assert got == brute(rows, 4, cover, 30)


def test_long_text_is_cut_between_words(monkeypatch):
    data = np.frombuffer(b"aa b c. dd e " * 40, np.uint8)
    monkeypatch.setattr(columns, "SLICE", 50)
    whole, parts = Counter(), Counter()

    def add(to, paths, counts, words):
        w = [b"", *words.to_pylist()]
        for p, c in zip(paths[1:].T.tolist(), counts.tolist(), strict=True):
            to[tuple(w[x] for x in p)] += c

    add(whole, *K.shard(data, np.array([0, len(data)]), np.array([0]), len(data), 5))
    for part, limit in K._parts(data, 5):
        add(parts, *K.shard(part, np.array([0, len(part)]), np.array([0]), limit, 5))
    assert whole == parts and sum(whole.values()) == 200


def test_runs_are_read_as_written():
    data = np.frombuffer("b a c. a b c. b a d é".encode(), np.uint8)
    paths, counts, words = K.shard(data, np.array([0, 6, len(data)]), np.array([1, 0]), len(data), 5)
    got = K.read(K.written(paths, counts, words, [b"x", "é".encode()]), 5)
    assert (got[0] == paths).all() and (got[1] == counts).all() and got[2].to_pylist() == words.to_pylist() and got[3] == {0: b"x", 1: "é".encode()}


def test_merge_holds_packed_paths():
    """All runs' paths as numbers of 4 bytes beside their keys and the result took 90 bytes a path."""
    import tracemalloc

    r = np.random.default_rng(3)
    words = pa.array([f"{i:03}".encode() for i in range(1000)], pa.large_binary())
    runs = []
    for _ in range(10):
        paths, counts = K.folded(np.concatenate([np.zeros((1, 20_000)), r.integers(1, 1001, (5, 20_000))]).astype(np.int32), None, 1000)
        runs.append(K.written(paths, counts, words, [b"x"]))
    every = [K.read(row, 5) for row in runs]
    want, times = K.folded(np.concatenate([paths for paths, *_ in every], 1), np.concatenate([counts for _, counts, *_ in every]), 1000)
    tracemalloc.start()
    paths, counts, _, _ = K.merged(runs, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(paths, want) and np.array_equal(counts, times) and peak < 75 * paths.shape[1]


def test_runs_are_let_go_as_they_are_merged():
    r = np.random.default_rng(5)
    words = pa.array([f"w{i:03}".encode() for i in range(100)], pa.large_binary())
    runs = []
    for _ in range(30):
        paths = np.concatenate([np.zeros((1, 4000), np.int64), r.integers(1, 101, (5, 4000))]).astype(np.int32)
        runs.append(K.written(*K.folded(paths, None, 100), words, [b"x"]))
    tracemalloc.start()
    paths, counts, langs, _ = K.merged(runs, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs == [] and counts.sum() == 120_000 and langs == [b"x"]
    assert peak < 5.1 * paths.nbytes  # 5.4 while all runs were held beside the whole


def test_a_node_cut_by_every_bound(spark, monkeypatch):
    """One word begins nearly all windows, so most ranges lie below one node."""
    monkeypatch.setattr(K, "RANGE_SAMPLE", 20)
    rows = [("en", f"hot word {i % 5} x{i} y{i % 3}") for i in range(300)]
    got = sorted(map(tuple, K.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4), 20, n=16).collect()))
    assert got == sorted(brute(rows, 20))


def test_empty_table(spark):
    assert K.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_exact_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits, and so does l * r."""
    row = spark.sql("SELECT (cast(1000 as decimal(4,0)) * cast(9000000000000 as decimal(16,0)) * cast(80000000000000 as decimal(18,0))) div (cast(9000000000001 as decimal(19,0)) * cast(9000000000003 as decimal(19,0))) AS s").first()
    assert row["s"] == 1000 * 9000000000000 * 80000000000000 // (9000000000001 * 9000000000003)
