import hashlib

import numpy as np
import pytest

from pagewright.llm import columns
from pagewright.llm.substrings import op8_substring_dedup, remove_repeats


def brute(rows, window):
    """rows: (id, text) of distinct ids."""
    first, out = {}, []
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        w = split[i]
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, w in split.items():
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_random_texts(spark):
    r = np.random.default_rng(4)
    pool = [" ".join(r.choice(list("abcdé"), int(r.integers(3, 12)))) for _ in range(9)]
    rows = [(int(i), "\n".join(r.choice(pool) if r.random() < 0.6 else " ".join(r.choice(list("vwxyz"), 4)) for _ in range(int(r.integers(0, 9))))) for i in r.permutation(120)]
    rows += [(500, "a " * 100), (501, "a " * 40), (502, None), (503, " \t "), (504, "one"), (505, "b c " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rid", "'x' as spans").repartition(6)
    got = remove_repeats(df, 4).collect()
    assert sorted(tuple(x)[:4] for x in got) == brute(rows, 4)
    assert all(hashlib.sha256(x["kept_text"].encode()).hexdigest() == x["kept_sha256"] for x in got)


def twins(n):
    """A Thue-Morse word of n letters, and the one with the letters exchanged."""
    t = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 512, 4096])
def test_words_that_collide_in_powers_of_two(spark, n):
    a, b = twins(n)
    head = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")], "doc_id long, text string")
    assert sorted((x["doc_id"], x["n_removed"]) for x in remove_repeats(df).collect()) == [(1, 0), (2, 0), (3, 13)]


@pytest.mark.parametrize("bits", [3, 10])
def test_equal_hashes_remove_nothing_by_themselves(spark, bits):
    r = np.random.default_rng(bits)
    rows = [(i, " ".join(r.choice(list("abcd"), int(r.integers(0, 60))))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(x)[:4] for x in remove_repeats(df, 5, bits=bits).collect()) == brute(rows, 5)


def test_long_texts_come_in_pieces(spark):
    r = np.random.default_rng(3)
    text = " ".join(map(str, r.integers(0, 50_000, 2_000_000)))
    assert len(text) > 2 * columns.SLICE
    rows = [(1, ""), (2, None), (3, text), (4, text[5_000_000:5_200_000]), (5, text[-3000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(x) for x in remove_repeats(df, texts=False).collect()) == brute(rows, 13)


def test_fold_keeps_one_of_each():
    from pagewright.llm.matches import Fold, claims_from

    fold, made = Fold(4, inside=False), []
    for part in (([5, 7, 5], [9, 9, 8], [0, 1, 4]), ([5, 7], [3, 9], [2, 6]), ([5], [1], [0])):
        fold.parts.append([np.array(x, t) for x, t in zip((*part, [1] * len(part[0])), (np.uint64, np.int64, np.int64, np.uint8), strict=True)])
        made += [row[2:] for row in fold.folded()]
    got = sorted(zip(*(x.tolist() for x in claims_from(made)), strict=True))
    assert got == [(3, 2, 1, 1, 0), (8, 4, 1, 3, 2), (9, 0, 1, 8, 4)]
    assert fold.kept[0].tolist() == [7, 7, 5] and fold.kept[1].tolist() == [9, 9, 1]


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (2, "x " + text), (None, text)], "doc_id long, text string")
    got = sorted(((x["doc_id"] or 0), x["n_removed"]) for x in remove_repeats(df).collect())
    assert got == [(0, 0), (1, 20), (1, 20), (2, 20), (2, 20)]
    assert remove_repeats(df.limit(0)).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op8_substring_dedup(spark, sf).collect()) == brute(rows, 13)
