import hashlib

import numpy as np
import pytest

from pagewright.llm import columns, suffixes
from pagewright.llm.suffixes import op2_suffix_dedup, remove_repeats


def brute(rows, length):
    """rows: (id, bytes) in order; by a dictionary of every window."""
    seen, out = set(), []
    for doc_id, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        rest = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(text) else 0
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r)[:5] for r in df.collect())


@pytest.mark.parametrize("gram", [3, 8, 20])
def test_random_texts(spark, gram):
    r = np.random.default_rng(gram)
    pool = ["".join(r.choice(list("abé "), int(r.integers(15, 60)))) for _ in range(12)]
    rows = [(int(i), "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice(list("abcdé \n"), 9)) for _ in range(int(r.integers(0, 14))))) for i in r.permutation(150)]
    rows += [(900, "ab" * 200), (901, "a" * 300), (902, ""), (903, "ab" * 120 + "c"), (904, "a" * 20)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, rid int, spans string").repartition(5)
    want = sorted(brute(sorted((a, b.encode()) for a, b in rows), 20))
    assert got(remove_repeats(df, 20, gram)) == want


@pytest.mark.parametrize("bits", [4, 12])
def test_equal_hashes_remove_nothing_by_themselves(spark, bits):
    r = np.random.default_rng(bits)
    pool = ["".join(r.choice(list("ab "), 30)) for _ in range(5)]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice(list("abc"), 12)) for _ in range(int(r.integers(0, 8))))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(remove_repeats(df, 20, 8, bits=bits)) == sorted(brute([(a, b.encode()) for a, b in rows], 20))


def test_an_empty_text_before_a_very_long_one():
    r = np.random.default_rng(2)
    text = "".join(map(str, r.integers(0, 1 << 40, 500_000)))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"rid": [1, 2, 3, 4], "text": ["", None, text, "x"]})
    sizes = [len(data) for _, data, _, _ in suffixes._pieces(iter([batch]), 100)]
    assert len(text) > 5_000_000 and max(sizes) <= 2 * suffixes.PIECE and sum(sizes) >= len(text)


def test_long_documents_come_in_pieces(spark, monkeypatch):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdef"), 5)) for _ in range(60)]
    text = " ".join(r.choice(words, 3000))
    rows = [(1, text), (2, text[500:1500]), (3, text[7000:])]
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    some = lambda: iter([__import__("pyarrow").RecordBatch.from_pydict({"rid": [1], "text": [text]})])
    pieces = list(suffixes._pieces(some(), 100))
    assert len(pieces) > 5
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute([(a, b.encode()) for a, b in rows], 100))


def test_odd_rows(spark):
    a, b = "x" * 50 + "y" * 80, "z" * 60 + "q" * 70
    rows = [(3, None), (1, a), (1, a), (2, a + b), (2, b), (None, b), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in remove_repeats(df).collect():
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert found[None] == [(130, 0)] and found[1] == [(130, 0)] * 2 and sorted(found[2]) == [(130, 130), (260, 260)]
    assert found[3] == [(0, 0)] and found[5] == [(0, 0)]
    assert got(remove_repeats(df.limit(0))) == []


def test_merged_and_narrow():
    rid, start, end = np.array([2, 1, 1, 1, 2]), np.array([5, 0, 4, 20, 1]), np.array([9, 4, 9, 30, 7])
    assert [x.tolist() for x in columns.merged(rid, start, end)] == [[1, 1, 2], [0, 20, 1], [9, 30, 9]]
    for x in ([], [5], [-3, 4, 1 << 60], [1, 200, 3]):
        assert columns.widened(columns.narrow(np.array(x, np.int64))).tolist() == x


def test_query(spark, sf):
    rows = sorted((r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got(op2_suffix_dedup(spark, sf)) == sorted(brute(rows, 100))
