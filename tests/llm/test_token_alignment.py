import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pagewright.llm import columns
from pagewright.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_LIBRARY = []


def library():
    if not _LIBRARY:
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        _LIBRARY.extend([a, sentencepiece.SentencePieceProcessor(model_file=B)])
    return _LIBRARY


def tokens(text):
    """Whole texts by the libraries: (A's ids, B's ids, A's byte strings, B's)."""
    a, b = library()
    if not text:
        return [], [], [], []
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    table = T.byte_of()
    xs = [bytes(table[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
        return [], [], [], []
    return x, y, xs, ys


def brute(docs):
    found, counts = [], Counter()
    for doc_id, text in docs:
        x, y, xs, ys = tokens(text)
        links, groups, i, j, p, q, own_a, own_b = [], [], 0, 0, 0, 0, [], []
        while i < len(x):
            links.append((x[i], y[j]))
            if not own_a or own_a[-1][0] != i:
                own_a.append((i, x[i]))
            if not own_b or own_b[-1][0] != j:
                own_b.append((j, y[j]))
            e, f = p + len(xs[i]), q + len(ys[j])
            if e == f:
                groups.append(",".join(str(v) for _, v in own_a) + "|" + ",".join(str(v) for _, v in own_b))
                own_a, own_b = [], []
            if e <= f:
                i, p = i + 1, e
            if f <= e:
                j, q = j + 1, f
        counts.update(set(links))
        found.append((doc_id, len(x), len(y), groups, links))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [
        (doc_id, n_a, n_b, len(groups), len(links), sum(counts[k] == top[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for doc_id, n_a, n_b, groups, links in found
    ]


ODD = [
    None, "", " ", "  ", "\n", "\t\n x", " lead", "trail ", "trail  \n", "a  b   c", "a \n b\n\n\nc\r\nd\re;\r f", "x▁y", "▁", "<|endoftext|> <s> </s> a<|endoftext|>b", "<0x0A> \x00 \x01 x", "naïve café ÀÉ ß œ",
    "日本語 の テキスト 中文", "emoji 👩‍👩‍👧 x​ y z   w　v u\x85t", "don't we'll it's I'M 12345 3.14 a1b2", "ﬁ Å é é ñ", "word " * 400, "﻿bom   x", "tab\tsep\tx", "× ÷ ҉ x", "A" * 3000,
]


def texts(seed, n):
    r = np.random.default_rng(seed)
    parts = ["the", "hello", "straße", " ", "  ", "\n", "\t", "\r", "é", "日", "👍", "'s", "12", "…", "▁", " ", "Über", "x"]
    p = np.array([9, 9, 9, 30, 2, 3, 1, 0.3, 3, 1, 1, 2, 3, 1, 0.03, 0.3, 5, 3])
    return ["".join(r.choice(parts, int(r.integers(0, 80)), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize(("size", "remembered"), [(4 << 20, 250_000), (500, 40)])
def test_against_the_libraries(spark, tmp_path, monkeypatch, size, remembered):
    monkeypatch.setattr(columns.slices, "__defaults__", (size,))
    monkeypatch.setattr(T, "REMEMBERED", remembered)
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(ODD + texts(1, 200) + ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slice", "'x' as a", "2 as k").repartition(3)
    T.write_alignments(docs, str(tmp_path / "x"), A, B, groups=True)
    key = lambda x: str(x)
    assert sorted(map(tuple, T.alignment_stats(spark, str(tmp_path / "x")).collect()), key=key) == sorted(brute(rows), key=key)
    said = {(r["doc_id"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in T.groups_of(spark, str(tmp_path / "x")).collect()}
    assert said == {(x[0], x[-1]) for x in brute(rows)}


def test_counts_of_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello hello"), (3, None)], "doc_id long, text string")
    T.write_alignments(docs, str(tmp_path / "x"), A, B)
    counts = Counter()
    for text in ("hello world", "hello hello"):
        counts.update({(x, y) for x, y in zip(*_linked(text), strict=True)})
    got = {(r["a"], r["b"]): (r["count"], r["best"]) for r in T.pair_counts(spark, str(tmp_path / "x")).collect()}
    assert {k: v[0] for k, v in got.items()} == counts
    assert all(best == (n == max(m for (a, _), m in counts.items() if a == k[0])) for k, (n, best) in got.items())


def _linked(text):
    x, y, xs, ys = tokens(text)
    at_a, at_b, _, _ = T.overlaps(np.array([len(v) for v in xs]), np.array([len(v) for v in ys]))
    return [x[i] for i in at_a], [y[j] for j in at_b]


def test_empty_table(spark, tmp_path):
    T.write_alignments(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "x"), A, B)
    assert T.alignment_stats(spark, str(tmp_path / "x")).collect() == []
