import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from pagewright.llm import simple8b, token_files
from pagewright.llm.token_files import Encoder, op10_token_files, read_token_ids, read_token_index, write_token_files
from pagewright.sources.session import shared_path

PATH = P.path("byte_bpe_50k.json")
ODD = [
    (5, "Hello it's  we'll 's  \n\n x''s a_b __ ½²  日本語\x1c\x1dz é<|endoftext|>!!"), (None, "null id"), (1, None), (2, ""), (7, "same"), (7, "same"),
    (7, "a different one"), (-3, "neg   nbsp\tTab\r\n 12³ 'tis 've'd"), (9, "word " * 30000), (10, "\n"), (11, "   "), (12, "ends with space "),
]


def brute(rows):
    t = Tokenizer.from_file(PATH)
    by_hash = lambda text: xxhash.xxh64_intdigest(text, 42) - (1 << 64) * (xxhash.xxh64_intdigest(text, 42) >> 63) if text is not None else 42
    rows, out, start = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by_hash(r[1]))), [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.mark.parametrize("n", [0, 1, 239, 1023, 1024, 1025, 40000])
@pytest.mark.parametrize("high", [1, 2, 5000, 50257, 2**32])
def test_round_trip(n, high):
    x = np.random.default_rng(n).integers(0, high, n)
    assert (simple8b.decode(*simple8b.encode(x), n) == x).all()


@pytest.mark.parametrize("most", [2048, 1])
def test_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(token_files, "MAX_BOUNDS", most)
    path = shared_path(spark, "test")
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in ODD], "doc_id long, text string, shard string, first int")
    write_token_files(docs, path, PATH, n_shards=3)
    got = sorted((tuple(r) for r in read_token_index(spark, path).collect()), key=key)
    assert got == sorted(brute(ODD), key=key)
    t = Tokenizer.from_file(PATH)
    for r in read_token_ids(spark, path).where("doc_id in (5, -3)").collect():
        assert list(r["ids"]) == [*t.encode(dict(ODD)[r["doc_id"]], add_special_tokens=False).ids, 0]


def test_other_kind_of_tokenizer(spark):
    path, other = shared_path(spark, "test"), P.path("word_bpe_49k.json")
    write_token_files(spark.createDataFrame([(1, "Hello World")], "doc_id long, text string"), path, other)
    assert list(read_token_ids(spark, path).first()["ids"]) == [*Tokenizer.from_file(other).encode("Hello World", add_special_tokens=False).ids, 0]


def test_empty(spark):
    path = shared_path(spark, "test")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_token_index(spark, path).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op10_token_files(spark, sf).collect()), key=key) == sorted(brute(rows), key=key)


def test_pieces_are_those_of_the_library():
    import random

    r, t, e = random.Random(5), Tokenizer.from_file(PATH), Encoder(PATH)
    some = ["'", "'s", "'re", "'ll", "'x", " ", "  ", "\n", "\t", "\r", "a", "é", "Zz", "Ĳ", "1", "42", "_", "!", "--", " '", "s", "re", "d", "''", "×", "日", "\x0b", "`^~{"]
    texts = ["".join(r.choices(some, k=r.randint(1, 14))) for _ in range(3000)]
    for text, got in zip(texts, e(texts), strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [64, 512, 1024, 4096])
def test_pieces_that_collide_in_powers_of_two(n):
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    b = a.translate(str.maketrans("ab", "ba"))
    t, e = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in (a, b, a + b):
        assert e([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_agrees(monkeypatch):
    t, e = Tokenizer.from_file(PATH), Encoder(PATH)
    e.pieces.most = e.chunks.most = 50
    monkeypatch.setattr(token_files, "CHARS", 40)
    texts = [f"word{i} été it's {i * 7919}  x\n  y\n\n z" * 3 for i in range(60)] * 2 + ["", None, "日本 it's" * 30, "no break" + "x" * 300]
    for text, got in zip(texts, e(texts), strict=True):
        assert got.tolist() == t.encode(text or "", add_special_tokens=False).ids
    assert all(len(x) <= 50 for x in (e.pieces, e.chunks))


def test_a_long_text_is_cut(monkeypatch):
    monkeypatch.setattr(token_files, "CHARS", 1000)
    text = "a  b\n\nc d's !!  \n" * 900
    cut = list(token_files.parts(text, 1000))
    assert "".join(cut) == text and len(cut) > 10 and max(map(len, cut)) < 1100


def test_ids_that_repeat_spread_over_shards(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(7, f"seven {i}") for i in range(300)] + [(7, "same")] * 200 + [(i, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = {r["shard"]: r["count"] for r in token_files.shards(docs, 8).groupBy("shard").count().collect()}
    assert len(sizes) > 4 and max(sizes.values()) < 400
    path = shared_path(spark, "test")
    write_token_files(docs, path, PATH, n_shards=8)
    got = read_token_index(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 400 + list(range(7)) + [7] * 501 + list(range(8, 20))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_words_asked_for_again_are_made_once():
    made = []
    held = token_files.Remembered(lambda key: made.append(key) or key.encode(), 4)
    for i in range(40):
        assert held["often"] == b"often" and held[f"once{i}"] == f"once{i}".encode()
        assert len(held) + len(held.older) <= 8
    assert made.count("often") == 1 and len(made) == 41


def test_words_and_marks_agree_with_the_library():
    encode = Encoder(PATH)
    words = ["the", "Übergrößen", "a1", "it's", "its'", "'s", "x.", "x..", "x,\n", "re:", "é!", "don't.", ".", "", "A\tb.", "1.", "q;?"]
    texts = [f"{a} {b} {c}" for a in words for b in words if b for c in words]
    assert all((x == encode._library(t)).all() and len(x) == len(encode._library(t)) for t, x in zip(texts, encode(texts), strict=True))
