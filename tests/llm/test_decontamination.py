import re

import pytest

from pagewright.llm import decontamination
from pagewright.llm.columns import with_row_ids
from pagewright.llm.decontamination import contaminated, op5_decontamination

RUN = re.compile(r"[^\W_]+")


def grams(text, width=5):
    w = RUN.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            width = min(5, len(RUN.findall((item or "").lower())))
            g, own = (grams(item, width), grams(text, width)) if width else (set(), set())
            if g and 5 * len(g & own) >= 4 * len(g):
                out.add((d, i, len(g), len(g & own)))
    return out


WORDS = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, WORDS), (2, "short one"), (3, None), (None, "A b c d e f g"), (5, ""), (1, WORDS), (7, " ".join(f"w{i}" for i in range(10, 22))), (8, "TAIL"), (9, "b-c, d"), (10, "one two three four")]
DOCS = [
    (1, "long " * 3000 + WORDS.upper().replace(" ", ", ") + " tail" * 500), (2, WORDS[:-20]), (3, " ".join(f"w{i}" for i in range(0, 25))), (4, "Short, ONE!"), (5, "a short one indeed"),
    (None, "x a b c d e f g y"), (7, None), (7, "x"), (7, "x"), (9, ""), (10, "a b c d e f"),
]


@pytest.mark.parametrize("few", [200_000, 0])
def test_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", few)
    _, docs = with_row_ids(spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as w", "2 as gram"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contaminated(docs, items).collect()}
    assert got == brute(DOCS, ITEMS)
    assert contaminated(docs.limit(0), items).collect() == [] and contaminated(docs, items.limit(0)).collect() == []


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {tuple(r)[:4] for r in op5_decontamination(spark, sf).collect()} == brute(docs, items)


def test_very_long_text(spark):
    """An item in the middle of a text of 2 MB is found; one that is spread over it isn't."""
    filler = [f"f{i % 5000}" for i in range(350_000)]
    text = " ".join([*filler[:170_000], WORDS, *filler[170_000:]])
    spread = " ".join(f"f{i}" for i in range(0, 4000, 100))
    _, docs = with_row_ids(spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string"))
    items = spark.createDataFrame([(1, WORDS), (2, spread)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contaminated(docs, items).collect()} == {(1, 1, 36, 36)}
