import numpy as np
import pytest

from pagewright.llm import near_copies as N
from test_near_copies import brute


def edited(r, words, edits):
    own = list(words)
    for at in r.choice(len(words), edits, replace=False):
        own[at] = f"x{r.integers(1 << 30)}"
    return own


def crowd(r, n):
    """A text of 150 words, and copies with 2 to 5 words replaced: half are similar to the text, hardly any to one another, and half to none."""
    words = [f"w{x}" for x in r.integers(0, 1 << 30, 150)]
    return {i: " ".join(edited(r, words, 0 if i == n // 2 else 2 + i % 4)) for i in range(n)}


def opened(monkeypatch):
    """The numbers of pairs whose texts are compared."""
    counts, verified = [], N._verified

    def counting(pairs, rows):
        counts.append(pairs.count())
        return verified(pairs, rows)

    monkeypatch.setattr(N, "_verified", counting)
    return counts


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {x["doc_id"]: x["component_id"] for x in N.near_copies(df).collect()}


def test_pairs_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch):
    counts, texts = opened(monkeypatch), crowd(np.random.default_rng(1), 400)
    want = brute(texts)
    assert 150 < sum(i != root for i, root in want.items()) < 250
    assert found(spark, texts) == want
    assert sum(counts) <= 2 * 400


@pytest.mark.parametrize("size, rounds", [(2, 1), (2, 4), (16, 4), (2, 0)])
def test_several_crowds_in_the_same_buckets(spark, monkeypatch, size, rounds):
    monkeypatch.setattr(N, "CROWD", size)
    monkeypatch.setattr(N, "ROUNDS", rounds, raising=False)
    r = np.random.default_rng(7)
    notice = " ".join(f"notice{i}" for i in range(60))
    texts = {}
    for k, words in enumerate((4, 30, 30, 80, 200)):  # the notice fills most of a text, or little of it
        base = [f"w{x}" for x in r.integers(0, 60 + words, words)]
        for i in range(40):
            own = edited(r, base, int(r.integers(0, min(words, 8))))
            texts[100 * k + i] = f"{notice} {' '.join(own)}" if i % 2 else f"{' '.join(own)} {notice}"
        for i in range(40, 50):  # longer ones, up to and beyond 5/4 of the size
            texts[100 * k + i] = f"{notice} {' '.join(base + [f'y{x}' for x in r.integers(0, 1 << 30, 2 * i - 78)])}"
    for k in range(40):
        texts[1000 + k] = f"{notice} {' '.join(f'z{x}' for x in r.integers(0, 1 << 30, int(r.integers(0, 40))))}"
    want = brute(texts)
    assert 20 < len(set(want.values())) < len(texts) - 100
    assert found(spark, texts) == want


def test_differences_find_every_similar_pair(spark):
    """What is similar to a text that isn't similar to the pivot shares a difference within both prefixes that leave room."""
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 62, 400).astype(np.uint64)
    none, met = (np.empty(0, np.uint32), np.empty(0, np.uint8)), 0
    for _ in range(3000):
        n = int(r.integers(1, 120))
        c = r.choice(pool, n, replace=False)
        x = np.unique(np.concatenate([r.choice(c, int(r.integers(0, n + 1)), replace=False), r.choice(pool, int(r.integers(0, 30)), replace=False)]))
        drop = int(r.integers(0, len(x) // 5 + 1))
        y = np.unique(np.concatenate([r.choice(x, len(x) - drop, replace=False), r.choice(pool, int(r.integers(0, len(x) // 5 + 1)), replace=False)])) if len(x) else x
        (dx, px), (dy, py) = (N._prefix(s, np.unique(c), *none) for s in (x, y))
        shared = len(np.intersect1d(x, y))
        alike, (near_x, near_y) = 9 * shared >= 4 * (len(x) + len(y)), (9 * d <= len(s) + len(c) for d, s in ((dx, x), (dy, y)))
        if alike and len(x) and len(y) and not (near_x and near_y):
            wx, wy = 9 * dx - len(x), 9 * dy - len(y)
            places = [(i, int(np.flatnonzero(py == e)[0])) for i, e in enumerate(px) if e in py]
            assert any(wx + wy <= 18 * min(dx - i, dy - j) for i, j in places)
            met += 1
    assert met > 100
