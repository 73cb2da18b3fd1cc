import numpy as np

from pagewright.llm import columns as C
from pagewright.llm import media as M

COMMON = 20


def recording(r, jingle, own, odd):
    """Items: 90 of its own, the common ones, 90 more; an even or an odd bit of each of its own is wrong."""
    code = own ^ (np.uint32(1) << (2 * r.integers(0, 16, len(own), np.uint32) + np.uint32(odd)))
    return np.concatenate([code[:90], jingle, code[90:]])


def test_recordings_alike_beside_the_chosen_two(spark):
    """Alike recordings with no landmark in common but those of a jingle, which the first and the drawn recording hold among others."""
    r = np.random.default_rng(7)
    draw = np.random.default_rng(8)
    codes = lambda n: draw.integers(0, 1 << 32, n, np.uint32)
    jingle, alike = codes(COMMON), codes(180)
    rids = np.arange(1, 31)
    drawn = int(rids[np.argmin(C.mixed(rids.astype(np.uint64)))])
    pair = [i for i in (11, 19, 25) if i != drawn][:2]
    items = {int(i): recording(r, jingle, alike, i == pair[0]) if i in pair else np.concatenate([codes(int(i) + 5), jingle, codes(70)]) for i in rids}
    rows = [(0, i, [int(x) for x in c.view(np.int32)]) for i, c in items.items()]
    prints = spark.createDataFrame(rows, "slice long, rid long, items array<int>").coalesce(1)
    got = [(x["u"], x["v"], x["shift"]) for x in M.links(prints, 3).collect()]
    assert got == [(pair[1], pair[0], 0)]
    want = [(a, b) for a in items for b in items if a > b and any(M.errors(items[a], items[b], s)[2] <= M.MAX_ERROR for s in range(-30, 31))]
    assert want == [(pair[1], pair[0])]
