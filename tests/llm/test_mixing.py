import math
import re
from hashlib import md5

from pagewright.llm.mixing import mix, op1_source_mix, share_targets, sized

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sums = [sum(size[i] for i, _, s in docs if s == x) for x in sources]
    out = {}
    for x, total, target in zip(sources, sums, share_targets(sums, [k % 3 + 1 for k in range(len(sources))])):
        own = sorted((i for i, _, s in docs if s == x), key=lambda i: md5(str(i).encode()).hexdigest())
        left, taken = math.floor(target + 0.5), dict.fromkeys(own, 0)
        while left and total:
            for i in own:
                n = min(left, size[i])
                taken[i] += n
                left -= n
        out |= {i: (i, size[i], total, target, taken[i]) for i in own}
    return out


def test_targets():
    assert share_targets([100, 100], [1, 3]) == [50.0, 150.0] and share_targets([0, 0], [1, 2]) == [0.0, 0.0]
    got = share_targets([10, 1000, 50, 0], [3, 1, 2, 1])
    assert got[0] == 30 and got[2] == 150 and got[3] == 0 and abs(sum(got) - 1060) < 1e-6 and got[1] == 880


def test_small_bins_and_hot_source(spark):
    docs = [(i, "w " * (i * 37 % 50), "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(900, None, None), (901, "", "empty"), (902, "x\x0by z q", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as bin")
    want = brute(docs)
    for rows in (7, 2048):
        got = {r["doc_id"]: (r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mix(sized(df), rows).collect()}
        assert got == want
    assert max(t[4] / t[1] for t in want.values() if t[1]) <= 3 and want[902][1] == 3


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, "d e f", None)], "doc_id long, text string, source string")
    got = mix(sized(df)).collect()
    assert len(got) == 4
    assert sum(r["taken"] for r in got) == 8
    assert mix(sized(df.limit(0))).collect() == []


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: tuple(r) for r in op1_source_mix(spark, sf).collect()} == brute(docs)
