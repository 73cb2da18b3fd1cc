"""What near-dedup holds on disk doesn't follow what it shuffles, nor the number of ids or of common shingles."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.llm import components as K
from pagewright.llm import near_copies as N
from pagewright.sources.session import checkpoint
from test_near_copies import brute


def shuffle_files(spark):
    top = os.path.dirname(str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0]))
    return {f for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_checkpoint_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    made = checkpoint(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(20):  # the files are removed a moment later
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert sum(x["s"] for x in made.collect()) == 499500
    assert checkpoint(made.groupBy("k").count()).count() == 7


def test_many_ids_tell_the_same_rows_as_few(spark, monkeypatch):
    rows = spark.range(-500, 3000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    ids = spark.range(0, 9000, 3).select((F.col("id") - 90).alias("of"))
    few = [{x["id"]: x["text"] for x in f(rows, "id", ids).collect()} for f in (C.having, C.lacking)]
    monkeypatch.setattr(C, "BROADCAST_ROWS", 5)
    for bits in (C.MAP_BITS, C.ROW_BITS):  # a full map takes more rows for one of them
        monkeypatch.setattr(C, "MAP_BITS", bits)
        kept, left = C.having(rows, "id", ids), C.lacking(rows, "id", ids)
        assert [{x["id"]: x["text"] for x in f.collect()} for f in (kept, left)] == few
        assert kept.columns == left.columns == rows.columns
    assert set(few[0]) == {i for i in range(-500, 3000) if i >= -90 and (i + 90) % 3 == 0} and len(few[0]) + len(few[1]) == 3500
    none = ids.limit(0)
    assert C.having(rows, "id", none).count() == 0 and C.lacking(rows, "id", none).count() == 3500


def test_shingles_of_low_hash_are_counted_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 1)  # of 60 documents about one is in the sample
    line = " ".join(f"line{i}" for i in range(60))
    df = spark.createDataFrame([(i, line + " " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)], "rid long, text string")
    known, level = N._frequent(df)
    low = np.array([x >> 32 for x in N.H._hashes(line.encode(), N.SHINGLE) if x < N.BAND], np.uint32)
    assert len(low) > 5 and set(low.tolist()) <= set(known.tolist())
    assert set(level[np.isin(known, low)].tolist()) == {int(12 * np.log2(60))}


@pytest.mark.parametrize("few", [0, K.FEW])
def test_groups_at_once_and_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW", few)
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(-90, 90, (110, 2))] + [(1 << 40, 1 << 41), (5, 5), (1 << 41, 1 << 39)] + [(1000 + i, 1001 + i) for i in range(200)]
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["root"] for x in K.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {a: b for a, b in label.items() if a != b}


def test_near_copies_with_every_table_taken_as_large(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(K, "FEW", 0)
    monkeypatch.setattr(N, "SAMPLE", 10)
    monkeypatch.setattr(N, "CROWD", 3)
    r, texts = np.random.default_rng(11), {}
    phrases = [" ".join(f"p{x}" for x in r.integers(0, 90, 7)) for _ in range(12)]
    for base in range(14):
        words = [f"w{x}" for x in r.integers(0, 500, 60)]
        for _ in range(6):
            own = list(words)
            for at in r.integers(0, len(words), int(r.integers(0, 4))):
                own[at] = f"x{r.integers(50)}"
            texts[len(texts)] = " ".join([*own, *(phrases[i] for i in r.integers(0, 12, 3))])
    want = brute(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in N.near_copies(df).collect()} == want
    assert 14 <= len(set(want.values())) < len(texts)
