import numpy as np

from pagewright.llm import media as M
from test_media import tone


def test_result_does_not_depend_on_partitions(spark, monkeypatch):
    """Recordings that share jingles, in one partition, in six, and in slices of one recording each."""
    r = np.random.default_rng(11)
    jingles = [tone(r, 0.4) for _ in range(4)]
    own = [tone(r, 0.6) for _ in range(20)]
    rows = [(i, bytes(np.concatenate([jingles[i % 4], own[i % 20], jingles[(i // 7) % 4]]))) for i in range(60)]
    rows += [(60, None), (61, b""), (62, rows[0][1]), (63, rows[5][1] * 2), (64, b"\x80" * 4000)]
    df = spark.createDataFrame(rows, "rid long, audio binary")
    runs = []
    for parts, size in ((1, 4 << 20), (6, 4 << 20), (3, 1)):
        monkeypatch.setattr(M.C, "SLICE", size)
        runs.append(sorted(map(tuple, M.aligned(df.repartition(parts)).collect()), key=lambda x: x[0]))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
    group = {x[0]: x[2] for x in runs[0]}
    assert all(group[i] == group[i % 20] for i in range(60)) and group[62] == group[0] and group[63] == group[5]
    assert (group[60], group[61], group[64]) == (60, 61, 64)


def test_ids_null_or_repeated(spark, tmp_path):
    """Null and repeated doc_ids, repeated rows and clashing columns: a result for each row, equal rows alike."""
    text = "".join(chr(97 + int(k)) for k in np.random.default_rng(3).integers(0, 26, 6000))
    docs = [(1, text), (1, text), (2, text), (None, text), (3, None), (3, ""), (None, None), (4, text[::-1])]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as rid", "text as items", "1 as slice").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in M.op3_audio_fingerprints(spark, str(tmp_path)).collect()]
    assert len(got) >= len(docs) and got.count(next(x for x in got if x[0] == 1)) == 2
    assert len({x[2] for x in got if x[1] and x[0] != 4}) == 1
