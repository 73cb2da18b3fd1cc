import numpy as np

from pagewright.llm import media as M
from test_media import tone


def test_copies_without_landmarks(spark):
    r = np.random.default_rng(8)
    short, few = tone(r, 0.06), tone(r, 0.125)
    steady = np.tile(tone(r, 0.004), 400)
    recordings = [short, few, steady, np.full(5000, 128, np.uint8), short[:-1], few, short, steady, np.full(5000, 128, np.uint8), short, np.empty(0, np.uint8), np.empty(0, np.uint8), tone(r, 0.125)]
    assert len(short) < M.FRAME + M.HOP * 19 and 0 < len(M.items(few, np.array([0, len(few)]))[0]) <= 2 * M.GAP
    df = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(recordings)] + [(20, None), (21, None)], "rid long, audio binary")
    got = {x["rid"]: x for x in M.aligned(df).collect()}
    assert {i: x["group"] for i, x in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 0, 7: 2, 8: 3, 9: 0, 10: 10, 11: 11, 12: 12, 20: 20, 21: 21}
    assert (got[9]["align_rid"], got[9]["overlap"], got[9]["bit_error"]) == (0, 0, None)
    assert (got[5]["align_rid"], got[5]["shift"], got[5]["bit_error"]) == (1, 0, 0.0)


def test_exact_copies_share_a_component(spark, sf):
    text = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = {}
    for x in M.op3_audio_fingerprints(spark, sf).collect():
        groups.setdefault(text[x["doc_id"]], set()).add(x["component_id"])
    assert all(len(g) == 1 for t, g in groups.items() if t)
