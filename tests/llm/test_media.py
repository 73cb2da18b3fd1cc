import math

import numpy as np

from pagewright.llm import media as M


def tone(r, seconds=1.0):
    t = np.arange(int(seconds * M.RATE)) / M.RATE
    out = np.zeros(len(t))
    for a in range(0, len(t), 800):
        out[a : a + 800] += sum(np.sin(2 * np.pi * f * t[a : a + 800]) for f in r.choice([220, 262, 330, 392, 440, 523, 659], 3))
    return (128 + 30 * out).clip(0, 255).astype(np.uint8)


def items_of(x):
    return M.items(x, np.array([0, len(x)]))[0]


def test_items_of_a_recording_do_not_depend_on_its_neighbours():
    r = np.random.default_rng(1)
    parts = [tone(r), tone(r, 0.02), np.full(3000, 128, np.uint8), tone(r, 0.5)]
    code, counts = M.items(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    assert counts[1] == 0 and counts[0] == (len(parts[0]) - M.FRAME) // M.HOP + 1 - 19
    for k, x in enumerate(parts):
        a = counts[:k].sum()
        assert (code[a : a + counts[k]] == items_of(x)).mean() > 0.99 if counts[k] else True


def naive_items(x):
    """The items of one recording by plain loops: direct Fourier sums, sums over areas without an integral image."""
    x = [float(v) - 128 for v in x]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (M.FRAME - 1)) for i in range(M.FRAME)]
    bins = np.exp(-2j * np.pi * np.outer(np.arange(M.FRAME // 2 + 1), np.arange(M.FRAME)) / M.FRAME)
    chroma = []
    for a in range(0, len(x) - M.FRAME + 1, M.HOP):
        power = np.abs(bins @ np.array([x[a + i] * window[i] for i in range(M.FRAME)])) ** 2
        classes = [0.0] * 12
        for k, e in enumerate(power):
            f = k * M.RATE / M.FRAME
            if 50 <= f <= 3600:
                pitch = 12 * math.log2(f / 440)
                for c in range(12):
                    classes[c] += max(0.0, 1 - abs((pitch - c + 6) % 12 - 6)) * e
        chroma.append(classes)
    levels = []
    for t in range(len(chroma) - 4):
        v = [sum(w * chroma[t + i][c] for i, w in enumerate((1, 3, 4, 3, 1))) for c in range(12)]
        norm = math.sqrt(sum(e * e for e in v))
        levels.append([round(e / norm * 1000) if norm > 1e-3 else 0 for e in v])
    out = []
    for t in range(len(levels) - M.WIDTH + 1):
        code = 0
        area = lambda a, b, y, z, t=t: sum(sum(levels[t + i][y:z]) for i in range(a, b))
        for j, (kind, y, h, w) in enumerate(M.FILTERS):
            e, half, third = y + h, w // 2, w // 3
            m, p, q = y + h // 2, y + h // 3, y + h - h // 3
            if kind == 0:
                value = math.log1p(area(0, w, y, e) / 1000) - math.log1p(w * h / 4)
            else:
                one, two = {
                    1: (area(0, w, m, e), area(0, w, y, m)), 2: (area(half, w, y, e), area(0, half, y, e)),
                    3: (area(0, half, m, e) + area(half, w, y, m), area(0, half, y, m) + area(half, w, m, e)),
                    4: (area(0, w, p, q), area(0, w, y, p) + area(0, w, q, e)), 5: (area(third, w - third, y, e), area(0, third, y, e) + area(w - third, w, y, e)),
                }[kind]
                value = math.log1p(one / 1000) - math.log1p(two / 1000)
            code |= (0, 1, 3, 2)[sum(value >= s for s in M.STEPS)] << (2 * j)
        out.append(code)
    return out


def test_items_agree_with_plain_loops():
    x = tone(np.random.default_rng(6), 0.35)
    got = items_of(x).tolist()
    want = naive_items(x)
    assert len(got) == len(want) > 50 and sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(want)


def degraded(r, x):
    """Copies with noise at 20 dB, half the gain, another phase of the frames, coarser steps, and a cut."""
    s = x.astype(float) - 128
    noise = r.normal(0, 1, len(s)) * np.sqrt((s**2).mean()) / 10
    back = lambda v: (128 + v).round().clip(0, 255).astype(np.uint8)
    return {"noise": back(s + noise), "gain": back(s * 0.5), "phase": x[M.HOP // 2 :], "steps": (x // 4 * 4 + 2).astype(np.uint8), "cut": x[len(x) // 3 + 5 :]}


def test_recall_on_degraded_copies(spark, sf):
    r = np.random.default_rng(4)
    texts = [t for t in (np.frombuffer(x["text"].encode(), np.uint8) for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()) if len(t) > 4000][:12]
    originals = [tone(r, 1.5) for _ in range(12)] + list({t.tobytes(): t for t in texts}.values())
    rows, of = [], {}
    for k, x in enumerate(originals):
        rows.append((k, bytes(x)))
        for kind, y in degraded(r, x).items():
            of[len(originals) + len(of)] = (k, kind)
            rows.append((len(originals) + len(of) - 1, bytes(y)))
    got = {x["rid"]: x["group"] for x in M.aligned(spark.createDataFrame(rows, "rid long, audio binary").repartition(3)).collect()}
    hits = {}
    for rid, (k, kind) in of.items():
        hits.setdefault(kind, []).append(got[rid] == got[k])
    assert all(np.mean(h) >= 0.9 for h in hits.values()), {k: np.mean(h) for k, h in hits.items()}
    assert len({got[k] for k in range(12)}) == 12  # tones of their own stay apart


def brute(recordings):
    """Groups by a dictionary of all landmarks, the offset with most votes, and the errors there; few recordings, so one slice."""
    label = {i: i for i in recordings}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    codes, places = {i: items_of(x).tolist() if len(x) else [] for i, x in recordings.items()}, {}
    for i, c in sorted(codes.items()):
        for p in range(len(c) - 2 * M.GAP):
            if len(set(c[p : p + 2 * M.GAP + 1])) > 1:
                places.setdefault((c[p], c[p + M.GAP], c[p + 2 * M.GAP]), []).append((i, p))
    votes = {}
    for found in places.values():
        for k, (i, p) in enumerate(found[1:], 1):
            for j, q in {found[0], found[k - 1]}:
                if i != j:
                    votes.setdefault((i, j), {}).setdefault(p - q, 0)
                    votes[i, j][p - q] += 1
    for (i, j), by_shift in votes.items():
        shift = max(by_shift, key=lambda s: (by_shift[s], -abs(s), s))
        a, b = codes[i][max(shift, 0) :], codes[j][max(-shift, 0) :]
        wrong = [(x ^ y).bit_count() for x, y in zip(a, b, strict=False)]
        k = min(len(wrong), M.SEGMENT)
        if k and min(sum(wrong[t : t + k]) for t in range(len(wrong) - k + 1)) <= M.MAX_ERROR * 32 * k:
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return {i: root(i) for i in recordings}


def test_alignment(spark):
    r = np.random.default_rng(2)
    a, b = tone(r, 2), tone(r, 2)
    noisy = (a.astype(int) + r.integers(-2, 3, len(a))).clip(0, 255).astype(np.uint8)
    recordings = {1: a, 2: a[M.HOP * 100 :], 3: b, 4: np.concatenate([b[: M.HOP * 50], a]), 5: noisy, 6: np.full(8000, 128, np.uint8), 7: np.full(9000, 128, np.uint8), 8: a, 9: np.empty(0, np.uint8)}
    df = spark.createDataFrame([(i, bytes(x)) for i, x in recordings.items()] + [(10, None)], "rid long, audio binary").selectExpr("*", "1 as items", "2 as u")
    got = {x["rid"]: x for x in M.aligned(df).collect()}
    want = brute({**recordings, 10: np.empty(0, np.uint8)})
    assert {i: x["group"] for i, x in got.items()} == want
    assert want[2] == want[4] == want[5] == want[8] == 1 and want[6] == 6 and want[7] == 7 and got[1]["align_rid"] is None
    assert (got[2]["align_rid"], got[2]["shift"], got[2]["bit_error"]) == (1, -100, 0.0)
    assert got[4]["shift"] == 50 and got[4]["bit_error"] < 0.05 and got[8]["overlap"] == got[1]["n_items"]
    assert M.aligned(df.limit(0)).collect() == []


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    audio = {i: np.frombuffer(t.encode(), np.uint8) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in M.op3_audio_fingerprints(spark, sf).collect()}
    assert got.keys() == texts.keys() and all(r["n_items"] == len(items_of(audio[i])) for i, r in got.items())
    want = brute(audio)
    long = [i for i in texts if len(M._landmarks(items_of(audio[i]) if len(audio[i]) else np.empty(0, np.uint32)))]
    assert all((want[i] == want[j]) == (got[i]["component_id"] == got[j]["component_id"]) for i in long for j in long)
    assert all(r["segment_error"] is None or r["segment_error"] <= M.MAX_ERROR for r in got.values())
