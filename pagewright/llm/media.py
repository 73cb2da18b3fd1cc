"""Media columns: chroma fingerprints of audio and their alignment.

Fingerprint. Frames of FRAME samples, HOP apart, become twelve pitch-class energies, smoothed over SMOOTH
frames, scaled to unit length and rounded to whole numbers. Over the image of pitch classes by time stand FILTERS of up to
WIDTH frames: differences of areas, read from an integral image. Each filter's value is quantised to two
bits; the sixteen of a position make one 32-bit item.

Alignment. A landmark is three items, GAP apart. Items that noise, gain or another phase of the frames leave alone are spread over
a recording, so a degraded copy keeps many of its landmarks. Recordings with a common landmark are candidates: each is paired with
two of them, the one of smallest rid and the one whose mixed rid is smallest, so a landmark of n recordings makes fewer than 2n pairs,
the same ones whatever partitions the recordings are in. A pair's landmarks vote in a histogram of offsets; at the winning offset the bit errors are counted over the overlap, and over each SEGMENT of it. The pair is
linked if the best segment (the whole overlap if that is shorter) has at most MAX_ERROR of its bits wrong: unrelated recordings
differ in more than a fifth. Each slice posts the two for each of its landmarks, and is answered where the two of all slices are others.

The rest. Recordings that share a landmark and are in different groups by then are all compared, at every offset at which they share
one: if two of a landmark's recordings are in different groups, one of them isn't in the group of the landmark's first, so the landmarks
of recordings that stand apart from a first are all that is looked up again. So no pair that shares a landmark and is right enough at it is in two groups.
Copies are one group by then; a landmark costs its outsiders times its recordings, on any number of tasks.

Recordings without a landmark, short, silent or steady ones, are linked by their whole: the sequence of all
their items, or the bytes where there are no items. Such a link has no votes.

Defined results
- null or empty audio: no items, a group of its own.
- too short audio (fewer samples than FRAME + HOP * (WIDTH + SMOOTH - 2)): no items, grouped with equal bytes; overlap 0, bit_error null.
- landmarks of one repeated item (silence, a steady tone) don't link; equal sequences of them do.
- equal ids or null ids: see columns.numbered(); equal rows share one result.
- a recording's frames are held at once: about 60 times its bytes / HOP.
- an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.llm.components import components
from pagewright.sources.session import checkpoint, prepare_workers, shuffle_partitions, table

RATE, FRAME, HOP = 8_000, 256, 32
SMOOTH = np.array([1, 3, 4, 3, 1])
WIDTH = 16
#: Items from one of a landmark's three to the next.
GAP = 8
#: Items over which bit errors decide, and the share of wrong bits that is accepted.
SEGMENT, MAX_ERROR = 64, 0.12
LEVELS = 1_000
#: (kind, first pitch class, height, width) of the filters, by a rule that varies all four.
FILTERS = tuple((k % 6, (5 * k) % (12 - h + 1), h, 2 + (7 * k) % (WIDTH - 1)) for k in range(16) for h in [2 + (5 * k) % 9])
#: Quantisation steps of a filter's log ratio, and the Gray code of the four levels.
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Bytes of audio in a worker's arrays at a time.
PIECE = 1 << 20


def _pitch_classes() -> np.ndarray:
    """(frequency bins, 12): the share of each bin in each pitch class, by the distance of its pitch."""
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(freq), 12))
    heard = (freq >= 50) & (freq <= 3_600)
    pitch = 12 * np.log2(np.maximum(freq, 1) / 440)
    for c in range(12):
        off = np.abs((pitch - c + 6) % 12 - 6)
        out[heard, c] = np.clip(1 - off[heard], 0, 1)
    return out


_CHROMA = _pitch_classes()
_WINDOW = np.hanning(FRAME)


def _areas(image: np.ndarray, kind: int, y: int, h: int, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two areas that a filter compares, at n positions of an integral image."""

    def area(t1: int, t2: int, y1: int, y2: int) -> np.ndarray:
        a, b = image[t1 : t1 + n], image[t2 : t2 + n]
        return b[:, y2] - a[:, y2] - b[:, y1] + a[:, y1]

    zero = np.zeros(n, np.int64)
    t, u, v = w // 2, w // 3, w - w // 3
    m, p, q = y + h // 2, y + h // 3, y + h - h // 3
    e = y + h
    if kind == 0:
        return area(0, w, y, e), zero
    if kind == 1:
        return area(0, w, m, e), area(0, w, y, m)
    if kind == 2:
        return area(t, w, y, e), area(0, t, y, e)
    if kind == 3:
        return area(0, t, m, e) + area(t, w, y, m), area(0, t, y, m) + area(t, w, m, e)
    if kind == 4:
        return area(0, w, p, q), area(0, w, y, p) + area(0, w, q, e)
    return area(u, v, y, e), area(0, u, y, e) + area(v, w, y, e)


def items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit unsigned samples of recordings end to end -> their items end to end, and the number of each's items."""
    sizes = np.diff(offsets)
    frames = np.maximum((sizes - FRAME) // HOP + 1, 0)
    frames[sizes < FRAME] = 0
    ends = np.cumsum(frames)
    total = int(ends[-1]) if len(ends) else 0
    counts = np.maximum(frames - (len(SMOOTH) - 1) - (WIDTH - 1), 0)
    if not counts.sum():
        return np.empty(0, np.uint32), counts
    starts = np.repeat(offsets[:-1] - HOP * (ends - frames), frames) + HOP * np.arange(total)
    views = np.lib.stride_tricks.sliding_window_view(data, FRAME)
    chroma = np.empty((total, 12))
    for i in range(0, total, 2048):
        x = (views[starts[i : i + 2048]] - 128.0) * _WINDOW
        spectrum = np.fft.rfft(x)
        chroma[i : i + 2048] = (spectrum.real**2 + spectrum.imag**2) @ _CHROMA
    # whole numbers from here on: sums don't depend on a recording's neighbours
    k = len(SMOOTH)
    smooth = sum(w * chroma[i : total - k + 1 + i] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    levels = np.rint(np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-3) * LEVELS).astype(np.int64)
    n = len(levels) - WIDTH + 1
    image = np.zeros((len(levels) + 1, 13), np.int64)
    image[1:, 1:] = levels.cumsum(0).cumsum(1)
    code = np.zeros(n, np.uint32)
    for j, (kind, y, h, w) in enumerate(FILTERS):
        a, b = _areas(image, kind, y, h, w, n)
        value = np.log1p(a / LEVELS) - np.log1p(b / LEVELS) if kind else np.log1p(a / LEVELS) - np.log1p(w * h / 4)
        code |= GRAY[np.searchsorted(STEPS, value, "right")] << np.uint32(2 * j)
    first = ends - frames
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return code[at], counts


def fingerprints(media: DataFrame) -> DataFrame:
    """(rid, audio binary) -> (slice, rid, items array<int>, whole binary): whole is null where a landmark stands, or nothing.

    slice: equal for neighbouring recordings of about C.SLICE bytes together."""
    prepare_workers(media.sparkSession)
    C.bounded_batches(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for rids, data, offsets in C.slices(batches, PIECE):
            if held >= C.SLICE:
                number, held = number + 1, 0
            held += len(data)
            code, counts = items(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            whole = [_whole(data[a:b], code[p:q]) for a, b, p, q in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rids), number)), pa.array(rids), pa.ListArray.from_arrays(pa.array(bounds), pa.array(code.view(np.int32))), pa.array(whole, pa.binary())], ["slice", "rid", "items", "whole"])

    return media.select("rid", "audio").mapInArrow(run, "slice long, rid long, items array<int>, whole binary")


def _landmarks(code: np.ndarray) -> np.ndarray:
    """Positions of a recording's landmarks: not those whose items, and all between, are one."""
    n = len(code) - 2 * GAP
    if n <= 0:
        return np.empty(0, np.int64)
    varied = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
    return np.flatnonzero(varied[2 * GAP :] > varied[:n])


def _hashed(rids: np.ndarray, counts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recordings' items end to end -> the hash, rid and position of each of their landmarks."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    found = [_landmarks(code[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    many = np.array([len(f) for f in found], np.int64)
    pos, rid = np.concatenate([*found, np.empty(0, np.int64)]), np.repeat(rids, many)
    at = pos + np.repeat(bounds[:-1], many)
    wide = code.astype(np.uint64)
    return C.mixed(C.mixed(wide[at] << C.U(32) | wide[at + GAP]) + wide[at + 2 * GAP]), rid, pos


def _whole(audio: np.ndarray, code: np.ndarray) -> bytes | None:
    """The digest of a recording's items, or of its bytes where it has none; nothing if it is empty or has a landmark."""
    if not len(audio) or len(_landmarks(code)):
        return None
    return hashlib.md5((b"i" + code.tobytes()) if len(code) else (b"b" + audio.tobytes())).digest()


def copies(prints: DataFrame) -> DataFrame:
    """(rid, whole) -> links (u, v, shift, votes) of recordings without a landmark to the smallest id of their whole."""
    least = prints.where("whole is not null").groupBy("whole").agg(F.min("rid").alias("v"), F.count("*").alias("many")).where("many > 1").select(F.col("whole").alias("w"), "v")
    both = prints.join(least, F.col("whole") == F.col("w")).where("rid <> v")
    return both.select(F.col("rid").alias("u"), "v", F.lit(0).alias("shift"), F.lit(0).cast("long").alias("votes"))


LINKS = "u long, v long, shift int, votes long"
#: Kinds of rows: a slice's landmarks, those of them whose drawn recording isn't the first, what a slice is told of either, its recordings.
_POSTED, _DRAWN, _FIRST_IS, _DRAWN_IS, _RECORDINGS = range(5)


class _Marks:
    """The landmarks of a slice, ordered by (hash, rid, pos), and the order in which their hashes are posted to n buckets."""

    def __init__(self, rids: np.ndarray, counts: np.ndarray, code: np.ndarray, n: int) -> None:
        h, rid, pos = _hashed(rids, counts, code)
        order = np.lexsort((pos, rid, h))
        self.h, self.rid, self.pos = h[order], rid[order], pos[order]
        self.run, self.first, self.drawn = _chosen(self.h, self.rid)
        #: Hashes by bucket, and inside one by the place of their first.
        bucket = C.bucket_of(self.h[self.first], n)
        self.turn = np.lexsort((self.pos[self.first], self.rid[self.first], bucket))
        self.base = np.searchsorted(bucket[self.turn], np.arange(n + 1))

    def posts(self, slice_: int) -> Iterator[tuple]:
        head = np.array([slice_], "<i8").tobytes()
        first, drawn = self.first[self.turn], self.drawn[self.turn]
        for b in np.flatnonzero(np.diff(self.base)).tolist():
            f, d = first[self.base[b] : self.base[b + 1]], drawn[self.base[b] : self.base[b + 1]]
            yield b, _POSTED, self.h[f].tobytes(), C.narrow(self.rid[f]), C.narrow(self.pos[f]), head
            k = np.flatnonzero(self.rid[f] != self.rid[d])
            if len(k):
                yield b, _DRAWN, C.narrow(k), C.narrow(self.rid[d[k]]), C.narrow(self.pos[d[k]]), head

    def votes(self, told: list[tuple]) -> Iterator[pa.RecordBatch]:
        """LINKS of the slice's landmarks with the chosen ones, once it has been told of those that are elsewhere."""
        chosen = {_FIRST_IS: (self.rid[self.first], self.pos[self.first]), _DRAWN_IS: (self.rid[self.drawn], self.pos[self.drawn])}
        for kind, k, rid, pos, head in told:
            at = self.turn[self.base[np.frombuffer(head, "<i8")[1]] + C.widened(k)]
            chosen[kind][0][at], chosen[kind][1][at] = C.widened(rid), C.widened(pos)
        (f, f_pos), (d, d_pos) = ([c[self.run] for c in x] for x in chosen.values())
        other = np.flatnonzero(self.rid != f)
        second = other[(self.rid[other] != d[other]) & (f[other] != d[other])]
        u = np.concatenate([self.rid[other], self.rid[second]])
        v = np.concatenate([f[other], d[second]])
        shift = np.concatenate([self.pos[other] - f_pos[other], self.pos[second] - d_pos[second]])
        if len(u):
            up = u > v  # the later recording stands first
            rows, votes = np.unique(np.stack([np.where(up, u, v), np.where(up, v, u), np.where(up, shift, -shift)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(votes)], ["u", "v", "shift", "votes"])


def _chosen(h: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ordered by hash -> each one's number of hash, and for each hash its first entry and the one whose mixed rid is least."""
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    first, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    if not len(h):
        return run, first, first
    draw = C.mixed(rid.astype(np.int64).view(np.uint64))
    at = np.flatnonzero(draw == np.minimum.reduceat(draw, first)[run])
    return run, first, at[np.concatenate([[True], run[at][1:] != run[at][:-1]])]


def _answers(rows: dict[int, list[tuple]], b: int, n: int) -> Iterator[tuple]:
    """What the slices posted to bucket b -> for each slice the first and the drawn recording of its landmarks, where they are another's."""
    posts = rows.pop(_POSTED, [])
    if not posts:
        return
    number = {row[3]: i for i, row in enumerate(posts)}
    h, rid, pos = C.joined(posts, 0, "<u8"), C.joined(posts, 1), C.joined(posts, 2)
    sizes = np.array([len(row[0]) // 8 for row in posts])
    base = np.cumsum(sizes) - sizes
    d_rid, d_pos = rid.copy(), pos.copy()
    for k, r, p, head in rows.pop(_DRAWN, []):
        at = base[number[head]] + C.widened(k)
        d_rid[at], d_pos[at] = C.widened(r), C.widened(p)
    heads = np.array([np.frombuffer(row[3], "<i8")[0] for row in posts])
    slice_of = np.repeat(np.arange(len(posts)), sizes)
    for kind, r, p, key in ((_FIRST_IS, rid, pos, rid), (_DRAWN_IS, d_rid, d_pos, C.mixed(d_rid.view(np.uint64)))):
        order = np.lexsort((p, key, h))
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[order][1:] != h[order][:-1]
        least = np.empty(len(h), np.int64)
        least[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        at = np.flatnonzero((r[least] != r) | (p[least] != p))
        bounds = np.searchsorted(slice_of[at], np.arange(len(posts) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            some = at[bounds[i] : bounds[i + 1]]
            to = int(C.row_bucket(heads[i : i + 1], n)[0])
            yield to, kind, C.narrow(some - base[i]), C.narrow(r[least[some]]), C.narrow(p[least[some]]), np.array([heads[i], b], "<i8").tobytes()


def _recordings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, rid, items), a slice's rows together -> (slice, rids, counts, items end to end)."""
    held: list[tuple] = []

    def out() -> tuple:
        return held[0][0], *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))

    for batch in batches:
        slices, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        lists = batch.column(2)
        code, counts = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.diff(lists.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(counts)])
        cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0][0] != slices[a]:
                yield out()
                held = []
            held.append((int(slices[a]), rids[a:b], counts[a:b].astype(np.int64), code[ends[a] : ends[b]]))
    if held:
        yield out()


def candidates(prints: DataFrame, n: int | None = None) -> DataFrame:
    """(slice, rid, items) -> (u, v, shift, votes), u > v: item p of u stands where item p - shift of v does."""
    n = n or shuffle_partitions(prints.sparkSession)
    rows = prints.select("slice", "rid", "items")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for number, rids, counts, code in _recordings(batches):
            yield from _Marks(rids, counts, code, n).posts(number)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for number, rids, counts, code in _recordings(batches):
            head = np.array([number], "<i8")
            yield int(C.row_bucket(head, n)[0]), _RECORDINGS, C.narrow(rids), C.narrow(counts), code.tobytes(), head.tobytes()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b, found in _by_bucket(batches):
            yield from _answers(found, b, n)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches):
            told: dict[int, list[tuple]] = {}
            for kind in (_FIRST_IS, _DRAWN_IS):
                for row in found.pop(kind, []):
                    told.setdefault(int(np.frombuffer(row[3], "<i8")[0]), []).append((kind, *row))
            for rids, counts, code, head in found.pop(_RECORDINGS, []):
                marks = _Marks(C.widened(rids), C.widened(counts), np.frombuffer(code, np.uint32), n)
                yield from marks.votes(told.pop(int(np.frombuffer(head, "<i8")[0]), []))

    posted = rows.mapInArrow(lambda b: C.blobs(post(b)), C.BLOB).repartitionById(n, F.col("bucket"))
    answers = posted.mapInArrow(lambda b: C.blobs(answer(b)), C.BLOB)
    own = rows.mapInArrow(lambda b: C.blobs(pack(b)), C.BLOB)
    votes = own.union(answers).repartitionById(n, F.col("bucket")).mapInArrow(vote, LINKS)
    return votes.groupBy("u", "v", "shift").agg(F.sum("votes").alias("votes"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """BLOB rows of a partition -> (bucket, its rows by kind); repartitionById leaves one bucket to a partition."""
    out: dict[int, dict[int, list[tuple]]] = {}
    for batch in batches:
        for b, kind, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            out.setdefault(b, {}).setdefault(kind, []).append(tuple(row))
    while out:
        yield out.popitem()


def errors(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, float, float]:
    """Items of two recordings, a's item p against b's p - shift -> their overlap, its share of wrong bits, and that of its best segment."""
    a, b = a[max(shift, 0) :], b[max(-shift, 0) :]
    n = min(len(a), len(b))
    if n <= 0:
        return 0, 1.0, 1.0
    wrong = np.concatenate([[0], np.cumsum(np.bitwise_count(a[:n] ^ b[:n]).astype(np.int64))])
    k = min(n, SEGMENT)
    return n, wrong[-1] / (32 * n), float((wrong[k:] - wrong[:-k]).min()) / (32 * k)


SCORED = "u long, v long, shift int, votes long, overlap int, bit_error double, segment_error double"


def _scored(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v, shifts array<struct<shift, votes>>) -> SCORED: the pairs that are right enough at an offset, there of those of most votes."""
    side = lambda p: prints.select(F.col("rid").alias(f"{p}_rid"), F.col("items").alias(f"{p}_items"))
    both = pairs.join(side("u"), F.col("u") == F.col("u_rid")).join(side("v"), F.col("v") == F.col("v_rid")).select("u", "v", "shifts", "u_items", "v_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(c.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.concatenate([[0], np.cumsum(np.diff(c.offsets.to_numpy()))])) for c in (batch.column(3), batch.column(4))]
            (x, p), (y, q) = lists
            rows = []
            for i, (u, v, shifts) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                for s in sorted(shifts, key=lambda s: (-s["votes"], abs(s["shift"]), -s["shift"])):
                    found = errors(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]], s["shift"])
                    if found[2] <= MAX_ERROR:
                        rows.append((u, v, s["shift"], s["votes"], *found))
                        break
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCORED.split(", ")])

    return both.mapInArrow(run, SCORED)


#: Bits of the table of landmarks that are looked up again, as a power of two: 16 MB at most, whatever their number.
_LOOKED_UP = 27


def _places(prints: DataFrame, table: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(slice, rid, items) -> (h, rid, pos) of all landmarks, or of those whose bit is in the table and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        if table is not None:
            bits = np.zeros(1 << (_LOOKED_UP - 6), np.uint64)
            bits[table[0]] = table[1]
        for _, rids, counts, code in _recordings(batches):
            h, rid, pos = _hashed(rids, counts, code)
            if bits is not None:
                keep = (bits[h >> C.U(70 - _LOOKED_UP)] >> (h & C.U(63))) & C.U(1) == 1
                h, rid, pos = h[keep], rid[keep], pos[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid, pa.int64()), pa.array(pos.astype(np.int32))], ["h", "rid", "pos"])

    return prints.select("slice", "rid", "items").mapInArrow(run, "h long, rid long, pos int")


def _apart(prints: DataFrame, best: DataFrame, first: DataFrame) -> DataFrame | None:
    """SCORED of all right pairs that share a landmark and are in different groups of the links found first; None if no two are."""
    groups = checkpoint(components(first.select("u", "v")))
    group = lambda p: groups.select(F.col("node").alias(f"{p}_node"), F.col("root").alias(f"{p}_root"))
    told = best.join(group("u"), F.col("u") == F.col("u_node"), "left").join(group("v"), F.col("v") == F.col("v_node"), "left")
    # the first of a landmark has the smallest rid, so it is v
    outside = checkpoint(told.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select(F.col("u").alias("outside")).distinct())
    if outside.isEmpty():
        return None
    own = _places(prints.join(C.small(outside), F.col("rid") == F.col("outside"), "left_semi"))
    word = F.shiftrightunsigned("h", 70 - _LOOKED_UP).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    found = own.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # 16 MB of bits at most
    places = _places(prints, (found["word"].to_numpy(), found["bits"].to_numpy().view(np.uint64)))
    places = places.join(group("g"), F.col("rid") == F.col("g_node"), "left").select("h", "rid", "pos", F.coalesce("g_root", "rid").alias("label"))
    places = checkpoint(places)
    held = places.groupBy("h", "label").agg(F.count("*").alias("times"))
    mixed = held.groupBy(F.col("h").alias("m")).agg(F.max_by("label", F.struct("times", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    rest = checkpoint(places.join(mixed, F.col("h") == F.col("m")).select("h", "rid", "pos", "label", "most"))
    other = rest.select(F.col("h").alias("k"), F.col("rid").alias("y"), F.col("pos").alias("py"), F.col("label").alias("other"))
    # two outsiders meet once, an outsider and one of the largest group too
    across = (F.col("h") == F.col("k")) & (F.col("label") != F.col("other")) & ((F.col("other") == F.col("most")) | (F.col("rid") < F.col("y")))
    met = rest.where("label <> most").join(other, across)
    shift = F.when(F.col("rid") > F.col("y"), F.col("pos") - F.col("py")).otherwise(F.col("py") - F.col("pos")).alias("shift")
    votes = met.select(F.greatest("rid", "y").alias("u"), F.least("rid", "y").alias("v"), shift).groupBy("u", "v", "shift").agg(F.count("*").alias("votes"))
    return _scored(votes.groupBy("u", "v").agg(F.collect_list(F.struct("shift", "votes")).alias("shifts")), prints)


def links(prints: DataFrame, n: int | None = None) -> DataFrame:
    """(slice, rid, items) -> SCORED: pairs with one of the two chosen of each landmark, at the offset that most of their landmarks agree
    on, and all pairs of different groups that share a landmark, at any offset; those whose best segment is right enough."""
    best = candidates(prints, n).groupBy("u", "v").agg(F.max(F.struct("votes", (-F.abs("shift")).alias("ns"), "shift")).alias("b"))
    best = checkpoint(best.select("u", "v", F.array(F.struct("b.shift", "b.votes")).alias("shifts")))
    first = checkpoint(_scored(best, prints))
    rest = _apart(prints, best, first)
    return first if rest is None else first.union(rest)


def aligned(media: DataFrame) -> DataFrame:
    """(rid, audio) -> (rid, n_items, group, align_rid, shift, votes, overlap, bit_error, segment_error): each recording's group, and its
    alignment with the recording that it shares most landmarks with, null for one that isn't linked to one before it."""
    prints = checkpoint(fingerprints(media))
    whole = copies(prints).join(prints.select(F.col("rid").alias("w_rid"), F.size("items").alias("overlap")), F.col("u") == F.col("w_rid"))
    right = F.when(F.col("overlap") > 0, 0.0)
    found = links(prints, C.buckets(media, "audio")).union(whole.select("u", "v", "shift", "votes", "overlap", right.alias("bit_error"), right.alias("segment_error")))
    found = checkpoint(found)
    groups = components(found.select("u", "v"))
    best = found.groupBy("u").agg(F.max(F.struct("votes", (-F.col("v")).alias("nv"), "shift", "overlap", "bit_error", "segment_error")).alias("b"))
    best = best.select("u", (-F.col("b.nv")).alias("align_rid"), "b.shift", "b.votes", "b.overlap", "b.bit_error", "b.segment_error")
    rows = prints.select("rid", F.size("items").alias("n_items"))
    rows = rows.join(groups, rows["rid"] == groups["node"], "left").join(best, rows["rid"] == best["u"], "left")
    return rows.select("rid", "n_items", F.coalesce("root", "rid").alias("group"), "align_rid", "shift", "votes", "overlap", "bit_error", "segment_error")


def op3_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no audio: the UTF-8 bytes of each document stand for a recording of 8-bit samples."""
    rows, distinct = C.with_row_ids(table(spark, sf_dir, "documents"))
    got = aligned(distinct.select("rid", F.col("text").cast("binary").alias("audio")))
    ids = rows.select(F.col("rid").alias("id"), "doc_id")
    got = got.join(ids, got["rid"] == ids["id"])
    names = ids.select(F.col("id").alias("g"), F.col("doc_id").alias("component_id")).distinct()
    got = got.join(names, got["group"] == names["g"])
    other = ids.select(F.col("id").alias("a"), F.col("doc_id").alias("align_id")).distinct()
    got = got.join(other, got["align_rid"] == other["a"], "left")
    return got.select("doc_id", "n_items", "component_id", "align_id", "shift", "votes", "overlap", F.round("bit_error", 6).alias("bit_error"), F.round("segment_error", 6).alias("segment_error"))
