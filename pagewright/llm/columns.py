"""Array helpers for operators that look at every position of every text.

Texts arrive as Arrow batches and are cut into slices of whole documents, so that a worker holds a
few megabytes of text and its arrays at a time. What a slice finds is dealt to buckets by hash and
shuffled as one row for each (slice, bucket) whose binary columns hold whole arrays.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.session import checkpoint, shuffle_partitions

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE = 4 << 20
#: Bytes of text whose windows share a bucket.
BUCKET = 64 << 20
U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def numbered(docs: DataFrame, text: str = "text", rid: str = "rid") -> tuple[DataFrame, bool]:
    """The rows with rid, unique for each different (doc_id, text) and ascending with doc_id; whether rid is unique.

    Where doc_id has neither nulls nor repeats, rid is doc_id. Else the pairs are sorted by doc_id,
    nulls first, then by the text's hash, and numbered in that order; equal rows share a rid.
    """
    found = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if found["most"] <= 1 and not found["nulls"]:
        return docs.withColumn(rid, F.col("doc_id").cast("long")).where(F.col(rid).isNotNull()), True  # none is null; the plan shows it
    keys = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col(text).cast("string")).alias("__th")]
    ids = docs.select(*keys).distinct().orderBy(F.col("__id").asc_nulls_first(), "__th").withColumn(rid, F.monotonically_increasing_id())
    ids = checkpoint(ids)
    same = docs["doc_id"].cast("long").eqNullSafe(ids["__id"]) & (F.xxhash64(docs[text].cast("string")) == ids["__th"])
    return docs.join(ids, same).drop("__id", "__th"), False


#: What modules of this package remember between a worker's tasks.
_REMEMBERED: list[dict] = []


def remembered() -> dict:
    """A dictionary that release() empties."""
    _REMEMBERED.append({})
    return _REMEMBERED[-1]


def release() -> None:
    """Drop what a worker remembers of other operators, and give what it has freed back to the system, ahead of a task that needs its memory."""
    for held in _REMEMBERED:
        held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def with_row_ids(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, text) of every row, and the same with one row for each rid; see numbered()."""
    rows, unique = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return rows, rows if unique else rows.dropDuplicates(["rid"])


#: Up to so many rows of a few numbers each are broadcast; they are counted first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Most bits of the map by which having() and lacking() tell rows from many ids (16 MB), bits for each id, and bits of one of its rows.
MAP_BITS, BITS_EACH, ROW_BITS = 27, 16, 15


def _mapped(rows: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows with __maybe: false only of those whose key is not among the n ids."""
    bits = min(MAP_BITS, max(ROW_BITS, (BITS_EACH * n).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    at = lambda c: F.shiftright(slot(c), ROW_BITS)
    place = lambda c: slot(c).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    bitmap = checkpoint(ids.groupBy(at(ids.columns[0]).alias("__at")).agg(F.bitmap_construct_agg(place(ids.columns[0])).alias("__map")))
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.shiftright(place(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    some = rows.join(F.broadcast(bitmap), at(key) == F.col("__at"), "left")
    return some.withColumn("__maybe", F.coalesce(F.getbit(byte, F.pmod(place(key), F.lit(8)).cast("int")) == 1, F.lit(False))).drop("__at", "__map")


def having(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key, a long that isn't null, is among the ids (of one column, of another name).

    Few ids are broadcast. Of many, a map of their hashes goes to all rows first, and only rows that it takes for one of them are shuffled, to be joined.
    """
    ids = checkpoint(ids)
    if (n := ids.count()) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), F.col(key) == F.col(ids.columns[0]), "left_semi")
    maybe = _mapped(rows, key, ids, n).where("__maybe").drop("__maybe")
    return maybe.join(ids, F.col(key) == F.col(ids.columns[0]), "left_semi")


def lacking(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key isn't among the ids; see having()."""
    ids = checkpoint(ids)
    if (n := ids.count()) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), F.col(key) == F.col(ids.columns[0]), "left_anti")
    mapped = _mapped(rows, key, ids, n)
    maybe = mapped.where("__maybe").join(ids, F.col(key) == F.col(ids.columns[0]), "left_anti")
    return mapped.where("not __maybe").union(maybe).drop("__maybe")


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rid, text) batches -> (rids, bytes, offsets) of whole documents; null texts are empty."""
    ids: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = 0

    def out():
        n = np.concatenate(lengths)
        offsets = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=offsets[1:])
        return np.concatenate(ids), np.concatenate(parts), offsets

    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = batch.column(1)
        text = text.cast(pa.large_binary()).fill_null(b"") if text.null_count else text.cast(pa.large_binary())
        buffers = text.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(rids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size - held, "right")) - 1)
            if ids and offsets[min(j, len(rids))] - offsets[i] + held > 2 * size:
                yield out()
                ids, parts, lengths, held = [], [], [], 0
                continue
            j = min(j, len(rids))
            ids.append(rids[i:j])
            parts.append(data[offsets[i] : offsets[j]])
            lengths.append(np.diff(offsets[i : j + 1]))
            held += int(offsets[j] - offsets[i])
            i = j
            if held >= size:
                yield out()
                ids, parts, lengths, held = [], [], [], 0
    if ids:
        yield out()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, one to one."""
    x = x ^ (x >> U(31))
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


#: The prime of the window hashes, 2**61 - 1, in which reductions are shifts and additions.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = U(PRIME), U((1 << 31) - 1), U((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo PRIME."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo PRIME, for x below it.

    >>> int(times(np.array([PRIME - 1], np.uint64), 3)[0]) == 3 * (PRIME - 1) % PRIME
    True
    """
    high, low = U(factor >> 31), U(factor & ((1 << 31) - 1))
    a, b = x >> U(31), x & _LOW31
    middle = a * low + b * high
    return reduced(U(2) * a * high + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + b * low)


class RabinKarp:
    """Rabin-Karp hashes of every window of a sequence: polynomials over a prime field at a fixed random point.

    Two different windows of w values collide for at most w of the field's 2**61 points, whatever the values are.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 32, PRIME))
        self.byte = rng.integers(1, PRIME, size=256, dtype=np.uint64)

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of values[i:i+width] for every i at which that many are left; values: bytes, or numbers below PRIME.

        Windows of 1, 2, 4 ... values are joined from two halves each, and the width from these.
        """
        part = self.byte[values] if values.dtype == np.uint8 else values
        n = max(0, len(values) - width + 1)
        out, done, size = None, 0, 1
        while True:
            if width & size:
                # what is joined so far stands before the part
                if out is None:
                    out = part
                else:
                    out = reduced(times(part[: len(part) - done], pow(self.base, done, PRIME)) + out[size : len(part) - done + size])
                done += size
            if 2 * size > width:
                break
            part = reduced(times(part[: len(part) - size], pow(self.base, size, PRIME)) + part[size:])
            size *= 2
        return mixed(out[:n])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words [^\\x20\\x09-\\x0D]+; none spans documents."""
    solid = ~WHITE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = np.unique(offsets[1:-1])
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def narrow(x: np.ndarray) -> bytes:
    """Integers as differences, in the narrowest type that holds them; the type comes first."""
    d = np.diff(x.astype(np.int64), prepend=0)
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        if not len(d) or (d[1:].min(initial=0) >= info.min and d[1:].max(initial=0) <= info.max):
            head = d[:1].astype("<i8").tobytes()
            return kind[2].encode() + head + d[1:].astype(kind).tobytes()
    raise AssertionError


def widened(b: bytes) -> np.ndarray:
    """What narrow() was given.

    >>> widened(narrow(np.array([5, -1, 1 << 40]))).tolist()
    [5, -1, 1099511627776]
    """
    if len(b) < 9:
        return np.empty(0, np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(b, "<i8", 1, 1), np.frombuffer(b, "<i" + chr(b[0]), offset=9).astype(np.int64)]))


def dealt(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, the columns' values there, in order) for each bucket that has any."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), [c[bounds[b] : bounds[b + 1]] for c in columns]


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    """Buckets below n of 64-bit hashes, by their high bits."""
    return ((x >> U(32)) * U(n) >> U(32)).astype(np.int64)


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    return rows.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def buckets(rows: DataFrame, text: str = "text") -> int:
    """How many buckets the windows of these texts go to: the session's shuffle partitions, or more for BUCKET bytes of text in each."""
    return max(shuffle_partitions(rows.sparkSession), -(-text_bytes(rows, text) // BUCKET))


def row_bucket(rid: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mixed(rid.astype(np.int64).view(np.uint64) + U(1)), n)


#: Rows that travel between the steps: a bucket, what the row holds, and arrays.
BLOB = "bucket int, kind int, a binary, b binary, c binary, d binary"
_NAMES = ["bucket", "kind", "a", "b", "c", "d"]
_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 4]


def blobs(rows: Iterable[tuple], flush: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, kind, up to four byte strings) -> batches of BLOB."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        cols = zip(*[(*r, *[None] * (6 - len(r))) for r in held], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)

    for row in rows:
        held.append(row)
        size += sum(map(len, row[2:]))
        if size >= flush:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """BLOB rows one by one, without their bucket."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)


def gathered(batches: Iterable[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """The rows of one bucket by kind: kind -> [(a, b, c, d), ...]."""
    out: dict[int, list[tuple]] = {}
    for batch in batches:
        d = batch.to_pydict()
        for kind, *row in zip(d["kind"], d["a"], d["b"], d["c"], d["d"], strict=True):
            out.setdefault(kind, []).append(tuple(row))
    return out


def joined(rows: list[tuple], column: int, kind: str | None = None) -> np.ndarray:
    """One column of gathered rows, end to end; kind: its numpy type, or none if narrow() wrote it."""
    parts = [np.frombuffer(r[column], kind) if kind else widened(r[column]) for r in rows]
    return np.concatenate(parts) if parts else np.empty(0, kind or np.int64)


def reach(rid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The running maximum of end, which starts anew with each row; rows stand together."""
    shift = np.zeros(len(rid), np.int64)
    shift[1:] = np.cumsum(rid[1:] != rid[:-1])
    shift *= int(end.max(initial=0)) + 1
    return np.maximum.accumulate(end + shift) - shift


def merged(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of rows -> maximal stretches, ordered; those that touch or overlap are joined."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    far = reach(rid, end)
    fresh = np.ones(len(rid), bool)
    fresh[1:] = (rid[1:] != rid[:-1]) | (start[1:] > far[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(rid)) - 1
    return rid[first], start[first], far[last]


def runs(rid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered positions -> (rid, first, count) of consecutive ones."""
    if not len(rid):
        return rid, pos, pos
    fresh = np.ones(len(rid), bool)
    fresh[1:] = (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(fresh)
    return rid[first], pos[first], np.diff(np.append(first, len(rid)))


#: Kinds of BLOB rows that hold stretches of documents: (rids, starts, ends).
SPANS = 9


def span_rows(rid: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, kind: int = SPANS) -> Iterator[tuple]:
    """Stretches, dealt by rid."""
    for b, (r, s, e) in dealt(row_bucket(rid, n), n, rid, start, end):
        yield b, kind, narrow(r), narrow(s), narrow(e - s)


def spans_from(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rid, start = joined(rows, 0), joined(rows, 1)
    return rid, start, start + joined(rows, 2)


def spans_by_row(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Merged stretches -> one row (rid, spans) for each rid; spans: its starts and ends, as int64 pairs."""
    rid, start, end = merged(rid, start, end)
    first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.empty(0, np.int64)
    pairs = np.stack([start, end], 1).astype("<i8")
    bounds = np.append(first, len(rid))
    for i in range(0, len(first), 4096):
        some = range(i, min(i + 4096, len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(rid[first[i : i + 4096]], pa.int64()), pa.array([pairs[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary())], ["rid", "spans"])


ROW_SPANS = "rid long, spans binary"


def collect_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All SPANS rows of one bucket -> ROW_SPANS."""
    yield from spans_by_row(*spans_from(gathered(batches).get(SPANS, [])))


def bounded_batches(df: DataFrame) -> None:
    """Keep Arrow batches small in bytes, whatever the texts' lengths."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
