"""Suffix dedup: suffixes are told apart in passes, only through their first `length` bytes.

Departure from a radix sort on the bytes: one entry for each suffix and 8-byte digit is 14 times the input, so only suffixes at
anchors are dealt, and a pass's digit is the hash of a stretch of bytes instead of the bytes. Suffixes that
stand alone after a pass are done; those that still tie go on to the next. What ties at the end is
compared by its bytes, so the groups of equal windows are exact (see matches).

Digit 1, anchors. A window of `length` bytes holds length - GRAM + 1 grams of GRAM bytes. Its anchor is
its gram of smallest hash (the leftmost of equals), so equal windows have their anchors at the same
offset. Windows that lie next to each other mostly share an anchor, about 27 of them, and travel as
one stretch, keyed by the anchor's gram. Stretches whose gram is found once are done.
Digit 2, stretches. Among stretches with the same gram, those that agree in their whole and in
the anchor's offset are ordered by position; all but the first claim to repeat it.
Digit 3, windows. Where a gram's stretches differ, the first of each kind is opened, and its windows
are dealt by all of their bytes; all but a window's first place claim to repeat it. This happens only near
the ends of repeated passages.
Confirmation. Claims that continue each other are joined into runs; a run is removed if its bytes are the claimed ones.

Each slice of documents makes these passes over its own rows first and sends on one row for each
gram, stretch or window, so that a passage that a third of all documents share reaches its bucket
once for each slice; a bucket folds what it gets, so it holds each different stretch once. Grams that differ within
one slice are sent as a mark, and their stretches go straight to digit 3.

Defined results
- null text: empty. Texts shorter than `length`: nothing is removed.
- rows that share a doc_id (or null ids, which come first) are ordered by the hash of their text;
  equal rows are one document and share its result.
- a long text is dealt in pieces that overlap; the last step holds one text.
- an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.llm import matches as M
from pagewright.sources.session import checkpoint, prepare_workers, table

LENGTH = 100
GRAM = 48
#: Bytes of text in a worker's arrays at a time.
PIECE = 3 << 18
_STRETCHES, _MARKS, _OPEN, _WINDOWS = 0, 1, 2, 3


class Rolling:
    """Hashes of all stretches of one width, from prefix sums modulo 2**64: cheap, so that each byte may begin one.

    Long texts of a special form collide (their difference has many factors of two); what ties is compared by its bytes.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 4 + 3
        self.byte = rng.integers(1 << 63, size=256, dtype=np.uint64) * C.U(2) + C.U(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def _grown(powers: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(powers) < n:
            powers = np.concatenate([powers, powers * C.U(pow(base, len(powers), 1 << 64))])
        return powers

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.powers = self._grown(self.powers, self.base, n + 1)
        self.inverses = self._grown(self.inverses, pow(self.base, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        terms = self.byte[data]
        terms *= self.powers[:n]
        np.cumsum(terms, out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of data[start:end], wherever it stands."""
        return C.mixed((sums[end] - sums[start]) * self.inverses[start])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        h = sums[width:] - sums[:-width]
        h *= self.inverses[: len(h)]
        return C.mixed(h)


_HASH = Rolling(21)



def _pieces(batches, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Slices; a very long document comes as overlapping pieces, each with its windows' first start."""
    for rids, data, offsets in C.slices(batches, PIECE):
        if len(rids) > 1 or len(data) <= 2 * PIECE:
            yield rids, data, offsets, 0
            continue
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            yield rids, part, np.array([0, len(part)]), at


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i+width] for every i at which that many are left."""
    n = len(x)
    cells = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    cells[:n] = x
    cells = cells.reshape(-1, width)
    left = np.minimum.accumulate(cells, 1).reshape(-1)[width - 1 : n].copy()
    right = cells[:, ::-1]
    np.minimum.accumulate(right, 1, out=right)
    return np.minimum(left, cells.reshape(-1)[: n - width + 1], out=left)


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, bits: int):
    """Stretches of windows that share an anchor: (document, first start, windows, gram's hash, stretch's hash)."""
    sums = _HASH.prefix(data)
    grams = _HASH.windows(sums, gram)
    place = C.U((1 << max(24, len(data).bit_length())) - 1)
    keys = grams & ~place
    keys |= np.arange(len(grams), dtype=np.uint64)
    anchor = _sliding_min(keys, length - gram + 1)
    del keys
    anchor &= place
    anchor = anchor.view(np.int64)
    start = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, offsets[:-1])
    start = start[start < len(anchor)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(anchor)), offsets[doc + 1] - length + 1)
    some = end > start
    doc, start, end = doc[some], start[some], end[some]
    anchor = anchor[start]
    shape = (anchor - start).astype(np.uint64) << C.U(32) | (end - start).astype(np.uint64)
    return doc, start, end - start, grams[anchor], C.mixed(_HASH.of(sums, start, end - 1 + length) + C.mixed(shape)) & _masked(bits)


def _masked(bits: int) -> np.uint64:
    return C.U((1 << 64) - (1 << (64 - bits)))


def _fresh(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the sorted columns take new values."""
    out = np.ones(len(sorted_columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return out


def _ties(g: np.ndarray, c: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the stretches by gram, stretch and position; which are first of their stretch; which grams have several."""
    order = np.lexsort((start, rid, c, g))
    g, c = g[order], c[order]
    first = _fresh(g, c)
    group = np.cumsum(_fresh(g)) - 1
    several = np.bincount(group, first)[group] > 1 if len(g) else first
    return order, first, several


def _heads(first: np.ndarray) -> np.ndarray:
    """For each place the last one before it, or itself, that is a first."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.empty(0, np.int64)


def _bucket(g: np.ndarray, n: int) -> np.ndarray:
    """Anchors are grams of small hash, so the hash itself isn't even."""
    return C.bucket_of(C.mixed(g ^ C.U(0x5851F42D4C957F2D)), n)


def _digit_1(length: int, gram: int, n: int, bits: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rids, data, offsets, base in _pieces(batches, length):
            if len(data) < length:
                continue
            doc, start, count, g, c = _anchored(data, offsets, length, gram, bits)
            rid, start = rids[doc], start - offsets[doc] + base
            order, first, several = _ties(g, c, rid, start)
            g, c, rid, start, count = g[order], c[order], rid[order], start[order], count[order]
            again, of = ~first, _heads(first)[~first]
            yield from M.claim_rows(rid[again], start[again], count[again], rid[of], start[of], n)
            opened = first & several
            yield from C.span_rows(rid[opened], start[opened], start[opened] + count[opened], n, _OPEN)
            marks = np.unique(g[opened])
            for b, (m,) in C.dealt(_bucket(marks, n), n, marks):
                yield b, _MARKS, m.tobytes()
            alone = first & ~several
            g, c, rid, start, count = (x[alone] for x in (g, c, rid, start, count))
            order = np.lexsort((start, rid))
            g, c, rid, start, count = (x[order] for x in (g, c, rid, start, count))
            for b, (x, y, r, s, k) in C.dealt(_bucket(g, n), n, g, c, rid, start, count):
                yield b, _STRETCHES, x.tobytes() + y.tobytes(), C.narrow(r), s.astype("<u4" if s.max() < 1 << 32 else "<u8").tobytes(), k.astype("<u1" if k.max() < 1 << 8 else "<u2").tobytes()

    return lambda batches: C.blobs(found(batches))


def _stretches(a: bytes, b: bytes, c: bytes, d: bytes) -> tuple[np.ndarray, ...]:
    """A row of stretches -> stretch's hash, rid, start, windows, gram's hash."""
    n = len(a) // 16
    return np.frombuffer(a, "<u8", offset=8 * n), C.widened(b), np.frombuffer(c, f"<u{len(c) // n}").astype(np.int64), np.frombuffer(d, f"<u{len(d) // n}").astype(np.uint16), np.frombuffer(a, "<u8", n)


def _digit_2(n: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fold, marks = M.Fold(n, inside=True), [np.empty(0, np.uint64)]
        for kind, a, b, c, d in C.entries(batches):
            if kind == M.CLAIMS:
                yield from M.claim_rows(*M.claims_from([(a, b, c, d)]), n)
            elif kind == _OPEN:
                yield from C.span_rows(*C.spans_from([(a, b, c)]), n, _OPEN)
            elif kind == _MARKS:
                marks.append(np.frombuffer(a, "<u8"))
            else:
                yield from fold.add(*_stretches(a, b, c, d))
        yield from fold.folded()
        if fold.kept:
            _, rid, start, count, g = fold.kept
            order = np.argsort(g)
            ordered = g[order]
            tied = np.isin(ordered, np.unique(np.concatenate(marks)))
            same = ordered[1:] == ordered[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            some = order[tied]
            yield from C.span_rows(rid[some], start[some], start[some] + count[some], n, _OPEN)

    return lambda batches: C.blobs(found(batches))


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CLAIMS and OPEN rows of one bucket -> FOUND with the kind."""
    rows = C.gathered(batches)
    opened = rows.pop(_OPEN, [])
    for batch in M.found_in(rows):
        yield batch.append_column("kind", pa.array([M.CLAIMS] * batch.num_rows, pa.int32()))
    for batch in M.found_in({C.SPANS: opened}):
        yield batch.append_column("kind", pa.array([_OPEN] * batch.num_rows, pa.int32()))


def _digit_3(length: int, n: int, bits: int):
    """(rid, text, the starts of open windows as spans) -> windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["i", "text"])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows_at, data, offsets, base in _pieces([rows], length):
                if len(data) < length:
                    continue
                starts, docs = [], []
                for i, offset, end in zip(rows_at.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for a, b in np.frombuffer(spans[i], "<i8").reshape(-1, 2).tolist():
                        a, b = max(a, base), min(b, base + end - offset - length + 1)
                        if a < b:
                            starts.append(np.arange(a, b) - base + offset)
                            docs.append(np.full(b - a, i))
                if not starts:
                    continue
                at, doc = np.concatenate(starts), np.concatenate(docs)
                x = _HASH.of(_HASH.prefix(data), at, at + length) & _masked(bits)
                offset = offsets[:-1][np.searchsorted(rows_at, doc)]
                rid, start = ids[doc], at - offset + base
                order = np.lexsort((start, rid, x))
                x, rid, start = x[order], rid[order], start[order]
                first = _fresh(x)
                of = _heads(first)[~first]
                yield from M.claim_rows(rid[~first], start[~first], np.ones(len(of), np.int64), rid[of], start[of], n)
                x, rid, start = x[first], rid[first], start[first]
                order = np.lexsort((start, rid))
                x, rid, start = x[order], rid[order], start[order]
                for b, (p, r, s) in C.dealt(C.bucket_of(x, n), n, x, rid, start):
                    yield b, _WINDOWS, p.tobytes(), C.narrow(r), C.narrow(s)

    return lambda batches: C.blobs(found(batches))


def _last(n: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fold = M.Fold(n, inside=True)
        for kind, a, b, c, d in C.entries(batches):
            if kind == M.CLAIMS:
                yield from M.claim_rows(*M.claims_from([(a, b, c, d)]), n)
            else:
                x = np.frombuffer(a, "<u8")
                yield from fold.add(x, C.widened(b), C.widened(c), np.ones(len(x), np.uint8))
        yield from fold.folded()

    return lambda batches: C.blobs(found(batches))


def windows_of(length: int, bits: int) -> M.Windows:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rids, data, offsets, base in _pieces(batches, length):
            doc = np.repeat(np.arange(len(rids)), np.maximum(np.diff(offsets) - length + 1, 0))
            if not len(doc):
                continue
            pos = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(rids)))[doc]
            at = offsets[:-1][doc] + pos
            yield rids, lambda i, d=data, at=at: d[at[i] : at[i] + length].tobytes(), doc, pos + base, _HASH.of(_HASH.prefix(data), at, at + length) & _masked(bits)

    return M.Windows(length, M.Text, hashes)


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = 64, n: int | None = None) -> DataFrame:
    """(rid, doc_id, text) -> claims of windows that also start earlier, as matches.FOUND."""
    if not 1 <= gram <= length < 1 << 16:
        raise ValueError("1 <= gram <= length < 65536")
    n = n or C.buckets(rows)
    prepare_workers(rows.sparkSession)
    C.bounded_batches(rows)
    bucket = F.col("bucket")
    deep = rows.select("rid", "text").mapInArrow(_digit_1(length, gram, n, bits), C.BLOB).repartitionById(n, bucket).mapInArrow(_digit_2(n), C.BLOB)
    known = checkpoint(deep.repartitionById(n, bucket).mapInArrow(_by_document, M.FOUND + ", kind int"))
    opened = known.where(F.col("kind") == _OPEN).select(F.col("rid").alias("o_rid"), F.col("spans").alias("opened"))
    # with doc_id, so that the texts' exchange is the one that the confirmation and the removal read too
    windows = rows.join(opened, rows["rid"] == opened["o_rid"]).select("rid", "text", "opened", "doc_id").mapInArrow(_digit_3(length, n, bits), C.BLOB)
    last = windows.repartitionById(n, bucket).mapInArrow(_last(n), C.BLOB).repartitionById(n, bucket).mapInArrow(M.by_document, M.FOUND)
    return known.where(F.col("kind") == M.CLAIMS).drop("kind").union(last)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: bool = True, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) of every row; the same for any number of hash bits.

    kept_bytes is binary: removal may cut through characters.
    """
    rows, distinct = C.with_row_ids(docs)

    def result(text: M.Text, gone: list[tuple[int, int]]) -> tuple:
        rest = text.without(gone)
        return (text.size, text.size - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), *[rest] * kept)

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * kept
    return M.applied(rows, distinct, repeats(distinct, length, gram, bits), windows_of(length, bits), True, result, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), kept=False)
