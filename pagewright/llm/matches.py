"""Repeated stretches of texts: claims made by hash, confirmed on the texts, settled by digest where a hash erred.

A claim says that `n` windows of a row, from `start` on, equal those of row `of` from `at` on. It comes from equal
hashes, so it may be false. Claims that continue each other are joined into runs, and a run is confirmed
by the digest (128 bits of BLAKE2b) of the very bytes that it covers on either side. Windows of runs that differ are
contested: all windows with their hashes are looked up again and told apart by their digests.
So hashes decide what is compared, and never what is removed.

Texts are sequences of units (words or bytes); a window is `width` units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.sources.session import checkpoint

#: Kinds of BLOB rows: (rid, start, of and at, n) of claims.
CLAIMS = 8
FOUND = "rid long, start long, n long, of long, at long, spans binary"
_FOUND = [pa.int64()] * 5 + [pa.binary()]
#: Contested hashes looked up at a time.
HASHES = 1 << 20
#: Bytes of a bucket's entries that are folded at once, at least.
FOLD = 64 << 20


class Text:
    """A text's units: get(a, b) is the bytes of units a to b, whole(spans) what is left without these."""

    def __init__(self, text: bytes) -> None:
        self.text, self.size = text, len(text)

    def get(self, a: int, b: int) -> bytes:
        return self.text[a:b]

    def without(self, spans: list[tuple[int, int]]) -> bytes:
        out, at = [], 0
        for a, b in spans:
            out.append(self.text[at:a])
            at = b
        return b"".join([*out, self.text[at:]])


class Words(Text):
    """Words, joined by single spaces."""

    PART = 4 << 20

    def __init__(self, text: bytes) -> None:
        self.text = text
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        data = np.frombuffer(text, np.uint8)
        for a in range(0, len(data), self.PART):
            solid = np.concatenate([[a > 0 and not C.WHITE[data[a - 1]]], ~C.WHITE[data[a : a + self.PART]], [False]])
            edge = solid[1:] != solid[:-1]
            if a + self.PART < len(data):
                edge[-1] = False
            at = np.flatnonzero(edge) + a
            ends = ~solid[1:][at - a]
            parts.append((at[~ends], at[ends]))
        self.starts = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        self.ends = np.concatenate([p[1] for p in parts]) if parts else self.starts
        self.size = len(self.starts)

    def get(self, a: int, b: int) -> bytes:
        return b" ".join(self.text[self.starts[a] : self.ends[b - 1]].split()) if a < b else b""

    def without(self, spans: list[tuple[int, int]]) -> bytes:
        out, at = [], 0
        for a, b in [*spans, (self.size, self.size)]:
            if at < a:
                out.append(self.get(at, a))
            at = b
        return b" ".join(out)


@dataclass(frozen=True)
class Windows:
    """What windows are made of: hashes() yields (rids, text, document numbers, positions, hashes) of slices; text(i): window i's bytes."""

    width: int
    units: type[Text]
    hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]


def claim_rows(rid: np.ndarray, start: np.ndarray, n: np.ndarray, of: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Claims, joined where they continue each other, dealt by row."""
    rid, start, n, of, at = continued(rid, start, n, of, at)
    for b, (r, s, k, o, a) in C.dealt(C.row_bucket(rid, buckets), buckets, rid, start, n, of, at):
        yield b, CLAIMS, C.narrow(r), C.narrow(s), C.narrow(k), C.narrow(r - o) + C.narrow(s - a)


def continued(rid: np.ndarray, start: np.ndarray, n: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims of the same two rows at the same distance become one where they touch or overlap."""
    order = np.lexsort((start, start - at, of, rid))
    rid, start, n, of, at = (x[order] for x in (rid, start, n, of, at))
    if not len(rid):
        return rid, start, n, of, at
    fresh = np.ones(len(rid), bool)
    fresh[1:] = (rid[1:] != rid[:-1]) | (of[1:] != of[:-1]) | (start[1:] - at[1:] != start[:-1] - at[:-1])
    group = np.cumsum(fresh) - 1
    _, first, reach = C.merged(group, start, start + n)
    # a run's first claim is the one that starts with it
    head = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > C.reach(group, start + n)[:-1])]))
    return rid[head], first, reach - first, of[head], at[head]


def claims_from(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    parts = []
    for a, b, c, d in rows:
        rid, start, n = C.widened(a), C.widened(b), C.widened(c)
        if not len(rid):
            continue
        of_size = 9 + (len(rid) - 1) * int(chr(d[0]))
        parts.append((rid, start, n, rid - C.widened(d[:of_size]), start - C.widened(d[of_size:])))
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(5))


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All SPANS and CLAIMS rows of one bucket -> FOUND: what is known to be repeated, and runs."""
    yield from found_in(C.gathered(batches))


def found_in(rows: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
    for batch in C.spans_by_row(*C.spans_from(rows.pop(C.SPANS, []))):
        nothing = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[nothing] * 4, batch.column(1)], [x.split()[0] for x in FOUND.split(", ")])
    runs = continued(*claims_from(rows.pop(CLAIMS, [])))
    for i in range(0, len(runs[0]), 1 << 16):
        some = [pa.array(x[i : i + (1 << 16)], pa.int64()) for x in runs]
        yield pa.RecordBatch.from_arrays([*some, pa.nulls(len(some[0]), pa.binary())], [x.split()[0] for x in FOUND.split(", ")])


class Fold:
    """The entries of a bucket, taken in parts: of equal windows the first stays, the others become claims on it.

    What is held grows with the different windows of a bucket only, however often one of them comes. inside: whether an
    earlier window of the same row counts too; where it doesn't, all of the first row's stay. Methods give rows of claims.
    """

    def __init__(self, buckets: int, inside: bool) -> None:
        self.buckets, self.inside = buckets, inside
        #: hash, rid, position, windows in it, and what the caller adds
        self.kept: list[np.ndarray] = []
        self.parts: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, *entries: np.ndarray) -> Iterator[tuple]:
        self.parts.append(list(entries))
        self.held += sum(x.nbytes for x in entries)
        if self.held > max(FOLD, sum(x.nbytes for x in self.kept)):
            yield from self.folded()

    def folded(self) -> Iterator[tuple]:
        if not self.parts:
            return
        parts = [self.kept] * bool(self.kept) + self.parts
        h, rid, pos, n, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(h)
        ordered = h[order]
        same = ordered[1:] == ordered[:-1]
        tied = np.zeros(len(h), bool)
        tied[1:] |= same
        tied[:-1] |= same
        some = order[tied]
        some = some[np.lexsort((pos[some], rid[some], h[some]))]
        fresh = np.ones(len(some), bool)
        fresh[1:] = h[some][1:] != h[some][:-1]
        first = some[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))] if len(some) else some
        again = ~fresh if self.inside else rid[some] > rid[first]
        a, b = some[again], first[again]
        yield from claim_rows(rid[a], pos[a], n[a].astype(np.int64), rid[b], pos[b], self.buckets)
        keep = np.sort(np.concatenate([order[~tied], some[~again]]))
        self.kept = [x[keep] for x in (h, rid, pos, n, *more)]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _digests(units: type[Text]):
    """(rid, text, asked) -> the digest of each stretch asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, at, n, out = [], [], [], []
            for r, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                text = units(text.as_py() or b"")
                for x in asked.as_py():
                    rid.append(r)
                    at.append(x["at"])
                    n.append(x["n"])
                    out.append(_digest(text.get(x["at"], x["at"] + x["n"])))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (rid, at, n)), pa.array(out, pa.binary())], ["d_of", "d_at", "d_n", "digest"])

    return run


def _with_found(rows: DataFrame, distinct: DataFrame, found: DataFrame, units: type[Text], width: int) -> DataFrame:
    """(rid, doc_id, text, known, claims): each row with its known stretches, and its claims with what they must digest to."""
    runs = found.where("spans is null").select("rid", "start", (F.col("n") + (width - 1)).alias("n"), "of", "at")
    asked = runs.select(F.col("of").alias("a_of"), "at", "n").distinct().groupBy("a_of").agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    digests = distinct.join(asked, distinct["rid"] == asked["a_of"]).select("rid", "text", "asked", "doc_id").mapInArrow(_digests(units), "d_of long, d_at long, d_n long, digest binary")
    claims = runs.join(digests, (F.col("of") == F.col("d_of")) & (F.col("at") == F.col("d_at")) & (F.col("n") == F.col("d_n")))
    claims = claims.groupBy(F.col("rid").alias("c_rid")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("claims"))
    known = found.where("spans is not null").groupBy(F.col("rid").alias("k_rid")).agg(F.collect_list("spans").alias("known"))
    whole = rows.join(known, rows["rid"] == known["k_rid"], "left").join(claims, rows["rid"] == claims["c_rid"], "left")
    return whole.select("rid", "doc_id", "text", "known", "claims")


def settled(text: Text, known: list[bytes] | None, claims: list[dict] | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal stretches to remove, and stretches whose claim is false."""
    pairs = [p for s in known or () for p in np.frombuffer(s, "<i8").reshape(-1, 2).tolist()]
    failed = []
    for c in claims or ():
        a, b = c["start"], c["start"] + c["n"]
        (pairs if _digest(text.get(a, b)) == c["digest"] else failed).append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, pairs)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out, failed


def applied(rows: DataFrame, distinct: DataFrame, found: DataFrame, windows: Windows, inside: bool, result: Callable[[Text, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """doc_id and what result() makes of every row's text and its maximal repeated stretches of units.

    rows, distinct: (rid, doc_id, text), of which the texts are shuffled once; found: FOUND, n in windows.
    The result is written to the shared folder: whether a claim failed is known only then.
    """
    fields = [x.strip() for x in f"rid long, doc_id long, failed binary, {schema}".split(",")]
    names, units = [x.split()[0] for x in fields], windows.units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in fields]
        for batch in batches:
            failed, out = [], []
            for text, known, claims in zip(batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                text = units(text.as_py() or b"")
                gone, wrong = settled(text, known, claims)
                failed.append(np.array(wrong, "<i8").tobytes() if wrong else None)
                out.append(result(text, gone))
            columns = [batch.column(0), batch.column(1), failed, *zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def settle(found: DataFrame) -> DataFrame:
        return checkpoint(_with_found(rows, distinct, found, units, windows.width).mapInArrow(run, ", ".join(fields)))

    done = settle(found)
    wrong = done.where("failed is not null").select("rid", "failed").dropDuplicates(["rid"])
    if not wrong.isEmpty():
        done = settle(found.union(contested(distinct, wrong, windows, inside)))
    return done.drop("rid", "failed")


def contested(rows: DataFrame, failed: DataFrame, windows: Windows, inside: bool) -> DataFrame:
    """(rid, text) and (rid, failed stretches) -> FOUND spans of all windows whose hash is that of a failed claim's window.

    inside: whether an earlier window of the same row counts too. All rows are read once for each HASHES hashes.
    """
    width, units, hashes = windows.width, windows.units, windows.hashes

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for rids, _, doc, pos, h in hashes(iter([batch.select([0, 1])])):
                wanted = np.zeros(len(h), bool)
                for d in np.unique(doc).tolist():
                    own = doc == d
                    for a, b in np.frombuffer(spans[int(rids[d])], "<i8").reshape(-1, 2).tolist():
                        wanted |= own & (pos >= a) & (pos <= b - width)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[wanted]).view(np.int64))], ["h"])

    f = failed.select(F.col("rid").alias("f_rid"), "failed")
    names = checkpoint(rows.join(f, rows["rid"] == f["f_rid"]).select("rid", "text", "failed").mapInArrow(named, "h long").distinct())
    blocks = -(-names.count() // HASHES)
    out = None
    for k in range(blocks):
        block = np.sort(names.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k).toArrow().column("h").to_numpy().view(np.uint64))  # about HASHES numbers

        def looked_up(batches: Iterator[pa.RecordBatch], block: np.ndarray = block) -> Iterator[pa.RecordBatch]:
            for rids, text, doc, pos, h in hashes(batches):
                at = np.flatnonzero(block[np.minimum(np.searchsorted(block, h), len(block) - 1)] == h)
                digests = [_digest(units(text(i)).get(0, width)) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(rids[doc[at]], pa.int64()), pa.array(pos[at], pa.int64())], ["digest", "rid", "pos"])

        places = checkpoint(rows.select("rid", "text").mapInArrow(looked_up, "digest binary, rid long, pos long"))
        first = places.groupBy(F.col("digest").alias("d")).agg(F.min(F.struct("rid", "pos")).alias("first"))
        later = F.struct("rid", "pos") > F.col("first") if inside else F.col("rid") > F.col("first.rid")
        again = places.join(first, places["digest"] == first["d"]).where(later).select("rid", "pos")
        out = again if out is None else out.union(again)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, pos = (batch.column(i).to_numpy() for i in (0, 1))
            yield from C.spans_by_row(rid, pos, pos + width)

    found = out.mapInArrow(spans, C.ROW_SPANS)
    return found.select("rid", *[F.lit(None).cast("long").alias(x) for x in ("start", "n", "of", "at")], "spans")
