"""Substring dedup: Rabin-Karp hashes of every window of words, counted over all documents.

1. Every slice of documents hashes all its windows: a word is its XXH64, a window the polynomial of its words over a
   prime field. Of windows that the slice holds in several documents, compared word by word, only those of
   the first document travel on; the others are repeats already. So a window that a third of all documents
   share reaches its bucket once for each slice, not for each document.
2. Windows are dealt to buckets by hash, one Spark partition each, as packed arrays; a bucket folds them into one
   entry for each hash, and claims that the windows of later documents repeat it.
3. Claims are dealt by document, joined into runs, confirmed on the words themselves (see matches), and merged into
   maximal removal intervals.

Hashes only decide what is compared: equal hashes of different words remove nothing, at any size.

Defined results
- null or empty text, or fewer words than a window: nothing is removed.
- rows that share a doc_id (or null ids, which come first) count as documents ordered by the hash
  of their text; equal rows are one document and share its result.
- windows repeated within one document only stay.
- a text of more than two slices is hashed in pieces that overlap by a window; the last step holds one text and its word bounds.
- an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.llm import matches as M
from pagewright.sources.session import checkpoint, prepare_workers, table

WINDOW = 13
_ENTRIES = 0
_HASH = C.RabinKarp(12)


class _Numbers(dict):
    """Different words by number, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, list[bytes], int]]:
    """(rids ascending, texts, words before the first text) of slices; a long text comes alone, in overlapping pieces."""
    for rids, data, offsets in C.slices(batches):
        if len(rids) > 1 or len(data) <= 2 * C.SLICE:
            order = np.argsort(rids, kind="stable")
            yield rids[order], [data[offsets[i] : offsets[i + 1]].tobytes() for i in order], 0
            continue
        at, base, size = 0, 0, C.SLICE
        while True:
            end = at + size
            while end < len(data) and not C.WHITE[data[end]]:
                end += 1
            part = data[at:end]
            starts = C.words(part, np.array([0, len(part)]))[0]
            if end < len(data) and len(starts) < window:
                size *= 2
                continue
            yield rids, [part.tobytes()], base
            if end >= len(data):
                break
            step = len(starts) - window + 1
            at, base, size = at + int(starts[step]), base + step, C.SLICE


def _hashed(batches: Iterator[pa.RecordBatch], window: int, bits: int):
    """(rids, texts' words, words as numbers, at, document of each window, its position, its hash) of slices; bits: of the hash."""
    for rids, texts, base in _pieces(batches, window):
        found = [t.split() for t in texts]
        counts = np.array([len(f) for f in found])
        first = np.cumsum(counts) - counts
        number = _Numbers()
        ids = np.concatenate([np.fromiter(map(number.__getitem__, f), np.int64, len(f)) for f in found])
        values = C.reduced(np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64))
        doc = np.repeat(np.arange(len(rids)), np.maximum(counts - window + 1, 0))
        if not len(doc):
            continue
        pos = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(rids)))[doc]
        at = first[doc] + pos
        yield rids, found, ids, at, doc, pos + base, _HASH.windows(values[ids], window)[at] & C.U((1 << 64) - (1 << (64 - bits)))


def windows_of(window: int, bits: int) -> M.Windows:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rids, found, _, _, doc, pos, h in _hashed(batches, window, bits):
            base = int(pos[0])
            yield rids, lambda i, f=found, d=doc, p=pos, b=base: b" ".join(f[d[i]][p[i] - b * (len(f) == 1) :][:window]), doc, pos, h

    return M.Windows(window, M.Words, hashes)


def _windows(window: int, n: int, bits: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rids, _, ids, at, doc, pos, h in _hashed(batches, window, bits):
            rid = rids[doc]
            order = np.argsort(h)
            sorted_h = h[order]
            group = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
            first = np.empty(len(h), np.int64)  # rows ascend, so a group's least place is its first document's
            first[order] = np.repeat(np.minimum.reduceat(order, group), np.diff(np.append(group, len(h))))
            repeat = np.flatnonzero(rid > rid[first])
            same = np.ones(len(repeat), bool)
            for j in range(window):
                same &= ids[at[repeat] + j] == ids[at[first[repeat]] + j]
            repeat = repeat[same]
            r, p, k = C.runs(rid[repeat], pos[repeat])
            yield from C.span_rows(r, p, p + k - 1 + window, n)
            keep = np.ones(len(h), bool)
            keep[repeat] = False
            h, rid, pos = h[keep], rid[keep], pos[keep]
            for b, (x, r, p) in C.dealt(C.bucket_of(h, n), n, h, rid, pos):
                yield b, _ENTRIES, x.tobytes(), C.narrow(r), C.narrow(p) if p.max() > 65535 else b"", p.astype("<u2").tobytes() if p.max() <= 65535 else b""

    return lambda batches: C.blobs(found(batches))


def _counted(n: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fold = M.Fold(n, inside=False)
        for kind, a, b, c, d in C.entries(batches):
            if kind == C.SPANS:
                yield from C.span_rows(*C.spans_from([(a, b, c)]), n)
            else:
                h = np.frombuffer(a, "<u8")
                yield from fold.add(h, C.widened(b), C.widened(c) if c else np.frombuffer(d, "<u2").astype(np.int64), np.ones(len(h), np.uint8))
        yield from fold.folded()

    return lambda batches: C.blobs(found(batches))


def repeats(rows: DataFrame, window: int = WINDOW, bits: int = 64, n: int | None = None) -> DataFrame:
    """(rid, text) -> what is known and what is claimed, as matches.FOUND."""
    n = n or C.buckets(rows)
    prepare_workers(rows.sparkSession)
    C.bounded_batches(rows)
    windows = rows.select("rid", "text").mapInArrow(_windows(window, n, bits), C.BLOB)
    counted = windows.repartitionById(n, F.col("bucket")).mapInArrow(_counted(n), C.BLOB)
    return checkpoint(counted.repartitionById(n, F.col("bucket")).mapInArrow(M.by_document, M.FOUND))


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row; the same for any number of hash bits."""
    rows, distinct = C.with_row_ids(docs)

    def result(text: M.Words, gone: list[tuple[int, int]]) -> tuple:
        line = text.without(gone)
        return (text.size, sum(b - a for a, b in gone), hashlib.sha256(line).hexdigest(), *[line.decode()] * texts)

    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return M.applied(rows, distinct, repeats(distinct, window, bits), windows_of(window, bits), False, result, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM win
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM keyed JOIN firsts USING (k) WHERE doc_id > first
), words AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) > 0 THEN range(1, len(w) + 1) ELSE [0] END) AS i FROM d
), kept AS (
  SELECT words.doc_id, count(*) FILTER (words.i > 0) AS n_words, count(hit.i) AS n_removed,
    coalesce(string_agg(w[words.i], ' ' ORDER BY words.i) FILTER (hit.i IS NULL AND words.i > 0), '') AS line
  FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.i = hit.i GROUP BY words.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(line) AS kept_sha256 FROM kept
"""
