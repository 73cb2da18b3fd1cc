"""Tables of keywords, matched against texts by an automaton of all of them, or by a hashed trie where they are many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.patterns import automaton, text_bytes
from pagewright.sources.session import checkpoint, prepare_workers

#: Bytes of keywords in one automaton; a larger table is matched by the trie of its hashed prefixes.
AUTOMATON_BYTES = 200_000
#: Most bits of the trie (16 MB): with more keywords more candidates are false, which the join with the keywords drops.
TRIE_BITS = 27
#: Bytes of texts whose candidates are grouped, and places walked at a time.
RUN, PLACES = 4 << 20, 1 << 19
#: Bytes that begin a character.
_LEADS = (np.arange(256) & 0xC0) != 0x80
_BASE, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def keyword_hits(rows: DataFrame, keywords: DataFrame, key: str, text: str, ignore_case: bool = True) -> DataFrame:
    """(key, text), (keyword) -> (key, keyword) for each row and each different keyword that its text holds.

    Matching ignores case by lower(), as contains_any() does. Null and empty keywords match nothing; a null text holds none.
    Up to AUTOMATON_BYTES of keywords go to every task. Of more, every task gets a bitmap of the hashes of their prefixes, and of
    their ends. The texts are passed over once: from each place on as long as the bitmap knows the prefix, so work grows with what matches
    there. What it takes for a keyword is joined with the keywords themselves, so hashes never decide a result.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    words = checkpoint(keywords.select(fold(F.col("keyword").cast("string")).alias("keyword")).where("keyword <> ''").distinct())
    size = words.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    source = rows.select(F.col(key), fold(F.col(text)).alias("__text"))
    kind = source.schema[key].dataType.simpleString()
    prepare_workers(rows.sparkSession)
    if size <= AUTOMATON_BYTES:
        return _by_automaton(source, words, key, kind)
    bits = min(TRIE_BITS, max(16, int(size).bit_length()))
    trie = rows.sparkSession.sparkContext.broadcast(_trie(words, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN, "right")) - 1)
                row, found = _candidates(trie.value, bits, data, offsets[i : j + 1])
                coded = found.dictionary_encode()
                row, number = np.divmod(np.unique(row + (j - i) * coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)), j - i)[::-1]
                bounds = np.searchsorted(number, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(bounds), batch.column(0).take(pa.array(row + i)))
                for a in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([coded.dictionary[a : a + 100_000].cast(pa.string()), keys[a : a + 100_000]], ["keyword", "__keys"])
                i = j

    taken = source.mapInArrow(run, f"keyword string, __keys array<{kind}>")
    return taken.join(words, "keyword", "left_semi").select(F.explode("__keys").alias(key), "keyword")


def _by_automaton(source: DataFrame, words: DataFrame, key: str, kind: str) -> DataFrame:
    own = words.orderBy("keyword").collect()  # AUTOMATON_BYTES at most
    patterns = source.sparkSession.sparkContext.broadcast([r["keyword"].encode() for r in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            row, number = automaton(tuple(patterns.value)).matches(data, offsets)
            for i in range(0, len(row), 100_000):
                some = slice(i, i + 100_000)
                named = pa.array([patterns.value[k].decode() for k in number[some].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some].astype(np.int64))), named], [key, "keyword"])

    return source.mapInArrow(run, f"`{key}` {kind}, keyword string")


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in the bitmap, by their high bits once they are mixed."""
    h = (h ^ (h >> np.uint64(32))) * _END
    return (h ^ (h >> np.uint64(29))) * _BASE >> np.uint64(64 - bits)


def _walk(data: np.ndarray, place: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, list]]:
    """(place, end, hash of the first n bytes there, n, alive) for n = 1, 2, ...; what the caller puts into alive goes on."""
    h, n = np.zeros(len(place), np.uint64), 0
    while len(place):
        go = np.flatnonzero(place + n < end)
        place, end, h = place[go], end[go], h[go]
        if not len(place):
            return
        h = (h + data[place + n].astype(np.uint64) + np.uint64(1)) * _BASE
        n += 1
        alive: list[np.ndarray] = []
        yield place, end, h, n, alive
        if alive:
            place, end, h = place[alive[0]], end[alive[0]], h[alive[0]]


def _trie(words: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes of all prefixes of the keywords, and of the keywords as ends: 2 ** bits bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            seen = []
            for place, end, h, n, _ in _walk(data, offsets[:-1], offsets[1:]):
                seen += [np.unique(_slots(h, bits)), _slots(h[place + n == end] ^ _END, bits)]
            slot = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]))
            at = slot >> np.uint64(6)
            first = np.flatnonzero(np.diff(at, prepend=~at[:1]))
            mask = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(mask.view(np.int64))], ["at", "mask"])

    found = words.select("keyword").mapInArrow(run, "at int, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["at"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint64)


def _candidates(trie: np.ndarray, bits: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(text, bytes of it that may be a keyword), for each place at which they stand."""

    def known(h: np.ndarray) -> np.ndarray:
        slot = _slots(h, bits)
        return np.flatnonzero(trie[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))

    begins, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(int(offsets[0]), int(offsets[-1]), PLACES):
        start = np.arange(a, min(a + PLACES, int(offsets[-1])))
        start = start[_LEADS[data[start]]]
        for place, end, h, n, alive in _walk(data, start, offsets[np.searchsorted(offsets, start, "right")]):
            go = known(h)
            ended = go[known(h[go] ^ _END)]
            last = place[ended] + n
            ended = ended[(last == end[ended]) | _LEADS[data[np.minimum(last, end[ended] - 1)]]]
            if len(ended):
                begins.append(place[ended])
                sizes.append(np.full(len(ended), n))
            alive.append(go)
    begin, size = np.concatenate(begins), np.concatenate(sizes)
    bounds = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(taken)])
    return np.searchsorted(offsets, begin, "right") - 1, found
