"""Phrase collocation mining: depth-limited count tries per shard, merged by prefix range.

A shard's trie has a language at its root and phrases of up to DEPTH words below; a node counts how often its phrase occurs.

1. A shard (a slice of documents) sorts the windows that begin at its words, each up to DEPTH words long and within its
   piece, and folds equal ones: its trie in order, written front-coded (each path without what it shares with the one
   before) and cut into prefix ranges. So a passage that a third of all documents share is one path of a shard.
2. A range merges its shards' runs and sums equal paths. Nodes that occur `least` times or more leave it with the counts of
   their left parts, which are their ancestors: a walk of the trie. Nodes that a bound of the range cuts through leave it
   too, as parts, and are summed afterwards: at most DEPTH + 1 for each bound.
3. A node's suffix link is the node without its first word, and its right parts are what the chain of links meets. Links
   are made depth by depth, by joins of the nodes that occur `least` times; no other node can be part of a candidate.

Bounds are quantiles of the windows of a sample of documents (about RANGE_SAMPLE windows for each range); they only balance the
ranges. Counts cover all documents and are exact; there is no filter before the merge.

Defined results
- null or empty text, or one of separators only: no words. null lang: UNKNOWN.
- a text of more than two slices is cut between words; windows look over the cut.
- repeated rows and equal or null doc_ids: every row counts.
- ties of the score: by count, then by the phrase's UTF-8 bytes, so ranks are always the same.
- an empty table gives an empty result. Further columns are ignored.
- scores are exact while 1000 * a * n is below 10^38.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.sources.session import checkpoint, prepare_workers, shuffle_partitions, table

DEPTH = 5
UNKNOWN = "und"
#: Bytes of text whose windows share a range.
RANGE = 16 << 20
RANGE_SAMPLE = 256
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAPS = _ENDS.copy()
_GAPS[[9, 32]] = True
_CODEC = "zstd"
#: Windows whose langs and words are numbered: lang, then DEPTH words, 0 where the piece has ended.
Paths = np.ndarray


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values from 0, ascending with their bytes, and the different values in that order."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _packing(most: int, columns: int) -> tuple[int, list[range]]:
    """How many bits a number up to `most` takes, and the columns that share each 64-bit key, the leading ones first."""
    bits = max(1, int(most).bit_length())
    each = 64 // bits
    return bits, [range(i, min(i + each, columns)) for i in range(0, columns, each)]


def keys_of(paths: Paths, most: int) -> list[np.ndarray]:
    """The columns packed into as few 64-bit keys as hold numbers up to `most`."""
    bits, groups = _packing(most, paths.shape[0])
    keys = []
    for group in groups:
        key = np.zeros(paths.shape[1], np.uint64)
        for d in group:
            key = (key << C.U(bits)) | paths[d].astype(np.uint64)
        keys.append(key)
    return keys


def paths_from(keys: list[np.ndarray], most: int, columns: int) -> Paths:
    """What keys_of() was given."""
    bits, groups = _packing(most, columns)
    paths = np.empty((columns, len(keys[0])), np.int32)
    for key, group in zip(keys, groups, strict=True):
        for nth, d in enumerate(reversed(group)):
            paths[d] = key >> C.U(bits * nth) & C.U((1 << bits) - 1)
    return paths


def _folded_keys(keys: list[np.ndarray], counts: np.ndarray | None) -> np.ndarray:
    """Put the ordered different keys in place of the keys, column by column; their counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for i in range(len(keys)):
        keys[i] = keys[i][order]
        fresh[1:] |= keys[i][1:] != keys[i][:-1]
    first = np.flatnonzero(fresh)
    total = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    del order
    for i in range(len(keys)):
        keys[i] = keys[i][first]
    return total


def folded(paths: Paths, counts: np.ndarray | None, most: int) -> tuple[Paths, np.ndarray]:
    """Ordered different paths and their counts (each 1 if none are given)."""
    if not paths.shape[1]:
        return paths, np.zeros(0, np.int64)
    keys, columns = keys_of(paths, most), paths.shape[0]
    del paths
    total = _folded_keys(keys, counts)
    return paths_from(keys, most, columns), total


def _parts(data: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, how many of them begin windows) of a long text; what follows is looked at only."""
    at = 0
    while at < len(data):
        end = at + C.SLICE
        while end < len(data) and not _GAPS[data[end]]:
            end += 1
        look, words = end, 0
        while look < len(data) and words < depth:
            words += bool(_GAPS[data[look]] and not _GAPS[data[look - 1]])
            look += 1
        yield data[at:look], min(end, len(data)) - at
        at = end


def shard(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, limit: int, depth: int) -> tuple[Paths, np.ndarray, pa.Array]:
    """A slice's trie: its paths in order, with counts, and its words in order; languages keep their numbers."""
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    solid = ~_GAPS[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    code, words = _ranked(_binary(data[solid], bounds))
    n = len(code)
    paths = np.zeros((depth + 1, n), np.int32)
    paths[0] = lang[doc]
    paths[1] = code + 1
    linked = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    reach = np.ones(n, bool)
    for d in range(2, depth + 1):
        k = d - 1
        reach = reach[: n - k] & linked[k - 1 :] if n > k else reach[:0]
        paths[d, : len(reach)] = np.where(reach, paths[1, k:], 0)
    own = int(np.searchsorted(starts, limit))
    paths, counts = folded(paths[:, :own], None, max(len(words), int(lang.max(initial=0))))
    return paths, counts, words


def _langs(batches: Iterator[pa.RecordBatch], langs: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches -> (number of the lang, text)."""
    for batch in batches:
        coded = batch.column(0).cast(pa.large_binary()).fill_null(UNKNOWN.encode()).dictionary_encode()
        numbers = np.array([langs.setdefault(x, len(langs)) for x in coded.dictionary.to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(numbers) else [], pa.int64()), batch.column(1)], ["lang", "text"])


def _shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[Paths, np.ndarray, pa.Array, list[bytes]]]:
    """Every slice's trie, and the languages by number."""
    langs: dict[bytes, int] = {}
    for numbers, data, offsets in C.slices(_langs(batches, langs)):
        small = len(numbers) > 1 or len(data) <= 2 * C.SLICE
        for part, limit in [(data, len(data))] if small else _parts(data, depth):
            paths, counts, words = shard(part, offsets if small else np.array([0, len(part)]), numbers, limit, depth)
            if len(counts):
                yield paths, counts, words, list(langs)


def written(paths: Paths, counts: np.ndarray, words: pa.Array, langs: list[bytes]) -> tuple[bytes, bytes, bytes, bytes]:
    """Ordered paths front-coded: how much each shares with the one before, what it doesn't, counts; with the words that it uses."""
    same = np.zeros(paths.shape[1], np.uint8)
    going = np.ones(paths.shape[1] - 1, bool)
    for column in paths:
        going &= column[1:] == column[:-1]
        same[1:] += going
    used = np.unique(paths[1:])
    used = used[used > 0]
    local = np.searchsorted(used, paths[1:]) + 1
    local[paths[1:] == 0] = 0
    local = np.concatenate([paths[:1], local])
    rest = local.T[np.arange(paths.shape[0])[None, :] >= same[:, None]]
    mine = words.take(pa.array(used - 1)).cast(pa.large_binary())
    lengths = pc.binary_length(mine).to_numpy()
    text = b"".join(mine.to_pylist())
    names = np.unique(paths[0])
    head = b"\0".join(str(n).encode() + b"=" + langs[n].hex().encode() for n in names.tolist())
    pack = lambda b: len(b).to_bytes(8, "little") + pa.compress(b, codec=_CODEC, asbytes=True) if b else b""
    kind = "<u1" if local.max() < 1 << 8 else "<u2" if local.max() < 1 << 16 else "<u4"
    return pack(same.tobytes()), kind[2].encode() + pack(rest.astype(kind).tobytes()), pack(C.narrow(counts)), pack(len(head).to_bytes(8, "little") + head + len(lengths).to_bytes(8, "little") + lengths.astype("<u4").tobytes() + text)


def read(row: tuple, depth: int) -> tuple[Paths, np.ndarray, pa.Array, dict[int, bytes]]:
    """What written() was given."""
    return paths_of(row, depth), counts_of(row), *book_of(row)


def _unpacked(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec=_CODEC, asbytes=True) if b else b""


def counts_of(row: tuple) -> np.ndarray:
    return C.widened(_unpacked(row[2]))


def book_of(row: tuple) -> tuple[pa.Array, dict[int, bytes]]:
    """The words and the languages of a run."""
    book = _unpacked(row[3])
    size = int.from_bytes(book[:8], "little")
    langs = {int(k): bytes.fromhex(v.decode()) for k, v in (x.split(b"=") for x in book[8 : 8 + size].split(b"\0"))}
    n = int.from_bytes(book[8 + size : 16 + size], "little")
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(book, "<u4", n, 16 + size), out=offsets[1:])
    return _binary(np.frombuffer(book, np.uint8, offset=16 + size + 4 * n), offsets), langs


def paths_of(row: tuple, depth: int) -> Paths:
    same = np.frombuffer(_unpacked(row[0]), np.uint8)
    rest = np.frombuffer(_unpacked(row[1][1:]), "<u" + chr(row[1][0]))
    begin = np.cumsum(depth + 1 - same.astype(np.int64)) - (depth + 1 - same)
    paths = np.empty((depth + 1, len(same)), np.int32)
    for d in range(depth + 1):
        at = np.flatnonzero(same <= d)  # a first path shares nothing
        paths[d] = np.repeat(rest[begin[at] + d - same[at]], np.diff(np.append(at, len(same))))
    return paths


def places(paths: Paths, words: pa.Array, langs: list[bytes], bounds: list[tuple]) -> np.ndarray:
    """Where each bound stands among ordered paths; of one language at a time.

    Numbers are doubled, so that a bound's word that isn't among the words stands between two.
    """
    listed = words.cast(pa.large_binary())
    wanted = sorted({w for b in bounds for w in b[1:] if w})
    known = dict(zip(wanted, _between(listed, wanted), strict=True))
    out = np.empty(len(bounds), np.int64)
    for i, bound in enumerate(bounds):
        a, b = 0, paths.shape[1]
        for d, word in enumerate(bound):
            if d == 0:
                below = [n for n in range(len(langs)) if langs[n] < word]  # numbers of languages don't ascend: see _by_lang()
                a = int(np.isin(paths[0], below).sum())
                b = a + int((paths[0] == langs.index(word)).sum()) if word in langs else a
            else:
                column, place = paths[d, a:b], known[word] if word else 0
                low = int(np.searchsorted(column, (place + 1) // 2, "left"))
                high = int(np.searchsorted(column, place // 2, "right")) if place % 2 == 0 else low
                a, b = a + low, a + max(low, high)
            if a == b:
                break
        out[i] = a
    return out


def _between(words: pa.Array, wanted: list[bytes]) -> list[int]:
    """For each wanted word twice its number (from 1), or the odd number between its neighbours'."""
    out, n = [], len(words)
    for w in wanted:
        a, b = 0, n
        while a < b:
            m = (a + b) // 2
            if words[m].as_py() < w:
                a = m + 1
            else:
                b = m
        out.append(2 * (a + 1) if a < n and words[a].as_py() == w else 2 * a + 1)
    return out


def _by_lang(paths: Paths, counts: np.ndarray, langs: list[bytes]) -> tuple[Paths, np.ndarray]:
    """The paths ordered by the languages' bytes instead of their numbers."""
    rank = np.argsort(sorted(range(len(langs)), key=langs.__getitem__))
    order = np.argsort(rank[paths[0]], kind="stable")
    return paths[:, order], counts[order]


def _ranges(bounds: list[tuple], depth: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for paths, counts, words, langs in _shards(batches, depth):
            paths, counts = _by_lang(paths, counts, langs)
            cuts = np.concatenate([[0], places(paths, words, langs, bounds), [paths.shape[1]]])
            for r in range(len(cuts) - 1):
                if cuts[r] < cuts[r + 1]:
                    yield r, 0, *written(paths[:, cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]], words, langs)

    return lambda batches: C.blobs(found(batches))


def merged(rows: list[tuple], depth: int) -> tuple[Paths, np.ndarray, list[bytes], pa.Array]:
    """The runs of a range as one trie: paths in order, counts, languages, words. Takes the rows off the list, and holds all runs as packed keys
    and one run's paths besides."""
    books = [book_of(row) for row in rows]
    langs = sorted({x for _, names in books for x in names.values()})
    sizes = [len(own) for own, _ in books]
    names_of = [names for _, names in books]
    code, words = _ranked(pa.concat_arrays([own for own, _ in books]))
    books.clear()
    code = code.astype(np.int32) + np.int32(1)
    counts = np.concatenate([counts_of(row) for row in rows])
    most = max(len(words), len(langs))
    bits, groups = _packing(most, depth + 1)
    keys = [np.zeros(len(counts), np.uint64) for _ in groups]
    at, end = 0, 0
    rows.reverse()
    for size, names in zip(sizes, names_of, strict=True):
        number = np.concatenate([np.zeros(1, np.int32), code[at : at + size]])
        to = np.zeros(max(names) + 1, np.int32)
        for k, name in names.items():
            to[k] = langs.index(name)
        run = paths_of(rows.pop(), depth)
        begin, end = end, end + run.shape[1]
        for key, group in zip(keys, groups, strict=True):
            own = key[begin:end]
            for d in group:
                own <<= C.U(bits)
                own |= (number[run[d]] if d else to[run[0]]).astype(np.uint64)
        at += size
    del code
    counts = _folded_keys(keys, counts)
    return paths_from(keys, most, depth + 1), counts, langs, words


NODES = "lang string, size int, phrase string, f long, lefts array<long>, open int, edge boolean"


def _nodes(bounds: list[tuple], depth: int, least: int):
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_()]
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        rows: list[tuple] = []
        number = None
        for batch in batches:
            number = batch.column(0)[0].as_py() if batch.num_rows else number
            rows += [row[1:] for row in C.entries([batch])]
        if not rows:
            return
        paths, counts, langs, words = merged(rows, depth)
        rows.clear()
        total = np.concatenate([[0], np.cumsum(counts)])
        near = [bounds[i] for i in (number - 1, number) if 0 <= i < len(bounds)]
        numbers = [[langs.index(b[0]) if b[0] in langs else -1] + [p // 2 if w and (p := _between(words, [w])[0]) % 2 == 0 else -1 if w else 0 for w in b[1:]] for b in near]
        fresh = np.zeros(paths.shape[1], bool)
        fresh[0] = True
        on_edge = [np.ones(paths.shape[1], bool) for _ in near]
        kept: list[tuple[np.ndarray, ...]] = []  # at each depth the nodes that leave: their first paths, counts and edges; what is above one leaves too
        for d in range(depth + 1):
            fresh[1:] |= paths[d, 1:] != paths[d, :-1]
            first = np.flatnonzero(fresh)
            f = total[np.append(first[1:], paths.shape[1])] - total[first]
            for on, bound in zip(on_edge, numbers, strict=True):
                on &= paths[d] == bound[d]
            edge = np.logical_or.reduce(on_edge)[first] if near else np.zeros(len(first), bool)
            if d == 0:
                edge = np.ones(len(first), bool)
            keep = (edge | (f >= least)) & ((paths[d, first] > 0) | (d == 0))
            at = first[keep]
            above = [np.searchsorted(own[0], at, "right") - 1 for own in kept[1:]]
            if len(at):
                text = [words.take(pa.array(paths[k, at] - 1)).cast(pa.binary()) for k in range(1, d + 1)]
                phrase = pc.binary_join_element_wise(*text, pa.scalar(b" ", pa.binary())).cast(pa.string()) if d else pa.array([""] * len(at), pa.string())
                lefts = np.stack([own[1][i] for own, i in zip(kept[1:], above, strict=True)], 1) if d > 1 else np.zeros((len(at), 0), np.int64)
                opened = np.sum([own[2][i] for own, i in zip(kept[1:], above, strict=True)], axis=0) if d > 1 else np.zeros(len(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * max(d - 1, 0) + 1, max(d - 1, 0)) if d > 1 else np.zeros(len(at) + 1), pa.int32()), pa.array(lefts.ravel(), pa.int64()))
                cols = [pa.array([langs[x].decode() for x in paths[0, at].tolist()]), [d] * len(at), phrase, f[keep], lists, opened.astype(np.int32), edge[keep]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            kept.append((at, f[keep], edge[keep]))

    return run


def range_bounds(rows: DataFrame, n: int, depth: int) -> list[tuple]:
    """Up to n - 1 ascending paths that cut the windows into ranges of about equal size."""
    if n < 2:
        return []
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    share = min(1.0, RANGE_SAMPLE * n * 8 / max(1, size["b"]) * 4)  # a word has about 8 bytes; a document gives a fourth of its windows or 64
    hashed = F.xxhash64("text", F.lit(13))
    some = rows.where(F.pmod(hashed, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).withColumn("h", hashed).dropDuplicates(["h"]).select("lang", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, _, words, langs in _shards(batches, depth):
            at = np.arange(0, paths.shape[1], max(1, paths.shape[1] // 4096))[:8192]
            listed = words.to_pylist()
            rows_ = [[langs[p[0]]] + [listed[w - 1] if w else b"" for w in p[1:]] for p in paths[:, at].T.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.list_(pa.binary()))], ["path"])

    found = sorted(tuple(r["path"]) for r in some.mapInArrow(windows, "path array<binary>").orderBy(F.xxhash64("path")).limit(RANGE_SAMPLE * n).collect())
    return sorted({tuple(bytes(x) for x in found[i * len(found) // n]) for i in range(1, n)} if found else set())


def phrase_counts(docs: DataFrame, least: int, depth: int = DEPTH, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f, lefts) of all phrases of up to `depth` words that occur `least` times; (lang, n).

    lefts: the counts of its first 1, 2, ... words. n: how many words the language has.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    prepare_workers(rows.sparkSession)
    C.bounded_batches(rows)
    n = n or max(shuffle_partitions(rows.sparkSession), -(-C.text_bytes(rows) // RANGE))
    bounds = range_bounds(rows, n, depth)
    runs = rows.mapInArrow(_ranges(bounds, depth), C.BLOB).repartitionById(len(bounds) + 1, F.col("bucket"))
    found = checkpoint(runs.mapInArrow(_nodes(bounds, depth, least), NODES))
    cut = F.broadcast(checkpoint(found.where("edge").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))))  # (depth + 1) nodes for each bound and side, and a language's for each range
    whole = found.where("not edge").select("lang", "size", "phrase", "f", "lefts", "open")
    nodes = whole.unionByName(cut.where((F.col("size") > 0) & (F.col("f") >= least)).select("lang", "size", "phrase", "f", F.array_repeat(F.lit(0).cast("long"), F.col("size") - 1).alias("lefts"), (F.col("size") - 1).alias("open")))
    for k in range(1, depth):
        own = cut.where(F.col("size") == k).select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("f").alias("__f"))
        part = F.when(F.col("open") >= k, F.substring_index("phrase", " ", k))
        mended = F.when(F.col("open") >= k, F.concat(F.slice("lefts", 1, k - 1), F.array("__f"), F.slice("lefts", k + 1, depth))).otherwise(F.col("lefts"))
        nodes = nodes.join(own, (nodes["lang"] == own["__lang"]) & (part == own["__part"]), "left").withColumn("lefts", mended).drop("__lang", "__part", "__f")
    return checkpoint(nodes.drop("open")), cut.where("size = 0").select("lang", F.col("f").alias("n"))


def linked(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """phrase_counts() of two words and more, with rights: the counts of what is left without the first 1, 2, ... words."""
    level = nodes.where("size = 1").withColumn("rights", F.array().cast("array<long>"))
    out = None
    for size in range(2, depth + 1):
        to = level.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__rest"), F.concat(F.array("f"), "rights").alias("rights"))
        own = nodes.where(F.col("size") == size).withColumn("rest", F.expr("substring(phrase, locate(' ', phrase) + 1)"))
        level = checkpoint(own.join(to, (own["lang"] == to["__lang"]) & (own["rest"] == to["__rest"])).drop("__lang", "__rest"))
        out = level if out is None else out.unionByName(level)
    return out


def collocations(docs: DataFrame, least: int = 100, cover: int = 100, top: int = 2000, depth: int = DEPTH, n: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to `depth` words that occur `least` times.

    A phrase scores floor(1000 * a * n / (l * r)) at the cut for which that is lowest. It goes if it is part of a longer one that
    occurs at least `cover` per cent as often; as counts fall with length, only phrases of one word more need be asked.
    """
    nodes, totals = phrase_counts(docs, least, depth, n)
    found = linked(nodes, depth)
    longer = found.where((F.col("size") > 2))
    covered = [
        longer.where(100 * F.col("f") >= cover * F.element_at("lefts", -1)).select("lang", F.expr("substring_index(phrase, ' ', size - 1)").alias("phrase")),
        longer.where(100 * F.col("f") >= cover * F.element_at("rights", 1)).select("lang", F.col("rest").alias("phrase")),
    ]
    kept = found.join(covered[0].union(covered[1]), ["lang", "phrase"], "left_anti").join(F.broadcast(totals), "lang")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.element_at("lefts", k).alias("l"), F.element_at("rights", k).alias("r")))
    each = kept.select("lang", "phrase", F.col("f").alias("a"), "n", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    each = each.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = each.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # a language's phrases are ranked in parts first, of which only the first `top` of each go on
    part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang, w FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
  ) WHERE len(w) > 0
), total AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM piece GROUP BY lang
), gram AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM piece, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)
), f AS MATERIALIZED (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 100
), cut AS (
  SELECT lang, size, phrase, f AS a, w, unnest(range(1, size)) AS k FROM f WHERE size > 1
), scored AS (
  SELECT cut.lang, cut.size, cut.phrase, a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score,
    row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY (1000 * a * n) // (x.f * y.f), k) AS nth
  FROM cut JOIN total USING (lang)
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:k], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k + 1:], ' ')
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, f
  FROM (SELECT lang, w, f, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT lang, w, f, unnest(range(2, size)) AS size FROM f WHERE size > 2))
), kept AS (
  SELECT * FROM scored s WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 100 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
