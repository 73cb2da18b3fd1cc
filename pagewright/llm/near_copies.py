"""Near copies by exact Jaccard similarity of five-word shingles.

Complete: every pair of documents whose distinct shingles have a Jaccard similarity of SIMILAR (4/5) or more is linked, and no other.

Sets. Documents of equal shingle sets are one class, named by its smallest id. The rest works on classes.

Prefix filter. Under any one order of all shingles, two sets of n and m shingles that share at least
o = ceil(4/9 * (n + m)) of them, as a similarity of 4/5 asks for, share one among the first n - o + 1 of the one and
m - o + 1 of the other. That is never more than the first n - ceil(4/5 * n) + 1, which a set is entered under, with their places.
Shingles that are frequent (counted in all documents for the hashes that prefixes begin with, and in a sample) come last in the order, so that
license lines and templates don't make buckets; the counts decide the cost alone, never the result.

Links. First the pairs that SimHash links, and each bucket's star around the first that came to it, where enough of the entries agree
(with fewer, the pair would fail), are verified and grouped. Then a bucket has a group that most of its entries are in, and
others: the others are compared with all entries of other groups whose places leave room for o shared shingles, first by
their prefixes, of which enough must be common, then by their texts.

Crowds. That is done in buckets of up to CROWD entries. In a larger one, where pairs would grow with the square of a crowd of near copies, all
are compared with a pivot c, a document of the group of most entries. D(x) being the number of shingles in one of x and c alone, and
w(x) = 9 D(x) - n(x), x and y are similar exactly if they share (w(x) + w(y)) / 18 or more of these differences. Those similar to c
are linked with it, and so with each other. Any other has w > n(c), so shares a difference with whatever it is similar to, and the prefix filter
is repeated on the differences: what x has beyond c comes first in the order, so that what the crowd has in common, which
filled the prefixes, is in none. Buckets of differences that are crowds of another group get a pivot of their own, up to ROUNDS times. No pair is left out.

Defined results
- null or empty texts, and texts without words: one class. Fewer words than a shingle: the whole sequence is the one shingle.
- ids must not be null; repeated ids of equal text are one document. An empty table: an empty result.
- classes are told apart, and candidates found, by 64-bit hashes; candidates are verified by the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.llm import matches as M
from pagewright.llm import simhash as H
from pagewright.llm.columns import bounded_batches
from pagewright.llm.components import components
from pagewright.sources.session import checkpoint, prepare_workers, shuffle_partitions

SHINGLE = 5
#: Documents of the sample that orders the shingles, and from how many of them a shingle counts as frequent. A smaller share
#: of all documents costs more candidates: a shingle of fewer copies is then as rare as one of a single document.
SAMPLE, FREQUENT = 100_000, 2
#: Hashes below it are counted in all documents. Rare shingles are ordered by their hashes, so that these are the ones in most prefixes (a fifth of
#: a set): however large the corpus, a prefix has few shingles that are frequent and not known to be.
BAND = 3 * 2**64 // 10
#: Most shingles whose frequency is kept.
KNOWN = 4_000_000
#: Most entries of a bucket that are compared by pairs, and how often the entries of larger ones are compared with a pivot first.
CROWD, ROUNDS = 16, 4


def _distinct(text: bytes | None) -> tuple[np.ndarray, list[int]]:
    """A text's distinct shingle hashes in order, and all of them."""
    h = H._hashes(text or b"", SHINGLE)
    return np.unique(np.array(h, np.uint64)), h


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred rows, whose arrays are small."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            yield batch.slice(i, 200)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The first 32 bits of shingle hashes that are frequent, in order, and the level of each: 12 log2 of the documents that have it, 255 at most.

    Those of a hash below BAND are counted in all documents, others in a sample of them. Up to KNOWN, the most frequent: 5 bytes each,
    whatever the corpus. A rare shingle with the first bits of a frequent one counts as frequent, which costs candidates and changes no result.
    """
    every = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for batch in _few(batches):
            found = [np.empty(0, np.uint64)]
            for whole, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                s = _distinct(text.as_py())[0]
                found.append(s if whole else s[: np.searchsorted(s, np.uint64(BAND))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    some = rows.select((F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).alias("whole"), "text").mapInArrow(run, "h long")
    often = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    copies = F.when(F.col("h").between(0, BAND - 1), F.col("n")).otherwise(F.col("n") * every)
    often = often.groupBy(F.shiftrightunsigned("h", 32).alias("h")).agg(F.least(F.floor(12 * F.log2(F.max(copies))), F.lit(255)).cast("short").alias("n"))
    often = checkpoint(often)
    counts = sorted(((r["n"], r["count"]) for r in often.groupBy("n").count().collect()), reverse=True)  # 254 rows at most
    least, total = 255, 0
    for n, count in counts:
        total += count
        if total > KNOWN:
            break
        least = n
    found = often.where(F.col("n") >= least).toArrow()
    h, n = found["h"].to_numpy().astype(np.uint32), found["n"].to_numpy().astype(np.uint8)
    order = np.argsort(h)
    return h[order], n[order]


def _often(s: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each shingle's level, see _frequent(); 0 of rare ones."""
    if not len(known) or not len(s):
        return np.zeros(len(s), np.uint8)
    start = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(known, start), len(known) - 1)
    return np.where(known[at] == start, times[at], 0)


def sketches(rows: DataFrame, known: np.ndarray, times: np.ndarray) -> DataFrame:
    """(rid, text) -> (rid, sig, n, fp, keys): the set's digest and size, the SimHash, and the prefix. known, times: see _frequent()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for batch in _few(batches):
            sigs, sizes, keys, found, counts = [], [], [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                s, h = _distinct(text.as_py())
                n = len(s)
                first = np.lexsort((s, _often(s, known, times)))[: n - (4 * n + 4) // 5 + 1]
                sigs.append(hashlib.md5(s.tobytes()).digest())
                sizes.append(n)
                keys.append(s[first].view(np.int64))
                found.append(np.array(h, np.uint64))
                counts.append(len(h))
            fp = H.majorities(np.concatenate([np.empty(0, np.uint64), *found]), np.array(counts, np.int64))
            columns = [batch.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "sig", "n", "fp", "keys"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, sig binary, n long, fp long, keys array<long>")


def _enough(met: Column) -> Column:
    """Whether so many common keys of two prefixes are as many as the sets' similarity asks for."""
    over = F.floor((4 * (F.col("nu") + F.col("nv")) + 8) / 9)
    slack = lambda n: over + 1 - F.floor((4 * n + 4) / 5)
    return met >= F.least(slack(F.col("nu")), slack(F.col("nv")))


def _likely(pairs: DataFrame) -> DataFrame:
    """(u, nu, v, nv), one row for each shared prefix shingle -> the pairs that share enough of them."""
    sized = pairs.where(5 * F.least("nu", "nv") >= 4 * F.greatest("nu", "nv"))
    met = sized.groupBy("u", "nu", "v", "nv").agg(F.count("*").alias("met"))
    return met.where(_enough(F.col("met"))).select("u", "v")


def similar(a: bytes | None, b: bytes | None) -> bool:
    """Whether two texts' shingle sets have a Jaccard similarity of 4/5 or more."""
    sets = []
    for text in (a, b):
        w = (text or b"").lower().split()
        sets.append({b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    shared = len(sets[0] & sets[1])
    return 5 * shared >= 4 * (len(sets[0]) + len(sets[1]) - shared)


def _texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, u_text, v_text)."""
    texts = C.having(rows, "rid", pairs.select(F.explode(F.array("u", "v")).alias("wanted")).distinct())
    text = lambda p: texts.select(F.col("rid").alias(f"{p}_rid"), F.col("text").alias(f"{p}_text"))
    both = pairs.join(text("u"), F.col("u") == F.col("u_rid")).join(text("v"), F.col("v") == F.col("v_rid"))
    return both.select("u", "v", "u_text", "v_text")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for batch in batches:
            a, b = batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
            keep = pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return _texts(pairs, rows).mapInArrow(run, "u long, v long")


def _prefix(x: np.ndarray, c: np.ndarray, known: np.ndarray, times: np.ndarray) -> tuple[int, np.ndarray]:
    """Of two documents' distinct shingles: how many are in one alone, and the first of these in order, by which x is found from c.

    Where x isn't similar to c, whatever is similar to x shares D(x) - n(x) / 4 or more of them, being of at most 5/4 of its size;
    where it is, what isn't similar to c, so has w > n(c), shares (w(x) + n(c) + 1) / 18 or more.
    """
    more, less = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
    d = len(more) + len(less)
    near = 9 * d <= len(x) + len(c)
    least = -(-(9 * d - len(x) + len(c) + 1) // 18) if near else d - len(x) // 4
    order = np.concatenate([part[np.lexsort((part, _often(part, known, times)))] for part in (more, less)])
    return d, order[: max(0, d - max(1, least) + 1)]


def _differences(crowds: DataFrame, rows: DataFrame, known: np.ndarray, times: np.ndarray) -> DataFrame:
    """(u, v) of documents and their pivots -> (u, v, n, d, linked, keys): u's size, its differences from v, whether they are similar, and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        pivot, c = None, None
        for batch in _few(batches):
            sizes, found, linked, keys = [], [], [], []
            u, v = (batch.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3))
            for a, b in zip(u, v, strict=True):
                if c is None or b != pivot:
                    pivot, c = b, _distinct(b)[0]
                x = _distinct(a)[0]
                d, first = _prefix(x, c, known, times)
                sizes.append(len(x))
                found.append(d)
                linked.append(9 * d <= len(x) + len(c) and similar(a, b))
                keys.append(first.view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), pa.array(linked, pa.bool_()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "n", "d", "linked", "keys"])

    return _texts(crowds, rows).mapInArrow(run, "u long, v long, n long, d long, linked boolean, keys array<long>")


#: Keys dealt together, about.
_DEAL = 1 << 19
SHARED = "key long, rid long, n long, pos int, first struct<rid:long,n:long>"


def _deal(n_buckets: int):
    """(rid, n, keys) -> the keys, by bucket, as packed arrays with each one's document, its size, and the place in its prefix."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        C.release()
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[tuple]:
            key, rid, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for b, (k, r, m, p) in C.dealt(C.bucket_of(C.mixed(key), n_buckets), n_buckets, key, rid, n, pos):
                yield b, 0, k.tobytes(), C.narrow(r), C.narrow(m), C.narrow(p)

        for batch in batches:
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            rid, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            held.append((lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(rid, counts), np.repeat(n, counts), pos))
            if sum(len(h[0]) for h in held) >= _DEAL:
                yield from out()
        if held:
            yield from out()

    return lambda batches: C.blobs(found(batches))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's keys -> SHARED: the entries of keys that several documents have, with the first that came.

    Parts are folded into one entry for each key, so what is held grows with the different keys only.
    """
    key, rid, n, pos, told = np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3, np.empty(0, bool)
    parts: list[tuple[np.ndarray, ...]] = []

    def folded() -> Iterator[pa.RecordBatch]:
        nonlocal key, rid, n, pos, told
        k, r, m, p = (np.concatenate([held, *more]) for held, more in zip((key, rid, n, pos), zip(*parts, strict=True), strict=True))
        said = np.concatenate([told, np.zeros(len(k) - len(told), bool)])
        parts.clear()
        order = np.argsort(k, kind="stable")  # what was held stands first
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[order][1:] != k[order][:-1]
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        some = tied & ~said[order]
        at, of = order[some], first[some]
        if len(at):
            heads = pa.StructArray.from_arrays([pa.array(r[of]), pa.array(m[of])], ["rid", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(k[at].view(np.int64)), pa.array(r[at]), pa.array(m[at]), pa.array(p[at], pa.int32()), heads], ["key", "rid", "n", "pos", "first"])
        said[order[tied]] = True
        keep = order[fresh]
        key, rid, n, pos, told = k[keep], r[keep], m[keep], p[keep], said[keep]

    for _, a, b, c, d in C.entries(batches):
        parts.append((np.frombuffer(a, "<u8"), C.widened(b), C.widened(c), C.widened(d)))
        if 32 * sum(len(x[0]) for x in parts) > max(M.FOLD, 32 * len(key)):
            yield from folded()
    if parts:
        yield from folded()


def shared_keys(heads: DataFrame, buckets: int) -> DataFrame:
    """(rid, n, keys) -> SHARED."""
    dealt = heads.select("rid", "n", "keys").mapInArrow(_deal(buckets), C.BLOB)
    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet, SHARED)


def _roomy(entries: DataFrame) -> DataFrame:
    """(key, rid, n, d, pos) -> (key, rid, n, w, room): the entry's document is found by it from those of w up to room."""
    w = 9 * F.col("d") - F.col("n")
    return entries.select("key", "rid", "n", w.alias("w"), (18 * (F.col("d") - F.col("pos")) - w).alias("room"))


def _label(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries with label: the group of their document."""
    return entries.join(groups, entries["rid"] == groups["g_node"], "left").withColumn("label", F.coalesce("root", "rid")).drop("g_node", "root")


def _few_across(labelled: DataFrame) -> DataFrame:
    """(u, v) of entries of the same bucket and different groups that leave room for one another; buckets of a few entries."""
    other = labelled.select(F.col("key").alias("k"), F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("w").alias("wv"), F.col("room").alias("room_v"), F.col("label").alias("other"))
    room = (F.col("wv") <= F.col("room")) & (F.col("w") <= F.col("room_v")) & (5 * F.least("n", "nv") >= 4 * F.greatest("n", "nv"))
    across: Column = (F.col("key") == F.col("k")) & (F.col("rid") < F.col("v")) & (F.col("label") != F.col("other")) & room
    return labelled.join(other, across).select(F.col("rid").alias("u"), "v").distinct()


def _mixed(labelled: DataFrame, own: DataFrame) -> DataFrame:
    """Entries of buckets with several groups -> key, rid, n, w, room, label, most (the group of most entries) and pivot (of it)."""
    centres = own.groupBy(F.col("label").alias("of")).agg(F.min_by("rid", F.struct("unshared", "rid")).alias("centre"), F.count("*").alias("members"))
    held = labelled.groupBy("key", "label").agg(F.count("*").alias("times"), F.min("w").alias("least"))
    held = held.join(centres, held["label"] == centres["of"])
    best = F.max_by(F.struct("label", "centre"), F.struct("times", "members", "label"))
    mixed = held.groupBy(F.col("key").alias("k")).agg(best.alias("best"), F.count("*").alias("labels"), F.min("least").alias("least"))
    mixed = mixed.where("labels > 1").select("k", "least", F.col("best.label").alias("most"), F.col("best.centre").alias("pivot"))
    return checkpoint(labelled.join(mixed, (labelled["key"] == mixed["k"]) & (labelled["room"] >= mixed["least"])).drop("k", "least"))


def _across(rest: DataFrame) -> DataFrame:
    """(u, v) as of _few_across(); entries of the largest group are compared with the others only."""
    other = rest.select(F.col("key").alias("k"), F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("w").alias("wv"), F.col("room").alias("room_v"), F.col("label").alias("other"))
    room = (F.col("wv") <= F.col("room")) & (F.col("w") <= F.col("room_v")) & (5 * F.least("n", "nv") >= 4 * F.greatest("n", "nv"))
    # two outsiders meet once, an outsider and one of the largest group too
    across: Column = (F.col("key") == F.col("k")) & (F.col("label") != F.col("other")) & ((F.col("other") == F.col("most")) | (F.col("rid") < F.col("v"))) & room
    return rest.where("label <> most").join(other, across).select(F.least("rid", "v").alias("u"), F.greatest("rid", "v").alias("v")).distinct()


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) -> (doc_id, component_id): the smallest id reachable by links of similar documents."""
    rows = docs.select(F.col(id_column).cast("long").alias("rid"), F.col(text).cast("string").alias("text"))
    prepare_workers(rows.sparkSession)
    bounded_batches(rows)
    known, times = _frequent(rows)
    made = checkpoint(sketches(rows, known, times))
    classes = checkpoint(made.groupBy("sig").agg(F.min("rid").alias("rep"), F.count("*").alias("members")))
    copies = made.select("rid", "sig").join(classes.where("members > 1"), "sig").where("rid <> rep").select(F.col("rid").alias("copy"))
    heads = C.lacking(made, "rid", copies)
    buckets = max(shuffle_partitions(rows.sparkSession), C.buckets(rows))
    shared = checkpoint(shared_keys(heads, buckets))

    prints = checkpoint(heads.groupBy("fp").agg(F.min("rid").alias("of")))
    linked = H.links(prints.select("fp"))
    end = lambda c: prints.select(F.col("fp").alias(f"{c}_fp"), F.col("of").alias(f"{c}_of"))
    linked = linked.join(end("u"), F.col("u") == F.col("u_fp")).join(end("v"), F.col("v") == F.col("v_fp")).select(F.least("u_of", "v_of").alias("u"), F.greatest("u_of", "v_of").alias("v"))
    alike = heads.join(prints.withColumnRenamed("fp", "p"), F.col("fp") == F.col("p")).where("rid <> of").select(F.col("of").alias("u"), F.col("rid").alias("v"))
    stars = shared.where("first.rid <> rid").select(F.col("first.rid").alias("u"), F.col("first.n").alias("nu"), F.col("rid").alias("v"), F.col("n").alias("nv"))
    first = checkpoint(_verified(checkpoint(_likely(stars).union(linked).union(alike).distinct()), rows))

    links, found = first, []
    prefix = F.col("n") - F.ceil(4 * F.col("n") / 5) + 1
    own = checkpoint(shared.groupBy("rid", "n").agg(F.count("*").alias("times")).select("rid", (prefix - F.col("times")).alias("unshared")))
    entries = _roomy(shared.withColumn("d", F.col("n")))
    for last in [False] * ROUNDS + [True]:
        groups = C.small(components(links).select(F.col("node").alias("g_node"), "root"))
        labelled = checkpoint(_label(entries, groups))
        sizes = labelled.groupBy(F.col("key").alias("crowd")).agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"))
        crowded = checkpoint(sizes.where((F.col("size") > CROWD) & (F.col("least") < F.col("most"))).select("crowd"))
        found.append(checkpoint(_few_across(C.lacking(labelled, "key", crowded))))
        if crowded.isEmpty():
            break
        rest = _mixed(C.having(labelled, "key", crowded), _label(own, groups))
        if last:
            found.append(checkpoint(_across(rest)))
            break
        crowds = checkpoint(rest.select(F.col("rid").alias("u"), F.col("pivot").alias("v")).where("u <> v").distinct())
        if crowds.isEmpty():
            break
        apart = checkpoint(_differences(crowds, rows, known, times))
        links = links.union(apart.where("linked").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        # only what several share can be met again, which packed arrays tell
        own_keys = apart.select(F.col("u").alias("rid"), F.col("d").alias("n"), F.transform("keys", lambda e: F.xxhash64("v", e)).alias("keys"))
        again = shared_keys(own_keys, buckets).select("key", "rid", F.col("n").alias("d"), "pos")
        sizes = C.small(apart.select(F.col("u").alias("sized"), "n").distinct())
        entries = _roomy(checkpoint(again.join(sizes, F.col("rid") == F.col("sized"))))
    pairs = reduce(DataFrame.union, found).distinct()
    # their whole prefixes say more, before a text is opened
    end = lambda p: heads.select(F.col("rid").alias(f"{p}_rid"), F.col("n").alias(f"n{p}"), F.col("keys").alias(f"{p}_keys"))
    met = pairs.join(end("u"), F.col("u") == F.col("u_rid")).join(end("v"), F.col("v") == F.col("v_rid"))
    pairs = met.where(_enough(F.size(F.array_intersect("u_keys", "v_keys")))).select("u", "v")
    second = _verified(checkpoint(pairs), rows)

    found = components(links.union(second))
    ids = made.select("rid", "sig").join(classes.select("sig", "rep"), "sig")
    return ids.join(found, ids["rep"] == found["node"], "left").select(F.col("rid").alias("doc_id"), F.coalesce("root", "rep").alias("component_id"))
