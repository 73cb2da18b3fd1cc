"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints. Bit by bit the majority of the XXH64 of a document's word shingles.

Covering tables. Give each of the 64 bits a non-zero vector of radius + 1 binary digits, and make one
table for each non-zero vector v, whose mask keeps the bits with an odd product with v. Up to
`radius` differing bits span at most `radius` dimensions, so some v is orthogonal to all of them:
its mask ignores them all, and the pair collides in that table. No pair within the radius is missed.

Links. Work is on distinct fingerprints. A bucket of two is compared. In a larger bucket, each member
names itself and every fingerprint one ignored bit away; two members name a common one exactly if
they differ in at most two bits, and at most 65 can name the same, so a star for each name links
all of them, without pairs and without a group that grows (radius 2; see named()).

Defined results
- null or empty text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole
  sequence is the one shingle.
- null doc_id: gets the smallest id reachable, null only if no linked document has one.
- repeated rows: the same fingerprint, so linked. An empty table: an empty result.
- further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import bounded_batches
from pagewright.llm.components import components
from pagewright.sources.session import checkpoint, prepare_workers, table

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2


def _hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased words."""
    words = text.lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]


_LANES = np.uint64(0x0101010101010101)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; an empty group's is zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    parts = -(-n // 255)  # groups in parts of up to 255, so that eight counters fit one word
    first = np.cumsum(n) - n
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(first, parts) + 255 * inner
    groups = np.cumsum(parts) - parts
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), groups)
        for byte in range(8):
            out[some] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprints(rows: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    prepare_workers(rows.sparkSession)
    bounded_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                h = _hashes(text.as_py() or b"", shingle)
                found.append(np.array(h, np.uint64))
                counts.append(len(h))
            fp = majorities(np.concatenate([np.empty(0, np.uint64), *found]), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The tables' masks.

    >>> [bin(m).count("1") for m in covering_masks()]
    [36, 36, 36, 36, 37, 37, 37]
    """
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, top + 1)]


def named(fp, ignored: list[int]):
    """A member's own fingerprint and those one ignored bit away."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in ignored])


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fp -> links (u, v) that join exactly the fingerprints within RADIUS of each other."""
    masks = covering_masks()
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    sizes = checkpoint(keys.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v")
    crowded = sizes.where("n > 2").select("t", "key")
    by_table = None
    for t, m in enumerate(masks):
        ignored = named(F.col("fp"), [i for i in range(BITS) if not m >> i & 1])
        by_table = F.when(F.col("t") == t, ignored) if by_table is None else by_table.when(F.col("t") == t, ignored)
    members = keys.join(crowded, ["t", "key"]).select("fp", F.explode(by_table).alias("name")).distinct()
    stars = members.groupBy("name").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.union(stars)


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id)."""
    prints = checkpoint(prints)
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.select("fp")))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    labels = rooted.join(least, rooted["root"] == least["r"]).select(F.col("fp").alias("label"), "component_id")
    return prints.join(labels, prints["fp"] == labels["label"]).select("doc_id", "fp", "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
