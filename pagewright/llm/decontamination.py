"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A benchmark item is short, the documents are long, so the sketch is of the item alone: its k smallest
shingle hashes (bottom-k MinHash), looked up among all of a document's shingles. Items are
partitioned by size, in powers of two, and k is set by the largest item u of the partition:
k = u - ceil(threshold * u) + 1. A document that holds at least `threshold` of an item's shingles lacks
too few of them to miss all k, so every such document is a candidate, however long it is.
Candidates are verified by exact containment of the shingles themselves.

The sketches are broadcast only if they are few; else the lookup is a shuffled join.

Shingles are five consecutive words of the lower-cased text; words are runs of letters and digits. An
item of fewer words is one shingle of its own length, and is looked for among the documents' runs of that
length: an item of one word is found in every document that has the word.

Defined results
- null or empty texts, and texts without words, have no shingle: they match nothing.
- repeated shingles of a text count once.
- null or repeated doc_ids: rows of different text are documents of their own; equal rows give one
  result. The same holds for items.
- empty tables: an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import with_row_ids
from pagewright.sources.session import checkpoint, table

SHINGLE = 5
THRESHOLD = 0.8
WORD = r"[\p{L}\p{N}]+"
#: Up to so many rows (of two integers, or of an integer and a shingle) are broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def with_words(rows: DataFrame) -> DataFrame:
    """Add the words as a column of their own, `w`: an expression used in a lambda would run once for each element."""
    return rows.withColumn("w", words(F.col("text"))).drop("text")


def _joined(words_of: Column) -> Column:
    return F.array_join(words_of, " ")


def runs(widths: list[int], of=_joined, kind: str = "array<string>") -> Column:
    """of() each run of so many words in `w`, for each width; of fewer words, nothing.

    Runs are joined by a space, which no word holds: array_distinct() hashes strings, but compares arrays pair by pair.
    """
    w = F.col("w")
    run = lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: of(F.slice(w, i, k)))
    made = [F.when(F.size(w) >= k, run(k)).otherwise(F.array().cast(kind)) for k in widths]
    return made[0] if len(made) == 1 else F.concat(*made)


def shingles(width: int = SHINGLE, of=_joined, kind: str = "array<string>") -> Column:
    """An item's shingles: of() each run of width words in `w`; of fewer words, of the one run of all; of none, nothing."""
    w = F.col("w")
    return F.when((F.size(w) > 0) & (F.size(w) < width), F.array(of(w))).otherwise(runs([width], of, kind))


def hashes(width: int = SHINGLE) -> Column:
    return shingles(width, F.xxhash64, "array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows: it is counted first."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(iid, hashes in order, distinct) -> (iid, h): each item's k smallest hashes, k by its size partition."""
    sized = items.select("iid", "hashes", F.size("hashes").alias("n")).where("n > 0")
    sized = sized.withColumn("part", F.floor(F.log2("n")))
    most = sized.groupBy(F.col("part").alias("of")).agg(F.max("n").alias("u"))
    k = F.col("u") - F.ceil(F.col("u") * threshold - F.lit(1e-9)) + 1
    sized = sized.join(F.broadcast(most), sized["part"] == most["of"])  # at most 31 size partitions
    return sized.select("iid", F.explode(F.slice("hashes", F.lit(1), F.least(k, F.size("hashes")).cast("int"))).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, text) and (item_id, text) -> (rid, doc_id, item_id, n_item, n_shared), n_shared >= threshold * n_item."""
    _, items = with_row_ids(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    items = checkpoint(with_words(items).select(F.col("rid").alias("iid"), F.col("doc_id").alias("item_id"), F.least(F.size("w"), F.lit(width)).alias("width"), F.array_distinct(shingles(width)).alias("grams"), F.array_sort(F.array_distinct(hashes(width))).alias("hashes")))
    sketch = checkpoint(sketches(items, threshold))
    widths = sorted(r["width"] for r in items.where("width > 0").select("width").distinct().collect()) or [width]  # at most `width` rows
    # explode() would add a filter on its array, pushed to the scan: the shingles would be made twice, and of all rows
    probes = with_words(docs).select("rid", F.explode_outer(runs(widths, F.xxhash64, "array<bigint>")).alias("p")).where("p is not null")
    sketch = _small(sketch)
    candidates = checkpoint(probes.join(sketch, probes["p"] == sketch["h"]).select("rid", "iid").distinct())
    wanted = _small(candidates.select(F.col("rid").alias("of")).distinct())
    grams = with_words(docs.join(wanted, docs["rid"] == wanted["of"])).select("rid", "doc_id", F.explode_outer(F.array_distinct(runs(widths))).alias("gram")).where("gram is not null")
    own = _small(items.select("iid", "item_id", F.size("grams").alias("n_item"), F.explode("grams").alias("own")))
    shared = grams.join(own, grams["gram"] == own["own"]).groupBy("rid", "doc_id", "iid", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    shared = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - F.lit(1e-9)))
    return shared.join(candidates, ["rid", "iid"], "left_semi").select("rid", "doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, docs = with_row_ids(table(spark, sf_dir, "documents"))
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


OP5_SQL = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), sized AS (
  SELECT item_id, w, least(len(w), 5) AS width FROM bw WHERE len(w) > 0
), i AS (
  SELECT item_id, len(s) AS n_item, unnest(s) AS k FROM (
    SELECT item_id, list_distinct(list_transform(range(1, len(w) - width + 2), lambda p: array_to_string(w[p:p + width - 1], ' '))) AS s FROM sized)
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - width + 2), lambda p: array_to_string(w[p:p + width - 1], ' '))) AS k
  FROM dw, (SELECT DISTINCT width FROM sized) WHERE len(w) >= width
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN i USING (k) GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""
