"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are range-sorted by that
key, distributed prefix sums of the sizes are built, and the mix is cut at the source's exact
budget; a budget above the source's size repeats whole epochs first.

The range sort uses explicit ranges: the key is uniform, so a source with n documents is cut into
ceil(n / BIN_ROWS) equal key ranges. A hot source simply has more ranges, each is bounded, and no
sampling pass is needed. Prefix sums are taken inside each range and over the ranges' totals.

Defined results
- null or empty text: size 0, taken 0.
- null source: a source of its own, last in the order of sources.
- null doc_id: its key is the key of the empty string; rows with equal keys and ids are ordered by
  size, and rows equal in all of these are interchangeable.
- an empty table gives an empty result; a source whose documents are all empty has target 0.
- columns of the input that clash with the result's names are ignored unless named as inputs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.sources.session import checkpoint, table

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one key range, on average.
BIN_ROWS = 2048
#: A source's target is at most this many times its size.
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
_SPAN = 16**8


def share_targets(sizes: list[int], weights: list[int], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Share sum(sizes) by weight; targets stop at max_epochs times the size, and what is over is
    shared again by weight among the rest until no target is above its limit.

    >>> share_targets([10, 90], [9, 1])
    [30.0, 70.0]
    """
    total = sum(sizes)
    capped: set[int] = set()
    while True:
        left = total - max_epochs * sum(sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and w * left > max_epochs * sizes[i] * weight}
        if not over:
            break
        capped |= over
    return [float(max_epochs * s) if i in capped else (w * left) / weight for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, key, slot): size in words, the hash-random key, and its first 32 bits."""
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    ).withColumn("slot", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))


def mix(rows: DataFrame, bin_rows: int = BIN_ROWS, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add source_size, target and taken to the rows of sized().

    The sources are a dimension: one row for each (name, size, documents) comes to the driver,
    where the targets are shared out; everything that grows with the documents stays distributed.
    """
    spark = rows.sparkSession
    rows = checkpoint(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = share_targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], max_epochs) if found else []
    plan = [
        (r["source"], r["size"], t, math.floor(t + 0.5) // r["size"] if r["size"] else 0, math.floor(t + 0.5) % r["size"] if r["size"] else 0, max(1, math.ceil(r["docs"] / bin_rows)))
        for r, t in zip(found, targets, strict=True)
    ]
    schema = "of string, source_size long, target double, epochs long, rest long, bins long"
    budgets = spark.createDataFrame(plan, schema)
    budgets = F.broadcast(budgets) if len(plan) <= 100_000 else budgets
    dealt = rows.join(budgets, rows["source"].eqNullSafe(budgets["of"]) if len(plan) <= 100_000 else F.coalesce(rows["source"], F.lit("\0null")) == F.coalesce(budgets["of"], F.lit("\0null")))
    dealt = dealt.withColumn("bin", F.floor(F.col("slot") * F.col("bins") / F.lit(_SPAN)).cast("long"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        dealt.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
        .select(F.col("source").alias("bin_of"), F.col("bin").alias("bin_no"), F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bin_start"))
    )
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    start = F.col("bin_start") + F.col("inner")
    return placed.join(bins, placed["source"].eqNullSafe(bins["bin_of"]) & (placed["bin"] == bins["bin_no"])).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))).cast("long").alias("taken"),
    )


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), fill AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    coalesce(CAST(sum(source_size) OVER below AS BIGINT), 0) AS lower_size, CAST(sum(w) OVER upward AS BIGINT) AS upper_w
  FROM s WINDOW below AS (ORDER BY source_size * 1.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    upward AS (ORDER BY source_size * 1.0 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), open AS (
  SELECT *, w * (total - 3 * lower_size) > 3 * source_size * upper_w AS capped FROM fill
), rate AS (
  SELECT CAST(any_value(total) - 3 * coalesce(sum(source_size) FILTER (capped), 0) AS BIGINT) AS left_size, CAST(sum(w) FILTER (NOT capped) AS BIGINT) AS left_w FROM open
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * left_size AS DOUBLE) / CAST(left_w AS DOUBLE) END AS target FROM open, rate
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM p
"""
