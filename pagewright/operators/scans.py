"""Folds over the rows of a key in order, for keys of any size.

Rows are sorted in ranges of (key, order), so that one key may fill many tasks; what a range needs from those before it is
one row of each. Three forms, from cheap to general:

- places(): a row's number within its key.
- before(): what built-in aggregates say of the ranges before a row's own; with a window inside the range this is a running
  maximum, sum or last value.
- running(): any associative composition of steps, such as clamped additions, whose order counts but whose grouping
  doesn't. Blocks of BLOCK rows are scanned by doubling (a row composes what stands 1, 2, 4, ... rows ahead of it), their last
  rows are the rows of the next level, and each row takes what its block's predecessors composed. No group is collected.

A null key is a key. Rows that are equal in their order may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.session import checkpoint

#: Rows that are scanned together: a power of two.
BLOCK = 256


def ranged(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows in ranges of (key, order), with the range's number, __part; written, since the ranges' bounds are sampled."""
    return checkpoint(rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))


def inside(key: str, order: Sequence[str]) -> Window:
    """The rows of a key in a range up to the current one, in order."""
    return Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(parts: DataFrame, key: str, **columns: Column) -> DataFrame:
    """(key, __part, ...), one row for each range -> (__key, __of, columns), each an aggregate of the key's ranges before."""
    ahead = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col(key).alias("__key"), F.col("__part").alias("__of"), *[c.over(ahead).alias(name) for name, c in columns.items()])


def with_before(rows: DataFrame, ahead: DataFrame, key: str) -> DataFrame:
    """Ranged rows with what before() says of their range."""
    return rows.join(ahead, rows[key].eqNullSafe(ahead["__key"]) & (rows["__part"] == ahead["__of"])).drop("__key", "__of")


def places(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each row's place within its key, from 0."""
    parts = ranged(rows, key, order)
    counts = before(parts.groupBy(key, "__part").agg(F.count("*").alias("__n")), key, __before=F.sum("__n"))
    numbered = parts.withColumn("__inside", F.row_number().over(inside(key, order)) - 1)
    return with_before(numbered, counts, key).withColumn("place", F.coalesce("__before", F.lit(0)) + F.col("__inside")).drop("__part", "__inside", "__before")


Compose = Callable[[Column, Column], Column]


def running(rows: DataFrame, key: str, order: Sequence[str], step: Column, compose: Compose, name: str = "scan", block: int = BLOCK) -> DataFrame:
    """The rows with their place, and the composition of their key's steps up to their own.

    step: a struct that is never null; compose(earlier, later): the same kind of struct.
    """
    numbered = places(rows.withColumn(name, step), key, order)
    most = numbered.agg(F.max("place")).first()[0] or 0
    return _scanned(numbered, key, compose, name, block, most)


def _scanned(rows: DataFrame, key: str, compose: Compose, name: str, block: int, most: int) -> DataFrame:
    rows = rows.withColumn("__block", F.floor(F.col("place") / block))
    window = Window.partitionBy(key, "__block").orderBy("place")
    reach = 1
    while reach < min(block, most + 1):
        rows = rows.withColumn("__ahead", F.lag(name, reach).over(window))
        rows = rows.withColumn(name, F.when(F.col("__ahead").isNull(), F.col(name)).otherwise(compose(F.col("__ahead"), F.col(name)))).drop("__ahead")
        reach *= 2
    if most < block:
        return rows.drop("__block")
    rows = checkpoint(rows)
    tops = rows.where(F.col("place") % block == block - 1).select(key, F.col("__block").alias("place"), name)
    ahead = _scanned(tops, key, compose, name, block, most // block).select(F.col(key).alias("__key"), (F.col("place") + 1).alias("__of"), F.col(name).alias("__ahead"))
    both = rows.join(ahead, rows[key].eqNullSafe(ahead["__key"]) & (rows["__block"] == ahead["__of"]), "left")
    whole = F.when(F.col("__ahead").isNull(), F.col(name)).otherwise(compose(F.col("__ahead"), F.col(name)))
    return both.withColumn(name, whole).drop("__key", "__of", "__ahead", "__block")
