"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.session import checkpoint

#: Up to so many links are grouped by the driver, at once.
FEW = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    both = edges.toArrow()  # FEW rows at most
    u, v = (both[c].to_numpy() for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root, before = np.arange(len(nodes)), None
    while before is None or not np.array_equal(root, before):
        before = root.copy()
        least = np.minimum(before[a], before[b])
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    found = pa.table({"node": nodes[linked], "root": nodes[root[linked]]})
    return edges.sparkSession.createDataFrame(found, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) of every linked node but the roots; root: the smallest node reachable.

    Few links are grouped by the driver. Of more, a round costs a few shuffles of the links, which only shrink; the number of rounds grows with the
    logarithm of the longest chain. Each round is written to the shared folder. Links of a node
    with itself are ignored, as are links with a null end; no links, no rows.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    if 0 < state[0] <= FEW:
        return _at_once(edges)
    while state[0]:
        edges = checkpoint(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
