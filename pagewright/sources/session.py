"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it through sys.path only."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Bytes of an Arrow batch of whole pages.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Give Python workers batches of BATCH_BYTES, or of one row that is longer, whatever the rows' lengths and number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir. Where that is unset, a local folder is used if Spark runs on this
    machine alone; anywhere else that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Where it is set, Spark removes a plan's shuffle files when its run ends; else when the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder; survives the loss of executors. What the plan has shuffled is removed from disk."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under that setting
    finally:
        spark.conf.set(_CLEANED, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same by way of Parquet files in the shared folder, of which later steps read only their columns."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
