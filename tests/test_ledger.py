import pytest
from pyspark.sql import functions as F

from pagewright.sources import stores


def test_lookups_open_few_files(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "discovery").otherwise("merge").alias("stage"), F.concat(F.lit("u"), F.lpad((F.col("id") % 500).cast("string"), 3, "0")).alias("url"), F.lit("s").alias("skill"), F.lit(None).cast("string").alias("model"),
        F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0.5).alias("cost_usd"), F.lit(None).cast("timestamp").alias("at"),
    ).union(spark.range(2000).select(F.col("id") + 4000, F.lit("warmup"), F.lit("hot"), F.lit("t"), F.lit(None), F.lit(1), F.lit(1), F.lit(0.0), F.lit(None)))
    stores.append_ledger(rows, str(tmp_path / "a"))
    stores.cluster_ledger(spark, str(tmp_path / "a"), str(tmp_path / "b"), files=20)
    total = spark.read.parquet(str(tmp_path / "b/files")).count()
    got, opened = stores.ledger_entries_of(spark, str(tmp_path / "b"), url="u123")
    assert total > 15 and opened <= 2 and sorted(r["seq"] for r in got.collect()) == [123 + 500 * i for i in range(8)]
    got.collect()
    assert len(got.inputFiles()) == opened
    got, opened = stores.ledger_entries_of(spark, str(tmp_path / "b"), url="hot", skill="t")
    assert got.count() == 2000 and opened > 1, "a hot url fills several files"
    got, opened = stores.ledger_entries_of(spark, str(tmp_path / "b"), url="u123", stage="merge")
    assert got.count() == 8 and stores.ledger_entries_of(spark, str(tmp_path / "b"), url="v")[0].collect() == []
    with pytest.raises(ValueError, match="looked up by"):
        stores.ledger_entries_of(spark, str(tmp_path / "b"), model="m")
