import numpy as np
import pytest

from pagewright.operators import proxies as Z
from pagewright.streaming import state as T

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def test_a_restarted_stream_ends_as_the_batch_does(rocks, tmp_path):
    """Half of the outcomes are in the stored table that the stream starts from, the rest comes in files before and after a restart."""
    r = np.random.default_rng(3)
    rows = [(f"p{r.integers(3)}", i, float(r.choice([0.05, -0.25, -0.05, 0.3]))) for i in range(300)] + [("new", 300, -0.9)]
    df = rocks.createDataFrame(rows, "proxy string, seq long, delta double")
    Z.proxy_health(df.where("seq < 150")).write.parquet(str(tmp_path / "stored"))
    stored = rocks.read.parquet(str(tmp_path / "stored"))

    def run():
        stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        T.health_stream(stream, stored).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)

    df.where("seq between 150 and 219").coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    df.where("seq >= 220").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = rocks.read.parquet(str(tmp_path / "out"))
    last = {}
    for x in sorted(map(tuple, out.collect()), key=lambda x: x[1]):
        last[x[0]] = x[2:]
    assert last == {x["proxy"]: (x["health"], x["quarantined"]) for x in Z.proxy_health(df).collect()}
