from datetime import datetime, timedelta
from pyspark.sql import functions as F

from pagewright.operators.proxies import throttle_state
from pagewright.sources import stores as S
from pagewright.streaming import state as T


def test_profile_store(spark, tmp_path):
    a = spark.createDataFrame([("https://a", "p1"), ("https://b", "p2")], "url_pattern string, profile string")
    S.save_profiles(None, a, str(tmp_path / "v1"))
    one = S.load_profiles(spark, str(tmp_path / "v1"))
    assert all(len(r["key"]) == 16 for r in one.collect())
    S.save_profiles(one.drop("key"), spark.createDataFrame([("https://b", "new"), ("https://c", "p3")], a.schema), str(tmp_path / "v2"))
    two = S.load_profiles(spark, str(tmp_path / "v2"))
    assert {(r["url_pattern"], r["profile"]) for r in two.collect()} == {("https://a", "p1"), ("https://b", "new"), ("https://c", "p3")}
    inputs = spark.createDataFrame([("https://a", "own"), ("https://b", None), ("https://z", None)], "url string, own_profile string")
    assert {r["url"]: r["profile"] for r in S.lookup_profiles(inputs, two).collect()} == {"https://a": "own", "https://b": "new", "https://z": None}
    assert S.delete_profiles(two, inputs).count() == 1
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"url_pattern": "x",\n "profile": "y"}')
    (tmp_path / "j/b.json").write_text("{broken")
    assert [tuple(r) for r in S.import_profiles(spark, str(tmp_path / "j"), "url_pattern string, profile string").where("url_pattern is not null").collect()] == [("x", "y")]


def test_profiles_are_imported_from_packs_and_from_files_of_one(spark, tmp_path):
    (tmp_path / "one").mkdir()
    for i, text in enumerate(['{\n  "id": 7,\n  "name": "é\\u001e"\n}\n', '{"id": 8, "name', "", '[{"id": 9}]']):
        (tmp_path / "one" / f"{i}.json").write_text(text)
    assert sorted(map(tuple, S.import_profiles(spark, str(tmp_path / "one"), "id long, name string").collect())) == [(7, "é\x1e"), (9, None)]
    made = spark.range(1000).selectExpr("concat('{\\n\"id\":', id, if(id % 4 = 0, '', '\\n}')) AS value").coalesce(2)
    S.export_documents(made, str(tmp_path / "packs"))
    assert len(list((tmp_path / "packs").glob("part-*"))) <= 2
    assert sorted(r["id"] for r in S.import_profiles(spark, str(tmp_path / "packs"), "id long").collect()) == [i for i in range(1000) if i % 4]


def test_ledger_trace_queue_retries(spark, tmp_path):
    row = spark.createDataFrame([(1, "p1", "u", "s", "m", 1, 2, 0.5, None)], S.LEDGER)
    for _ in range(2):
        S.append_ledger(row, str(tmp_path / "ledger"))
    assert S.read_ledger(spark, str(tmp_path / "ledger")).count() == 2
    events = spark.createDataFrame([("tier_won", "t", "u", "s", "{}"), ("odd", "t", None, None, None)], S.TRACE)
    S.append_trace(events, str(tmp_path / "trace"))
    assert sorted(r["kind"] for r in S.read_trace(spark, str(tmp_path / "trace")).collect()) == ["llm_called", "tier_won"]
    assert [r["seq"] for r in S.bounded_queue(spark.range(9).withColumnRenamed("id", "seq"), 3).collect()] == [0, 1, 2]
    tries = spark.createDataFrame([("a", 0, 500, None), ("a", 1, 200, None), ("a", 2, 201, None), ("b", 0, 500, None), ("b", 1, 403, "captcha_detected"), ("c", 0, 0, "timeout")], "url string, attempt int, status int, error string")
    assert {r["url"]: (r["attempt"], r["status"], r["error"]) for r in S.first_success(tries).collect()} == {"a": (1, 200, None), "b": (1, 0, "HTTP 403"), "c": (0, 0, "timeout")}


def feed(spark, tmp_path, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    stream = feed(spark, tmp_path / "r", [[("d", 1, 0.0), ("d", 2, 0.0)], [("d", 3, 0.0), ("d", 4, 0.0), ("e", 5, 1.0)]], "domain string, seq long, at double")
    got = {r["seq"]: r["wait"] for r in drained(T.rate_limit_stream(stream), "waits")}
    assert [got[i] for i in (1, 2, 3, 4)] == throttle_state(None, iter([0.0] * 4), 1.0, 3)[1] and got[5] == 0.0
    stream = feed(spark, tmp_path / "s", [[("s", i, "wix", False) for i in range(2)], [("s", i, "wix" if i < 4 else "wp", i >= 4) for i in range(2, 9)]], "skill string, seq long, platform string, known boolean")
    assert [tuple(r) for r in drained(T.trigger_stream(stream, 5, 3), "fired")] == [("s", 2, "smart", 3), ("s", 7, "batch", 5)]
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    stream = feed(spark, tmp_path / "c", [[(at(1), "a", 1.0), (at(70), "a", 2.0)], [(at(300), "b", 1.0)]], "at timestamp, stage string, cost_usd double")
    assert {(r["stage"], r["cost_usd"]) for r in drained(T.costs_by_window(stream), "costs")} >= {("a", 1.0), ("a", 2.0)}
    stream = feed(spark, tmp_path / "t", [[("tier_won", "t", "u", "s", "{}")]], S.TRACE)
    T.write_trace(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.schema(S.TRACE).json(str(tmp_path / "out")).count() == 1
