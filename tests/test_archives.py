import gzip

import pytest

from pagewright.operators import extraction as E
from pagewright.operators import functions
from pagewright.sources import archives


def record(url, body, status="200 OK", kind="response", length=None, content="text/html"):
    http = f"HTTP/1.1 {status}\r\nContent-Type: {content}\r\n\r\n".encode() + body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: <{url}>\r\nWARC-Date: 2026-01-02T03:04:05Z\r\nContent-Length: {len(http) if length is None else length}\r\n\r\n".encode() + http + b"\r\n\r\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.warc").write_bytes(record("http://a/1", "é\nWARC/1.0\r\n\r\n".encode()) + b"noise\r\n" + record("http://a/2", b"x", length="?") + record("http://a/3", b"y", "404 Not Found") + record("http://a/4", b"z", kind="metadata"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("http://b/1", "ü".encode("latin-1"), content="text/html; charset=ISO-8859-1")) + gzip.compress(record("http://b/2", b"q", length=9999)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("http://c/1", b"whole")) + gzip.compress(record("http://c/2", b"broken"))[:-20])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "_temporary").write_bytes(record("http://no", b""))
    return tmp_path


WANT = [("http://a/1", "é\nWARC/1.0\r\n\r\n", 200, None), ("http://a/3", "y", 404, "HTTP 404"), ("http://b/1", "ü", 200, None), ("http://c/1", "whole", 200, None)]


def test_batch(spark, folder):
    archives.register(spark)
    df = spark.read.format("warc").load(str(folder))
    assert sorted((r["url"], r["html"], r["status_code"], r["error"]) for r in df.collect()) == WANT
    assert df.rdd.getNumPartitions() == 4 and str(df.first()["at"]) == "2026-01-02 03:04:05"
    assert [r["url"] for r in df.where("status_code = 404").collect()] == ["http://a/3"]
    assert [r["html"] for r in df.where("url = 'http://c/1' and status_code = 200 and html like 'w%'").collect()] == ["whole"]
    (folder / "empty").mkdir()
    assert spark.read.format("warc").load(str(folder / "empty")).collect() == []


def test_stream_takes_each_file_once(spark, folder, tmp_path_factory):
    archives.register(spark)
    at, out = str(tmp_path_factory.mktemp("state")), str(tmp_path_factory.mktemp("out"))
    run = lambda: spark.readStream.format("warc").load(str(folder)).select("url", "html", "status_code", "error").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(60)
    run()
    (folder / "z.warc").write_bytes(record("http://z/1", b"late"))
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [*WANT, ("http://z/1", "late", 200, None)]


def test_table_function(spark):
    tier = E.Tier("mine", 0.5, 0.7, lambda p, o: "mine" in p.html, lambda p, o: ([{"a": "x", "b": [1], "n": None}, "text"], "mine"))
    functions.register(spark, (tier, *E.CASCADE), "my_records")
    spark.createDataFrame([("u", "mine", None), ("v", None, None), ("w", "<p>", "text/html")], "url string, html string, content_type string").createOrReplaceTempView("my_pages")
    got = spark.sql("SELECT url, r.* FROM my_pages, LATERAL my_records(url, html, content_type, 'a, b,n,a') AS r").collect()
    assert [tuple(r) for r in got] == [("u", "mine", 0.7, 0, '{"a": "x", "b": [1], "n": null}', "x", "[1]", None), ("u", "mine", 0.7, 1, '"text"', None, None, None)]
    assert spark.sql("SELECT r.* FROM my_pages, LATERAL my_records(url, html, content_type, '') AS r").columns == ["tier_used", "confidence", "rec_idx", "record_json"]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT r.* FROM my_pages, LATERAL my_records(url, html, content_type, url) AS r").collect()
