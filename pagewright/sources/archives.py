"""Page archives (WARC) as a Spark data source, for batches and streams.

    archives.register(spark)
    spark.read.format("warc").load(folder)          spark.readStream.format("warc").load(folder)

A partition is a file, plain or gzip, read record by record: a task holds one record. Responses become pages (url, html, status_code,
content_type, error, at, file); other records are passed over. Equality on url or status_code is checked before a page is
decoded. Files are opened through pyarrow, so any of its file systems will do.

Defined results
- a record without a length, cut short, or that isn't HTTP: skipped, and the next one that begins as a record is read on.
- a gzip file that breaks: its pages up to there.
- bytes that aren't in the page's character set (its content type's, else UTF-8): replaced.
- a stream takes each file once, in the order of names; files must be whole when they appear (moved into place).
- an empty folder: no rows.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime
from typing import Any, BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from pagewright.sources.session import prepare_workers

SCHEMA = "url string, html string, status_code int, content_type string, error string, at timestamp, file string"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def listed(path: str) -> list[str]:
    """The files of a folder (or the one file), by name; hidden ones and those of writers at work aren't."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name[:1] not in "._")


def _opened(path: str, name: str) -> BinaryIO:
    from pyarrow import fs

    stream = fs.FileSystem.from_uri(path)[0].open_input_stream(name, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream


def _headers(stream: BinaryIO) -> dict[str, str]:
    out = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every whole record."""
    import io

    lines = stream if hasattr(stream, "peek") else io.BufferedReader(stream)
    try:
        while line := lines.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = _headers(lines)
            if not headers.get("content-length", "").isdigit():
                continue
            block = lines.read(int(headers["content-length"]))
            if len(block) == int(headers["content-length"]):
                yield headers, block
    except (EOFError, OSError, zlib.error):
        return


def page(headers: dict[str, str], block: bytes, wanted: dict[str, Any]) -> tuple | None:
    """A response's row without its file; None of another record, or one that isn't wanted."""
    url = headers.get("warc-target-uri", "").strip("<>")
    if headers.get("warc-type") != "response" or "url" in wanted and url != wanted["url"]:
        return None
    head, split, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\S+ (\d{3})", first)
    if not split or not status or "status_code" in wanted and int(status[1]) != wanted["status_code"]:
        return None
    kind = next((x.partition(":")[2].strip() for x in rest if x.lower().startswith("content-type:")), "")
    charset = _CHARSET.search(kind)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    try:
        at = datetime.fromisoformat(headers.get("warc-date", "").replace("Z", "+00:00"))
    except ValueError:
        at = None
    return url, text, int(status[1]), kind, None if 200 <= int(status[1]) < 300 else f"HTTP {status[1]}", at


class WarcFile(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader:
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, {}

    def read(self, partition: WarcFile | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks for one partition where there is none
            return
        with _opened(self.path, partition.name) as stream:
            for headers, block in records(stream):
                if (row := page(headers, block, self.wanted)) is not None:
                    yield (*row, partition.name)


class WarcReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("url",), ("status_code",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> Sequence[WarcFile]:
        return [WarcFile(name) for name in listed(self.path)]


class WarcStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the last name that was taken."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(listed(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[WarcFile]:
        return [WarcFile(name) for name in listed(self.path) if start["after"] < name <= end["after"]]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options["path"])

    def streamReader(self, schema) -> WarcStreamReader:  # noqa: ANN001
        return WarcStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    prepare_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
