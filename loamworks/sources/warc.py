"""WET and WARC files as a data source: ``spark.read.format("warc").load(path)`` after ``register(spark)``.

Files lie in a folder, or match a pattern of the last part of a path, on any file system. Each file is one partition, read as a stream; ``.gz`` by suffix, UTF-8 with replacement of invalid bytes. A record begins at a
line ``WARC/``, its headers end at the first blank line, and its body lasts for ``Content-Length`` bytes, so body lines that look
like headers stay text. For ``warc`` files the HTTP headers before the page are left out. Records without id or body are skipped.
"""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamworks import storage

SCHEMA = "id string, url string, text string, source string, file_type string, source_file string, dump string"
_DUMP = re.compile(r"(CC-MAIN-\d{4}-\d{2})")


def records(stream, file_type: str) -> Iterator[tuple[str, str | None, str]]:
    """id, url and text of each record of an open binary file."""
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        headers: dict[str, str] = {}
        line = stream.readline()
        while line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
            line = stream.readline()
        size = headers.get("content-length", "")
        if size.isdigit():
            body = stream.read(int(size))
            line = stream.readline()
        else:  # without a length the body lasts until the next record
            parts = []
            line = stream.readline()
            while line and not line.startswith(b"WARC/"):
                parts.append(line)
                line = stream.readline()
            body = b"".join(parts)
        if file_type == "warc" and body.startswith(b"HTTP/"):
            head, gap, page = body.partition(b"\r\n\r\n")
            if not gap:
                head, gap, page = body.partition(b"\n\n")
            body = page if b"text/html" in head.lower() else b""
        text = body.decode("utf-8", "replace").strip()
        if (ident := headers.get("warc-record-id")) and text:
            yield ident.strip("<>"), headers.get("warc-target-uri"), text


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        path = options.get("path", "")
        self.file_type = options.get("file_type", "wet")
        self.limit = int(options.get("limit", "0") or 0)
        self.paths = [p for p in storage.list_files(path) if not os.path.basename(p).startswith(("_", "."))] if path else []

    def partitions(self):
        return [_File(p) for p in self.paths] or [_File("")]

    def read(self, partition):
        path = partition.path
        if not path:
            return
        dump = _DUMP.search(path)
        where, inner = storage.locate(path)
        with where.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None, buffer_size=1 << 20) as raw, io.BufferedReader(raw, 1 << 20) as f:
            for n, (ident, url, text) in enumerate(records(f, self.file_type)):
                if self.limit and n >= self.limit:
                    return
                yield ident, url, text, "commoncrawl", self.file_type, os.path.basename(path), dump.group(1) if dump else None


class WarcDataSource(DataSource):
    """Options: ``file_type`` (wet or warc), ``limit`` (records of a file at most; 0: all)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, file_type: str = "wet", limit: int = 0) -> DataFrame:
    """All records of the files; ``limit`` bounds their number in all (0: no limit)."""
    register(spark)
    df = spark.read.format("warc").option("file_type", file_type).option("limit", limit).load(path)
    return df.limit(limit) if limit else df
