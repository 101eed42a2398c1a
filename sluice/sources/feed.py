"""Feeds: files of one JSON entry a line that only grow, as a batch and a streaming source.

Each source is a file `<source>.jsonl`. A stream's offset is the number of bytes
taken of each source, up to the end of a line: the driver looks at sizes and the
ends of files, executors read the ranges between. A range that is read again
gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from .paginated import SCHEMA, parse_time, to_item

#: Bytes that are read at once to find a file's last line end, and of a range.
BLOCK = 1 << 20


def _files(path: str) -> tuple[pafs.FileSystem, dict[str, pafs.FileInfo]]:
    system, base = pafs.FileSystem.from_uri(path)
    found = system.get_file_info(pafs.FileSelector(base))
    return system, {f.base_name.removesuffix(".jsonl"): f for f in found if f.is_file and f.base_name.endswith(".jsonl")}


def whole_lines(system: pafs.FileSystem, file: pafs.FileInfo) -> int:
    """Bytes up to the end of the last whole line."""
    with system.open_input_file(file.path) as f:
        end = f.size()
        while end > 0:
            lo = max(0, end - BLOCK)
            at = f.read_at(end - lo, lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            end = lo
    return 0


class Range(InputPartition):
    def __init__(self, source: str, begin: int, end: int):
        self.source, self.begin, self.end = source, begin, end


def rows_of(path: str, part: Range, since=None) -> Iterator[tuple]:
    """Items of a range; pos is the byte at which an entry begins. Lines that are no usable entry are passed by."""
    system, base = pafs.FileSystem.from_uri(path)
    with system.open_input_file(f"{base}/{part.source}.jsonl") as f:
        at, rest = part.begin, b""
        while at < part.end:
            block = f.read_at(min(BLOCK, part.end - at), at)
            lines = (rest + block).split(b"\n")
            pos = at - len(rest)
            at += len(block)
            rest = lines.pop()
            for line in lines:
                begin, pos = pos, pos + len(line) + 1
                try:
                    item = to_item(json.loads(line))
                except ValueError:
                    item = None
                if item is None or (since is not None and (item.posted_at is None or item.posted_at < since)):
                    continue
                yield part.source, begin, item.external_id, item.url, json.dumps(item.payload, ensure_ascii=False), item.posted_at


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.since = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """posted_at >= since (or later) is kept by the reader; Spark still checks what is after it alone."""
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, GreaterThan)) and f.attribute == ("posted_at",):
                moment = f.value if f.value.tzinfo else f.value.astimezone()
                self.since = moment if self.since is None else max(self.since, moment)
                if isinstance(f, GreaterThan):
                    yield f
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, files = _files(self.path)
        return [Range(s, 0, whole_lines(system, f)) for s, f in sorted(files.items())] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self.path, partition, self.since) if partition.end else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = _files(self.path)
        return {s: whole_lines(system, f) for s, f in sorted(files.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(s, start.get(s, 0), n) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.read or spark.readStream.format("sluice_feed").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "sluice_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options["path"])

    def streamReader(self, schema):
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known. Spark refuses readers that take filters unless the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
