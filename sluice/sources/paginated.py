"""Paginated sources: the walk over pages, and a Spark data source for it.

Pages of one source follow each other, so each source is one partition, and
sources are read in parallel.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .http import ProtocolError

ACCESS_METHODS = ("PUBLIC_API", "PARTNER_API", "PUBLIC_FEED", "PERMITTED_CRAWL", "MANUAL_IMPORT")
SCHEMA = "source string, pos long, external_id string, url string, payload string, posted_at timestamp"


@dataclass(frozen=True)
class Descriptor:
    key: str
    display_name: str
    access_method: str
    terms_url: str
    compliance_note: str = ""
    ordering: str = "UNSPECIFIED"
    volatile_paths: tuple[str, ...] = ()
    rate_limit_rps: float = 1.0
    page_size: int = 20
    max_pages: int = 10


def problems(d: Descriptor) -> list[str]:
    """What is wrong with a descriptor."""
    out = []
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", d.key or ""):
        out.append("key")
    if not (d.display_name or "").strip():
        out.append("display_name")
    if d.access_method not in ACCESS_METHODS:
        out.append("access_method")
    terms = urlsplit(d.terms_url or "")
    if terms.scheme != "https" or not terms.netloc:
        out.append("terms_url")
    if d.ordering not in ("RECENT_FIRST", "UNSPECIFIED"):
        out.append("ordering")
    if not (isinstance(d.rate_limit_rps, (int, float)) and math.isfinite(d.rate_limit_rps) and d.rate_limit_rps > 0):
        out.append("rate_limit_rps")
    out += [n for n in ("page_size", "max_pages") if not (isinstance(getattr(d, n), int) and getattr(d, n) > 0)]
    return out


@dataclass
class Item:
    external_id: str
    url: str
    payload: object
    posted_at: datetime.datetime | None = None


@dataclass
class SourcePage:
    items: list
    next_cursor: str | None = None


def whole_limit(limit) -> int:
    return max(0, math.trunc(limit)) if isinstance(limit, (int, float)) and math.isfinite(limit) else 0


def walk(fetch: Callable[[str | None], SourcePage], descriptor: Descriptor, limit=500, since: datetime.datetime | None = None, stop: Callable[[], bool] = lambda: False) -> Iterator[Item]:
    """Items of a source, page by page, up to limit.

    Missing entries are skipped. Ends at the page cap, an empty page, a cursor
    seen before, stop(), or, for RECENT_FIRST, the first item before `since`;
    other sources skip such items. Items without a date pass.
    """
    left, cursor, seen = whole_limit(limit), None, set()
    for _ in range(descriptor.max_pages if left else 0):
        if stop():
            return
        page = fetch(cursor)
        if not page.items:
            return
        for item in page.items:
            if stop():
                return
            if item is None:
                continue
            if since is not None and item.posted_at is not None and item.posted_at < since:
                if descriptor.ordering == "RECENT_FIRST":
                    return
                continue
            yield item
            left -= 1
            if not left:
                return
        if page.next_cursor is None or page.next_cursor in seen:
            return
        cursor = page.next_cursor
        seen.add(cursor)


def parse_time(text) -> datetime.datetime | None:
    try:
        t = datetime.datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)


def to_item(entry) -> Item | None:
    """An entry of a board's file as an item; None if its id or address is unusable."""
    if not isinstance(entry, dict) or not isinstance(entry.get("id"), str) or not entry["id"]:
        return None
    if not isinstance(entry.get("url"), str) or not entry["url"].startswith("https://"):
        return None
    return Item(entry["id"], entry["url"], entry, parse_time(entry.get("postedAt")))


def board_pages(text: str, page_size: int) -> Callable[[str | None], SourcePage]:
    """Pages of a JSON file with a `jobs` array."""
    try:
        jobs = json.loads(text)["jobs"]
    except (ValueError, KeyError, TypeError) as e:
        raise ProtocolError(f"no jobs: {e}") from e
    if not isinstance(jobs, list):
        raise ProtocolError("jobs is no array")

    def fetch(cursor: str | None) -> SourcePage:
        n = int(cursor.rpartition("-")[2]) if cursor else 1
        part = jobs[(n - 1) * page_size : n * page_size]
        return SourcePage([i for i in map(to_item, part) if i is not None], f"page-{n + 1}" if n * page_size < len(jobs) else None)

    return fetch


class _Source(InputPartition):
    def __init__(self, name: str, text: str):
        self.name, self.text = name, text


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.since = parse_time(options["since"]) if options.get("since") else None

    def partitions(self):
        return [_Source(k, v) for k, v in sorted(json.loads(self.options["boards"]).items())]

    def read(self, partition):
        o = self.options
        d = Descriptor(partition.name, partition.name, "MANUAL_IMPORT", "https://example.org", ordering=o.get("ordering", "UNSPECIFIED"), page_size=int(o.get("pagesize", 20)), max_pages=int(o.get("maxpages", 10)))
        for pos, item in enumerate(walk(board_pages(partition.text, d.page_size), d, int(o.get("limit", 500)), self.since)):
            yield partition.name, pos, item.external_id, item.url, json.dumps(item.payload, ensure_ascii=False), item.posted_at


class BoardSource(DataSource):
    """spark.read.format("sluice_boards").option("boards", JSON of name -> file text)."""

    @classmethod
    def name(cls) -> str:
        return "sluice_boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class Registry:
    """Descriptors by key; a key twice is an error."""

    def __init__(self, descriptors: list[Descriptor]):
        self.by_key: dict[str, Descriptor] = {}
        for d in descriptors:
            if bad := problems(d):
                raise ValueError(f"{d.key}: {', '.join(bad)}")
            if d.key in self.by_key:
                raise ValueError(f"{d.key} twice")
            self.by_key[d.key] = d

    def keys(self) -> list[str]:
        return sorted(self.by_key)

    def has(self, key: str) -> bool:
        return key in self.by_key

    def require(self, key: str) -> Descriptor:
        if key not in self.by_key:
            raise KeyError(f"no source {key}")
        return self.by_key[key]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoardSource)
