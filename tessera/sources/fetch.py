"""Pages and paged boards over HTTP, as distributed reads.

Addresses are dealt out by host, so one task asks one host, one request at a time with a pause between; many hosts are
asked at once. Nothing is raised for an address that fails: its row says why, and callers leave what they stored alone."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import urls

PAGE = "requested_url string, url string, status int, html string, error string, fetched_at string"
AGENT = "Mozilla/5.0 (compatible; tessera)"


def get(url: str, timeout: float, most: int, body: bytes | None = None, kinds: tuple[str, ...] = ()) -> tuple[str, int | None, str | None, str | None]:
    """(final address, status, text, error) of one request. The text is null unless its type is one of ``kinds`` (any if none are
    named); a body is read up to ``most`` bytes, so that a server that never ends cannot hold a task."""
    headers = {"User-Agent": AGENT} | ({"Content-Type": "application/json"} if body is not None else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            kind = r.headers.get_content_type()
            raw = r.read(most)
            text = raw.decode(r.headers.get_content_charset() or "utf-8", "replace") if not kinds or kind in kinds else None
            return r.geturl(), r.status, text, None if text is not None else f"type {kind}"
    except urllib.error.HTTPError as e:
        return e.geturl() or url, e.code, None, f"http {e.code}"
    except (OSError, ValueError) as e:
        return url, None, None, type(e).__name__


def fetch(addresses: DataFrame, delay: float = 1.0, timeout: float = 10.0, most: int = 4 << 20, kinds: tuple[str, ...] = ("text/html", "application/xhtml+xml")) -> DataFrame:
    """PAGE rows of the distinct ``addresses`` (url): the response of each, or why there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for b in batches:
            for url, host in zip(b.column("url").to_pylist(), b.column("host").to_pylist()):
                if (wait := last.get(host, 0) + delay - time.monotonic()) > 0:
                    time.sleep(wait)
                final, status, text, error = get(url, timeout, most, kinds=kinds)
                last[host] = time.monotonic()
                now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")
                cols = [pa.array([x], t) for x, t in zip((url, final, status, text, error, now), (pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3))]
                yield pa.RecordBatch.from_arrays(cols, ["requested_url", "url", "status", "html", "error", "fetched_at"])

    rows = addresses.select("url").where("url is not null").distinct().withColumn("host", urls.host("url"))
    return rows.repartition("host").sortWithinPartitions("host").mapInArrow(run, PAGE)


def at_path(value, path: str):
    """What stands at a dotted path of decoded JSON, or None."""
    for key in filter(None, path.split(".")):
        value = value.get(key) if isinstance(value, dict) else None
    return value


class _Board(InputPartition):
    def __init__(self, board: str):
        self.board = board


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [_Board(b) for b in self.o["boards"].split(",") if b]

    def read(self, partition: _Board) -> Iterator[tuple]:
        o, start, total = self.o, 0, None
        size, cap = int(o.get("size", 100)), int(o.get("cap", 1000))
        while start < min(cap, total if total is not None else start + 1):
            spot = {"{board}": partition.board, "{start}": str(start), "{size}": str(size)}
            url, body = o["url"], o.get("body")
            for k, v in spot.items():
                url, body = url.replace(k, v), body and body.replace(k, v)
            _, status, text, error = get(url, float(o.get("timeout", 10)), 64 << 20, body.encode() if body else None)
            try:
                page = json.loads(text) if text else None
            except ValueError:
                page, error = None, "not json"
            items = at_path(page, o.get("items", "")) if page is not None else None
            if not isinstance(items, list):
                yield partition.board, start, None, error or "no items"
                return
            for i, item in enumerate(items):
                yield partition.board, start + i, json.dumps(item, ensure_ascii=False), None
            said = at_path(page, o["total"]) if o.get("total") else None
            total = int(said) if isinstance(said, (int, str)) and str(said).isdigit() else (total if total is not None else None)
            if not items or (total is None and len(items) < size):
                return
            total = cap if total is None else total
            start += size
            time.sleep(float(o.get("delay", 0.5)))


class PagedBoards(DataSource):
    """``spark.read.format("paged_boards")``: (board, place, item, error) of boards that answer page by page.

    Options: boards (comma-separated), url and body (POST if given) with {board}, {start} and {size}; items and total, the
    paths of the list and of the count; size, cap, delay, timeout. A board is a partition; it is read until its total, an
    empty page or the cap; a page that cannot be read ends it with a row that says why."""

    @classmethod
    def name(cls) -> str:
        return "paged_boards"

    def schema(self) -> str:
        return "board string, place int, item string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


#: How known providers page: address, body, list, count, page size.
PROVIDERS = {
    "smartrecruiters": {"url": "https://api.smartrecruiters.com/v1/companies/{board}/postings?limit={size}&offset={start}", "items": "content", "total": "totalFound", "size": "100", "cap": "1000"},
    "workday": {"url": "https://{board}/jobs", "body": '{"limit": {size}, "offset": {start}, "searchText": "Israel"}', "items": "jobPostings", "total": "total", "size": "20", "cap": "1000"},
    "eightfold": {"url": "https://{board}&start={start}&num={size}", "items": "positions", "total": "count", "size": "100", "cap": "1000"},
}


def boards(spark, provider: str, names: list[str], **options) -> DataFrame:
    """The items of a provider's boards; ``options`` replace the provider's."""
    spark.dataSource.register(PagedBoards)
    return spark.read.format("paged_boards").options(**{**PROVIDERS[provider], **options, "boards": ",".join(names)}).load()


def whole_boards(items: DataFrame) -> DataFrame:
    """The items of boards that were read to their end; one that failed half way must not close what it did not show."""
    failed = items.where("error is not null").select("board").distinct()
    return items.where("error is null").join(F.broadcast(failed), "board", "left_anti")  # one row a board at most
