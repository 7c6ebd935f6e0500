"""An offset-paged source as a Spark data source: each page is a partition, fetched with retries, checked for completeness."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(get: Callable[[str], tuple[int, bytes]], url: str, attempts: int = 4, pause: float = 1.0) -> bytes:
    """The body of ``url``; 429 and 5xx are tried again after 1, 2, 4 ... pauses, other failures are final."""
    for k in range(attempts):
        status, body = get(url)
        if status < 400:
            return body
        if status != 429 and status < 500 or k == attempts - 1:
            raise OSError(f"{url}: status {status}")
        time.sleep(pause * 2**k)
    raise AssertionError


def _get(url: str) -> tuple[int, bytes]:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=60) as r:
            return getattr(r, "status", None) or 200, r.read()
    except HTTPError as e:
        return e.code, b""


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size, self.pause = options["url"], int(options.get("pagesize", "100")), float(options.get("pause", "1"))

    def _page(self, offset: int, size: int) -> dict:
        return json.loads(fetch(_get, self.url.replace("{offset}", str(offset)).replace("{size}", str(size)), pause=self.pause))

    def partitions(self) -> list[_Page]:
        return [_Page(i) for i in range(0, int(self._page(0, 1)["total"]), self.size)]

    def read(self, partition: _Page) -> Iterator[tuple[int, str]]:
        page = self._page(partition.offset, self.size)
        results, wanted = page["results"][: self.size], min(self.size, int(page["total"]) - partition.offset)
        if len(results) < wanted:
            raise OSError(f"page at {partition.offset} has {len(results)} of {wanted} results")
        for i, r in enumerate(results):
            yield partition.offset + i, json.dumps(r)


class PagedSource(DataSource):
    """Options: url with {offset} and {size} (http or file), pageSize, pause. The answer is JSON with total and results."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "position long, result string"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
