"""A Spark data source that reads search results over HTTP on the executors: retries, backoff, request spacing.

spark.dataSource.register(SearchDataSource); then
spark.read.format("paperloom_http").option("url", "https://host/search?q={query}").option("queries", '["a"]').load()
gives query_id, status, payload. Failures are rows, never exceptions."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import DEFAULTS, Settings


def backoff_seconds(attempt: int) -> float:
    return min(2.0 ** (attempt - 1), 4.0)


def retry_after_seconds(header: str | None) -> float | None:
    try:
        return min(max(float(header), 0.0), 10.0)
    except (TypeError, ValueError):
        return None


class Spacer:
    """At least `interval` seconds between the starts of requests."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next = interval, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.interval


def fetch(url: str, settings: Settings = DEFAULTS, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """Status and body: 429, 5xx and transport errors are tried again, other 4xx are final."""
    opener = opener or (lambda u: urllib.request.urlopen(u, timeout=settings.http_timeout))
    status = "unavailable"
    for attempt in range(1, settings.http_retries + 2):
        wait = None
        try:
            with opener(url) as answer:
                return "ok", answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            status = "rate_limited" if error.code == 429 else "unavailable"
            if error.code != 429 and error.code < 500:
                return ("not_found" if error.code == 404 else status), None
            wait = retry_after_seconds(error.headers.get("Retry-After") if error.headers else None)
        except TimeoutError:
            status = "timeout"
        except (urllib.error.URLError, OSError):
            status = "unavailable"
        if attempt <= settings.http_retries:
            sleep(wait if wait is not None else backoff_seconds(attempt) + random.uniform(0, 0.25))
    return status, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.interval = options["url"], float(options.get("interval", "0"))
        self.queries = json.loads(options["queries"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one reader for each host keeps the spacing

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str | None]]:
        spacer = Spacer(self.interval)
        for query in self.queries:
            spacer.wait()
            status, body = fetch(self.url.replace("{query}", urllib.parse.quote(query)))
            yield query, status, body


class SearchDataSource(DataSource):
    """query_id, status and payload of one request for each query."""

    @classmethod
    def name(cls) -> str:
        return "paperloom_http"

    def schema(self) -> str:
        return "query_id string, status string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
