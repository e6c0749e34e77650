"""Pages from outside: a fetcher interface, retries, and an offline fetcher over a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, html string, statusCode int, contentType string, lastmod string"


class Fetcher(Protocol):
    """(status, html, content type, Last-Modified) of a url; raises on a network error."""

    def __call__(self, url: str, since: str | None) -> tuple[int, str, str, str | None]: ...


def pause(attempt: int, longest: float = 30.0) -> float:
    """Seconds before attempt 1, 2, ...: 2, 4, 8 and so on."""
    return min(2.0**attempt, longest)


def with_retry(fetch: Fetcher, url: str, since: str | None = None, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, str, str | None] | None:
    """The answer, or None: 429, 5xx and network errors are tried again, other answers but 2xx and 304 aren't."""
    for attempt in range(retries + 1):
        if attempt:
            sleep(pause(attempt))
        try:
            got = fetch(url, since)
        except Exception:
            continue
        if 200 <= got[0] < 300 or got[0] == 304:
            return got
        if got[0] != 429 and got[0] < 500:
            return None
    return None


def fetch_pages(urls: DataFrame, fetch: Fetcher, retries: int = 3, parallel: int | None = None) -> DataFrame:
    """Fetched pages of urls(url[, since]); failed ones have a null status. Filter urls first: nothing
    is pushed below this. `parallel` bounds how many requests run at once."""
    rows = urls.select("url", F.col("since") if "since" in urls.columns else F.lit(None).cast("string").alias("since"))
    rows = rows if parallel is None else rows.repartition(parallel, "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(u, with_retry(fetch, u, s, retries)) for u, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([u for u, _ in got], pa.string()), pa.array([g and g[1] for _, g in got], pa.string()), pa.array([g and g[0] for _, g in got], pa.int32()),
                pa.array([g and g[2] for _, g in got], pa.string()), pa.array([g and g[3] for _, g in got], pa.string()),
            ], ["url", "html", "statusCode", "contentType", "lastmod"])

    return rows.mapInArrow(run, FETCHED)


def from_table(urls: DataFrame, web: DataFrame) -> DataFrame:
    """The offline fetcher: answers come from web(url, html, statusCode, contentType, lastmod)."""
    return urls.select("url").join(web.select("url", "html", "statusCode", "contentType", "lastmod"), "url", "left")
