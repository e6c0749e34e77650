"""Refresh as a stream: each micro-batch of listed pages is one incremental run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow import schemas
from corpusflow.operators import incremental
from corpusflow.operators.index import Embedder
from corpusflow.sources import files


def latest(pages: DataFrame) -> DataFrame:
    """One row a url, the last listed."""
    rest = [c for c in pages.columns if c != "url"]
    return pages.groupBy("url").agg(F.max_by(F.struct(*rest), F.coalesce("lastmod", F.lit(""))).alias("p")).select("url", "p.*")


def refresh_stream(pages: DataFrame, root: str, embedder: Embedder, checkpoint: str, done: Callable[[incremental.Refresh, int], None] | None = None, **settings) -> StreamingQuery:
    """Keep the index and snapshot under `root` up to date from a stream of pages(url, html, statusCode,
    contentType, lastmod). A micro-batch lists some pages, not the whole site, so pages that it doesn't
    list stay. A batch that is run twice finds its own hashes and changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fetched = latest(batch).checkpoint()
        previous = files.load_versioned(spark, f"{root}/snapshot")
        held = files.load_versioned(spark, f"{root}/index", schemas.INDEXED)
        listed = fetched.select("url", "lastmod")
        others = previous.join(listed, "url", "left_anti")
        out = incremental.refresh(listed, fetched, previous.join(listed, "url", "left_semi"), held, embedder, **settings)
        files.save_versioned(out.index, f"{root}/index")
        files.save_versioned(out.snapshot.unionByName(others), f"{root}/snapshot")
        if done is not None:
            done(out, number)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
