"""Raw pages to cleaned pages: blocks, length filter, exact-duplicate removal, manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.config import CleanConfig
from corpusflow.functions.text import half_up, normalized, source_hash, utf16_length
from corpusflow.functions.urls import PARTS, file_key
from corpusflow.operators.html import parsed


def valid_raw(pages: DataFrame) -> DataFrame:
    """Rows whose url can be parsed and whose other fields are there."""
    return pages.where(F.col("url").rlike(PARTS) & F.col("html").isNotNull() & F.col("statusCode").isNotNull() & F.col("contentType").isNotNull() & (F.col("depth") >= 0))


def valid_cleaned(pages: DataFrame) -> DataFrame:
    """Cleaned pages with a url that can be parsed, all other fields, and blocks and headings without gaps."""
    keep = F.col("url").rlike(PARTS) & (F.col("depth") >= 0)
    for c in ("title", "headings", "textBlocks", "cleanedAt", "sourceHash"):
        keep = keep & F.col(c).isNotNull()
    blocks = F.forall("textBlocks", lambda b: F.coalesce(b["type"].isin("paragraph", "list", "table", "faq") & b["content"].isNotNull() & b["headingPath"].isNotNull(), F.lit(False)))
    headings = F.forall("headings", lambda h: F.coalesce(h["level"].isNotNull() & h["text"].isNotNull(), F.lit(False)))
    return pages.where(keep & blocks & headings)


def valid_chunks(rows: DataFrame, required: tuple[str, ...] = ("chunk_id", "doc_id", "text", "source_url", "page_title", "heading_path", "content_type", "token_count")) -> DataFrame:
    """Rows with all required fields and a text that isn't blank."""
    keep = F.length(normalized(F.col("text"))) > 0
    for c in required:
        keep = keep & F.col(c).isNotNull()
    return rows.where(keep)


def valid_vectors(rows: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.size(column) == dim))


def total_length(contents: Column) -> Column:
    return F.aggregate(F.transform(contents, utf16_length), F.lit(0).cast("int"), lambda a, n: a + n)


def clean(pages: DataFrame, config: CleanConfig = CleanConfig(), cleaned_at: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """Cleaned pages with `error`, why a page couldn't be read, and `kept`: false for those pages and where
    the blocks are too short; one parse a page."""
    page = pages.select("url", "depth", parsed(F.col("html"), or_error=True).alias("p"))
    blocks = F.transform("p.blocks", lambda b: F.struct(b["type"].alias("type"), normalized(b["content"]).alias("content"), b["headingPath"].alias("headingPath")))
    rows = page.select("url", "depth", "p.title", "p.headings", "p.error", blocks.alias("textBlocks"))
    contents = F.transform("textBlocks", lambda b: b["content"])
    return rows.select("url", "title", "headings", "textBlocks", F.lit(cleaned_at).alias("cleanedAt"), source_hash(contents).alias("sourceHash"), "depth", "error", (F.col("error").isNull() & (F.coalesce(total_length(contents), F.lit(0)) >= config.min_content_length)).alias("kept"))


def first_by_hash(pages: DataFrame) -> DataFrame:
    """One page of each sourceHash, that with the smallest file key. Rows are combined before the only
    shuffle, so a hash that holds a third of all pages costs one row a task."""
    rest = [c for c in pages.columns if c != "sourceHash"]
    best = F.min_by(F.struct(*rest), file_key(F.col("url"))).alias("page")
    return pages.groupBy("sourceHash").agg(best).select(*[F.col("sourceHash") if c == "sourceHash" else F.col(f"page.{c}") for c in pages.columns])


def clean_pages(pages: DataFrame, config: CleanConfig = CleanConfig(), cleaned_at: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    return first_by_hash(clean(pages, config, cleaned_at).where("kept").drop("kept", "error"))


def _extra(**values: int | str | None) -> list[Column]:
    """Constants of a manifest that were given."""
    return [F.lit(v).cast("long" if isinstance(v, int) else "string").alias(c) for c, v in values.items() if v is not None]


def clean_manifest(cleaned: DataFrame, dropped_error: int | None = None, started_at: str | None = None, finished_at: str | None = None) -> DataFrame:
    """One row of counts from clean()'s rows, duplicates counted by hash; where they are given, also begin,
    end, and dropped_error: the invalid pages (see invalid_count) and those that the parser failed on."""
    by_hash = cleaned.groupBy("kept", "sourceHash", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))
    failed = [] if dropped_error is None else [(F.coalesce(F.sum(F.when(F.col("failed"), F.col("n"))), F.lit(0)) + dropped_error).alias("dropped_error")]
    return by_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pages_read"), F.count_if("kept").alias("pages_cleaned"),
        F.coalesce(F.sum(F.when(~F.col("kept") & ~F.col("failed"), F.col("n"))), F.lit(0)).alias("dropped_short"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n") - 1)), F.lit(0)).alias("dropped_duplicate"),
        *failed, *_extra(started_at=started_at, finished_at=finished_at),
    )


def invalid_count(pages: DataFrame, valid: Callable[[DataFrame], DataFrame]) -> int:
    """How many rows `valid` (valid_raw, valid_cleaned) leaves out."""
    return pages.count() - valid(pages).count()


def chunk_manifest(pages_read: int, chunks: DataFrame, pages_failed: int | None = None, started_at: str | None = None, finished_at: str | None = None) -> DataFrame:
    """Counts and rounded averages; 0 where there is nothing. Begin and end where given, and pages_failed:
    the given number and the pages that chunk_pages marked as failed."""
    failed = F.count_if("failed") if "failed" in chunks.columns else F.lit(0).cast("long")
    bad = chunks.agg(failed.alias("bad"))
    if "failed" in chunks.columns:
        chunks = chunks.where("NOT failed")
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    totals = per.agg(F.count("*").alias("pages_chunked"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    lost = [] if pages_failed is None else [(F.col("bad") + pages_failed).alias("pages_failed")]
    return totals.join(bad).select(F.lit(pages_read).cast("long").alias("pages_read"), "pages_chunked", "total_chunks", (half_up(ratio("total_chunks", "pages_chunked") * 10) / 10).alias("avg_chunks_per_page"), half_up(ratio("tokens", "total_chunks")).alias("avg_tokens_per_chunk"), *lost, *_extra(started_at=started_at, finished_at=finished_at))
