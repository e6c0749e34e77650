"""Pages that fail, log records, suggested questions."""

import json

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.tokens import Estimate
from corpusflow.log import logger
from corpusflow.operators import chat, chunk, clean, html

PAGE = f"<title>t</title><p>{'word ' * 200}</p>"


class Fussy(Estimate):
    """Fails on texts with a mark."""

    def count(self, text):
        if "bad" in text:
            raise ValueError("a bad text")
        return super().count(text)


def test_pages_that_the_parser_fails_on(spark, monkeypatch):
    real = html.content

    def content(page):
        if "broken" in page:
            raise ValueError("a broken page")
        return real(page)

    monkeypatch.setattr(html, "content", content)
    rows = spark.createDataFrame([("https://e.com/1", PAGE, 0), ("https://e.com/2", "broken", 0), ("https://e.com/3", None, 0)], "url string, html string, depth int")
    got = clean.clean(rows, clean.CleanConfig(min_content_length=0))
    assert {(r["url"], r["kept"], r["error"]) for r in got.collect()} == {("https://e.com/1", True, None), ("https://e.com/2", False, "ValueError: a broken page"), ("https://e.com/3", True, None)}
    assert clean.clean_manifest(clean.clean(rows), 0).first().asDict() == {"pages_read": 3, "pages_cleaned": 1, "dropped_short": 1, "dropped_duplicate": 0, "dropped_error": 1}
    with pytest.raises(Exception, match="a broken page"):
        rows.select(html.parsed(F.col("html"))["links"].alias("links")).collect()


def test_manifest_counts_failed_pages(spark):
    rows = spark.createDataFrame([("https://e.com/1", "t", "h1", True, None), ("https://e.com/2", None, None, False, "ValueError: x"), ("https://e.com/3", "t", "h2", False, None)], "url string, title string, sourceHash string, kept boolean, error string")
    row = clean.clean_manifest(rows, 1).first().asDict()
    assert row == {"pages_read": 3, "pages_cleaned": 1, "dropped_short": 1, "dropped_duplicate": 0, "dropped_error": 2}


def test_pages_that_cannot_be_chunked(spark):
    rows = spark.createDataFrame([(f"https://e.com/{i}", "T", [("paragraph", text, ["H"])], "s") for i, text in enumerate(("word " * 100, "bad " * 100, "x"))], "url string, title string, textBlocks array<struct<type:string,content:string,headingPath:array<string>>>, sourceHash string").withColumn("cleanedAt", F.lit("now"))
    got = chunk.chunk_pages(rows, tokenizer=Fussy(), mark_failed=True)
    assert sorted((r["source_url"], r["failed"], r["chunk_id"] is None) for r in got.collect()) == [("https://e.com/0", False, False), ("https://e.com/1", True, True)]
    row = clean.chunk_manifest(3, got, 4).first()
    assert (row["pages_chunked"], row["total_chunks"], row["pages_failed"]) == (1, 1, 5)
    assert "failed" not in chunk.chunk_pages(rows).columns
    with pytest.raises(Exception, match="a bad text"):
        chunk.chunk_pages(rows, tokenizer=Fussy()).collect()


def test_cleaned_pages_have_no_error_column(spark):
    rows = spark.createDataFrame([("https://e.com/1", PAGE, 0)], "url string, html string, depth int")
    assert clean.clean(rows).first()["error"] is None and "error" not in clean.clean_pages(rows).columns


def test_log_records(capsys):
    log = logger("crawl", "info")
    log.debug("no")
    log.info("fetched", extra={"meta": {"url": "u", "n": 1}})
    log.error("failed %s", "x")
    said = capsys.readouterr()
    one, two = json.loads(said.out), json.loads(said.err)
    assert (one["level"], one["module"], one["message"], one["meta"]) == ("info", "crawl", "fetched", {"url": "u", "n": 1})
    assert (two["level"], two["message"], "meta" in two, two["timestamp"][-1]) == ("error", "failed x", False, "Z")
    with pytest.raises(ValueError):
        logger("crawl", "loud")


def test_suggested_questions(spark):
    rows = chat.suggested_questions(spark.createDataFrame([(1, "sd"), (2, "xx"), (3, None)], "id int, language string")).collect()
    assert sorted((r["id"], r["place"]) for r in rows) == [(i, p) for i in (1, 2, 3) for p in (0, 1, 2)]
    asked = {(r["id"], r["place"]): r["question"] for r in rows}
    assert asked[2, 0] == asked[3, 0] != asked[1, 0]


def test_pages_are_parsed_once(spark):
    rows = spark.createDataFrame([("https://e.com/1", PAGE, 0)], "url string, html string, depth int")
    pages = clean.clean_pages(rows)
    for df, n in ((pages, 1), (chunk.chunk_pages(pages), 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == n
