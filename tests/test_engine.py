"""Crawling, refresh, retrieval, answers, chat, files and streaming on small inputs."""

from pyspark.sql import functions as F

from corpusflow import schemas
from corpusflow.config import CrawlConfig
from corpusflow.operators import answer, chat, crawl, incremental, index, retrieve
from corpusflow.plans.tables import checkpoints
from corpusflow.sources import fetch, files
from corpusflow.streaming.refresh import refresh_stream

PAGE = "<title>{0}</title><p>" + "{0} words about a topic. " * 30 + "</p>"


def test_robots(spark):
    rules = spark.createDataFrame([("https://e.com", "disallow", "/a"), ("https://e.com", "allow", "/a/b"), ("https://e.com", "allow", "/t"), ("https://e.com", "disallow", "/t")], "origin string, kind string, pattern string")
    pages = spark.createDataFrame([("https://e.com/a/x",), ("https://e.com/a/b/c",), ("https://e.com/z",), ("https://e.com/t",), ("https://o.com/a",)], "url string")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(pages, rules).collect()}
    assert got == {"https://e.com/a/x": False, "https://e.com/a/b/c": True, "https://e.com/z": True, "https://e.com/t": True, "https://o.com/a": True}


def web(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, statusCode int, contentType string, lastmod string, links array<string>")


def test_crawl(spark):
    checkpoints(spark)
    pages = web(spark, [("https://e.com/", "h", 200, "text/html", "1", ["/a", "b", "/x.pdf", "https://o.com/", "mailto:q"]), ("https://e.com/a", "h", 200, "text/html", "1", ["/deep"]), ("https://e.com/b", "h", 500, "text/html", "1", ["/never"]), ("https://e.com/deep", "h", 200, "image/png", "1", [])])
    rules = spark.createDataFrame([], "origin string, kind string, pattern string")
    config = CrawlConfig(seeds=("http://www.e.com",), allowed_domains=("e.com",))
    got = {r["url"]: (r["depth"], r["outcome"]) for r in crawl.crawl(pages, rules, config).collect()}
    assert got == {"https://e.com/": (0, "fetched"), "https://e.com/a": (1, "fetched"), "https://e.com/b": (1, "failed"), "https://e.com/x.pdf": (1, "extension"), "https://e.com/deep": (2, "non_html")}
    assert {r["url"] for r in crawl.discover(pages, config).collect()} == {"https://e.com/", "https://e.com/a"}
    counts = crawl.crawl_manifest(crawl.crawl(pages, rules, config), 1.5).first()
    assert (counts["pages_fetched"], counts["pages_failed"], counts["duration_seconds"]) == (2, 1, 2)


def test_diff_truth_table(spark):
    cur = spark.createDataFrame([("new", "1"), ("moved", "2"), ("nodate", None), ("olddate", "1"), ("same", "1")], "url string, lastmod string")
    prev = spark.createDataFrame([("moved", "1"), ("nodate", "1"), ("olddate", ""), ("same", "1"), ("gone", "1")], "url string, lastmod string")
    assert {r["url"]: r["change"] for r in incremental.diff(cur, prev).collect()} == {"new": "added", "moved": "changed", "nodate": "changed", "olddate": "changed", "same": "unchanged", "gone": "removed"}


def refreshed(spark, pages, previous, held):
    fetched = spark.createDataFrame([(u, h, 200, "text/html") for u, _, h in pages], "url string, html string, statusCode int, contentType string")
    current = spark.createDataFrame([(u, m) for u, m, _ in pages], "url string, lastmod string")
    return incremental.refresh(current, fetched, previous, held, index.HashingEmbedder(8))


def test_refresh(spark):
    checkpoints(spark)
    nothing, empty = spark.createDataFrame([], schemas.SNAPSHOT), spark.createDataFrame([], schemas.INDEXED)
    one = refreshed(spark, [("https://e.com/1", "1", PAGE.format("one")), ("https://e.com/2", "1", PAGE.format("two")), ("https://e.com/3", "1", "<p>short</p>")], nothing, empty)
    assert one.metadata.first().asDict() == {"pages_added": 2, "pages_updated": 0, "pages_removed": 0, "pages_skipped": 0, "errors": 1, "total_urls_discovered": 3}
    snapshot, held = one.snapshot.checkpoint(), one.index.checkpoint()
    assert snapshot.count() == 2
    two = refreshed(spark, [("https://e.com/1", "2", PAGE.format("one")), ("https://e.com/3", "1", PAGE.format("three"))], snapshot, held)
    assert {r["url"]: r["status"] for r in two.results.collect()} == {"https://e.com/1": "skipped", "https://e.com/3": "added"}
    assert {r["source_url"] for r in two.index.collect()} == {"https://e.com/1", "https://e.com/3"}
    assert {r["url"]: r["lastmod"] for r in two.snapshot.collect()} == {"https://e.com/1": "1", "https://e.com/3": "1"}


def test_index(spark):
    rows = spark.createDataFrame([("d1-0", "d1", 1), ("d1-1", "d1", 2), ("d2-0", "d2", 3)], "chunk_id string, doc_id string, v int")
    new = spark.createDataFrame([("d1-0", "d1", 9)], "chunk_id string, doc_id string, v int")
    assert sorted(r["v"] for r in index.upsert(rows, new).collect()) == [2, 3, 9]
    assert [r["v"] for r in index.replace_documents(rows, new).orderBy("v").collect()] == [3, 9]
    assert index.deleted_count(rows, new).first()[0] == 2


def test_search_in_turns(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(30)], "chunk_id long, vector array<float>")
    asked = rows.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    once = sorted(map(tuple, index.search(rows, asked, 4).collect()))
    monkeypatch.setattr(index, "QUERY_BYTES", 2 * 8 * 3)
    assert sorted(map(tuple, index.search(rows, asked, 4).collect())) == once and len(once) == 24


def test_retrieve_and_answer(spark):
    checkpoints(spark)
    chunks = spark.createDataFrame([(f"d-{i}", "d", t, 10, f"https://e.com/{i}", "T", "H", [], "paragraph", "now", "en", i, 3, "s") for i, t in enumerate(["red fox in the snow", "blue whale in the sea", "green tree in the park"])], "chunk_id string, doc_id string, text string, token_count long, source_url string, page_title string, section_heading string, heading_path array<string>, content_type string, crawled_at string, language string, chunk_index int, chunk_count long, source_hash string")
    embedder = index.HashingEmbedder(256)
    held = index.index_rows(chunks, embedder).checkpoint()
    asked = spark.createDataFrame([(1, "blue whale in the deep sea"), (2, " x "), (3, "who made this"), (4, "zebra quantum piano violin marble stone")], "query_id long, query string")
    got, info = retrieve.retrieve(asked, held, embedder, retrieve.OverlapReranker())
    info = {r["query_id"]: r for r in info.collect()}
    rows = got.orderBy("query_id", "rank").collect()
    assert info[2]["reason"] == "no_results" and info[4]["reason"] == "low_vector_score" and info[1]["confident"] and info[3]["vector_top_score"] == 1.0
    assert [r["chunk_id"] for r in rows if r["query_id"] == 1][0] == "d-1" and [r["chunk_id"] for r in rows if r["query_id"] == 3] == ["static-makers"]

    def broken(query, texts):
        raise RuntimeError

    fallback = retrieve.retrieve(asked, held, embedder, broken)[0].where("query_id = 1").collect()
    assert fallback and all(r["rerank_score"] is None for r in fallback)
    contexts = answer.context(answer.within_budget(got))
    prompts = answer.prompts(asked.withColumn("confident", F.lit(True)).withColumn("language", F.lit("ur")), contexts)
    said = {r["query_id"]: r["answer"] for r in answer.generate(prompts, lambda s, u: "ok" if "Urdu" in s else 1 / 0).collect()}
    assert set(said.values()) == {"ok"} and "[1]" in contexts.where("query_id = 1").first()["context"]


def test_budget_and_citations(spark):
    rows = spark.createDataFrame([(1, 1, 3000, "u1"), (1, 2, 1500, "u2"), (1, 3, 500, "u3")], "query_id long, rank int, token_count long, source_url string")
    assert [r["rank"] for r in answer.within_budget(rows).collect()] == [1]
    usable = spark.createDataFrame([(q, r, u) for q in range(1, 5) for r, u in ((1, "u1"), (2, "u2"))], "query_id long, rank int, source_url string")
    answers = spark.createDataFrame([(1, "[2] [1] [2] [9] [0]"), (2, "only [9]"), (3, "short"), (4, "l" * 90), (5, "[1]")], "query_id long, answer string")
    assert {r["query_id"]: r["sources"] for r in answer.resolve_citations(answers, usable).collect()} == {1: ["u2", "u1"], 2: [], 3: [], 4: ["u1", "u2"], 5: []}


def test_chat(spark):
    body = 'event: metadata\ndata: {"confident": false}\n\nevent: text\ndata: {"delta": "a"}\n\nevent: text\ndata: {"delta": "b"}\n\n: note\n\nevent: sources\ndata: {"sources": ["u", {"url": "v", "title": "V"}]}\n\nevent: done\ndata: {}\n\n'
    row = chat.fold(chat.parse_wire(spark.createDataFrame([(1, body)], "query_id long, body string"))).first()
    assert (row["content"], row["is_refusal"], [tuple(s) for s in row["sources"]], row["error"]) == ("ab", True, [("u", ""), ("v", "V")], None)
    messages = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "system", "d")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in chat.last_user_message(messages).collect()] == [(1, "c")]
    rows = spark.createDataFrame([("m", 1, "x"), ("n", 2, "y"), ("m", 3, "z")], "id string, seq int, body string")
    assert {tuple(r) for r in chat.upsert_messages(rows).collect()} == {("m", 1, "z"), ("n", 2, "y")}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"url": "https://e.com", "html": "h", "statusCode": 200, "fetchedAt": "t", "contentType": "", "depth": 0}')
    (tmp_path / "in/b.json").write_text("{broken")
    (tmp_path / "in/_manifest.json").write_text('{"url": "no"}')
    assert [r["url"] for r in files.raw_pages(spark, str(tmp_path / "in")).collect()] == ["https://e.com"]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n  \n{bad\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()) == [1, 2]
    root = str(tmp_path / "state")
    assert files.load_versioned(spark, root).count() == 0
    rows = spark.createDataFrame([("u", "1", "1", "h", "t")], schemas.SNAPSHOT)
    files.save_versioned(rows, root)
    files.save_versioned(files.load_versioned(spark, root).unionByName(rows), root)
    assert files.load_versioned(spark, root).count() == 2 and files.load_versioned(spark, root, version=2).count() == 0


def test_fetch(spark):
    tried, waits = [], []

    def flaky(url, since):
        tried.append(url)
        if len(tried) < 3:
            raise OSError
        return 200, "h", "text/html", None

    assert fetch.with_retry(flaky, "u", sleep=waits.append)[0] == 200 and waits == [2.0, 4.0]
    assert fetch.with_retry(lambda u, s: (404, "", "", None), "u", sleep=waits.append) is None
    rows = fetch.fetch_pages(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u, s: (200, "h", "t", None) if u == "a" else (403, "", "", None))
    assert {r["url"]: r["statusCode"] for r in rows.collect()} == {"a": 200, "b": None}


def test_stream(spark, tmp_path):
    checkpoints(spark)
    schema = "url string, html string, statusCode int, contentType string, lastmod string"
    source, root = str(tmp_path / "in"), str(tmp_path / "state")
    for n, rows in enumerate(([("https://e.com/1", PAGE.format("one"), 200, "text/html", "1"), ("https://e.com/2", PAGE.format("two"), 200, "text/html", "1")], [("https://e.com/2", PAGE.format("new"), 200, "text/html", "2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        refresh_stream(spark.readStream.schema(schema).parquet(source), root, index.HashingEmbedder(8), str(tmp_path / "cp")).awaitTermination()
        held = files.load_versioned(spark, f"{root}/index", schemas.INDEXED).collect()
        assert {r["source_url"] for r in held} == {"https://e.com/1", "https://e.com/2"} and any(("new" in r["text"]) == bool(n) for r in held if r["source_url"].endswith("2"))
    assert files.load_versioned(spark, f"{root}/snapshot").count() == 2
