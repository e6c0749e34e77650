"""Settings from the environment, manifests in full, the history of chats, paths of urls."""

import pytest
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig, CrawlConfig, RetrieveConfig, from_env
from corpusflow.functions import urls
from corpusflow.operators import chat, clean, incremental


def test_settings_from_the_environment():
    env = {"CORPUSFLOW_MAX_TOKENS": "300", "CORPUSFLOW_LOSSLESS": "True", "CORPUSFLOW_SEEDS": "https://e.com, https://o.com", "CORPUSFLOW_MAX_PAGES": "", "CORPUSFLOW_MIN_VECTOR": "0.5"}
    assert from_env(ChunkConfig, env=env) == ChunkConfig(max_tokens=300, lossless=True)
    assert from_env(CrawlConfig, env=env) == CrawlConfig(seeds=("https://e.com", "https://o.com"), max_pages=None)
    assert from_env(RetrieveConfig, env=env).min_vector == 0.5 and from_env(ChunkConfig, env={}) == ChunkConfig()
    for bad in ({"CORPUSFLOW_MAX_TOKENS": "many"}, {"CORPUSFLOW_LOSSLESS": "maybe"}, {"CORPUSFLOW_MIN_TOKENS": "900"}):
        with pytest.raises(ValueError):
            from_env(ChunkConfig, env=bad)


def test_paths_are_encoded(spark):
    cases = {
        "https://e.com/a b": "https://e.com/a%20b", "https://e.com/café/日": "https://e.com/caf%C3%A9/%E6%97%A5", "https://e.com/😀": "https://e.com/%F0%9F%98%80", "https://e.com/a%20b%zz": "https://e.com/a%20b%zz",
        'https://e.com/"<>`{}^': "https://e.com/%22%3C%3E%60%7B%7D%5E", "https://e.com/a|b~c[d]'(e)*!$&+,;=:@-_.": "https://e.com/a|b~c[d]'(e)*!$&+,;=:@-_.", "https://e.com/a\tb\nc": "https://e.com/abc",
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want string").select("want", urls.normalize(F.col("url")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_manifests_in_full(spark):
    pages = spark.createDataFrame([("https://e.com/1", f"<title>t</title><p>{'a' * 500}</p>", 200, "text/html", 0), ("no url", "h", 200, "text/html", 0), ("https://e.com/2", None, 200, "text/html", 0)], "url string, html string, statusCode int, contentType string, depth int")
    bad = clean.invalid_count(pages, clean.valid_raw)
    row = clean.clean_manifest(clean.clean(clean.valid_raw(pages)), bad, "then", "now").first().asDict()
    assert row == {"pages_read": 1, "pages_cleaned": 1, "dropped_short": 0, "dropped_duplicate": 0, "dropped_error": 2, "started_at": "then", "finished_at": "now"}
    none = spark.createDataFrame([], "doc_id string, token_count long")
    row = clean.chunk_manifest(2, none, 1, "then", "now").first()
    assert (row["pages_read"], row["pages_failed"], row["total_chunks"], row["started_at"], row["finished_at"]) == (2, 1, 0, "then", "now")
    changes = spark.createDataFrame([("u", "added")], "url string, change string")
    results = spark.createDataFrame([("u", "added")], "url string, status string")
    row = incremental.run_metadata(changes, results, "then", "now").first()
    assert (row["pages_added"], row["started_at"], row["finished_at"]) == (1, "then", "now")


def test_chat_history(spark, tmp_path):
    path = str(tmp_path / "history")
    assert chat.load_messages(spark, path).count() == 0
    chat.save_messages(spark.createDataFrame([("s", "1", 0, "user", "q"), ("s", "2", 1, "assistant", "par"), ("t", "2", 0, "user", "other")], chat.MESSAGES), path)
    chat.save_messages(spark.createDataFrame([("s", "2", 2, "assistant", "partial no more")], chat.MESSAGES), path)
    (tmp_path / "history/part-broken.parquet").write_text("broken")
    got = {tuple(r) for r in chat.load_messages(spark, path).collect()}
    assert got == {("s", "1", 0, "user", "q"), ("s", "2", 1, "assistant", "partial no more"), ("t", "2", 0, "user", "other")}
