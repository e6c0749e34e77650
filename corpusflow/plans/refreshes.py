"""Queries over two snapshots of the pages, and over the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.urls import doc_id
from corpusflow.operators import incremental, index
from corpusflow.plans import page_sql
from corpusflow.plans.tables import SITEMAP, SNAPSHOT, checkpoints, raw_pages, sitemap, snapshot, table


def diff_snapshot(spark, sf_dir):
    return incremental.diff(sitemap(spark, sf_dir), snapshot(spark, sf_dir)).select("url", "lastmod", "change")


def fetch_changes(spark, sf_dir):
    checkpoints(spark)
    changes = incremental.diff(sitemap(spark, sf_dir), snapshot(spark, sf_dir)).where("change IN ('added', 'changed')")
    return incremental.fetched_changes(changes, raw_pages(spark, sf_dir), snapshot(spark, sf_dir)).select("url", "prevHash", "contentHash", "differs")


def _results(spark, sf_dir):
    """Outcomes by rule instead of by processing, so that SQL can follow them."""
    changes = incremental.diff(sitemap(spark, sf_dir), snapshot(spark, sf_dir))
    n = F.conv(F.substring(F.sha2("url", 256), 1, 4), 16, 10).cast("long")
    status = F.when(n % 5 == 0, "skipped").when(n % 7 == 0, "error").when(F.col("change") == "added", "added").otherwise("updated")
    rows = changes.where("change IN ('added', 'changed')").select("url", "lastmod", "previous", status.alias("status"))
    return changes, rows.withColumn("newHash", F.when(F.col("status").isin("added", "updated"), F.sha2("url", 256)))


def snapshot_rebuild(spark, sf_dir):
    changes, results = _results(spark, sf_dir)
    return incremental.rebuild_snapshot(changes, results, snapshot(spark, sf_dir), "now")


def run_metadata(spark, sf_dir):
    return incremental.run_metadata(*_results(spark, sf_dir))


def process_delta(spark, sf_dir):
    checkpoints(spark)
    prev = snapshot(spark, sf_dir)
    changes = incremental.diff(sitemap(spark, sf_dir), prev).where("change IN ('added', 'changed')")
    return incremental.process_delta(changes, raw_pages(spark, sf_dir), prev).results.drop("previous")


def incremental_refresh(spark, sf_dir):
    checkpoints(spark)
    embedder = index.HashingEmbedder(16)
    from corpusflow.schemas import INDEXED

    out = incremental.refresh(sitemap(spark, sf_dir), raw_pages(spark, sf_dir), snapshot(spark, sf_dir), spark.createDataFrame([], INDEXED), embedder)
    return out.index.select("chunk_id", "doc_id", "source_url", "chunk_index", "token_count", F.sha2("text", 256).alias("text_digest"))


def _index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("https://e.com/"), (F.col("doc_id") % 100).cast("string")))
    return rows.select(F.concat(doc_id(F.col("url")), F.lit("-"), F.col("doc_id").cast("string")).alias("chunk_id"), doc_id(F.col("url")).alias("doc_id"), F.col("n_chars"))


def _docs(spark):
    return spark.range(0, 100, 9).select(doc_id(F.concat(F.lit("https://e.com/"), F.col("id").cast("string"))).alias("doc_id"))


def delete_by_doc(spark, sf_dir):
    return index.delete_documents(_index(spark, sf_dir), _docs(spark))


def deleted_chunks(spark, sf_dir):
    return index.deleted_count(_index(spark, sf_dir), _docs(spark))


def index_upsert(spark, sf_dir):
    rows = _index(spark, sf_dir)
    new = rows.where("n_chars % 4 = 0").select("chunk_id", "doc_id", (-F.col("n_chars")).alias("n_chars"))
    return index.upsert(rows.where("n_chars % 3 <> 0"), new)


_DIFF = f"""{SNAPSHOT}, {SITEMAP}, d AS (SELECT coalesce(cur.url, prev.url) AS url, cur.lastmod AS lastmod, prev.hash, prev.lastmod AS was, prev.url IS NOT NULL AS known,
 CASE WHEN cur.url IS NULL THEN 'removed' WHEN prev.url IS NULL THEN 'added' WHEN coalesce(cur.lastmod, '') = '' OR coalesce(prev.lastmod, '') = '' OR cur.lastmod <> prev.lastmod THEN 'changed' ELSE 'unchanged' END AS change
 FROM cur FULL OUTER JOIN prev ON cur.url = prev.url)"""
_RESULTS = f"""{_DIFF}, n AS (SELECT *, ('0x' || sha256(url)[1:4])::BIGINT AS h FROM d WHERE change IN ('added', 'changed')),
r AS (SELECT *, CASE WHEN h % 5 = 0 THEN 'skipped' WHEN h % 7 = 0 THEN 'error' WHEN change = 'added' THEN 'added' ELSE 'updated' END AS status FROM n)"""
#: What of the candidates is new, and its chunks; a page isn't compared with others here.
_FRESH = f"""{_DIFF}, {page_sql.CLEANED}, n AS (SELECT d.url, d.lastmod, d.hash AS was_hash, coalesce(d.hash, '') = '' AS first, sha256(q.html) AS now_hash, coalesce(coalesce(d.hash, '') = '' OR d.hash <> sha256(q.html), false) AND q.url IS NOT NULL AS differs FROM d LEFT JOIN pages q ON q.url = d.url WHERE change IN ('added', 'changed')),
o AS (SELECT * FROM p WHERE kept AND url IN (SELECT url FROM n WHERE differs)), {page_sql.chunked('o')}, y AS (SELECT source_url AS url, count(*) AS made FROM k GROUP BY 1)"""
_IDX = "i AS (SELECT sha256('https://e.com/' || (doc_id % 100))[1:16] || '-' || doc_id AS chunk_id, sha256('https://e.com/' || (doc_id % 100))[1:16] AS doc_id, n_chars FROM documents)"
_GONE = "g AS (SELECT sha256('https://e.com/' || x)[1:16] AS doc_id FROM range(0, 100, 9) t(x))"
SQL = {
    "process_delta": f"WITH {_FRESH}, z AS (SELECT n.url, lastmod, CASE WHEN NOT differs THEN 'skipped' WHEN made IS NULL THEN 'error' WHEN first THEN 'added' ELSE 'updated' END AS status, now_hash, coalesce(made, 0) AS chunks_written FROM n LEFT JOIN y USING (url)) SELECT url, lastmod, status, CASE WHEN status IN ('added', 'updated') THEN now_hash END AS \"newHash\", chunks_written FROM z",
    "incremental_refresh": f"WITH {_FRESH} SELECT chunk_id, doc_id, source_url, chunk_index, token_count, sha256(text) AS text_digest FROM k",
    "diff_snapshot": f"WITH {_DIFF} SELECT url, lastmod, change FROM d",
    "fetch_changes": f"WITH {_DIFF} SELECT d.url, d.hash AS prevHash, sha256(p.html) AS contentHash, coalesce(d.hash IS NULL OR d.hash <> sha256(p.html), false) AS differs FROM d LEFT JOIN pages p ON p.url = d.url WHERE change IN ('added', 'changed')",
    "snapshot_rebuild": f"WITH {_RESULTS} SELECT url, was AS lastmod, was AS lastModified, hash AS contentHash, 'then' AS lastFetchedAt FROM d WHERE change = 'unchanged' UNION ALL SELECT url, was, was, hash, 'then' FROM r WHERE status = 'skipped' AND known UNION ALL SELECT url, lastmod, lastmod, sha256(url), 'now' FROM r WHERE status IN ('added', 'updated')",
    "run_metadata": f"WITH {_RESULTS} SELECT (SELECT count(*) FROM r WHERE status = 'added') AS pages_added, (SELECT count(*) FROM r WHERE status = 'updated') AS pages_updated, (SELECT count(*) FROM d WHERE change = 'removed') AS pages_removed, (SELECT count(*) FROM r WHERE status = 'skipped') + (SELECT count(*) FROM d WHERE change = 'unchanged') AS pages_skipped, (SELECT count(*) FROM r WHERE status = 'error') AS errors, (SELECT count(*) FROM d WHERE change <> 'removed') AS total_urls_discovered",
    "delete_by_doc": f"WITH {_IDX}, {_GONE} SELECT i.* FROM i ANTI JOIN g USING (doc_id)",
    "deleted_chunks": f"WITH {_IDX}, {_GONE} SELECT count(*) AS deleted_chunks FROM i SEMI JOIN g USING (doc_id)",
    "index_upsert": f"WITH {_IDX}, n AS (SELECT chunk_id, doc_id, -n_chars AS n_chars FROM i WHERE n_chars % 4 = 0) SELECT * FROM n UNION ALL SELECT * FROM i WHERE n_chars % 3 <> 0 AND chunk_id NOT IN (SELECT chunk_id FROM n)",
}
QUERIES = {f.__name__: f for f in (diff_snapshot, fetch_changes, snapshot_rebuild, run_metadata, process_delta, incremental_refresh, delete_by_doc, deleted_chunks, index_upsert)}
