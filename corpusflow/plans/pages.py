"""Queries over pages and documents: urls, keys, text, cleaning, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.config import SKIP_EXTENSIONS, STRIP_PARAMS
from corpusflow.functions import text, tokens, urls
from corpusflow.operators import chunk, clean, crawl, index
from corpusflow.operators.html import parsed
from corpusflow.plans import page_sql
from corpusflow.plans.tables import BLOCKS, WS, blocks, checkpoints, chunks, raw_pages, sql_normalized, sql_trim, table, web

DOMAINS = ("news.example", "www.example.com", "wiki.example")


def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm"))


def url_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.normalize(F.col("url")).alias("norm")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


def url_domain_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.in_domains(F.col("url"), DOMAINS).alias("allowed"))


def url_skip_extension(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    made = F.concat(F.col("url"), F.element_at(F.array(*[F.lit(x) for x in ("", ".PDF", ".css", "/a.zip")]), (F.col("page_id") % 4 + 1).cast("int")))
    return rows.select("page_id", urls.has_extension(made).alias("skip"))


def url_labels(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host_label(u).alias("host_label"), urls.path_label(u).alias("path_label"), urls.source_title(F.when(F.col("page_id") % 2 == 0, "  T ").otherwise(" "), u).alias("title"))


def doc_ids(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.file_key(u).alias("file_key"), urls.doc_id(u).alias("doc_id"), urls.chunk_id(urls.doc_id(u), F.col("page_id")).alias("chunk_id"))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"))


def normalize_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized(F.col("text")), 256).alias("lines"), F.sha2(text.inline(F.col("text")), 256).alias("line"))


def token_estimate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tokens.count(t).alias("tokens"), tokens.truncate(t, 10).alias("head"), tokens.tail(t, 10).alias("tail"))


def chunk_fixed_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunk.fixed_split(F.col("text"), 100)).alias("i", "piece"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "piece")


def sentence_split(spark, sf_dir):
    found = chunk.sentence_split(F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(found).cast("long").alias("n"), F.sha2(F.array_join(found, "|"), 256).alias("digest"))


def section_islands(spark, sf_dir):
    rows = chunk.section_islands(blocks(spark, sf_dir), "doc_id", "pos", F.col("path"))
    return rows.groupBy("doc_id", "section").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


def dominant_type(spark, sf_dir):
    rows = blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("type").alias("kinds"))
    return rows.select("doc_id", chunk.dominant_type(F.col("kinds")).alias("type"))


def min_length_filter(spark, sf_dir):
    rows = blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("content").alias("contents"))
    total = clean.total_length(F.col("contents"))
    return rows.select("doc_id", total.cast("long").alias("total")).where(F.col("total") >= clean.CleanConfig().min_content_length)


def source_hash_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string")).alias("url"), text.source_hash(F.split("text", "\n", -1)).alias("sourceHash"))
    return clean.first_by_hash(rows)


def retrieval_text(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    path = F.when(F.col("pos") % 3 == 2, F.array().cast("array<string>")).otherwise(F.col("path"))
    return rows.select("doc_id", "pos", F.sha2(text.retrieval_text(F.col("content"), path), 256).alias("digest"), text.section_heading(path, F.lit("T")).alias("heading"))


def link_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", parsed(F.col("html"))["links"].alias("links"))
    base = rows.withColumn("url", urls.normalize(F.col("url"))).where("url IS NOT NULL")
    return crawl.links(base).groupBy("src", "dst").agg(F.min("pos").cast("long").alias("pos"))


def clean_pages(spark, sf_dir):
    rows = clean.clean_pages(clean.valid_raw(raw_pages(spark, sf_dir)))
    return rows.select("url", "title", F.to_json("headings").alias("headings"), F.to_json("textBlocks").alias("blocks"), "sourceHash", "depth")


def clean_manifest(spark, sf_dir):
    pages = raw_pages(spark, sf_dir)
    return clean.clean_manifest(clean.clean(clean.valid_raw(pages)), clean.invalid_count(pages, clean.valid_raw))


def chunk_pages(spark, sf_dir):
    rows = chunk.chunk_pages(clean.clean_pages(clean.valid_raw(raw_pages(spark, sf_dir))))
    return clean.valid_chunks(rows).withColumn("heading_path", F.array_join("heading_path", " > "))


def chunk_manifest(spark, sf_dir):
    checkpoints(spark)
    pages = clean.clean_pages(clean.valid_raw(raw_pages(spark, sf_dir))).checkpoint()
    return clean.chunk_manifest(pages.count(), chunk.chunk_pages(clean.valid_cleaned(pages), mark_failed=True), clean.invalid_count(pages, clean.valid_cleaned))


def index_pages(spark, sf_dir):
    rows = chunk.chunk_pages(clean.clean_pages(clean.valid_raw(raw_pages(spark, sf_dir))))
    rows = clean.valid_vectors(index.index_rows(rows, index.HashingEmbedder()), 64)
    return rows.withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 6)))


def index_batches(spark, sf_dir):
    rows = index.batches(table(spark, sf_dir, "documents").select("doc_id").distinct(), "doc_id", 96)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def flat_metadata(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("heading_path", F.array("page_title", "heading_path"))
    rest = {c: F.lit(c) for c in ("doc_id", "section_heading", "crawled_at", "language", "source_hash")} | {"chunk_index": F.lit(0), "chunk_count": F.lit(1)}
    flat = rows.withColumns(rest).select("chunk_id", *index.flat_metadata())
    return flat.select("chunk_id", "heading_path", F.sha2("text", 256).alias("text_digest"), "token_count")


def robots_rules(spark, sf_dir):
    checkpoints(spark)
    return crawl.robots_rules(_robots(spark), "corpusflow/1.0")


ROBOTS = "# all\nUser-agent: *\nDisallow: /de\nAllow: /de/1\nDisallow:\nUser-agent: other\nDisallow: /\nUser-agent: CorpusFlow\nDisallow: /fr/ # why\nAllow: /fr/\nDisallow: /es/2"


def _robots(spark):
    return spark.createDataFrame([("https://news.example", 200, ROBOTS), ("https://www.wiki.example", 200, "User-agent: *\nDisallow: /"), ("http://gone.example", 404, "User-agent: *\nDisallow: /")], "origin string, status int, body string")


RULES = (("disallow", "/de"), ("allow", "/de/1"), ("disallow", "/fr/"), ("allow", "/fr/"), ("disallow", "/es/2"))


def robots_longest_match(spark, sf_dir):
    """The same rules for every host of the table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    origins = pages.select(urls.origin(F.col("url")).alias("origin")).distinct()
    rules = origins.join(F.broadcast(spark.createDataFrame(list(RULES), "kind string, pattern string")))
    return crawl.robots_allowed(pages, rules).select("page_id", "allowed")


def _graph(spark, sf_dir):
    n = F.lit(table(spark, sf_dir, "pages").count())
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return rows.select(F.col("page_id").cast("string").alias("src"), F.pmod(F.col("page_id") * 7 + F.col("k"), n).cast("string").alias("dst"))


def crawl_bfs(spark, sf_dir):
    checkpoints(spark)
    return crawl.reachable(_graph(spark, sf_dir), spark.createDataFrame([("1",)], "url string"), 4)


def crawl_outcomes(spark, sf_dir):
    """A crawl of the pages themselves: every url is a seed, all hosts are allowed and have the same robots
    file, and no page bound is set."""
    checkpoints(spark)
    from corpusflow.config import CrawlConfig

    pages = web(spark, sf_dir)
    hosts = tuple(r[0] for r in pages.select(urls.host(F.col("url")).alias("h")).distinct().orderBy("h").collect())
    files = pages.select(urls.origin(F.col("url")).alias("origin"), F.lit(200).alias("status"), F.lit(ROBOTS).alias("body")).distinct()
    rules = crawl.robots_rules(files, "corpusflow/1.0")
    return crawl.crawl(pages, rules, CrawlConfig(allowed_domains=hosts, max_pages=None), pages.select("url")).select("url", "depth", "outcome")


def crawl_manifest(spark, sf_dir):
    rows = crawl.crawl_manifest(crawl_outcomes(spark, sf_dir), 1.5, "then", "now")
    return rows.withColumn("failed_urls", F.sha2(F.array_join("failed_urls", "|"), 256))


def discover(spark, sf_dir):
    checkpoints(spark)
    from corpusflow.config import CrawlConfig

    pages = web(spark, sf_dir)
    hosts = tuple(r[0] for r in pages.select(urls.host(F.col("url")).alias("h")).distinct().orderBy("h").collect())
    return crawl.discover(pages, CrawlConfig(allowed_domains=hosts, max_pages=None), pages.select("url"))


_U = r"^(?i)(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"
_HOST = r"regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1)"
_STRIP = ", ".join(f"'{p}'" for p in STRIP_PARAMS)
_NORM = rf"""'https://' || {_HOST} || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/$', '') END
 || coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_STRIP}))), 'string_agg', '&'), ''), '')"""
_PIECES = "unnest(list_transform(range(0, length(text), 400), lambda i: substring(text, i + 1, 400)))"
_SEGMENT = "replace(list_filter(string_split(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[-1], '-', ' ')"
_LABEL = rf"coalesce(list_aggregate(list_transform(regexp_extract_all({_SEGMENT}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ''), 'Home')"
#: A path as URLs have it: what a path can't hold as %XX of its UTF-8.
_ENCODED = r"coalesce(list_aggregate(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[^\x21\x23-\x3b\x3d\x3f-\x5d\x5f\x61-\x7a\x7c\x7e]') THEN url_encode(c) ELSE c END), 'string_agg', ''), '')"
#: Links lead to no page of the table, so what isn't a page lies one step away and fails, if it may be fetched at all.
_CRAWL = rf"""s AS (SELECT DISTINCT {_NORM} AS url FROM pages), g AS (SELECT {_NORM} AS url, min_by(html, page_id) AS html FROM pages GROUP BY 1),
r(kind, pattern) AS (VALUES {', '.join(map(str, RULES))}), b AS (SELECT url, html, {_PATH} AS path, true AS ruled FROM g),
judged AS (SELECT url, html, coalesce(max(length(pattern)) FILTER (kind = 'disallow'), -1) AS deny, coalesce(max(length(pattern)) FILTER (kind = 'allow'), -1) AS allow FROM b LEFT JOIN r ON ruled AND starts_with(path, pattern) GROUP BY 1, 2),
f AS (SELECT url, html, CASE WHEN deny = -1 OR allow >= deny THEN 'fetched' ELSE 'robots' END AS outcome FROM judged),
h AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=.([^>''"]*)', 1)) AS href FROM f WHERE outcome = 'fetched'),
t AS (SELECT DISTINCT regexp_extract(src, '^(https://[^/?#]*)', 1) || regexp_replace({_ENCODED.format('href')}, '(.)/$', '\1') AS url FROM h WHERE starts_with(href, '/')),
n AS (SELECT url, {_PATH} AS path, true AS ruled FROM t WHERE url NOT IN (SELECT url FROM s)),
m AS (SELECT url, path, coalesce(max(length(pattern)) FILTER (kind = 'disallow'), -1) AS deny, coalesce(max(length(pattern)) FILTER (kind = 'allow'), -1) AS allow FROM n LEFT JOIN r ON ruled AND starts_with(path, pattern) GROUP BY 1, 2),
o AS (SELECT url, 0 AS depth, outcome FROM f UNION ALL SELECT url, 1, CASE WHEN regexp_matches(path, '(?i)\.({'|'.join(SKIP_EXTENSIONS)})\z') THEN 'extension' WHEN deny = -1 OR allow >= deny THEN 'failed' ELSE 'robots' END FROM m)"""
SQL = {
    **page_sql.SQL,
    "url_normalize": f"SELECT page_id, {_NORM} AS norm FROM pages",
    "url_dedupe": f"SELECT {_NORM} AS norm, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1",
    "url_domain_filter": f"SELECT page_id, {_HOST} AS host, {_HOST} IN ('news.example', 'example.com', 'wiki.example') AS allowed FROM pages",
    "url_skip_extension": rf"SELECT page_id, regexp_matches(regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1), '(?i)\.({'|'.join(SKIP_EXTENSIONS)})\z') AS skip FROM (SELECT page_id, url || ['', '.PDF', '.css', '/a.zip'][(page_id % 4 + 1)::INT] AS u FROM pages)",
    "doc_ids": "SELECT page_id, sha256(url) || '.json' AS file_key, sha256(url)[1:16] AS doc_id, sha256(url)[1:16] || '-' || page_id AS chunk_id FROM pages",
    "content_hash": "SELECT page_id, sha256(html) AS content_hash FROM pages",
    "normalize_whitespace": f"SELECT doc_id, sha256({sql_normalized('text')}) AS lines, sha256(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS line FROM documents",
    "token_estimate": "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, text[1:40] AS head, right(text, 40) AS tail FROM documents WHERE text IS NOT NULL",
    "chunk_fixed_split": f"SELECT doc_id, i - 1 AS i, piece FROM (SELECT doc_id, {_PIECES} AS piece, unnest(range(1, ceil(length(text) / 400.0)::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL)",
    "sentence_split": r"WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]+|\S+\z') AS f FROM documents WHERE text IS NOT NULL) SELECT doc_id, greatest(len(f), 1)::BIGINT AS n, sha256(CASE WHEN len(f) > 0 THEN array_to_string(f, '|') ELSE text END) AS digest FROM s",
    "section_islands": f"WITH {BLOCKS}, l AS (SELECT *, coalesce((path <> lag(path) OVER (PARTITION BY doc_id ORDER BY pos))::INT, 0) AS new FROM blocks), s AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM l) SELECT doc_id, section, min(pos) AS first, count(*) AS n FROM s GROUP BY ALL",
    "dominant_type": f"WITH {BLOCKS}, k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (type = 'table') AS t, count(*) FILTER (type = 'faq') AS f, count(*) FILTER (type = 'list') AS l FROM blocks GROUP BY 1) SELECT doc_id, CASE WHEN t > 0 AND 2 * t >= n THEN 'table' WHEN f > 0 AND 2 * f >= n THEN 'faq' WHEN l > 0 AND 2 * l >= n THEN 'list' ELSE 'paragraph' END AS type FROM k",
    "min_length_filter": f"WITH {BLOCKS} SELECT doc_id, sum(length(content))::BIGINT AS total FROM blocks WHERE content <> '' GROUP BY 1 HAVING total >= 400",
    "source_hash_dedupe": f"WITH d AS (SELECT 'https://e.com/' || doc_id AS url, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {sql_normalized('x')}), chr(10) || '---' || chr(10))) AS sourceHash FROM documents WHERE text IS NOT NULL) SELECT arg_min(url, sha256(url)) AS url, sourceHash FROM d GROUP BY sourceHash",
    "retrieval_text": f"WITH {BLOCKS}, r AS (SELECT doc_id, pos, content, CASE WHEN pos % 3 = 2 THEN []::VARCHAR[] ELSE path END AS path FROM blocks) SELECT doc_id, pos, sha256(CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') || chr(10) || chr(10) ELSE '' END || content) AS digest, coalesce(nullif(path[-1], ''), 'T') AS heading FROM r",
    "index_batches": "WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 96 AS batch FROM (SELECT DISTINCT doc_id FROM documents)) SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY 1",
    "flat_metadata": "SELECT doc_id::VARCHAR AS chunk_id, lang || ' > ' || CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS heading_path, sha256(text) AS text_digest, ceil(length(text) / 4.0)::BIGINT AS token_count FROM documents WHERE text IS NOT NULL",
    "robots_rules": f"""WITH f(origin, status, body) AS (VALUES ('https://news.example', 200, '{ROBOTS}'), ('https://www.wiki.example', 200, 'User-agent: *' || chr(10) || 'Disallow: /'), ('http://gone.example', 404, 'User-agent: *' || chr(10) || 'Disallow: /')),
l AS (SELECT origin, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS pos FROM f WHERE status = 200), s AS (SELECT origin, pos, trim(regexp_replace(raw, '#.*', '')) AS line FROM l),
k AS (SELECT origin, pos, lower(trim(string_split(line, ':')[1])) AS kind, trim(array_to_string(string_split(line, ':')[2:], ':')) AS pattern FROM s),
a AS (SELECT *, last_value(CASE WHEN kind = 'user-agent' THEN lower(pattern) IN ('*', 'corpusflow') END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY pos ROWS UNBOUNDED PRECEDING) AS applies FROM k)
SELECT origin, kind, pattern FROM a WHERE applies AND kind IN ('allow', 'disallow') AND pattern <> ''""",
    "crawl_outcomes": f"""WITH {_CRAWL} SELECT url, depth, outcome FROM o""",
    "crawl_manifest": f"""WITH {_CRAWL} SELECT count(*) FILTER (outcome = 'fetched') AS pages_fetched, count(*) FILTER (outcome = 'failed') AS pages_failed, count(*) FILTER (outcome = 'robots') AS pages_skipped_robots, 0::BIGINT AS pages_skipped_domain, 0::BIGINT AS pages_skipped_non_html, count(*) FILTER (outcome = 'extension') AS pages_skipped_extension, sha256(coalesce(string_agg(url, '|' ORDER BY url) FILTER (outcome = 'failed'), '')) AS failed_urls, 2::BIGINT AS duration_seconds, 'then' AS started_at, 'now' AS finished_at FROM o""",
    "discover": f"WITH u AS (SELECT DISTINCT {_NORM} AS url FROM pages) SELECT url, '2024-01-01' AS lastmod FROM u",
    "robots_longest_match": f"WITH r(kind, pattern) AS (VALUES {', '.join(map(str, RULES))}), p AS (SELECT page_id, {_PATH} AS path FROM pages), m AS (SELECT page_id, coalesce(max(length(pattern)) FILTER (kind = 'disallow'), -1) AS deny, coalesce(max(length(pattern)) FILTER (kind = 'allow'), -1) AS allow FROM p LEFT JOIN r ON starts_with(p.path, r.pattern) GROUP BY 1) SELECT page_id, deny = -1 OR allow >= deny AS allowed FROM m",
    "crawl_bfs": "WITH RECURSIVE g AS (SELECT page_id AS src, (page_id * 7 + k) % (SELECT count(*) FROM pages) AS dst FROM pages, (VALUES (0), (1), (2)) t(k)), r(url, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.url WHERE r.depth < 4) SELECT url::VARCHAR AS url, min(depth)::INT AS depth FROM r GROUP BY 1",
    "link_extract": rf"WITH p AS (SELECT {_NORM} AS src, regexp_extract_all(html, '(?i)<a\s[^>]*?href=.([^>''\x22]*)', 1) AS l FROM pages), h AS (SELECT src, unnest(l) AS href, unnest(range(len(l))) AS pos FROM p) SELECT src, regexp_extract(src, '^(https://[^/?#]*)', 1) || regexp_replace({_ENCODED.format('href')}, '(.)/$', '\1') AS dst, min(pos) AS pos FROM h WHERE starts_with(href, '/') GROUP BY 1, 2",
    "url_labels": f"SELECT page_id, {_HOST} AS host_label, {_LABEL} AS path_label, CASE WHEN page_id % 2 = 0 THEN 'T' ELSE {_LABEL} END AS title FROM pages",
}
NAMES = (url_normalize, url_dedupe, url_domain_filter, url_skip_extension, url_labels, doc_ids, content_hash, normalize_whitespace, token_estimate, chunk_fixed_split, sentence_split, section_islands, dominant_type, min_length_filter, source_hash_dedupe, retrieval_text, link_extract, clean_pages, clean_manifest, chunk_pages, chunk_manifest, index_pages, index_batches, flat_metadata, robots_rules, robots_longest_match, crawl_bfs, crawl_outcomes, crawl_manifest, discover)
QUERIES = {f.__name__: f for f in NAMES}
