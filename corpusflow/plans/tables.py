"""The test tables as the operators' inputs, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import urls
from corpusflow.operators.html import parsed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Operators that cut their lineage need a folder: the session's, or one of our own where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="corpusflow-")
        sc.setCheckpointDir(folder)


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("url", "html", F.lit(200).alias("statusCode"), F.lit("1970-01-01T00:00:00.000Z").alias("fetchedAt"), F.lit("text/html").alias("contentType"), F.lit(0).alias("depth"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by normal url with their links; of urls that become equal the smallest page_id counts."""
    rows = table(spark, sf_dir, "pages").withColumn("url", urls.normalize(F.col("url"))).where("url IS NOT NULL")
    rows = rows.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    return rows.select("url", "html", F.lit(200).alias("statusCode"), F.lit("text/html").alias("contentType"), F.lit("2024-01-01").alias("lastmod"), parsed(F.col("html"))["links"].alias("links"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where("page_id % 10 <> 0")
    mod = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("d"), (F.col("page_id") % 5).cast("string")))
    value = F.when(F.col("page_id") % 5 == 0, F.sha2(F.concat("html", F.lit("old")), 256)).otherwise(F.sha2("html", 256))
    return rows.select("url", mod.alias("lastmod"), mod.alias("lastModified"), value.alias("contentHash"), F.lit("then").alias("lastFetchedAt"))


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where("page_id % 11 <> 0")
    return rows.select("url", F.concat(F.when(F.col("page_id") % 3 == 0, "e").otherwise("d"), (F.col("page_id") % 5).cast("string")).alias("lastmod"))


SNAPSHOT = """prev AS (SELECT url, CASE WHEN page_id % 7 <> 0 THEN 'd' || (page_id % 5) END AS lastmod, CASE WHEN page_id % 5 = 0 THEN sha256(html || 'old') ELSE sha256(html) END AS hash FROM pages WHERE page_id % 10 <> 0)"""
SITEMAP = """cur AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN 'e' ELSE 'd' END || (page_id % 5) AS lastmod FROM pages WHERE page_id % 11 <> 0)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ranked chunks of five queries."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        (F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("https://e.com/"), (F.col("doc_id") % 50).cast("string"))).alias("source_url"),
        F.col("lang").alias("page_title"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise("").alias("heading_path"), F.lit("paragraph").alias("content_type"),
        F.ceil(F.length("text") / 4).cast("long").alias("token_count"), (F.col("doc_id") % 100 / 100.0).cast("double").alias("vector_score"), F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 90 / 90.0).cast("double")).alias("rerank_score"),
    ).where("text IS NOT NULL")


CHUNKS = """c AS (SELECT doc_id % 5 AS query_id, doc_id AS rank, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'https://e.com/' || (doc_id % 50) END AS source_url, lang AS page_title,
 CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS heading_path, ceil(length(text) / 4.0)::BIGINT AS token_count, (doc_id % 100) / 100.0::DOUBLE AS vector_score, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 90) / 90.0::DOUBLE END AS rerank_score
 FROM documents WHERE text IS NOT NULL)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks of a page with a made-up path and type."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = rows.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    n = F.length("content")
    kind = F.when(n % 5 == 0, "table").when(n % 3 == 0, "list").when(n % 7 == 0, "faq").otherwise("paragraph")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "content", kind.alias("type"), F.when(n % 2 == 0, F.array("source")).otherwise(F.array("source", "lang")).alias("path"))


BLOCKS = r"""b AS (SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, pos, content, CASE WHEN length(content) % 5 = 0 THEN 'table' WHEN length(content) % 3 = 0 THEN 'list' WHEN length(content) % 7 = 0 THEN 'faq' ELSE 'paragraph' END AS type,
 CASE WHEN length(content) % 2 = 0 THEN [source] ELSE [source, lang] END AS path FROM b)"""

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_trim(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '\A{WS}+', ''), '{WS}+\z', '')"


def sql_normalized(e: str) -> str:
    e = rf"regexp_replace({e}, '[ \t\f\x0B]+', ' ', 'g')"
    e = rf"regexp_replace({e}, '\n{WS}*\n+', chr(10), 'g')"
    return sql_trim(rf"regexp_replace({e}, ' *\n *', chr(10), 'g')")
