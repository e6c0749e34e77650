"""Questions to chunks: facts, expansion, search, gates, reranking, diagnostics; a batch at a time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import RetrieveConfig
from corpusflow.functions.text import WS, once, trimmed, utf16_length
from corpusflow.functions.tokens import count
from corpusflow.operators import index

#: Neutral facts: (id, triggers, content, source_url, source_title, priority, grp).
FACTS = (
    ("maker-one", ["first maker", "architecture"], "The first maker designed the architecture of this assistant.", "", "Project", 10, "makers"),
    ("maker-two", ["second maker"], "The second maker built the index of this assistant.", "", "Project", 10, "makers"),
    ("makers", ["who made", "developer", "first maker", "second maker"], "A team of two made this assistant.", "", "Project", 5, "makers"),
    ("project", ["tech stack", "architecture", "how does this work"], "The project crawls a site, indexes it and answers from it.", "", "Project", 5, "project"),
    ("assistant", ["who are you", "assistant"], "This is an assistant that answers from indexed pages.", "", "Project", 3, "project"),
)


def facts_table(spark, facts: Sequence[tuple] = FACTS) -> DataFrame:
    from corpusflow.schemas import FACT

    return spark.createDataFrame(list(facts), FACT)


def triggered(query: Column, trigger: Column) -> Column:
    """A trigger of several words is found anywhere, one word only as a whole word."""
    q, t = F.lower(query), F.lower(trigger)
    word = F.concat(F.lit("(?<![A-Za-z0-9_])"), F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit("(?![A-Za-z0-9_])"))
    return F.when(t.contains(" "), q.contains(t)).otherwise(F.regexp_like(q, word))


def match_facts(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, fact columns): triggered facts, of each group those of the highest priority. The table
    of facts is a fixed, small part of the settings and is broadcast."""
    hits = questions.select("query_id", "query").join(F.broadcast(facts), F.exists("triggers", lambda t: triggered(F.col("query"), t)))
    group = F.coalesce("grp", F.concat(F.lit("solo-"), F.col("id")))
    rank = F.rank().over(Window.partitionBy("query_id", group).orderBy(F.desc(F.coalesce("priority", F.lit(0)))))
    return hits.withColumn("__r", rank).where("__r = 1").drop("__r", "query")


def fact_chunks(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.concat(F.lit("static-"), F.col("id")).alias("chunk_id"), F.col("content").alias("text"), F.col("source_url"), F.col("source_title").alias("page_title"), count(F.col("content")).alias("token_count"), F.lit(1.0).alias("vector_score"), F.lit(1.0).alias("rerank_score"))


def expanded(query: Column, config: RetrieveConfig = RetrieveConfig()) -> Column:
    """Short questions with the topic of the first pattern that they hold."""
    words = F.size(F.split(trimmed(query), f"{WS}+"))
    out = F.when(words > 5, query)
    for pattern, topic in config.expansions:
        out = out.when(F.lower(query).rlike(pattern), F.concat(query, F.lit(" " + topic)))
    return out.when(words <= 2, F.concat(query, F.lit(" " + config.generic))).otherwise(query)


class Reranker(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class OverlapReranker:
    """The share of a question's words that a text holds."""

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(t.lower().split())) / len(asked) if asked else 0.0 for t in texts]


def scored(query: Column, text: Column, reranker: Reranker) -> Column:
    """Null where the reranker fails: the vector order then counts."""

    @F.arrow_udf("double")
    def run(queries: pa.Array, texts: pa.Array) -> pa.Array:
        by: dict[str, list[int]] = {}
        for i, q in enumerate(queries.to_pylist()):
            by.setdefault(q or "", []).append(i)
        values, out = texts.to_pylist(), [None] * len(texts)
        for q, places in by.items():
            try:
                got = reranker(q, [values[i] or "" for i in places])
            except Exception:
                continue
            for i, s in zip(places, got, strict=True):
                out[i] = float(s)
        return pa.array(out, pa.float64())

    return once(run)(query, text)


def gate(candidates: DataFrame, queries: DataFrame, score: str, least: float, reason: str) -> DataFrame:
    """queries with the top score, whether it passes, and the reason if it doesn't."""
    top = candidates.groupBy("query_id").agg(F.max(score).alias("top"), F.count("*").alias("candidates"))
    rows = queries.select("query_id").join(top, "query_id", "left")
    why = F.when(F.col("top").isNull(), "no_results").when(F.col("top") < least, reason)
    return rows.select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "top", why.alias("reason"), why.isNull().alias("confident"))


def rerank_top(candidates: DataFrame, n: int) -> DataFrame:
    """Each query's n best by rerank_score, then vector rank; without scores the vector order."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "vector_rank")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def final_chunks(reranked: DataFrame, least: float) -> DataFrame:
    """What is handed on: rows at or above `least`; all where the reranker gave no score."""
    return reranked.where(F.col("rerank_score").isNull() | (F.col("rerank_score") >= least))


def retrieve(questions: DataFrame, held: DataFrame, embedder: index.Embedder, reranker: Reranker, facts: DataFrame | None = None, config: RetrieveConfig = RetrieveConfig()) -> tuple[DataFrame, DataFrame]:
    """(chunks, diagnostics) of questions(query_id, query): short ones have no results, those that
    trigger facts get these alone, the rest are searched, gated, reranked and gated again. A question that
    the embedder fails on has the reason `error` and doesn't hold up the others."""
    asked = questions.select("query_id", trimmed(F.coalesce("query", F.lit(""))).alias("query")).checkpoint()
    spark = asked.sparkSession
    long_enough = asked.where(utf16_length(F.col("query")) >= config.min_query_chars)
    hits = fact_chunks(match_facts(long_enough, facts_table(spark) if facts is None else facts)).checkpoint()
    open_ = long_enough.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    vectors = open_.select("query_id", "query", index.embedded(expanded(F.col("query"), config), embedder, "query", or_null=True).alias("vector")).checkpoint()
    failed = vectors.where("vector IS NULL").select("query_id", F.lit(True).alias("failed"))
    vectors = vectors.where("vector IS NOT NULL")
    found = index.search(held, vectors, config.top_k).checkpoint()
    first = gate(found, vectors, "vector_score", config.min_vector, "low_vector_score")
    passed = found.join(first.where("confident").select("query_id"), "query_id", "left_semi").join(vectors.select("query_id", "query"), "query_id").join(held.select("chunk_id", "text", "source_url", "page_title", "heading_path", "content_type", "token_count"), "chunk_id")
    ranked = rerank_top(passed.withColumn("rerank_score", scored(F.col("query"), F.col("text"), reranker)), config.rerank_n).checkpoint()
    tops = ranked.groupBy("query_id").agg(F.max("rerank_score").alias("rerank_top"), F.count("*").alias("after"))
    low = tops.where(F.col("rerank_top") < config.min_rerank).select("query_id")
    columns = ["query_id", "rank", "chunk_id", "text", "source_url", "page_title", "heading_path", "content_type", "token_count", "vector_score", "rerank_score"]
    searched = final_chunks(ranked.join(low, "query_id", "left_anti"), config.min_rerank).select(*columns)
    static = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).withColumn("heading_path", F.lit("")).withColumn("content_type", F.lit("paragraph")).select(*columns)
    info = asked.select("query_id").join(first.select("query_id", "candidates", "top", "reason"), "query_id", "left").join(tops, "query_id", "left").join(hits.groupBy("query_id").agg(F.count("*").alias("facts")), "query_id", "left").join(failed, "query_id", "left")
    reason = F.when(F.col("facts").isNotNull(), F.lit(None)).when(F.col("failed"), "error").when(F.col("candidates").isNull(), "no_results").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("rerank_top") < config.min_rerank, "low_rerank_score")
    fact = F.col("facts").isNotNull()
    diagnostics = info.select("query_id", reason.isNull().alias("confident"), reason.alias("reason"), F.when(fact, 1.0).otherwise(F.coalesce("top", F.lit(0.0))).alias("vector_top_score"), F.when(fact, 1.0).otherwise(F.col("rerank_top")).alias("rerank_top_score"), F.coalesce("facts", "candidates", F.lit(0)).alias("candidates_retrieved"), F.coalesce("facts", "after", F.lit(0)).alias("candidates_after_rerank"))
    return searched.unionByName(static), diagnostics
