"""Retrieved chunks to prompts, and answers to citations."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import REFUSALS, AnswerConfig
from corpusflow.functions.arrow import by_parts
from corpusflow.functions.text import citation_numbers, is_refusal, or_else

SYSTEM = {
    True: "Answer from the numbered context only, in two to five sentences unless a list is asked for. Cite sources as [N].",
    False: "The context may not fit. Say what it does and doesn't cover, and help otherwise. Cite sources as [N] where used.",
}
REPLY_IN = {"en": "Reply in English.", "ur": "Reply in Urdu.", "sd": "Reply in Sindhi."}
DECLINED = "I don't have enough information to answer that."


#: Tasks over which the chunks of one query are dealt before they meet.
PARTS = 64


def within_budget(chunks: DataFrame, budget: int = AnswerConfig().budget_tokens) -> DataFrame:
    """Each query's first chunks by rank, up to the first that would go over the budget. Token counts aren't
    negative, so a chunk before which its own part of a query's chunks has used the budget up isn't needed to
    tell which fit: a query's chunks are dealt over PARTS tasks, and only what can matter meets in one."""
    order = lambda *keys: Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.coalesce("token_count", F.lit(0))
    parts = chunks.withColumn("__part", F.pmod(F.xxhash64("rank"), F.lit(PARTS)))
    parts = parts.withColumn("__before", F.sum(tokens).over(order("query_id", "__part")) - tokens).where(F.col("__before") <= budget)
    used = F.sum("token_count").over(order("query_id"))
    return parts.drop("__part", "__before").withColumn("used", used).where(F.col("used") <= budget)


def _blocks(rows: DataFrame, block: Column) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("__at", at).withColumn("__block", block)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__block"))), lambda x: x["__block"]), "\n\n").alias("context"))


def context(chunks: DataFrame) -> DataFrame:
    """(query_id, context): numbered blocks in order of rank; those without a url are marked internal.
    A budget bounds what is gathered for a query."""
    # The marks and labels of a block, that of internal metadata included.
    head = F.concat(F.lit("--- Context ["), F.col("__at").cast("string"), F.lit("] ---\n"))
    inner = F.concat(F.lit("Source: "), F.col("page_title"), F.lit(" (internal project metadata — do NOT cite as a URL)\n\n"), F.col("text"))
    outer = F.concat(F.lit("Source URL: "), F.col("source_url"), F.lit("\nPage Title: "), F.col("page_title"), F.lit("\nSection: "), or_else(F.col("heading_path"), F.lit("(none)")), F.lit("\n\n"), F.col("text"))
    return _blocks(chunks, F.concat(head, F.when(F.coalesce(F.col("source_url"), F.lit("")) == "", inner).otherwise(outer)))


def context_once(chunks: DataFrame) -> DataFrame:
    """The same for one-shot answers, with content type and score."""
    score = F.format_string("%.3f", F.coalesce("rerank_score", "vector_score"))
    return _blocks(chunks, F.concat(
        F.lit("--- Context "), F.col("__at").cast("string"), F.lit(" ---\nSource URL: "), F.col("source_url"), F.lit("\nPage Title: "), F.col("page_title"), F.lit("\nSection: "), or_else(F.col("heading_path"), F.lit("(none)")),
        F.lit("\nContent Type: "), F.col("content_type"), F.lit("\nRelevance Score: "), score, F.lit("\n\n"), F.col("text"),
    ))


def language_code(c: Column) -> Column:
    return F.when(c.isin("ur", "sd"), c).otherwise("en")


def prompts(questions: DataFrame, contexts: DataFrame, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """(query_id, system, user, temperature, max_tokens) of questions(query_id, query, confident, language)."""
    rows = questions.join(contexts, "query_id", "left")
    reply = F.create_map(*[F.lit(x) for kv in REPLY_IN.items() for x in kv])
    system = F.concat(F.when(F.col("confident"), SYSTEM[True]).otherwise(SYSTEM[False]), F.lit(" "), F.element_at(reply, language_code(F.col("language"))))
    bare = F.concat(F.lit("No context documents were retrieved for this question.\n\nQuestion: "), F.col("query"))
    user = F.when(F.col("context").isNull(), bare).otherwise(F.concat(F.lit("Context:\n\n"), F.col("context"), F.lit("\n\n---\nQuestion: "), F.col("query")))
    return rows.select("query_id", system.alias("system"), user.alias("user"), F.when(F.col("confident"), config.temperature).otherwise(config.temperature_unsure).alias("temperature"), F.lit(config.max_tokens).alias("max_tokens"))


def generate(prompt: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """(query_id, answer): model(system, user) in Arrow batches; its failure gives the canned refusal."""

    def said(system: str, user: str) -> str:
        try:
            return model(system, user)
        except Exception:
            return DECLINED

    @F.arrow_udf("string")
    def run(systems: pa.Array, users: pa.Array) -> pa.Array:
        return by_parts(lambda s, u: list(map(said, s, u)), pa.string(), systems, users)

    return prompt.select("query_id", run(F.col("system"), F.col("user")).alias("answer"))


SYSTEM_ONCE = "Answer from the context only and name the chunks you use."
FAILED = "The answer could not be made. Please try again."


def generate_once(questions: DataFrame, chunks: DataFrame, model: Callable[[str, str, float, int], str], config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """(query_id, answer, refused, sources) of questions(query_id, query, confident), one call each over their
    chunks within the budget: a refusal where retrieval isn't confident or nothing fits; an answer that is
    blank or fails is refused too. sources are the urls of all chunks used, in order, repeats included."""
    used = within_budget(chunks, config.budget_tokens)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    urls = used.withColumn("__at", at).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("source_url", F.lit("")).alias("u")))), lambda x: x["u"]).alias("urls"))
    rows = questions.join(context_once(used), "query_id", "left").join(urls, "query_id", "left")
    ready = F.coalesce(F.col("confident"), F.lit(False)) & F.col("context").isNotNull()

    def made(user: str | None) -> str | None:
        try:
            said = None if user is None else model(SYSTEM_ONCE, user, config.temperature, config.max_tokens_once)
            return said if said is None or said.strip() else ""
        except Exception:
            return ""

    @F.arrow_udf("string")
    def run(users: pa.Array) -> pa.Array:
        return by_parts(lambda some: list(map(made, some)), pa.string(), users)

    user = F.when(ready, F.concat("context", F.lit("\n\n---\nUser Question: "), F.coalesce("query", F.lit(""))))
    rows = rows.select("query_id", "urls", run(user).alias("said"))
    good = F.col("said") != ""
    answer = F.when(F.col("said").isNull(), DECLINED).when(good, F.col("said")).otherwise(FAILED)
    return rows.select("query_id", answer.alias("answer"), ~F.coalesce(good, F.lit(False)).alias("x"), F.when(good, F.col("urls")).otherwise(F.array().cast("array<string>")).alias("sources")).toDF("query_id", "answer", "refused", "sources")


def resolve_citations(answers: DataFrame, usable: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, sources) of answers(query_id, answer): cited urls in order of first citation; without
    any [N] none for a refusal, else all distinct urls in order; none where nothing was usable. by: the column
    of both tables that says which chunks were usable; answers may share them."""
    at = F.row_number().over(Window.partitionBy(by).orderBy("rank"))
    lists = usable.withColumn("__at", at).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("source_url", F.lit("")).alias("u")))), lambda x: x["u"]).alias("urls"))
    rows = answers.join(lists, by, "left").withColumn("cited", citation_numbers(F.coalesce("answer", F.lit(""))))
    real = lambda c: F.array_distinct(F.filter(c, lambda u: u.isNotNull() & (u != "")))
    picked = F.transform(F.filter("cited", lambda i: (i >= 1) & (i <= F.size("urls"))), lambda i: F.get("urls", i.cast("int") - 1))
    none = F.array().cast("array<string>")
    out = F.when(F.col("urls").isNull(), none).when(F.size("cited") > 0, real(picked)).when(is_refusal(F.coalesce("answer", F.lit("")), REFUSALS), none).otherwise(real(F.col("urls")))
    return rows.select("query_id", out.alias("sources"))
