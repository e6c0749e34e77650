"""Queries over questions, chunks and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.config import EXPANSIONS, GENERIC_EXPANSION, LANGUAGES, REFUSALS, SUGGESTED
from corpusflow.functions import text
from corpusflow.operators import answer, chat, chunk, clean, index, retrieve
from corpusflow.plans import page_sql
from corpusflow.plans.tables import CHUNKS, WS, checkpoints, chunks, raw_pages, sql_trim, table


def _questions(spark, sf_dir):
    rows = chat.last_user_message(table(spark, sf_dir, "conversations"))
    return rows.select(F.col("conv_id").alias("query_id"), "query")


def last_user_message(spark, sf_dir):
    return chat.last_user_message(table(spark, sf_dir, "conversations"))


def request_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", chat.valid_request(F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" \t")).alias("valid"))


def language_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(F.lit("en"), F.lit("ur"), F.lit("sd"), F.lit("xx")), (F.col("conv_id") % 4 + 1).cast("int")).alias("language"))
    return chat.with_language(rows)


def suggested_questions(spark, sf_dir):
    """The questions each conversation would be offered in its language."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.element_at(F.array(F.lit("en"), F.lit("ur"), F.lit("sd"), F.lit("xx")), (F.col("conv_id") % 4 + 1).cast("int")).alias("language")).distinct()
    return chat.suggested_questions(rows)


def expand_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieve.expanded(F.expr("substring_index(text, ' ', 1 + CAST(turn % 7 AS INT))")).alias("expanded"))


def static_fact_match(spark, sf_dir):
    rows = retrieve.match_facts(_asked(spark, sf_dir), retrieve.facts_table(spark))
    return rows.select("query_id", "id", "priority", "grp")


_ASKED = ("who made this", "Is there a first maker?", "the architecture", "assistants", "tech stack of the assistant", "nothing here")


def _asked(spark, sf_dir):
    q = F.element_at(F.array(*[F.lit(x) for x in _ASKED]), (F.col("conv_id") % len(_ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), q.alias("query")).distinct()


def static_chunks(spark, sf_dir):
    return retrieve.fact_chunks(retrieve.match_facts(_asked(spark, sf_dir), retrieve.facts_table(spark)))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return rows, rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _rounded(rows, *columns):
    """Scores to six places, so that they can be compared with those of another engine."""
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def vector_topk(spark, sf_dir):
    return _rounded(index.search(*_vectors(spark, sf_dir), 15), "vector_score")


def vector_gate(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    found = index.search(rows, asked, 15).where("chunk_id <> query_id")
    return _rounded(retrieve.gate(found, asked, "vector_score", 0.45, "low_vector_score"), "top")


def rerank_topn(spark, sf_dir):
    found = chunks(spark, sf_dir).withColumn("vector_rank", F.col("rank")).drop("rank")
    return retrieve.rerank_top(found, 5).select("query_id", "chunk_id", "rank", "rerank_score")


def final_chunks(spark, sf_dir):
    return retrieve.final_chunks(chunks(spark, sf_dir), 0.15).select("query_id", "chunk_id")


def _retrieved(spark, sf_dir):
    checkpoints(spark)
    embedder = index.HashingEmbedder()
    held = index.index_rows(chunk.chunk_pages(clean.clean_pages(raw_pages(spark, sf_dir))), embedder).checkpoint()
    return retrieve.retrieve(_questions(spark, sf_dir), held, embedder, retrieve.OverlapReranker())


def retrieve_chunks(spark, sf_dir):
    return _rounded(_retrieved(spark, sf_dir)[0].drop("text"), "vector_score", "rerank_score")


def retrieve_diag(spark, sf_dir):
    return _rounded(_retrieved(spark, sf_dir)[1], "vector_top_score", "rerank_top_score")


def context_budget(spark, sf_dir):
    return answer.within_budget(chunks(spark, sf_dir)).select("query_id", "rank", F.col("used").cast("long").alias("used"))


def build_context(spark, sf_dir):
    return answer.context(answer.within_budget(chunks(spark, sf_dir)))


def build_context_once(spark, sf_dir):
    return answer.context_once(answer.within_budget(chunks(spark, sf_dir)))


def _asked_contexts(spark, sf_dir):
    """Contexts of all questions: question q gets that of slot q % 6; there are five, so a sixth get none."""
    slots = _questions(spark, sf_dir).select("query_id", F.pmod("query_id", F.lit(6)).alias("slot"))
    return slots.join(build_context(spark, sf_dir).withColumnRenamed("query_id", "slot"), "slot").select("query_id", "context")


def build_prompt(spark, sf_dir):
    checkpoints(spark)
    q = F.col("query_id")
    asked = _questions(spark, sf_dir).select("query_id", "query", (q % 2 == 0).alias("confident"), F.element_at(F.array(F.lit("en"), F.lit("ur"), F.lit("zz")), (q % 3 + 1).cast("int")).alias("language"))
    rows = answer.prompts(asked, _asked_contexts(spark, sf_dir))
    return rows.select("query_id", "system", F.sha2("user", 256).alias("user_digest"), F.col("temperature").cast("double").alias("temperature"), "max_tokens")


def generate(spark, sf_dir):
    checkpoints(spark)
    asked = _questions(spark, sf_dir).select("query_id", "query", F.lit(True).alias("confident"), F.lit("en").alias("language"))
    return answer.generate(answer.prompts(asked, _asked_contexts(spark, sf_dir)), lambda system, user: f"{len(user)} characters [1]")


def _answers(spark, sf_dir):
    t = F.col("text")
    body = F.when(F.col("turn") % 4 == 0, F.concat(t, F.lit(" [2] and [1], [2] and [99]"))).when(F.col("turn") % 4 == 1, F.concat(t, F.lit(" [77]"))).when(F.col("turn") % 4 == 2, F.repeat(t, 3)).otherwise(F.concat(t, F.lit(" I don't have enough information.")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 100 + F.col("turn")) % 1000000).alias("query_id"), body.alias("answer"))


def resolve_citations(spark, sf_dir):
    """Ids of answers repeat from 10,000 conversations on, so their chunks are met by slot."""
    rows = _answers(spark, sf_dir).select("query_id", "answer", (F.col("conv_id") % 6).alias("slot"))
    shared = answer.within_budget(chunks(spark, sf_dir)).select(F.col("query_id").alias("slot"), "rank", "source_url")
    return answer.resolve_citations(rows, shared, "slot").select("query_id", F.array_join("sources", ",").alias("sources"))


def refusal_detect(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", text.is_refusal(F.col("answer"), REFUSALS).alias("refusal"))


def citation_tokens(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", text.citation_tokens(F.col("answer")).alias("marked"))


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("d"))
    return chat.events(rows.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") % 3 != 0).alias("confident"), F.lit("no_results").alias("reason"), F.transform("d", lambda x: x["t"]).alias("deltas"), F.array(F.lit("https://e.com/1")).alias("sources"), F.when(F.col("conv_id") % 10 == 0, "broken").alias("error")))


def chat_events(spark, sf_dir):
    """The payloads are compared as parsed: whether confident, and the text, url or message they hold."""
    data = lambda path: F.get_json_object("data", path)
    return _events(spark, sf_dir).select("query_id", "seq", "event", data("$.confident").alias("confident"), F.coalesce(data("$.delta"), data("$.sources[0]"), data("$.message"), data("$.reason")).alias("said"))


def fold_events(spark, sf_dir):
    """Events to the wire and back, folded."""
    frames = chat.wire(_events(spark, sf_dir)).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x["frame"]), "").alias("body"))
    rows = chat.fold(chat.parse_wire(frames))
    return rows.select("query_id", "content", F.array_join(F.transform("sources", lambda s: s["url"]), ",").alias("urls"), "is_refusal", "error")


def message_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("id"), F.col("event_id").alias("seq"), "event_type", "user_id")
    return chat.upsert_messages(rows)


_WORDS = f"string_split_regex({sql_trim('q')}, '{WS}+')"
_CASES = " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN q || ' {t}'" for p, t in EXPANSIONS)
_FACTS = ", ".join(f"('{i}', {t}, '{c}', '{u}', '{s}', {p}, '{g}')" for i, t, c, u, s, p, g in retrieve.FACTS)
_HITS = f"""known(id, triggers, content, source_url, source_title, priority, grp) AS (VALUES {_FACTS}), h AS (SELECT q.query_id, known.*, rank() OVER (PARTITION BY query_id, grp ORDER BY priority DESC) AS r FROM q, known WHERE len(list_filter(triggers, lambda t: CASE WHEN contains(t, ' ') THEN contains(lower(query), t) ELSE regexp_matches(lower(query), '\\b' || t || '\\b') END)) > 0)"""
_MATCH = f"q AS (SELECT DISTINCT conv_id AS query_id, {list(_ASKED)}[(conv_id % {len(_ASKED)} + 1)::INT] AS query FROM conversations), {_HITS}"
_SEARCH = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.e, q.e))) AS vector_score FROM v q, v c WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id)::INT AS vector_rank FROM s QUALIFY vector_rank <= 15)"""
_EXPANDED = f"CASE WHEN len({_WORDS}) > 5 THEN q {_CASES} WHEN len({_WORDS}) <= 2 THEN q || ' {GENERIC_EXPANSION}' ELSE q END"
#: All questions, answered by facts (h) or by the index: candidates, those that pass, the five best.
_RETRIEVED = rf"""{page_sql.INDEXED}, l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS said FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0),
asked AS (SELECT conv_id AS query_id, {sql_trim("coalesce(said, '')")} AS query FROM l), q AS (SELECT * FROM asked WHERE length(query) >= 2), {_HITS}, facts AS (SELECT query_id, count(*) AS n FROM h WHERE r = 1 GROUP BY 1),
open AS (SELECT query_id, query AS q FROM q WHERE query_id NOT IN (SELECT query_id FROM facts)), vec AS (SELECT query_id, q, {page_sql.embedded(_EXPANDED)} AS e FROM open),
near AS (SELECT query_id, chunk_id, q, list_dot_product(e, vector) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(vector, vector))) AS vector_score FROM vec, i WHERE list_dot_product(e, e) > 0 AND list_dot_product(vector, vector) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) <= 15),
best AS (SELECT query_id, max(vector_score) AS top, count(*) AS n FROM near GROUP BY 1),
held AS (SELECT near.*, list_distinct(list_filter(string_split_regex(lower(q), '{WS}+'), lambda x: x <> '')) AS words, i.* EXCLUDE (chunk_id) FROM near JOIN best USING (query_id) JOIN i USING (chunk_id) WHERE top >= 0.45),
scored AS (SELECT *, CASE WHEN len(words) > 0 THEN len(list_intersect(words, string_split_regex(lower(text), '{WS}+'))) / len(words) ELSE 0 END AS rerank_score FROM held),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 5),
tops AS (SELECT query_id, max(rerank_score) AS top, count(*) AS n FROM ranked GROUP BY 1)"""
_BUDGET = f"{CHUNKS}, w AS (SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c), u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nr FROM w WHERE used <= 4000)"
_ANSWERS = "a AS (SELECT conv_id, turn, (conv_id * 100 + turn) % 1000000 AS query_id, CASE WHEN turn % 4 = 0 THEN text || ' [2] and [1], [2] and [99]' WHEN turn % 4 = 1 THEN text || ' [77]' WHEN turn % 4 = 2 THEN repeat(text, 3) ELSE text || ' I don''t have enough information.' END AS answer FROM conversations)"
_REFUSED = "(length(" + sql_trim("answer") + ") < 80 OR " + " OR ".join("regexp_matches(lower(answer), '" + p.replace("'", "''") + "')" for p in REFUSALS) + ")"
_LANGS = ", ".join(map(str, LANGUAGES))
_BLOCK = "'--- Context [' || nr || '] ---' || chr(10) || CASE WHEN source_url = '' THEN 'Source: ' || page_title || ' (internal project metadata — do NOT cite as a URL)' ELSE 'Source URL: ' || source_url || chr(10) || 'Page Title: ' || page_title || chr(10) || 'Section: ' || CASE WHEN heading_path = '' THEN '(none)' ELSE heading_path END END || chr(10) || chr(10) || text"
_ONCE = "'--- Context ' || nr || ' ---' || chr(10) || 'Source URL: ' || source_url || chr(10) || 'Page Title: ' || page_title || chr(10) || 'Section: ' || CASE WHEN heading_path = '' THEN '(none)' ELSE heading_path END || chr(10) || 'Content Type: paragraph' || chr(10) || 'Relevance Score: ' || printf('%.3f', coalesce(rerank_score, vector_score)) || chr(10) || chr(10) || text"
_JOINED = "chr(10) || chr(10) ORDER BY nr"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROMPT = f"""{_BUDGET}, x AS (SELECT query_id AS slot, string_agg({_BLOCK}, {_JOINED}) AS context FROM u GROUP BY 1), q AS (SELECT conv_id AS query_id, arg_max(text, turn) FILTER (role = 'user') AS query FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0),
p AS (SELECT query_id, CASE WHEN context IS NULL THEN 'No context documents were retrieved for this question.' || chr(10) || chr(10) || 'Question: ' || query ELSE 'Context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || query END AS "user" FROM q LEFT JOIN x ON slot = query_id % 6)"""
SQL = {
    "last_user_message": "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS query FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0",
    "request_validation": f"SELECT conv_id, turn, length({sql_trim('q')}) > 0 AS valid FROM (SELECT *, coalesce(CASE WHEN turn % 3 <> 0 THEN text ELSE ' ' || chr(9) END, '') AS q FROM conversations)",
    "language_rows": f"SELECT conv_id, turn, language, code, language_name, direction FROM (SELECT conv_id, turn, ['en', 'ur', 'sd', 'xx'][(conv_id % 4 + 1)::INT] AS language FROM conversations) c JOIN (VALUES {_LANGS}) t(code, language_name, direction) ON t.code = CASE WHEN language IN ('ur', 'sd') THEN language ELSE 'en' END",
    "suggested_questions": f"SELECT conv_id, language, place, question FROM (SELECT DISTINCT conv_id, ['en', 'ur', 'sd', 'xx'][(conv_id % 4 + 1)::INT] AS language FROM conversations) c JOIN (VALUES {', '.join(str((c, i, q)) for c, a in SUGGESTED.items() for i, q in enumerate(a))}) t(code, place, question) ON t.code = CASE WHEN language IN ('ur', 'sd') THEN language ELSE 'en' END",
    "expand_query": f"SELECT conv_id, turn, {_EXPANDED} AS expanded FROM (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:(1 + turn % 7)], ' ') AS q FROM conversations)",
    "static_fact_match": f"WITH {_MATCH} SELECT query_id, id, priority, grp FROM h WHERE r = 1",
    "static_chunks": f"WITH {_MATCH} SELECT query_id, 'static-' || id AS chunk_id, content AS text, source_url, source_title AS page_title, ceil(length(content) / 4.0)::BIGINT AS token_count, 1.0::DOUBLE AS vector_score, 1.0::DOUBLE AS rerank_score FROM h WHERE r = 1",
    "vector_topk": f"WITH {_SEARCH} SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, vector_rank FROM t",
    "vector_gate": f"WITH {_SEARCH}, g AS (SELECT query_id, count(*) AS candidates, max(vector_score) AS top FROM t WHERE chunk_id <> query_id GROUP BY 1) SELECT query_id, candidates, round(top, 6) AS top, CASE WHEN top < 0.45 THEN 'low_vector_score' END AS reason, top >= 0.45 AS confident FROM g",
    "retrieve_chunks": f"""WITH {_RETRIEVED} SELECT query_id, rank::INT AS rank, chunk_id, source_url, page_title, heading_path, content_type, token_count, round(vector_score, 6) AS vector_score, round(rerank_score, 6) AS rerank_score FROM ranked WHERE rerank_score >= 0.15
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT, 'static-' || id, source_url, source_title, '', 'paragraph', ceil(length(content) / 4.0)::BIGINT, 1, 1 FROM h WHERE r = 1""",
    "retrieve_diag": f"""WITH {_RETRIEVED}, info AS (SELECT query_id, facts.n AS facts, best.n AS found, best.top AS top, tops.top AS rerank_top, tops.n AS after FROM asked LEFT JOIN facts USING (query_id) LEFT JOIN best USING (query_id) LEFT JOIN tops USING (query_id)),
why AS (SELECT *, CASE WHEN facts > 0 THEN NULL WHEN found IS NULL THEN 'no_results' WHEN top < 0.45 THEN 'low_vector_score' WHEN rerank_top < 0.15 THEN 'low_rerank_score' END AS reason FROM info)
SELECT query_id, reason IS NULL AS confident, reason, round(CASE WHEN facts > 0 THEN 1 ELSE coalesce(top, 0) END, 6)::DOUBLE AS vector_top_score, round(CASE WHEN facts > 0 THEN 1 ELSE rerank_top END, 6)::DOUBLE AS rerank_top_score, coalesce(facts, found, 0) AS candidates_retrieved, coalesce(facts, after, 0) AS candidates_after_rerank FROM why""",
    "rerank_topn": f"WITH {CHUNKS} SELECT query_id, rank::VARCHAR AS chunk_id, r::INT AS rank, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS r FROM c) WHERE r <= 5",
    "final_chunks": f"WITH {CHUNKS} SELECT query_id, rank::VARCHAR AS chunk_id FROM c WHERE rerank_score IS NULL OR rerank_score >= 0.15",
    "context_budget": f"WITH {_BUDGET} SELECT query_id, rank, used FROM u",
    "build_context": f"WITH {_BUDGET} SELECT query_id, string_agg({_BLOCK}, {_JOINED}) AS context FROM u GROUP BY 1",
    "build_context_once": f"WITH {_BUDGET} SELECT query_id, string_agg({_ONCE}, {_JOINED}) AS context FROM u GROUP BY 1",
    "resolve_citations": f"""WITH {_ANSWERS}, {_BUDGET}, l AS (SELECT query_id AS slot, list(source_url ORDER BY rank) AS urls FROM u GROUP BY 1),
n AS (SELECT query_id, answer, urls, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT) AS cited FROM a LEFT JOIN l ON slot = conv_id % 6),
p AS (SELECT query_id, CASE WHEN urls IS NULL THEN [] WHEN len(cited) > 0 THEN list_transform(list_filter(cited, lambda i: i BETWEEN 1 AND len(urls)), lambda i: urls[i]) WHEN {_REFUSED} THEN [] ELSE urls END AS s FROM n)
SELECT query_id, array_to_string(list_filter(s, lambda u, i: u <> '' AND list_position(s, u) = i), ',') AS sources FROM p""",
    "refusal_detect": f"WITH {_ANSWERS} SELECT conv_id, turn, {_REFUSED} AS refusal FROM a",
    "citation_tokens": f"WITH {_ANSWERS} SELECT conv_id, turn, regexp_replace(answer, '\\[(\\d+)\\]', '`[cit:\\1]`', 'g') AS marked FROM a",
    "chat_events": """WITH d AS (SELECT conv_id AS query_id, list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT query_id, unnest(CASE WHEN query_id % 10 = 0 THEN [{'event': 'error', 'confident': NULL, 'said': 'broken'}] ELSE [{'event': 'metadata', 'confident': CASE WHEN query_id % 3 <> 0 THEN 'true' ELSE 'false' END, 'said': 'no_results'}] || list_transform(t, lambda x: {'event': 'text', 'confident': NULL, 'said': x}) || [{'event': 'sources', 'confident': NULL, 'said': 'https://e.com/1'}, {'event': 'done', 'confident': NULL, 'said': NULL}] END) AS v, unnest(range(CASE WHEN query_id % 10 = 0 THEN 1 ELSE len(t) + 3 END)) AS seq FROM d)
SELECT query_id, seq::INT AS seq, v.event AS event, v.confident AS confident, v.said AS said FROM e""",
    "build_prompt": f"""WITH {_PROMPT} SELECT query_id, CASE WHEN query_id % 2 = 0 THEN {_quoted(answer.SYSTEM[True])} ELSE {_quoted(answer.SYSTEM[False])} END || ' ' || CASE WHEN query_id % 3 = 1 THEN {_quoted(answer.REPLY_IN["ur"])} ELSE {_quoted(answer.REPLY_IN["en"])} END AS system, sha256("user") AS user_digest, CASE WHEN query_id % 2 = 0 THEN 0.1 ELSE 0.25 END::DOUBLE AS temperature, 900::INT AS max_tokens FROM p""",
    "generate": f"""WITH {_PROMPT} SELECT query_id, CASE WHEN "user" IS NULL THEN {_quoted(answer.DECLINED)} ELSE length("user") || ' characters [1]' END AS answer FROM p""",
    "fold_events": "SELECT conv_id AS query_id, CASE WHEN conv_id % 10 = 0 THEN '' ELSE string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, '')) END AS content, CASE WHEN conv_id % 10 = 0 THEN '' ELSE 'https://e.com/1' END AS urls, conv_id % 10 <> 0 AND conv_id % 3 = 0 AS is_refusal, CASE WHEN conv_id % 10 = 0 THEN 'broken' END AS error FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "message_upsert": "SELECT event_id % 500 AS id, min(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1",
}
NAMES = (last_user_message, request_validation, language_rows, suggested_questions, expand_query, static_fact_match, static_chunks, vector_topk, vector_gate, rerank_topn, final_chunks, retrieve_chunks, retrieve_diag, context_budget, build_context, build_context_once, build_prompt, generate, resolve_citations, refusal_detect, citation_tokens, chat_events, fold_events, message_upsert)
QUERIES = {f.__name__: f for f in NAMES}
