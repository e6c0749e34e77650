"""Cleaning and chunking of the test tables' pages as SQL. All these pages have one shape: a title, then an
article of one h1 and paragraphs, some never closed. So SQL reads them by patterns, knows one section a
page, and folds paragraphs to chunks by rules of its own, apart from the operators that it is held against."""

from __future__ import annotations

from corpusflow.config import ChunkConfig, CleanConfig
from corpusflow.plans.tables import WS, sql_trim

_C, _MOST = ChunkConfig(), "most"


def _line(e: str) -> str:
    """Text of markup that holds no tags: entities of these pages, then every run of whitespace one blank."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        e = f"replace({e}, '{name}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({e}, '&amp;?', '&', 'g'), '{WS}+', ' ', 'g'))"


def _count(e: str) -> str:
    return f"((length({e}) + 3) // 4)"


def _cut(e: str) -> str:
    return f"list_transform(range(0, length({e}), 4 * {_MOST}), lambda i: substring({e}, i + 1, 4 * {_MOST}))"


_PARAGRAPH = _line("regexp_replace(regexp_replace(p, '(?s)</p>.*', ''), '<[^>]*>', '', 'g')")
#: p(page_id, url, title, h1, texts, hash, kept), and c: of each hash that is long enough the first page.
CLEANED = rf"""m AS (SELECT page_id, url, {_line("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS head, {_line("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1, regexp_extract(html, '(?s)</h1>(.*)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, coalesce(nullif(head, ''), h1) AS title, h1, list_filter(list_transform(string_split(body, '<p>')[2:], lambda p: {_PARAGRAPH}), lambda x: x <> '') AS texts FROM m),
p AS (SELECT *, sha256(array_to_string(texts, chr(10) || '---' || chr(10))) AS hash, length(array_to_string(texts, '')) >= {CleanConfig().min_content_length} AS kept FROM t),
c AS (SELECT * FROM p WHERE kept QUALIFY row_number() OVER (PARTITION BY hash ORDER BY sha256(url), page_id) = 1)"""

_FULL = f"a.held <> '' AND {_count("a.held || ' ' || b.held")} > {_MOST}"
_HELD = f"(CASE WHEN a.held = '' OR {_FULL} THEN b.held ELSE a.held || ' ' || b.held END)"
_OUT = f"(CASE WHEN {_FULL} THEN a.made || [a.held] ELSE a.made END)"
#: A paragraph x that is too long, as runs of its sentences; a run that is too long itself is cut.
_SENTENCES = rf"""list_transform([list_reduce(list_transform(regexp_extract_all(x, '[^.!?]+[.!?]+|\S+\z'), lambda s: {{'made': []::VARCHAR[], 'held': trim(s)}}),
 lambda a, b: CASE WHEN {_count(_HELD)} > {_MOST} THEN {{'made': {_OUT} || {_cut(_HELD)}, 'held': ''}} ELSE {{'made': {_OUT}, 'held': {_HELD}}} END, {{'made': []::VARCHAR[], 'held': ''}})], lambda r: CASE WHEN r.held <> '' THEN r.made || [r.held] ELSE r.made END)[1]"""
_FLUSH = f"(a.part <> '' AND (b.size > {_MOST} OR a.size + b.size > {_MOST}))"
_AGAIN = f"(CASE WHEN b.size <= {_MOST} THEN right(a.part, {4 * _C.overlap_tokens}) ELSE '' END)"
_PART = f"(CASE WHEN {_FLUSH} THEN {_AGAIN} ELSE a.part END)"
_SIZE = f"(CASE WHEN {_FLUSH} THEN {_count(_AGAIN)} ELSE a.size END)"
_DONE = f"(CASE WHEN {_FLUSH} THEN a.made || [a.part] ELSE a.made END)"
_GLUED = f"(CASE WHEN {_PART} = '' THEN b.part ELSE {_PART} || chr(10) || chr(10) || b.part END)"


def chunked(pages: str) -> str:
    """k(chunk_id, doc_id, text, ...): chunks of `pages`, a table like p."""
    return rf"""w AS (SELECT *, CASE WHEN h1 <> '' THEN h1 || chr(10) || chr(10) ELSE '' END AS prefix, greatest({_C.max_tokens} - {_count("CASE WHEN h1 <> '' THEN h1 || chr(10) || chr(10) ELSE '' END")}, {_C.floor_tokens}) AS most FROM {pages}),
s AS (SELECT *, flatten(list_transform(texts, lambda x: CASE WHEN {_count('x')} <= {_MOST} THEN [x] ELSE {_SENTENCES} END)) AS pieces FROM w),
f AS (SELECT *, list_reduce(list_transform(pieces, lambda x: {{'made': []::VARCHAR[], 'part': x, 'size': {_count('x')}}}),
 lambda a, b: CASE WHEN b.size > {_MOST} THEN {{'made': {_DONE} || {_cut('b.part')}, 'part': {_PART}, 'size': {_SIZE}}} ELSE {{'made': {_DONE}, 'part': {_GLUED}, 'size': {_SIZE} + b.size}} END, {{'made': []::VARCHAR[], 'part': '', 'size': 0::BIGINT}}) AS r FROM s),
g AS (SELECT *, list_filter(list_transform(CASE WHEN r.part <> '' THEN r.made || [r.part] ELSE r.made END, lambda x: {sql_trim('x')}), lambda x: length(x) >= {_C.min_chars}) AS found FROM f),
e AS (SELECT *, unnest(found) AS content, unnest(range(len(found)))::INT AS chunk_index FROM g),
k AS (SELECT sha256(url)[1:16] || '-' || chunk_index AS chunk_id, sha256(url)[1:16] AS doc_id, prefix || content AS text, {_count('prefix || content')} AS token_count, url AS source_url, title AS page_title, coalesce(nullif(h1, ''), title) AS section_heading, h1 AS heading_path, 'paragraph' AS content_type,
 '1970-01-01T00:00:00.000Z' AS crawled_at, 'en' AS language, false AS is_boilerplate, chunk_index, len(found) AS chunk_count, hash AS source_hash FROM e)"""


def embedded(e: str) -> str:
    """A list of 64 doubles: words of the text e by the bits of their digests, scaled to norm 1 in floats."""
    words = f"list_transform(list_filter(string_split_regex(lower({e}), '[ \\n]+'), lambda x: x <> ''), lambda x: md5(x))"
    slots = f"list_transform({words}, lambda h: {{'slot': ('0x' || h[1:2])::INT % 64, 'add': CASE WHEN h[15] >= '8' THEN 1 ELSE -1 END}})"
    sums = f"list_transform([{slots}], lambda w: list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter(w, lambda y: y.slot = d), lambda y: y.add)), 0)::DOUBLE))[1]"
    return f"list_transform([{sums}], lambda v: list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE ELSE 0 END))[1]"


#: i(chunk_id, vector, doc_id, ...): the index of all kept pages.
INDEXED = f"{CLEANED}, {chunked('c')}, i AS (SELECT *, {embedded('text')} AS vector FROM k)"
_TOTALS = "x AS (SELECT count(DISTINCT doc_id) AS pages, count(*) AS n, coalesce(sum(token_count), 0)::BIGINT AS tokens FROM k)"
_BLOCK = "to_json(list_transform(texts, lambda x: {'type': 'paragraph', 'content': x, 'headingPath': CASE WHEN h1 <> '' THEN [h1] ELSE [] END}))::VARCHAR"
SQL = {
    "clean_pages": f"WITH {CLEANED} SELECT url, title, CASE WHEN h1 <> '' THEN to_json([{{'level': 1, 'text': h1}}])::VARCHAR ELSE '[]' END AS headings, {_BLOCK} AS blocks, hash AS \"sourceHash\", 0::INT AS depth FROM c",
    "clean_manifest": f"WITH {CLEANED} SELECT (SELECT count(*) FROM p) AS pages_read, (SELECT count(*) FROM c) AS pages_cleaned, (SELECT count(*) FROM p WHERE NOT kept) AS dropped_short, (SELECT count(*) - count(DISTINCT hash) FROM p WHERE kept) AS dropped_duplicate, 0::BIGINT AS dropped_error",
    "chunk_pages": f"WITH {CLEANED}, {chunked('c')} SELECT * FROM k",
    "index_pages": f"WITH {INDEXED} SELECT chunk_id, list_transform(vector, lambda x: round(x, 6)) AS vector, doc_id, source_url, page_title, section_heading, heading_path, content_type, token_count, chunk_index, chunk_count, crawled_at, language, source_hash, text FROM i",
    "chunk_manifest": f"WITH {CLEANED}, {chunked('c')}, {_TOTALS} SELECT (SELECT count(*) FROM c) AS pages_read, pages AS pages_chunked, n AS total_chunks, CASE WHEN pages > 0 THEN floor(n / pages * 10 + 0.5) / 10 ELSE 0 END::DOUBLE AS avg_chunks_per_page, CASE WHEN n > 0 THEN floor(tokens / n + 0.5) ELSE 0 END::BIGINT AS avg_tokens_per_chunk, 0::BIGINT AS pages_failed FROM x",
}
