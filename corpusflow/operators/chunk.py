"""Cleaned pages to retrieval chunks. Merging and packing depend on what came before them, so a page's
blocks are folded in an Arrow function; ids, texts and counts are expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig
from corpusflow.functions import tokens
from corpusflow.functions.arrow import by_parts
from corpusflow.functions.text import BLANKS, once, retrieval_text, section_heading
from corpusflow.functions.tokens import Estimate, Tokenizer, units
from corpusflow.functions.urls import chunk_id, doc_id

#: A sentence with its end marks; and of what has none behind the last mark, the last word.
SENTENCE, LAST_WORD = r"[^.!?]+[.!?]+", r"\S+\z"
_ENDED, _WHOLE = re.compile(SENTENCE), re.compile(r"[^.!?]*[.!?]+|[^.!?]+\Z")


def sections(blocks: list[dict]) -> list[tuple[list[str], list[dict]]]:
    """Adjacent blocks under one heading path."""
    out: list[tuple[list[str], list[dict]]] = []
    for b in blocks:
        if out and out[-1][0] == b["headingPath"]:
            out[-1][1].append(b)
        else:
            out.append((b["headingPath"], [b]))
    return out


def _deeper(a: tuple[list[str], list[dict]], b: tuple[list[str], list[dict]]) -> tuple[list[str], list[dict]]:
    return (b[0] if len(b[0]) >= len(a[0]) else a[0], a[1] + b[1])


def merge(parts: list[tuple[list[str], list[dict]]], tokenizer: Tokenizer, least: int) -> list[tuple[list[str], list[dict]]]:
    """A small section takes in the next one of its own branch; a small last one joins the one before."""
    small = lambda s: tokenizer.count("\n\n".join(b["content"] for b in s[1])) < least
    out: list[tuple[list[str], list[dict]]] = []
    for s in parts:
        n = min(len(out[-1][0]), len(s[0])) if out else 0
        if out and out[-1][0][:n] == s[0][:n] and small(out[-1]):
            out[-1] = _deeper(out[-1], s)
        else:
            out.append(s)
    if len(out) > 1 and small(out[-1]):
        last = out.pop()
        out[-1] = _deeper(out[-1], last)
    return out


def dominant(blocks: list[dict]) -> str:
    kinds = [b["type"] for b in blocks]
    return next((k for k in ("table", "faq", "list") if k in kinds and 2 * kinds.count(k) >= len(kinds)), "paragraph")


def _sentences(text: str) -> list[str]:
    """SENTENCE | LAST_WORD over the text. Each part is matched only where it can match, so a long text
    without marks costs one pass."""
    cut = max(map(text.rfind, ".!?")) + 1
    found, rest = _ENDED.findall(text[:cut]), text[cut:]
    if not rest:  # marks that no sentence took may end the text
        lone = text if not found else ""
        rest = lone[len(lone.rstrip(".!?")) :] if lone else ""
    last = rest[max((rest.rfind(b) for b in BLANKS), default=-1) + 1 :]
    return [*found, last] if last else found


def sentences(text: str, tokenizer: Tokenizer, most: int, lossless: bool) -> list[str]:
    """Sentences packed up to `most` tokens; a longer one is cut hard."""
    found = (_WHOLE.findall(text) if lossless else _sentences(text)) or [text]
    out, held = [], ""
    for s in (x.strip(BLANKS) for x in found):
        grown = f"{held} {s}" if held else s
        if held and tokenizer.count(grown) > most:
            out.append(held)
            grown = s
        held = grown
        if tokenizer.count(held) > most:
            out += tokenizer.split(held, most)
            held = ""
    return [*out, held] if held else out


def pack(blocks: list[dict], tokenizer: Tokenizer, most: int, config: ChunkConfig) -> list[str]:
    """Blocks packed up to `most` tokens; after a full chunk the next begins with its last tokens."""
    out: list[str] = []
    parts: list[str] = []
    size = 0
    for b in blocks:
        whole = tokenizer.count(b["content"]) <= most
        for piece in [b["content"]] if whole else sentences(b["content"], tokenizer, most, config.lossless):
            n = tokenizer.count(piece)
            if parts and (n > most or size + n > most):
                out.append("\n\n".join(parts))
                again = tokenizer.tail(out[-1], config.overlap_tokens) if n <= most else ""
                parts, size = ([again], tokenizer.count(again)) if again else ([], 0)
            if n > most:
                out += tokenizer.split(piece, most)
            else:
                parts.append(piece)
                size += n
    return [*out, "\n\n".join(parts)] if parts else out


def page_chunks(blocks: list[dict], config: ChunkConfig, tokenizer: Tokenizer) -> list[dict]:
    out = []
    for path, own in merge(sections(blocks), tokenizer, config.min_tokens):
        prefix = " > ".join(path) + "\n\n" if path else ""
        most = max(config.max_tokens - tokenizer.count(prefix), config.floor_tokens)
        kind = dominant(own)
        pieces = (p.strip(BLANKS) for p in pack(own, tokenizer, most, config))
        out += [{"content": p, "heading_path": path, "content_type": kind} for p in pieces if units(p) >= config.min_chars]
    return out


_SCHEMA = "array<struct<content:string,heading_path:array<string>,content_type:string,tokens:bigint>>"
_ARROW = pa.list_(pa.struct([("content", pa.string()), ("heading_path", pa.list_(pa.string())), ("content_type", pa.string()), ("tokens", pa.int64())]))


def chunked(blocks: Column, config: ChunkConfig, tokenizer: Tokenizer, or_null: bool = False) -> Column:
    """Chunks of each page's blocks. or_null: null for a page that this fails on, instead of an error."""

    def cut(page: list[dict]) -> list[dict] | None:
        try:
            found = page_chunks(page, config, tokenizer)
            for c in found:
                c["tokens"] = tokenizer.count(" > ".join(c["heading_path"]) + "\n\n" + c["content"] if c["heading_path"] else c["content"])
        except MemoryError:
            raise
        except Exception:
            if not or_null:
                raise
            return None
        return found

    @F.arrow_udf(_SCHEMA)
    def run(pages: pa.Array) -> pa.Array:
        return by_parts(lambda some: [cut(page or []) for page in some], _ARROW, pages)

    return once(run)(blocks)


def chunk_pages(cleaned: DataFrame, config: ChunkConfig = ChunkConfig(), tokenizer: Tokenizer | None = None, mark_failed: bool = False) -> DataFrame:
    """Chunk rows of cleaned pages; chunk_index counts the kept chunks of a page from 0. No shuffle.
    mark_failed: a page that can't be chunked is one row with `failed`, instead of an error."""
    rows = cleaned.withColumn("found", chunked(F.col("textBlocks"), config, tokenizer or Estimate(), mark_failed))
    failed = [F.col("found").isNull().alias("failed")] if mark_failed else []
    explode = F.posexplode_outer if mark_failed else F.posexplode
    rows = rows.select("url", "title", "cleanedAt", "sourceHash", F.size("found").cast("long").alias("chunk_count"), *failed, explode("found").alias("chunk_index", "c"))
    if mark_failed:
        rows = rows.where("failed OR c IS NOT NULL")
    doc = doc_id(F.col("url"))
    return rows.select(
        F.when(F.col("chunk_index").isNotNull(), chunk_id(doc, F.col("chunk_index"))).alias("chunk_id"), doc.alias("doc_id"), retrieval_text(F.col("c.content"), F.col("c.heading_path")).alias("text"), F.col("c.tokens").alias("token_count"),
        F.col("url").alias("source_url"), F.col("title").alias("page_title"), section_heading(F.col("c.heading_path"), F.col("title")).alias("section_heading"), F.col("c.heading_path").alias("heading_path"), F.col("c.content_type").alias("content_type"),
        F.col("cleanedAt").alias("crawled_at"), F.lit("en").alias("language"), F.lit(False).alias("is_boilerplate"), "chunk_index", "chunk_count", F.col("sourceHash").alias("source_hash"), *(["failed"] if mark_failed else []),
    )


def section_islands(blocks: DataFrame, key: str, position: str, path: Column) -> DataFrame:
    """blocks with `section`, counted from 0: adjacent blocks of one path share it."""
    order = Window.partitionBy(key).orderBy(position)
    new = F.coalesce((path != F.lag(path).over(order)).cast("int"), F.lit(0))
    return blocks.withColumn("__new", new).withColumn("section", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _equals(value: str):
    return lambda x: x == value


def dominant_type(kinds: Column) -> Column:
    """table, else faq, else list, if half of the blocks are of it; else paragraph."""
    out = F.lit("paragraph")
    for k in ("list", "faq", "table"):
        n = F.size(F.filter(kinds, _equals(k)))
        out = F.when((n > 0) & (2 * n >= F.size(kinds)), k).otherwise(out)
    return out


def sentence_split(text: Column) -> Column:
    """Sentences, then the last word of what has no end mark; of neither, the text. Each pattern sees
    only the part where it can match: over the whole text their union takes quadratic time."""
    head = F.regexp_extract(text, r"(?s)\A(.*[.!?])", 1)
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    found = F.regexp_extract_all(head, F.lit(SENTENCE), 0)
    lone = F.when((rest == "") & (F.size(found) == 0), text).otherwise(rest)
    last = F.regexp_extract_all(lone, F.lit(r"(?:\A|(?<=\s))\S+\z"), 0)
    found = F.concat(found, last)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def fixed_split(text: Column, n: int) -> Column:
    return tokens.split(text, n)
