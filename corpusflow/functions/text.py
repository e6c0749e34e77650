"""Text expressions with the whitespace, length and rounding rules that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace: neither Java's \s nor its Unicode variant is this set.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The same set as characters.
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def once(udf):
    """A Python function that a plan calls once a row. Catalyst copies a deterministic one into each filter
    and projection that reads its result, and so would parse every page two times or more."""
    return udf.asNondeterministic()


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{WS}+", ""), rf"{WS}+\z", "")


def inline(c: Column) -> Column:
    """Every run of whitespace is one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalized(c: Column) -> Column:
    """Blanks collapse within lines, blank lines go, lines have no blanks at their ends."""
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, rf"\n{WS}*\n+", "\n")
    return trimmed(F.regexp_replace(c, r" *\n *", "\n"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; characters beyond the BMP count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def or_else(c: Column, other: Column) -> Column:
    """other where c is null or empty."""
    return F.when(c.isNull() | (c == ""), other).otherwise(c)


def joined(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def source_hash(contents: Column) -> Column:
    """Digest of a page's normalized blocks; equal for pages with equal content."""
    return F.sha2(F.array_join(F.transform(contents, normalized), "\n---\n"), 256)


def retrieval_text(content: Column, path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"), content)).otherwise(content)


def section_heading(path: Column, title: Column) -> Column:
    return or_else(F.try_element_at(path, F.lit(-1)), title)


def is_refusal(answer: Column, patterns: tuple[str, ...]) -> Column:
    """A short answer, or one that says it knows nothing."""
    text = F.lower(trimmed(answer))
    found = utf16_length(text) < 80
    for p in patterns:
        found = found | text.rlike(p)
    return found


def citation_tokens(c: Column) -> Column:
    return F.regexp_replace(c, r"\[(\d+)\]", "`[cit:$1]`")


def citation_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), 1), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))
