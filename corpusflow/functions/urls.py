"""URL expressions: normal form, domain and extension tests, keys and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.config import SKIP_EXTENSIONS, SKIP_LINKS, STRIP_PARAMS
from corpusflow.functions.text import or_else, trimmed

#: scheme, authority, path, query, fragment
PARTS = r"(?is)\A(https?):[/\\]{2}([^/\\?#]+)([^?#]*)(\?[^#]*)?(#.*)?\z"
#: Characters that no path has in normal form.
UNSAFE = r"[^\x21\x23-\x3b\x3d\x3f-\x5d\x5f\x61-\x7a\x7c\x7e]"
#: Characters that no authority has.
BAD_HOST = r"[\s<>\[\]^|%\x00-\x20\x7f]"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _without_dots(path: Column) -> Column:
    """`.` and `..` segments resolved."""
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), _resolved(path)).otherwise(path)


def _resolved(path: Column) -> Column:
    kept = F.aggregate(
        F.slice(F.split(path, "/", -1), 2, 1 << 20),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    folder = path.rlike(r"/\.{1,2}\z")
    return _let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), "/").otherwise("")))


def _encoded(path: Column) -> Column:
    """Controls, blanks, quotes, angle brackets, braces, carets, backquotes and what is beyond ASCII as %XX
    of their UTF-8; escapes that are there stay as they are."""
    one = lambda c: F.when(c == " ", "%20").when(c.rlike(UNSAFE), F.url_encode(c)).otherwise(c)
    return F.when(path.rlike(UNSAFE), F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)."), 0), one), "")).otherwise(path)


def _query(raw: Column) -> Column:
    """Kept parameters, decoded, in order of `key,value`, encoded again."""
    words = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(
        F.filter(F.split(F.substring(raw, 2, 1 << 30), "&", -1), lambda x: x != ""),
        lambda x: F.struct(words(F.regexp_extract(x, r"(?s)\A([^=]*)", 1)).alias("k"), words(F.regexp_extract(x, r"(?s)\A[^=]*=?(.*)\z", 1)).alias("v")),
    )
    kept = F.filter(F.when(raw != "", pairs), lambda p: ~F.lower(p["k"]).isin(*STRIP_PARAMS))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(F.concat(p["k"], F.lit(","), p["v"]).alias("s"), p["k"].alias("k"), p["v"].alias("v"))))
    return F.coalesce(F.array_join(F.transform(ordered, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"), F.lit(""))


def resolve(ref: Column, base: Column) -> Column:
    """An absolute URL from a link on the page `base` (itself in normal form)."""
    ref = trimmed(ref)
    origin = F.regexp_extract(base, r"\A(https?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"\Ahttps?://[^/?#]*([^?#]*)", 1)
    folder = F.concat(origin, or_else(F.regexp_extract(path, r"(?s)\A(.*/)", 1), F.lit("/")))
    return (
        F.when(ref.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.lit("https:"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when((ref == "") | ref.startswith("#"), base)
        .otherwise(F.concat(folder, ref))
    )


def normalize(url: Column, base: Column | None = None) -> Column:
    """https, host in lower case without one leading `www.`, no fragment, no tracking parameters, the
    others sorted, one trailing slash off. Null for other schemes and what is no URL."""
    return _let(trimmed(url) if base is None else resolve(url, base), _normalize)


def _normalize(url: Column) -> Column:
    scheme, authority = F.lower(_part(url, 1)), F.lower(_part(url, 2))
    host = F.regexp_replace(authority, r"\Awww\.", "")
    host = F.regexp_replace(host, r":443\z|:\z", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).otherwise(host)
    path = _let(F.regexp_replace(F.translate(_part(url, 3), "\\", "/"), r"[\t\n\r]", ""), _encoded)
    path = _let(or_else(path, F.lit("/")), _without_dots)
    path = F.regexp_replace(path, r"(?<=.)/\z", "")
    query = F.regexp_replace(_query(_part(url, 4)), r"\A(?=.)", "?")
    full = F.concat(F.lit("https://"), host, path, query)
    return F.when(url.rlike(PARTS) & (host != "") & ~authority.rlike(BAD_HOST), full)


def host(url: Column) -> Column:
    """Lower case, without one leading `www.` and without port; null if it is no URL."""
    h = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r":\d*\z", ""), r"\Awww\.", "")
    return F.when(url.rlike(PARTS), h)


def path(url: Column) -> Column:
    return F.when(url.rlike(PARTS), or_else(_part(url, 3), F.lit("/")))


def origin(url: Column) -> Column:
    return F.when(url.rlike(PARTS), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2))))


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """Host equality; subdomains don't match."""
    allowed = [d.lower().removeprefix("www.") for d in domains]
    return F.coalesce(host(url).isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def has_extension(url: Column, extensions: Sequence[str] = SKIP_EXTENSIONS) -> Column:
    return F.coalesce(path(url).rlike(rf"(?i)\.({'|'.join(extensions)})\z"), F.lit(False))


def is_link(href: Column) -> Column:
    ok = F.coalesce(href != "", F.lit(False))
    for prefix in SKIP_LINKS:
        ok = ok & ~href.startswith(prefix)
    return ok


def file_key(url: Column) -> Column:
    return F.concat(F.sha2(url, 256), F.lit(".json"))


def doc_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat_ws("-", doc, index.cast("string"))


def host_label(url: Column) -> Column:
    return F.coalesce(host(url), url)


def path_label(url: Column) -> Column:
    """The last path segment as words with capitals; `Home` without one."""
    segments = F.filter(F.split(path(url), "/", -1), lambda s: s != "")
    text = F.translate(F.try_element_at(segments, F.lit(-1)), "-", " ")
    # A capital at each start of a word of ASCII letters, digits and underscores.
    marked = F.regexp_replace(text, r"(?<![A-Za-z0-9_])([A-Za-z0-9_])", "\u0001$1")
    parts = F.split(marked, "\u0001", -1)
    words = F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))))
    return F.when(~url.rlike(PARTS), url).when(F.size(segments) == 0, "Home").otherwise(F.array_join(words, ""))


def source_title(title: Column, url: Column) -> Column:
    return or_else(trimmed(F.coalesce(title, F.lit(""))), path_label(url))
