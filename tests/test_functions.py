"""Golden cases of text, token and url expressions."""

import pytest
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig
from corpusflow.functions import text, tokens, urls
from corpusflow.operators import answer, chunk
from corpusflow.functions.tokens import Bpe, Estimate


def values(spark, inputs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").coalesce(1)
    return [r[1] for r in rows.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "http://WWW.Ex.com/a/?utm_source=x&b=2&a=1#f": "https://ex.com/a?a=1&b=2",
        "mailto:x@y.z": None, "not a url": None, "": None, None: None, "https://e.com/": "https://e.com/", "https://e.com": "https://e.com/",
        "https://e.com/a//": "https://e.com/a/", "http://e.com:80/x": "https://e.com/x", "https://e.com:443/x": "https://e.com/x", "https://e.com:8080/x": "https://e.com:8080/x",
        "https://e.com/a/./b/../c": "https://e.com/a/c", "https://e.com/?PAGE=1&q=a b": "https://e.com/?q=a+b", "https://e.com/x?q": "https://e.com/x?q=", "https://www.www.e.com/": "https://www.e.com/",
    }
    got = values(spark, list(cases), urls.normalize)
    assert dict(zip(cases, got, strict=True)) == cases
    kept = [u for u in cases.values() if u and not u.endswith("a/") and "www" not in u]
    assert values(spark, kept, urls.normalize) == kept


def test_relative_urls(spark):
    rows = spark.createDataFrame([("/x/", "https://e.com/d", "https://e.com/x"), ("foo", "https://e.com/dir", "https://e.com/foo"), ("?b=1", "https://e.com/d", "https://e.com/d?b=1"), ("//o.com/y", "https://e.com/d", "https://o.com/y"), ("../z", "https://e.com/a/b/c", "https://e.com/a/z"), ("http://o.com", "https://e.com/", "https://o.com/")], "ref string, base string, want string")
    assert rows.select((urls.normalize(F.col("ref"), F.col("base")) == F.col("want")).alias("ok")).where("NOT coalesce(ok, false)").count() == 0


def test_url_tests_and_labels(spark):
    assert values(spark, ["https://e.com/f.PDF", "https://e.com/f.pdf?x=1", "https://e.com/f.pdf/x", "https://e.com/f.html", "bad"], urls.has_extension) == [True, True, False, False, False]
    assert values(spark, ["https://www.E.com/", "https://sub.e.com/", "x"], lambda u: urls.in_domains(u, ["e.com"])) == [True, False, False]
    assert values(spark, ["mailto:a", "#x", "", "/x", "JAVASCRIPT:x"], urls.is_link) == [False, False, False, True, True]
    assert values(spark, ["https://www.e.com/a/bs-computer-SCIENCE", "https://e.com/", "bad"], urls.path_label) == ["Bs Computer SCIENCE", "Home", "bad"]
    assert values(spark, ["https://www.e.com/a", "bad"], urls.host_label) == ["e.com", "bad"]


def test_whitespace(spark):
    assert values(spark, [" a \t b \n \n  c ", "﻿ x", None], text.normalized) == ["a b\nc", "x", None]
    assert values(spark, ["  a\n  b ", ""], text.inline) == ["a b", ""]
    assert values(spark, ["a\U0001f600", "", "abc"], text.utf16_length) == [3, 0, 3]


def test_tokens(spark):
    assert values(spark, ["abcde", "", "\U0001f600" * 2], tokens.count) == [2, 0, 1]
    assert values(spark, ["abcdefgh", "ab"], lambda c: tokens.tail(c, 1)) == ["efgh", "ab"]
    assert values(spark, ["abcdefghi", ""], lambda c: tokens.split(c, 1)) == [["abcd", "efgh", "i"], []]
    e = Estimate()
    assert (e.count("abcde"), e.tail("abcdefgh", 1), e.split("abcdefghi", 1), e.truncate("abcdefgh", 1)) == (2, "efgh", ["abcd", "efgh", "i"], "abcd")
    b = Bpe("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert "".join(b.split("Hello wide world, once more", 2)) == "Hello wide world, once more" and b.count(b.tail("one two three four", 2)) == 2


@pytest.mark.parametrize("given", ["Hello world. This is tail without punct", "One. Two! Three?", "no marks at all", "...", "!! tail", "a.b.  ", "", "  ", "x. !!", "end. word "])
def test_sentences(spark, given):
    import re

    want = re.findall(r"[^.!?]+[.!?]+|\S+\Z", given) or [given]
    assert values(spark, [given], chunk.sentence_split) == [want]
    assert (chunk._sentences(given) or [given]) == want


def test_rules(spark):
    assert values(spark, [["table", "list"], ["list", "p", "p"], ["faq"], []], chunk.dominant_type, "array<string>") == ["table", "paragraph", "faq", "paragraph"]
    assert values(spark, ["[2] [1] [2] [9] [0]", "none"], text.citation_numbers) == [[2, 1, 2, 9, 0], []]
    assert values(spark, ["see [3]"], text.citation_tokens) == ["see `[cit:3]`"]
    assert values(spark, ["short", "x" * 80, "y" * 80 + " I dont have enough information"], lambda c: text.is_refusal(c, ("don'?t have (specific |enough )?information",))) == [True, False, True]
    assert values(spark, ["ur", "xx", None], answer.language_code) == ["ur", "en", "en"]
    with pytest.raises(ValueError):
        ChunkConfig(overlap_tokens=500)
