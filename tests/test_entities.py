"""Entities that a cut left without their semicolon, as some pages of larger tables have."""

from corpusflow.operators.html import content


def test_quote_without_semicolon_is_a_quote():
    got = content("<title>t = &quot</title><h1>t = &quot</h1><p>a &quot b &amp c")
    assert got["title"] == 't = "' and got["headings"][0]["text"] == 't = "'
    assert got["blocks"][0]["content"] == 'a " b & c'
