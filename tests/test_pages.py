"""HTML, cleaning and chunking: golden cases."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.config import ChunkConfig
from corpusflow.functions.tokens import Estimate
from corpusflow.operators import chunk, clean
from corpusflow.operators.html import content


def block(path, n, kind="paragraph"):
    return {"type": kind, "content": "x" * (4 * n), "headingPath": path}


def test_headings_and_blocks():
    got = content("<title> T </title><h1>A</h1><p>one<h3>B</h3><p>two<h2>C</h2><p>three")
    assert got["title"] == "T" and [b["headingPath"] for b in got["blocks"]] == [["A"], ["A", "B"], ["A", "C"]]
    assert [b["content"] for b in got["blocks"]] == ["one", "two", "three"]


def test_nesting_tables_lists():
    assert content("<ul><li><p>x</p></li><li>y<ul><li>z</li></ul></li></ul>")["blocks"][0]["content"] == "- x\n- yz"
    table = content("<table><tr><th>H1<th>H2<tr><td>1<td>2<tr><td>H1<td>H2</table>")["blocks"]
    assert [b["content"] for b in table] == ["Columns: H1 | H2\nRow: 1 | 2"]
    assert content("<title>Our FAQ</title><ol><li>a</ol>")["blocks"][0]["type"] == "faq"


def test_boilerplate():
    long = "<p>" + "word " * 200 + "</p>"
    keep = "<div class='Pagination'><p>a</p><p>b</p><p>c</p></div>"
    assert len(content(long + keep)["blocks"]) == 4
    assert len(content(long + "<div id=my-pagination><p>short</p></div><nav><p>n</p></nav>")["blocks"]) == 1
    got = content("<p>a<b>b<br><p>c<script>var t = '</p>';</script>&amp;&copy;")
    assert [b["content"] for b in got["blocks"]] == ["ab", "c&©"]
    assert content("")["blocks"] == [] and content("<a href='/x'>l</a><nav><a href=y></nav>")["links"] == ["/x", "y"]


def test_clean_and_dedupe(spark):
    page = lambda n: f"<title>t</title><p>{'a' * n}</p>"
    rows = spark.createDataFrame([("https://e.com/1", page(399), 0), ("https://e.com/2", page(400), 0), ("https://e.com/3", page(400), 0), ("https://e.com/4", None, 0)], "url string, html string, depth int")
    got = [r["url"] for r in clean.clean_pages(rows).collect()]
    import hashlib

    assert got == [min(("https://e.com/2", "https://e.com/3"), key=lambda u: hashlib.sha256(u.encode()).hexdigest())]
    counts = clean.clean_manifest(clean.clean(rows)).first()
    assert tuple(counts) == (4, 1, 2, 1)


def test_sections_and_merging():
    e = Estimate()
    assert [len(s[1]) for s in chunk.sections([block(["A"], 1), block(["A"], 1), block(["B"], 1), block(["A"], 1)])] == [2, 1, 1]
    merged = chunk.merge(chunk.sections([block(["A"], 10), block(["A", "B"], 300)]), e, 200)
    assert [s[0] for s in merged] == [["A", "B"]]
    merged = chunk.merge(chunk.sections([block(["A"], 300), block(["Z"], 10)]), e, 200)
    assert [s[0] for s in merged] == [["Z"]] and len(merged[0][1]) == 2


def test_packing():
    e, c = Estimate(), ChunkConfig()
    assert [len(x) for x in chunk.pack([block([], 300), block([], 300)], e, 500, c)] == [1200, 300 + 2 + 1200]
    assert [len(x) for x in chunk.pack([block([], 1200)], e, 500, c)] == [2000, 300 + 2 + 2000, 300 + 2 + 800]
    assert chunk.page_chunks([{"type": "paragraph", "content": "y" * 19, "headingPath": []}], c, e) == []
    assert len(chunk.page_chunks([{"type": "paragraph", "content": "y" * 20, "headingPath": []}], c, e)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.text("ab .!?\n", max_size=3000)), max_size=6))
def test_chunks_are_sound(blocks):
    rows = [{"type": "paragraph", "content": t, "headingPath": [p]} for p, t in blocks]
    got = chunk.page_chunks(rows, ChunkConfig(max_tokens=120, min_tokens=20, overlap_tokens=10), Estimate())
    assert all(len(c["content"]) >= 20 for c in got)


def test_chunk_rows(spark):
    cleaned = spark.createDataFrame([("https://e.com/1", "T", [("paragraph", "word " * 100, ["H"])], "s")], "url string, title string, textBlocks array<struct<type:string,content:string,headingPath:array<string>>>, sourceHash string").withColumn("cleanedAt", F.lit("now"))
    row = chunk.chunk_pages(cleaned).first()
    assert row["chunk_id"] == row["doc_id"] + "-0" and row["text"].startswith("H\n\nword") and row["token_count"] == -(-len(row["text"]) // 4) and row["section_heading"] == "H"
