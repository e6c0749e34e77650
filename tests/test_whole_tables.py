"""Queries of corpusflow/plans answer for every row of their tables."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusflow.plans.pages import QUERIES as PAGES
from corpusflow.plans.questions import QUERIES as QUESTIONS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_search_takes_every_fiftieth_row(spark):
    rows = [r for r in table("embeddings") if r["embedding"] is not None]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {int(q): (x @ x[ids == q][0]).round(6) for q in ids[ids % 50 == 0]}
    got = {}
    for r in QUESTIONS["vector_topk"](spark, SF).orderBy("vector_rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["vector_score"]))
    assert set(got) == set(want) and len(got) == 10
    for q, found in got.items():
        best = np.sort(want[q])[::-1][:15]
        assert np.allclose([s for _, s in found], best, atol=2e-6) and all(abs(want[q][ids == i][0] - s) < 2e-6 for i, s in found)
    gated = QUESTIONS["vector_gate"](spark, SF).collect()
    assert {r["query_id"] for r in gated} == set(want)
    for r in gated:
        others = [s for i, s in got[r["query_id"]] if i != r["query_id"]]
        assert (r["candidates"], r["top"]) == (len(others), max(others))


def test_retrieval_text_takes_every_line(spark):
    want = {(d["doc_id"], i) for d in table("documents") if d["text"] is not None for i in range(d["text"].count("\n") + 1)}
    got = [(r["doc_id"], r["pos"]) for r in PAGES["retrieval_text"](spark, SF).collect()]
    assert max(i for _, i in want) > 2 and len(got) == len(want) and set(got) == want


def budgeted():
    """Urls by query_id of the chunks within the budget, from all documents."""
    used, out = {}, {}
    for d in sorted(table("documents"), key=lambda d: d["doc_id"]):
        q = d["doc_id"] % 5
        if d["text"] is not None:
            used[q] = used.get(q, 0) - (-len(d["text"]) // 4)
            if used[q] <= 4000:
                out.setdefault(q, []).append("" if d["doc_id"] % 7 == 0 else f"https://e.com/{d['doc_id'] % 50}")
    return out


def test_citations_resolve_over_the_budgeted_chunks_of_all_documents(spark):
    usable, got = budgeted(), {r["query_id"]: r["sources"] for r in QUESTIONS["resolve_citations"](spark, SF).collect()}
    seen = 0
    for r in table("conversations"):
        if r["turn"] % 4 == 0 and r["text"] is not None and "[" not in r["text"]:
            urls = usable.get(r["conv_id"] % 6, [])
            cited = [urls[i - 1] for i in (2, 1, 2, 99) if i <= len(urls)]
            assert got[r["conv_id"] * 100 + r["turn"]] == ",".join(dict.fromkeys(u for u in cited if u))
            seen += 1
    assert seen and set(map(len, usable.values())) != {8}


def test_crawl_judges_every_page(spark):
    norm = {r["norm"] for r in PAGES["url_normalize"](spark, SF).collect()} - {None}
    got = PAGES["crawl_outcomes"](spark, SF).collect()
    assert len({r["url"] for r in got}) == len(got) and {r["url"] for r in got if r["depth"] == 0} == norm
    assert {r["outcome"] for r in got if r["depth"] == 0} <= {"fetched", "robots"}


def test_prompts_and_answers_for_every_question(spark):
    asked = {r["conv_id"]: r["query"] for r in QUESTIONS["last_user_message"](spark, SF).collect()}
    got = {r["query_id"]: r for r in QUESTIONS["build_prompt"](spark, SF).collect()}
    assert len(asked) > 6 and set(got) == set(asked)
    bare = [q for q in got if q % 6 == 5]
    assert bare and len({got[q]["user_digest"] for q in bare}) == len({asked[q] for q in bare})
    assert all((got[q]["temperature"] == got[0]["temperature"]) == (q % 2 == 0) for q in got) if 0 in got else True
    answers = {r["query_id"]: r["answer"] for r in QUESTIONS["generate"](spark, SF).collect()}
    assert set(answers) == set(asked)
    for q in bare:
        if asked[q] is not None:
            assert answers[q] == f"{len('No context documents were retrieved for this question.') + len('Question: ') + 2 + len(asked[q])} characters [1]"
