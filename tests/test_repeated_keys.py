"""Queries agree with their SQL where urls are listed twice and question ids collide, as in larger tables."""

from collections import Counter

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def article(title, words):
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{f'{words} words about a topic. ' * 30}</p></article></body></html>"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Urls in two and three versions: of every age, changed and not, some with the same content."""
    folder = tmp_path_factory.mktemp("repeated")
    pages = [{"page_id": i, "url": f"https://e.com/en/{i % 40}", "html": article(f"T{i}", f"w{i % 60}")} for i in range(110)]
    pq.write_table(pa.Table.from_pylist(pages), folder / "pages.parquet")
    return str(folder)


def agree(spark, folder, name):
    db = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        if (found := f"{folder}/{t}.parquet") and pa.fs.LocalFileSystem().get_file_info(found).is_file:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{found}'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = entry.queries()[name](spark, folder)
    assert rows.columns == columns
    got, want = Counter(tuple(r) for r in rows.collect()), Counter(want.fetchall())
    assert got == want


def test_changes_of_repeated_urls(spark, tables):
    for name in ("diff_snapshot", "fetch_changes"):
        agree(spark, tables, name)


def test_refreshed_pages_of_repeated_urls(spark, tables):
    for name in ("process_delta", "incremental_refresh"):
        agree(spark, tables, name)


def test_snapshot_of_repeated_urls(spark, tables):
    agree(spark, tables, "snapshot_rebuild")
    agree(spark, tables, "run_metadata")


def test_citations_of_answers_with_one_id(spark, tmp_path):
    """Ids are conv_id * 100 + turn, to six digits: 3 and 10003 share theirs, but not their chunks."""
    said = [{"conv_id": c, "turn": t, "role": "assistant", "text": "An answer of some length, which is not a refusal as it says what it knows about it."} for c in (3, 4, 10003, 10004, 20003) for t in range(4)]
    docs = [{"doc_id": i, "text": f"words {i} " * 20, "lang": "en", "source": "web", "n_chars": 0} for i in range(400)]
    pq.write_table(pa.Table.from_pylist(said), tmp_path / "conversations.parquet")
    pq.write_table(pa.Table.from_pylist(docs), tmp_path / "documents.parquet")
    agree(spark, str(tmp_path), "resolve_citations")
