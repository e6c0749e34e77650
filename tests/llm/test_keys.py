"""Rows without a doc_id, and texts that share one, lose nothing."""

from collections import Counter

from corpus_pipeline import STAGES, suffix_array_dedup
from corpusflow.llm import near_dedup, packing, repeats
from corpusflow.llm.common import ROW_KEYS, identified
from tests.llm.test_operators import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = prose(60, 50)
TEXTS = [prose(40, i) + " " + PASSAGE for i in range(51, 57)]
#: One id holds three texts and a null, no id two texts; one row is there twice.
ROWS = [(1, TEXTS[0]), (1, TEXTS[1]), (1, TEXTS[2]), (1, None), (1, TEXTS[1]), (None, TEXTS[3]), (None, TEXTS[4]), (2, TEXTS[5])]


def table(spark):
    return spark.createDataFrame([(i, t, "en", "hot", len(t or "")) for i, t in ROWS], DOCS).repartition(3)


def test_identified(spark):
    got = [identified(df).collect() for df in (table(spark), table(spark).repartition(7))]
    assert sorted(got[0], key=str) == sorted(got[1], key=str) and got[0][0].__fields__ == DOCS.replace(" long", "").replace(" string", "").split(", ")
    keys = [r["doc_id"] for r in got[0]]
    assert len(set(keys)) == len(keys) == 7 and None not in keys
    assert Counter(r["text"] for r in got[0]) == Counter([*TEXTS, None])
    held = {r["doc_id"]: r["text"] for r in got[0] if r["doc_id"] < ROW_KEYS}
    assert set(held) == {1, 2} and held[1] in TEXTS[:3] and held[2] == TEXTS[5]


def test_operators_and_stages_keep_every_text(spark, tmp_path):
    path = str(tmp_path / "sf")
    table(spark).write.parquet(f"{path}/documents.parquet")
    for op in (near_dedup.op4_near_dedup, repeats.op7_repeated_passages, packing.op8_best_fit_packing):
        assert len({r["doc_id"] for r in op(spark, path).collect()}) == 7
    assert near_dedup.near_duplicates(table(spark)).count() == 5
    whole = identified(table(spark))
    cut = {r["doc_id"]: r["text"] for r in suffix_array_dedup(spark, whole, path).collect()}
    source = {r["doc_id"]: r["text"] for r in whole.collect() if r["text"]}
    assert set(source) <= set(cut) and all(cut[i][:50] == source[i][:50] for i in source)
    assert sum(PASSAGE in cut[i] for i in source) == 1
    # The first stage gives the keys: an id of which one text is rejected keeps its others.
    mixed = spark.createDataFrame([(i, prose(50, i), "en", "hot", 1) for i in range(200)] + [(3, "12 34 !!", "en", "hot", 1), (None, prose(50, 900), "en", "hot", 1)], DOCS)
    left = {r["text"] for r in STAGES[0][1](spark, mixed, path).collect()}
    assert left >= {prose(50, 3), prose(50, 900)} and "12 34 !!" not in left
