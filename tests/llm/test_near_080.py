"""The pipeline takes near copies from a similarity of 0.80 on."""

import inspect

import numpy as np

from corpus_pipeline import minhash_near_dedup
from corpusflow.llm import near_dedup
from tests.llm import brute
from tests.llm.test_operators import prose


def test_stage_takes_copies_between_080_and_085(spark):
    words = prose(100, 70).split()
    words[30] = words[70] = "changed"  # 10 of 96 shingles differ: 86 / 106
    rows = [(1, prose(100, 70)), (2, " ".join(words)), (3, prose(100, 71))]
    assert brute.near_dedup(rows, 80)[2][1] == 1 and brute.near_dedup(rows, 85)[2][1] == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in minhash_near_dedup(spark, docs, "").collect()} == {1, 3}
    assert inspect.signature(near_dedup.near_duplicates).parameters["percent"].default == 80


def test_bands_hold_recall_at_080():
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 1e-5 and near_dedup.BANDS * near_dedup.ROWS <= near_dedup.T
    rng, met = np.random.default_rng(3), 0
    for _ in range(300):
        x = rng.integers(1, 1 << 63, 225, dtype=np.uint64)
        sets = [np.sort(x[:200]), np.sort(np.r_[x[:177], x[200:222]])]  # 177 / 222, just under 0.80
        keys = near_dedup.bands(near_dedup.sketches(np.concatenate(sets), np.array([0, 200, 399])))
        met += bool((keys[0] == keys[1]).any())
    assert met == 300
