"""The stages on planted cases: what must go goes, clean documents stay."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corpus_pipeline import STAGES, run
from corpusflow.llm import language, mixing
from corpusflow.llm.common import released

WORDS = {"en": ["the", "which", "through", "light", "night", "water", "house", "under", "never", "always"], "de": ["der", "nacht", "durch", "licht", "wasser", "haus", "unter", "niemals", "immer", "schwer"]}


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    make = lambda lang, n: " ".join(w + str(rng.randint(0, 99)) * (rng.random() < 0.2) for w in rng.choices(WORDS[lang], k=n))
    rows = [(i, make("en" if i % 2 else "de", 60), "en" if i % 2 else "de", "hot" if i % 3 else "cold") for i in range(120)]
    passage = make("en", 60)
    rows += [(500, rows[0][1], "de", "hot"), (501, rows[1][1] + " more", "en", "hot"), (502, "12345 678 !!", "en", "hot"), (503, None, None, None), (504, make("en", 40) + " " + passage, "en", "hot"), (505, make("en", 40) + " " + passage, "en", "hot")]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "sf")
    table.write.parquet(f"{path}/documents.parquet")
    docs, seen = table, {}
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, path)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert set(docs.columns) == set(table.columns)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(120)) | {504, 505}
    assert set(seen["language_id"]) == clean | {500, 501}
    assert set(seen["minhash_near_dedup"]) == clean
    assert set(seen["suffix_array_dedup"]) == clean and passage in seen["suffix_array_dedup"][504] and passage not in seen["suffix_array_dedup"][505]
    assert set(seen["mix_to_targets"]) < clean
    packed = {r["doc_id"] for r in run(spark, path).collect()}
    assert packed == set(seen["mix_to_targets"])


def test_language_stage_learns_from_all_documents(spark, tmp_path, monkeypatch):
    """Texts in an alphabet that one document among 12,000 has are told as its language, and two runs over
    rows dealt otherwise learn the same."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS["en" if i % 2 else "de"], k=5)), "en" if i % 2 else "de", "s", 0) for i in range(12000)]
    odd = {f"{a * 5} {a * 3}": ("de", "en")[i % 2] for i, a in enumerate("ωжאشกա")}
    rows += [(20000 + i, t, lang, "s", 0) for i, (t, lang) in enumerate(odd.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    learned, real = [], corpus_pipeline.accepted
    monkeypatch.setattr(corpus_pipeline, "accepted", lambda text, model: learned.append(model) or real(text, model))
    for d in (docs.repartition(2), docs.repartition(7, "doc_id")):
        assert dict(STAGES)["language_id"](spark, d, str(tmp_path)).count() == len(rows)
    assert {t: learned[0](np.frombuffer(t.encode(), np.uint8))[0] for t in odd} == odd
    assert (learned[0].table == learned[1].table).all() and learned[0].reject_below == learned[1].reject_below


def test_language_stage_tallies_in_little_memory(spark):
    """Tables of subwords are made of a few texts at a time, however many there are in a batch, and whole:
    also of texts with few subwords, with none, and with counts and gaps beyond a byte."""

    class Docs:
        where = select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)) for _ in range(1200)]
    texts[5], texts[600], texts[-1] = "", "a " * 900, "1 2"
    rows = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en", "de", None] * 400, "half": pa.array([0, 1] * 600, pa.int32())})
    run, found, peak = language.tallied(Docs()), [], []
    next(run(iter([rows.slice(0, 1)])))
    tracemalloc.start()
    for got in run(iter([rows])):
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found += got.to_pylist()
        tracemalloc.start()
    tracemalloc.stop()
    kept = [i for i in range(1200) if i not in (5, 1199)]
    assert [(r["lang"], r["half"]) for r in found] == [(("en", "de", None)[i % 3], i % 2) for i in kept]
    for i, r in zip(kept, found, strict=True):
        at, n = np.cumsum(np.frombuffer(r["gap"], np.uint8), dtype=np.int64), np.frombuffer(r["n"], np.uint8)
        assert (np.bincount(at, n, language.BUCKETS) == language.bucket_counts(np.frombuffer(texts[i].encode(), np.uint8))).all()
    assert max(peak) < 40 << 20


def test_mixing_stage_learns_from_all_documents(spark, tmp_path, monkeypatch):
    """Words of single documents among 3,000 have a weight in the topics of the stage, and two runs over
    rows dealt otherwise keep the same documents."""
    rows = [(i, f"sea{i % 7} war{i % 5} tax{i % 3} sea{i % 7} own{i}", "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    learned, real = [], mixing.learn_topics
    monkeypatch.setattr(mixing, "learn_topics", lambda docs: learned.append(real(docs)) or learned[-1])
    kept = [{r["doc_id"] for r in dict(STAGES)["mix_to_targets"](spark, d, str(tmp_path)).collect()} for d in (docs.repartition(2), docs.repartition(7, "doc_id"))]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 3000
    data = np.frombuffer(" ".join(r[1] for r in rows).encode(), np.uint8)
    seen = np.unique(mixing.bucketed(data, np.array([0, len(data)]))[1])
    everywhere = np.abs(learned[0].table[seen]).max(axis=1) > 0
    assert everywhere.all() and (learned[0].table == learned[1].table).all()


def test_workers_give_memory_back():
    """What a task needed and freed doesn't stay with its worker, also where something small lies behind it."""
    held, anonymous = [], lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def run(batches):
        junk = [bytes(b"x" * (64 << 10)) + bytes([len(held)]) for _ in range(4000)]
        held.append(bytes(b"y" * (64 << 10)) + b"z")
        yield len(junk)

    before = anonymous()
    assert list(released(run)(iter([]))) == [4000]
    assert anonymous() - before < 60
