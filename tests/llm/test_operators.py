"""Each operator against a plain version, and on nulls, empties, ties, repeats, clashing names and no rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import ann, graph, language, licenses, mixing, near_dedup, packing, repeats, sharding, token_counts, topk
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
WORDS = ["".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


BASE, SHARED = prose(120, 1), prose(60, 2)
EDGES = [
    (1, BASE), (2, BASE), (3, BASE + " tail"), (4, BASE.upper()), (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "one  two"), (10, prose(90, 3) + " " + SHARED), (11, SHARED + " " + prose(80, 4)),
    (12, "é" * 300), (13, "x" * 500), (14, prose(20_000, 6)), (15, "word " * 400), (16, SHARED[3:140]), (17, BASE.replace("a", "b", 3)), (18, prose(20_000, 6)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "")) for i, t in EDGES]
    clash = spark.createDataFrame(rows, DOCS)
    for c in ("rep", "bands", "grp", "spans", "part", "kind", "tokens", "shard", "slot", "digest", "comp", "node", "a", "b", "n"):
        clash = clash.withColumn(c, F.lit("clash"))
    return clash.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def keyless(df):
    """The rows with a null key and one row repeated."""
    spark = df.sparkSession
    more = spark.createDataFrame([(None, BASE, "en", "s", 1), (1, BASE, "en", "s", 1)], DOCS)
    return df.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


ODD = [(900, None), (901, []), (902, [1.0, None, 2.0, 0.0]), (903, [float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0, 1.0]), (905, [0.0, 0.0, 0.0, 0.0]), (906, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((130, 4)).astype(np.float32)
    x[5] = x[6] = x[25]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(i, v, 0) for i, v in ODD] + [(3, x[3].tolist(), 0)]
    got = defaultdict(list)
    for r in topk.exact_topk(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = np.floor(64 * np.vstack([x, np.zeros((1, 4))]).astype(np.float64)).astype(int)
    ids = np.array([*range(130), 905])
    assert set(got) == {0, 20, 40, 60, 80, 100, 120}
    for q, found in got.items():
        s = y @ y[ids == q][0]
        want = [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert found == [(n + 1, *w) for n, w in enumerate(want)]
    assert topk.exact_topk(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in topk.exact_topk(vectors(spark, [(0, [1.0], 0), (1, [1.0], 0)])).collect()] == [(0, 1, 1, 4096)]


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(i, v, 0) for i, v in ODD]
    got = defaultdict(list)
    for r in ann.ann_topk(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(400), -s))[:20].tolist())
        assert len(got[q]) == 20 and all(abs(s[v] - score) < 1e-9 for v, score in got[q])
        hit += len(want & {v for v, _ in got[q]})
    assert hit / 400 >= 0.9
    assert ann.ann_topk(vectors(spark, [])).count() == 0 and ann.ann_topk(vectors(spark, [(0, [1.0], 0), (1, [1.0], 0)])).count() == 1


def test_multi_index_finds_all_within_the_radius():
    codes = np.random.default_rng(2).integers(0, 256, (500, 32)).astype(np.uint8)
    index = ann.MultiIndex(codes)
    far = np.bitwise_count(codes ^ codes[3]).sum(axis=1)
    for radius in (0, 15, 31, 110, 128):
        assert index.within(codes[3], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_sharding(spark, docs, none):
    rows = sharding.shard_documents(keyless(docs)).collect()
    assert len(rows) == len(EDGES) + 2 and {r["law"] for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict(EDGES)
    for r in rows:
        t = text.get(r["doc_id"], BASE)
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1 and sharding.shard_documents(none).count() == 0


def test_weighted_shards_move_little(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(ids, {0: 1.0, 1: 3.0, 2: 0.0}, {3: 1.0}).collect()
    n = Counter(r["shard"] for r in rows)
    assert 2 not in n and abs(n[1] / 4000 - 0.75) < 0.04
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {3} and abs(len(moved) / 4000 - 0.2) < 0.04


def test_near_dedup(spark, docs, none):
    want = brute.near_dedup(EDGES)
    for df in (docs, keyless(docs)):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()} == want
    assert want[3][1] == 1 and want[5] == (0, 5, True) and near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """More members than a cell holds, in a chain of small changes, so several rounds and blocks run."""
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    monkeypatch.setattr(near_dedup, "GROWTH", 2)
    words, rows = prose(100, 9).split(), []
    for i in range(60):
        words = list(words)
        words[(i * 7) % 100] = f"w{i}"
        rows.append((i, " ".join(words)))
    want = brute.near_dedup(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_sketches_fill_every_place():
    sets = np.arange(1, 40, dtype=np.uint64)
    out = near_dedup.sketches(sets, np.array([0, 1, 39]))
    assert (out != np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("local", [1 << 20, 7])
def test_components(spark, local):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (500, 499)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), local).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 500: 499, 499: 499}
    assert graph.components(spark.createDataFrame([], "a long, b long"), local).count() == 0


def test_repeats(spark, docs, none):
    want = brute.repeats(EDGES)
    for df in (docs, keyless(docs)):
        assert {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(df).collect()} == want
    assert want[2][1] == len(BASE) and want[13][1] == 500 - 100 + 100 - 1 and repeats.remove_repeats(none).count() == 0
    short = brute.repeats(EDGES, 40)
    assert {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(docs, length=40, k=16).collect()} == short


def test_shares_keep_keys_together(monkeypatch):
    monkeypatch.setattr(repeats, "AT_ONCE", 50)
    rows = np.zeros(400, repeats.PHRASE)
    rows["trigger"] = np.arange(400) % 90
    parts = list(repeats.shares(rows, "trigger", 400))
    assert sum(map(len, parts)) == 400 and len(parts) == 8
    owner = [set(p["trigger"].tolist()) for p in parts]
    assert sum(map(len, owner)) == 90


def test_mixing(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(20, 60), i), "en" if i % 4 else "de", "hot" if i % 3 else "cold", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"hot": 0.5, "cold": 0.5}, "lang": {"en": 0.6, "de": 0.4}}
    here = mixing.mix_sources(df, targets, rate=0.3).collect()
    joined = {r["doc_id"]: r["probability"] for r in mixing.mix_sources(df, targets, rate=0.3, cells_here=0).collect()}
    assert all(abs(joined[r["doc_id"]] - r["probability"]) < 1e-4 for r in here)
    mass = Counter()
    for r in here:
        mass[r["source"]] += r["tokens"] * r["probability"]
        mass["all"] += r["tokens"] * r["probability"]
    total = sum(r["tokens"] for r in here)
    assert abs(mass["all"] / total - 0.3) < 1e-3 and abs(mass["hot"] / mass["all"] - 0.5) < 0.01
    assert abs(sum(r["tokens"] for r in here if r["sampled"]) / total - 0.3) < 0.05
    edge = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert len(edge) == len(EDGES) and not edge[5]["sampled"] and edge[5]["tokens"] == 0 and mixing.mix_sources(none).count() == 0
    assert len({(r["doc_id"], r["sampled"]) for r in mixing.mix_sources(keyless(docs)).collect() if r["doc_id"] == 1}) == 1


def test_token_counts(spark, docs, none):
    import tiktoken

    with open(token_counts.TOKENIZER, "rb") as f:
        counter = token_counts.Counter(f.read())
    assert isinstance(counter.encoding, tiktoken.Encoding)
    rng = random.Random(4)
    for seed in range(40):
        text = prose(rng.randint(0, 300), seed) + rng.choice(["", "  \n", " 12 don't é中\U0001f600"])
        tree = token_counts.TokenTree(text, counter)
        for _ in range(6):
            a = rng.randint(0, len(text) + 3)
            b, new = a + rng.randint(0, 12), rng.choice(["", " ", "x", " new words", "'ll", "\n\n", "9"])
            tree.edit(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text))
    rows = {r["doc_id"]: r for r in token_counts.edited_counts(docs).collect()}
    assert rows[5]["n_tokens"] == 0 == rows[5]["n_edits"] and rows[14]["n_reencoded"] < rows[14]["n_pretokens"] / 10
    assert all(rows[i]["n_tokens"] == len(counter.encoding.encode_ordinary(t or "")) for i, t in EDGES)
    assert token_counts.edited_counts(none).count() == 0


def test_packing(spark, docs, none):
    for df in (docs, keyless(docs)):
        rows = packing.best_fit(df, group_rows=6, tokens=packing.word_count(F.col("text"))).collect()
        n = Counter()
        room = defaultdict(list)
        for r in rows:
            n[r["doc_id"]] += r["n_tokens"]
            if r["bin_id"]:
                room[r["bin_id"], r["bin_capacity"]].append((r["bin_start"], r["bin_start"] + r["n_tokens"]))
        assert n == {i: len((t or "").split()) for i, t in EDGES}
        for (_, capacity), spans in room.items():
            spans.sort()
            used = spans[-1][1]
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and capacity == min(c for c in packing.CAPACITIES if c >= used)
        assert len({b for b, _ in room}) == len(room)
    assert packing.best_fit(none).count() == 0


def test_packing_costs_no_more_than_one_length():
    sizes = np.random.default_rng(5).integers(1, 3000, 300)
    cost = lambda found: sum(c + packing.OVERHEAD for c in {f[3]: f[5] for f in found}.values())
    several = cost(packing.pack(sizes, packing.CAPACITIES, packing.OVERHEAD))
    assert several <= min(cost(packing.pack(sizes, (c,), packing.OVERHEAD)) for c in packing.CAPACITIES)


def test_licenses(spark, docs, none):
    mit = licenses.KNOWN["MIT"][0]
    texts = [mit, mit.upper().replace(",", ""), mit.replace("<year> <holder>", "1999 Some One").replace("MIT License", "MIT Licence"), mit + " more", "Copyright (c) 2001 X", None, "", "licensed under cc by 4.0"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["license_id"] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "CC-BY-4.0"] and rows[5]["digest"] is None
    assert licenses.scan_licenses(keyless(docs)).count() == len(EDGES) + 2 and licenses.scan_licenses(none).count() == 0


def test_language(spark, docs, none):
    rng, rows = random.Random(6), []
    words = {"aa": ["mono", "toro", "kalo", "ribo", "santo"], "bb": ["schwer", "nacht", "licht", "mensch", "durch"], "cc": ["the", "which", "through", "light", "night"]}
    for i in range(900):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(3, 30))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df, language.learn(df)).collect()
    held = [r for r in got if r["held_out"]]
    true = {i: lang for i, _, lang in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in language.identify(docs, language.learn(df)).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["rejected"] for i in (5, 6, 7)) and edge[12]["lang_pred"] != "und"
    assert language.identify(none, language.learn(none)).count() == 0 and language.learn(none) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    blind = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "wrong").otherwise(F.col("lang")))
    assert [tuple(r) for r in language.identify(blind, language.learn(blind)).orderBy("doc_id").collect()] == sorted((tuple(r) for r in got), key=lambda r: r[0])
