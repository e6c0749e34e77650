"""What hashes must not decide, what skew must not lose, and operators against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES, language_id, suffix_array_dedup
from corpusflow.llm import ann, blocks, mixing, near_dedup, packing, repeats, sharding, token_counts, topk
from tests.llm import brute
from tests.llm.test_operators import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def found(df):
    return {r["doc_id"]: tuple(r)[1:5] for r in df.collect()}


def test_words_that_cancel_in_a_polynomial(spark):
    """Thue-Morse words and their complements have one hash modulo 2^64 under any odd base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word[:1024]), (4, word[:1024].translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert found(repeats.remove_repeats(df)) == brute.repeats(rows)


def test_all_batches_of_a_part():
    rows = np.zeros(6, repeats.MARK)
    rows["doc"] = range(6)
    some = [repeats.as_batch([*repeats.packed(repeats.REMOVE, np.array([i // 3]), rows[i : i + 1])]) for i in range(6)]
    parts = [repeats.unpacked(p, repeats.REMOVE, repeats.MARK)["doc"].tolist() for p in repeats.whole_parts(iter(some))]
    assert parts == [[0, 1, 2], [3, 4, 5]]


@pytest.mark.parametrize("limits", [{}, {"local_hot": 2}, {"hot": 2}])
def test_repeats_of_hot_triggers(spark, limits):
    """One passage in many documents, each with another text around it, and a very repetitive one."""
    passage, rng = prose(40, 77), random.Random(7)
    rows = [(i, prose(rng.randint(0, 30), 1000 + i) + " " + passage[rng.randint(0, 60) :] + " " + prose(rng.randint(0, 30), 2000 + i)) for i in range(90)]
    rows += [(900, "ab" * 700), (901, "ba" * 300 + "\0" * 150 + "é" * 90), (902, "\0" * 400)]
    assert found(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **limits)) == brute.repeats(rows)


def test_long_texts_in_slices(spark, monkeypatch):
    text = prose(3000, 5)
    data = np.frombuffer(text.encode(), np.uint8)
    whole, _ = near_dedup.shingle_sets(data, np.array([0, len(data)]), 5)
    for size in (50, 997, 5000, 10**6):
        assert near_dedup.long_set(data, 5, size).tolist() == whole.tolist()
    names = near_dedup.named(data)
    monkeypatch.setattr(near_dedup, "SLICE", 100)
    assert near_dedup.named(data) == names and near_dedup.named(np.frombuffer(text.upper().replace(" ", "\t \n").encode(), np.uint8)) == names


def test_stage_cuts_each_row_by_itself(spark):
    passage = prose(60, 3)
    rows = [(1, "aaa " + passage + " tail", "en", "s", 1, "x"), (1, "zzz wholly other text", "en", "s", 1, "y"), (2, "bbb " + passage, "en", "s", 1, "z"), (3, None, "en", "s", 1, "n")]
    docs = spark.createDataFrame(rows, DOCS + ", kept_text string").withColumn("row", F.lit("r")).withColumn("__id", F.lit("i"))
    got = suffix_array_dedup(spark, docs, "")
    assert got.columns == docs.columns
    texts = {r["kept_text"]: (r["text"], r["row"], r["__id"], r["n_chars"]) for r in got.collect()}
    assert texts["y"] == ("zzz wholly other text", "r", "i", 1) and texts["n"][0] is None and texts["x"][0].endswith("tail") and texts["x"][0].startswith("aaa")
    # One of the two keeps the passage: whether x keeps doc_id 1 or y does is told by their hashes.
    assert (passage in texts["x"][0]) != (passage in texts["z"][0])
    assert all(texts[k][3] == (1 if passage in texts[k][0] else len(texts[k][0])) for k in "xz")


def test_stages_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(i, prose(30, i), None, "s", 1) for i in range(10)], DOCS)
    assert language_id(spark, docs, "").count() == 10
    for _, stage in STAGES:
        out = stage(spark, docs.limit(0), "")
        assert out.count() == 0


def test_trees_follow_edit_tables(spark, tmp_path):
    rng = random.Random(2)
    texts = {i: prose(rng.randint(0, 200), i) for i in range(12)}
    docs = spark.createDataFrame([*texts.items(), (50, None)], "doc_id long, text string")
    with open(token_counts.TOKENIZER, "rb") as f:
        counter = token_counts.Counter(f.read())
    trees = token_counts.build_trees(docs)
    for turn in range(3):
        trees.write.parquet(str(tmp_path / f"trees{turn}"))
        trees = spark.read.parquet(str(tmp_path / f"trees{turn}"))
        rows = []
        for i in rng.sample(sorted(texts), 7):
            for seq in range(rng.randint(1, 4)):
                a = rng.randint(0, len(texts[i]) + 2)
                b, new = a + rng.randint(0, 30), rng.choice(["", " new words ", "x", "\n\n", "it's 12"])
                rows.append((i, seq, a, b, new))
                texts[i] = texts[i][:a] + new + texts[i][max(a, b) :] if a < len(texts[i]) else texts[i] + new
        edits = spark.createDataFrame([*rows, (999, 0, 0, 1, "none"), (None, 0, 0, 1, "none")], "doc_id long, seq int, start long, stop long, replacement string").repartition(4)
        trees = token_counts.apply_edits(trees, edits)
        got = {r["doc_id"]: (r["text"], r["n_tokens"], r["n_pretokens"]) for r in trees.collect()}
        assert got == {**{i: (t, len(counter.encoding.encode_ordinary(t)), len(counter.split.findall(t))) for i, t in texts.items()}, 50: (None, 0, 0)}


def test_margins_hold_after_the_cap(spark):
    """Against plain raking; a level asked for more than its tokens lowers the rate until margins hold."""
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(20, 60), i), "en" if i % 4 else "de", "hot" if i % 10 else "cold", 0) for i in range(1200)]
    df = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"hot": 0.6, "cold": 0.4}, "lang": {"en": 0.5, "de": 0.5}}
    topics = mixing.Topics(np.zeros((mixing.BUCKETS, mixing.TOPICS)), {"": np.zeros(mixing.TOPICS)})
    got = mixing.mix_sources(df, targets, rate=0.7, topics=topics).collect()
    mass = Counter()
    for r in got:
        for m in ("source", "lang"):
            mass[r[m]] += r["tokens"] * r["probability"]
    whole = mass["hot"] + mass["cold"]
    assert all(abs(mass[k] / whole - v) < 1e-3 for goal in targets.values() for k, v in goal.items())
    assert whole < 0.3 * sum(r["tokens"] for r in got) and all(0 <= r["probability"] <= 1 for r in got)
    # Plain iterative proportional fitting, where nothing is capped.
    cells = Counter()
    for r in got:
        cells[r["source"], r["lang"]] += r["tokens"]
    weight, total = dict(cells), sum(cells.values())
    for _ in range(200):
        for j, goal in enumerate(targets.values()):
            now = Counter()
            for c, w in weight.items():
                now[c[j]] += w
            weight = {c: w * goal[c[j]] * total / now[c[j]] for c, w in weight.items()}
    low = {(r["source"], r["lang"]): r["probability"] for r in mixing.mix_sources(df, targets, rate=0.05, topics=topics).collect()}
    assert all(abs(low[c] - 0.05 * weight[c] / cells[c]) < 1e-4 for c in cells)


def test_topics_are_clusters_of_vocabulary(spark):
    words = [[f"{c}{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] for c in ("sea", "war", "tax")]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[i % 3], k=60)), "en", "s", 0) for i in range(300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    by = defaultdict(Counter)
    for r in got:
        by[r["topic"]][r["doc_id"] % 3] += 1
    assert len(by) >= 3 and all(max(n.values()) >= 0.98 * sum(n.values()) for n in by.values())


def test_topics_are_learned_from_all_documents(spark, monkeypatch):
    """Each word is in two of 4,000 documents' own words: none may be without weight. And against plain
    k-means over all documents, however they are dealt to tasks."""
    rng = random.Random(7)
    themes = [[f"{c}{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)] for c in ("sea", "war", "tax", "law")]
    rows = [(i, " ".join([*rng.choices(themes[i % 4], k=30), f"own{i % 2000}", *["often"] * (600 * (i == 8))]), "en" if i % 3 else "de", "s", 0) for i in range(4000)]
    learned, real = [], mixing.learn_topics
    monkeypatch.setattr(mixing, "learn_topics", lambda docs: learned.append(real(docs)) or learned[-1])
    got = {r["doc_id"]: r["topic"] for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    again = {r["doc_id"]: r["topic"] for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(8, "doc_id")).collect()}
    x = np.zeros((len(rows), mixing.BUCKETS))
    for i, r in enumerate(rows):
        data = np.frombuffer(r[1].encode(), np.uint8)
        np.add.at(x[i], mixing.bucketed(data, np.array([0, len(data)]))[1], 1)
    assert (np.abs(learned[0].table[x.any(axis=0)]).max(axis=1) > 0).all()
    assert got == again and (learned[0].table == learned[1].table).all()
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    x = x / x.sum(axis=1, keepdims=True) * weight
    for lang in ("en", "de"):
        of = np.array([r[2] == lang for r in rows])
        assert np.abs(learned[0].table.T / weight @ x[of].mean(axis=0) - learned[0].usual[lang]).max() < 1e-6
        x[of] -= x[of].mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = learned[0].table.T / weight
    own = (x @ centres.T).argmax(axis=1)
    assert np.mean([got[r[0]] == f"t{t}" for r, t in zip(rows, own, strict=True)]) > 0.999
    sums = np.stack([x[own == t].sum(axis=0) for t in range(mixing.TOPICS)])
    assert ((sums / np.linalg.norm(sums, axis=1, keepdims=True) * centres).sum(axis=1) > 0.97).all()


def test_packing_takes_tokens_and_opens_each_bin_at_its_cost(spark):
    rows = [(i, prose(i * 7, i)) for i in range(20)]
    with open(token_counts.TOKENIZER, "rb") as f:
        counter = token_counts.Counter(f.read())
    got = Counter()
    for r in packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == {i: len(counter.encoding.encode_ordinary(t)) for i, t in rows}
    # 5 + 3 fill a bin of 8, 4 one of 4, whatever one length for all would do.
    assert sorted(Counter((b, cap) for _, _, _, b, _, cap in packing.pack(np.array([5, 4, 3]), (4, 8), 0)).values()) == [1, 2]
    rng = np.random.default_rng(1)

    def least(sizes, capacities, overhead):
        """Over all ways to put a few documents in bins."""
        def ways(items):
            if not items:
                yield []
                return
            for rest in ways(items[1:]):
                for i in range(len(rest)):
                    yield [*rest[:i], rest[i] + items[0], *rest[i + 1 :]]
                yield [*rest, items[0]]

        fits = [[min(c for c in capacities if c >= b) for b in way] for way in ways(sizes) if max(way) <= max(capacities)]
        return min(sum(w) + overhead * len(w) for w in fits)

    for _ in range(25):
        sizes = rng.integers(1, 100, 6).tolist()
        bins = {b: cap for _, _, _, b, _, cap in packing.pack(np.array(sizes), (32, 64, 128), 4)}
        assert sum(c + 4 for c in bins.values()) <= 1.25 * least(sizes, (32, 64, 128), 4)


def test_shards_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 7)
    rows = [(None if i % 3 == 0 else i % 40, "t" * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("slot", F.lit("clash"))
    got = sharding.shard_documents(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    other = sharding.shard_documents(df.withColumn("doc_id", F.col("doc_id").cast("int"))).collect()
    assert {(r["doc_id"], r["shard"]) for r in other} == {(r["doc_id"], r["shard"]) for r in got}
    # The least cost over the shards, in plain Python over Spark's hashes.
    keys = {r["doc_id"] for r in got}
    hashes = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[F.shiftrightunsigned(F.xxhash64(F.col("k").cast("string"), F.lit(s)), 11).alias(str(s)) for s in range(17)]).collect()
    for h in hashes:
        cost = [-np.log((h[str(s)] + 0.5) / 2**53) for s in range(17)]
        assert {(r["shard"], r["grown_shard"]) for r in got if r["doc_id"] == h["k"]} == {(int(np.argmin(cost[:16])), int(np.argmin(cost)))}


def vectors(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("dim", "cell", "kind", "cb", "qb", "rank", "score", "query_id", "d", "n"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(6)


def nearest(x, q, k):
    s = x.astype(np.float64) @ x[q].astype(np.float64)
    s[q] = -np.inf
    return s, np.lexsort((np.arange(len(x)), -s))[:k]


def test_index_prunes_where_there_is_structure(spark):
    """Clusters: little is looked at, and nearly all is found; ties go to the smaller id."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((200, 32))
    x = (centres[rng.integers(0, 200, 12_000)] + 0.05 * rng.standard_normal((12_000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[9] = x[20]
    df = vectors(spark, x)
    got = defaultdict(list)
    for r in ann.ann_topk(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 12_000, 20):
        s, want = nearest(x, q, 20)
        assert len(got[q]) == 20 and [v for v, _ in got[q]] == sorted((v for v, _ in got[q]), key=lambda v: (-dict(got[q])[v], v))
        hit += len(set(want.tolist()) & {v for v, _ in got[q]})
    assert hit / (600 * 20) >= 0.9 and [v for v, _ in got[20]][:2] == [7, 9] and got[20][0][1] == got[20][1][1]
    usable = blocks.usable(df.select("vec_id", "embedding"), True)
    codes, radius, _ = ann.learned(usable, 20, 4096, 128, 256, 0.95)
    index = ann.MultiIndex(codes(x))
    for q in range(0, 12_000, 100):
        index.within(codes(x[q][None], query=True)[0], radius)
    assert index.did < 0.2 * index.could


def test_several_blocks_and_turns(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_BYTES", 8 * 8 * 4)
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (500, 8)).astype(np.float32)  # many ties
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = defaultdict(list)
        for r in topk.exact_topk(vectors(spark, x, [(900, [1.0, 2.0])]), scale=1.0).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(0, 500, 20):
        s, want = nearest(x, q, 20)
        assert got[q] == [(int(v), int(s[v])) for v in want]


def test_scores_beyond_64_bits():
    x = np.array([[1e17, 1.0], [1e17, 2.0], [3.0, -1e17]])
    with pytest.raises(OverflowError):
        list(topk.taat([0], x[:1], [0, 1, 2], x, 2, 64.0))
    y = np.array([[2.0**40, 0.0], [2.0**20, 0.0], [-(2.0**20), 0.0]])
    kept = {int(p): int(s) for _, places, scores in topk.taat([0], y[1:2] * 2**22, [0, 1, 2], y[1:], 2, 1.0) for p, s in zip(places, scores, strict=True)}
    assert kept == {0: 2**62, 1: -(2**62)}


def test_vectors_in_one_length():
    table = pa.table({"vec_id": [3, 1, 2], "embedding": pa.array([[1.0, 2.0], [3.0], [0.0, 1.0]], pa.list_(pa.float64()))})
    got = [(ids.tolist(), x.tolist()) for ids, x in blocks.by_length(table)]
    assert got == [([1], [[3.0]]), ([2, 3], [[0.0, 1.0], [1.0, 2.0]])]


def test_counts_in_one_pass_are_those_of_kept_trees(spark, monkeypatch):
    rows = [(i, None if i == 3 else prose(i * 9, i)) for i in range(14)] + [(None, "a b"), (5, prose(45, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = token_counts.updated(token_counts.build_trees(docs).withColumn("edits", token_counts.sample_edits(F.col("text"))))
    want = Counter((r["doc_id"], r["n_pretokens_before"], r["n_tokens_before"], r["n_edits"], r["n_tokens"], r["n_reencoded"]) for r in kept.collect())
    assert Counter(map(tuple, token_counts.edited_counts(docs).collect())) == want
    (batch,) = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}).to_batches()
    monkeypatch.setattr(token_counts, "SLICE", 200)
    parts = list(token_counts._sliced([batch]))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
