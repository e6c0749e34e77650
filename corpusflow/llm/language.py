"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, release, released, slices, stored, text_buffer
from corpusflow.llm.mixing import PAIRS, packed, totals

BITS = 14
BUCKETS = 1 << BITS
#: Bytes of a long text that are looked at together.
PIECE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters stay (bytes of other scripts count as letters here), all else is a word's edge.
_FOLD = np.where(((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128), _LOWER, 32).astype(np.uint8)


def subwords(data: np.ndarray) -> np.ndarray:
    """Buckets of all runs of 2, 3 and 4 bytes of a folded text that begin or end in a letter; words have edges."""
    b = _FOLD[data]
    b = np.concatenate(([32], b, [32])).astype(np.uint32)
    out, gram = [], b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        gram = (gram[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        ok = (b[: len(b) - n + 1] != 32) | (b[1 : len(b) - n + 2] != 32)
        out.append((gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF))[ok] * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in a text; a long one is taken PIECE bytes at a time, cut at a word's
    edge, so memory is bounded."""
    if len(data) <= 2 * PIECE:
        return np.bincount(subwords(data), minlength=BUCKETS)
    out, at = np.zeros(BUCKETS, np.int64), 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and end < at + 2 * PIECE and _FOLD[data[end]] != 32:
            end += 1
        out += np.bincount(subwords(data[at:end]), minlength=BUCKETS)
        at = end
    return out


@dataclass
class Model:
    """table is embeddings times weights: a text's logits are the mean of its subwords' rows plus bias."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def __call__(self, data: np.ndarray) -> tuple[str, float]:
        counts = bucket_counts(data)
        z = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 12, rate: float = 40.0, batch: int = 16, seed: int = 11) -> Model:
    """Stochastic gradient descent on four fifths of the rows (language, buckets, counts); on the rest
    the temperature is fitted and the rejection threshold set below nearly all right answers."""
    names = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    y = np.array([names.index(r[0]) for r in rows])
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) * 4 // 5)
    fit, check = order[:cut], order[cut:] if len(rows) > cut else order
    emb = rng.standard_normal((BUCKETS, dim)).astype(np.float32) * 0.1
    w, bias = rng.standard_normal((dim, len(names))).astype(np.float32) * 0.1, np.zeros(len(names), np.float32)
    share = [(b, (c / c.sum()).astype(np.float32)) for _, b, c in rows]
    total, step = epochs * (len(fit) // batch + 1), 0
    for _ in range(epochs):
        for lo in range(0, len(fit), batch):
            some = fit[lo : lo + batch] if lo == 0 else rng.choice(fit, min(batch, len(fit)), replace=False)
            lr = rate * (1 - step / total)
            step += 1
            h = np.stack([share[i][1] @ emb[share[i][0]] for i in some])
            g = softmax(h @ w + bias)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            back = g @ w.T
            w -= lr * 0.05 * (h.T @ g)
            bias -= lr * 0.002 * g.sum(axis=0)
            for k, i in enumerate(some):
                emb[share[i][0]] -= lr * share[i][1][:, None] * back[k]
    z = np.stack([share[i][1] @ emb[share[i][0]] for i in check]) @ w + bias
    true = y[check]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(true)), true] + 1e-12).mean()
    temperature = float(min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == true]
    below = min(0.4, float(np.quantile(right, 0.001)) * 0.9) if len(right) else 0.0
    return Model(names, (emb @ w).astype(np.float64), bias.astype(np.float64), temperature, below)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def sampled(docs: DataFrame, sample_rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About sample_rows labelled rows that aren't held out, spread evenly over the languages by a hash
    of doc_id, as counts of at most BUCKETS subword buckets a row, made on the executors."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    each = max(1, sample_rows // len(counts))
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.where(chance < rates[F.col("lang")]).select("doc_id", "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids, langs, at, how = [], [], [], []
            for i, (doc, lang) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                c = bucket_counts(data[offsets[i] : offsets[i + 1]])
                if c.any():
                    ids.append(doc)
                    langs.append(lang)
                    at.append(np.flatnonzero(c).astype(np.int32))
                    how.append(c[c > 0].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(how, pa.list_(pa.int32()))})

    table = rows.mapInArrow(released(count), "doc_id long, lang string, at array<int>, n array<int>").toArrow()
    found = zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["at"], table["n"], strict=True)
    return [(lang, at.values.to_numpy(), n.values.to_numpy()) for _, lang, at, n in sorted(found, key=lambda r: (r[0], r[1], len(r[2]), int(r[3].values.to_numpy().sum())))]


def learn(docs: DataFrame, sample_rows: int = 3000) -> Model | None:
    """The model, learned from docs(doc_id, text, lang); None if no row can be learned from."""
    rows = sampled(docs.select("doc_id", "text", "lang"), sample_rows)
    return train(rows) if rows else None


#: Languages weigh alike in learn_from_all(), but one that holds less than one of so many rows weighs less.
LEAST = 1024
#: Passes that learn, and how far the first one moves a bucket's weights at most; later ones move them less.
STEPS, RATE = 8, 5.0
#: Sums over all rows are of whole numbers, of so many to 1, so they are the same in any order.
FIXED = float(1 << 32)
#: Steps of the confidence that the rejection threshold is read from.
LEVELS = 1 << 16
TEMPERATURES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)


def tallied(docs: DataFrame) -> DataFrame:
    """(lang, half, gap, n) of each row of docs(text, lang) with a language and with subwords. half: 0 or 1, by
    a hash of the text. gap, n: its buckets, as distances from the one before, and how many subwords are
    in each, as bytes; a larger distance or count takes several. About PAIRS buckets of rows are worked on
    at a time: each takes some 150 bytes meanwhile."""

    def encoded(batch: pa.RecordBatch, some: list[int], at: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, at)])
        gap, count = np.concatenate(at), np.concatenate(n)
        skips, more = gap // 255, (count - 1) // 255
        long = skips + 1 + more
        to = np.r_[0, np.cumsum(long)]
        k = np.arange(to[-1]) - np.repeat(to[:-1] + skips, long)
        gaps = np.where(k < 0, 255, np.where(k == 0, np.repeat(gap % 255, long), 0)).astype(np.uint8)
        counts = np.where(k < 0, 0, np.where(k == 0, np.repeat(count - 255 * more, long), 255)).astype(np.uint8)
        rest = [batch.column(c).take(pa.array(some)) for c in ("lang", "half")]
        return pa.RecordBatch.from_arrays([*rest, packed(gaps, to[ends]), packed(counts, to[ends])], ["lang", "half", "gap", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            some, at, n, pairs = [], [], [], 0
            for i in range(batch.num_rows):
                c = bucket_counts(data[offsets[i] : offsets[i + 1]])
                found = np.flatnonzero(c)
                if len(found):
                    some.append(i)
                    at.append(np.diff(found, prepend=0))
                    n.append(c[found])
                    pairs += len(found)
                if pairs >= PAIRS:
                    yield encoded(batch, some, at, n)
                    some, at, n, pairs = [], [], [], 0
            if some:
                yield encoded(batch, some, at, n)

    half = F.xxhash64("text", F.lit("language")).bitwiseAND(F.lit(1)).cast("int").alias("half")
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", half)
    return rows.mapInArrow(released(run), "lang string, half int, gap binary, n binary")


@dataclass
class Halves:
    """Two models, each learned from the rows of one half. embeddings: (2, BUCKETS, dim); weights:
    (2, dim, languages); weigh: what a row of each language counts."""

    languages: list[str]
    weigh: np.ndarray
    embeddings: np.ndarray
    weights: np.ndarray

    def judged(self, batch: pa.RecordBatch, other: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Some rows of tallied() at a time, by the model of their half, or of the other one: the rows'
        models, languages, means of embeddings (dim, rows) and logits; and of their pairs how many there
        are of each row, the model and bucket, and the share."""
        code = {x: i for i, x in enumerate(self.languages)}
        langs = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int64)
        halves = batch.column("half").to_numpy().astype(np.int64) ^ int(other)
        gaps, ends = text_buffer(batch.column("gap"))
        counts = text_buffer(batch.column("n"))[0]
        columns = np.ascontiguousarray(self.embeddings.reshape(2 * BUCKETS, -1).T)
        for lo, hi in slices(ends + np.arange(len(ends)) * len(self.languages), PAIRS):
            a, b, half = ends[lo], ends[hi], halves[lo:hi]
            starts, long = ends[lo:hi] - a, np.diff(ends[lo : hi + 1])
            at, n = np.cumsum(gaps[a:b], dtype=np.int64), counts[a:b].astype(float)
            at += np.repeat(half * BUCKETS - at[starts] + gaps[a:b][starts], long)
            share = n / np.repeat(np.add.reduceat(n, starts), long)
            means = np.stack([np.add.reduceat(c[at] * share, starts) for c in columns])
            z = np.zeros((hi - lo, len(self.languages)))
            for k, mean in enumerate(means):
                z += mean[:, None] * self.weights[half, k]
            yield half, langs[lo:hi], means, z, long, at, share

    def slopes(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the loss over all rows, by embeddings and by weights."""
        n, dim = self.embeddings.size, self.weights.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            emb, w = np.zeros((dim, 2 * BUCKETS), np.int64), np.zeros(self.weights.shape, np.int64)
            for batch in batches:
                for half, lang, means, z, long, at, share in self.judged(batch, other=False):
                    off = softmax(z)
                    off[np.arange(len(z)), lang] -= 1
                    off *= self.weigh[lang][:, None] * FIXED
                    for k in range(dim):
                        back = (off * self.weights[half, k]).sum(axis=1)
                        emb[k] += np.bincount(at, np.rint(share * np.repeat(back, long)), 2 * BUCKETS).astype(np.int64)
                        each = np.rint(means[k][:, None] * off).astype(np.int64)
                        w[0, k] += each[half == 0].sum(axis=0)
                        w[1, k] += each[half == 1].sum(axis=0)
            return np.r_[emb.T.ravel(), w.ravel()]

        got = totals(rows, sums, n + self.weights.size) / FIXED
        return got[:n].reshape(self.embeddings.shape), got[n:].reshape(self.weights.shape)

    def calibrated(self, rows: DataFrame) -> tuple[float, float]:
        """The temperature of the least loss, and the threshold below nearly all right answers, over all
        rows, each judged by the model that hasn't seen its text."""
        n = len(TEMPERATURES)

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            loss, right = np.zeros(n, np.int64), np.zeros((n, LEVELS + 1), np.int64)
            for batch in batches:
                for _, lang, _, z, *_ in self.judged(batch, other=True):
                    weigh, told = self.weigh[lang] * FIXED, z.argmax(axis=1) == lang
                    for i, t in enumerate(TEMPERATURES):
                        p = softmax(z / t)
                        loss[i] += np.rint(-np.log(p[np.arange(len(z)), lang] + 1e-12) * weigh).astype(np.int64).sum()
                        level = (p.max(axis=1)[told] * LEVELS).astype(np.int64)
                        right[i] += np.bincount(level, np.rint(weigh[told]), LEVELS + 1).astype(np.int64)
            return np.r_[loss, right.ravel()]

        got = totals(rows, sums, n * (LEVELS + 2))
        best = int(got[:n].argmin())
        reached = np.cumsum(got[n:].reshape(n, -1)[best])
        below = int(np.searchsorted(reached, 0.001 * reached[-1])) / LEVELS
        return TEMPERATURES[best], min(0.4, below * 0.9) if reached[-1] else 0.0


def learn_from_all(docs: DataFrame, dim: int = 16) -> Model | None:
    """The model, learned from all rows of docs(text, lang) with a language and with subwords; None if
    there are none.

    Each half of the texts has a model; the temperature and the rejection threshold are those of all rows
    under the model of the other half, and the result is the mean of the two. Each step (Adam) is a pass over
    the stored table of all rows on the executors; the driver holds embeddings and weights. Neither the
    order of rows nor how they are dealt to tasks matters. A bucket that no row has weighs nothing.
    """
    rows = stored(tallied(docs.select("text", F.col("lang").cast("string").alias("lang"))))
    found = rows.groupBy("lang", "half").agg(F.count("*").alias("n")).collect()
    if not found:
        forget(rows)
        return None
    names = sorted({r["lang"] for r in found})
    count = np.array([sum(r["n"] for r in found if r["lang"] == x) for x in names], float)
    count = np.maximum(count, count.sum() / LEAST)
    dim = min(dim, len(names))
    w = np.eye(dim) if dim == len(names) else np.random.default_rng(11).standard_normal((dim, len(names))) / dim**0.5
    halves = Halves(names, count.min() / count, np.zeros((2, BUCKETS, dim)), np.stack([w, w]))
    means, squares = [0.0, 0.0], [0.0, 0.0]
    for step in range(STEPS):
        new = []
        for i, (x, slope, rate) in enumerate(zip((halves.embeddings, halves.weights), halves.slopes(rows), (RATE, RATE / 100), strict=True)):
            means[i] = 0.9 * means[i] + 0.1 * slope
            squares[i] = 0.99 * squares[i] + 0.01 * slope**2
            root = np.sqrt(squares[i] / (1 - 0.99 ** (step + 1)))
            new.append(x - rate * (1 - step / STEPS) * means[i] / (1 - 0.9 ** (step + 1)) / np.maximum(root, 1e-12))
        halves = Halves(names, halves.weigh, *new)
    temperature, below = halves.calibrated(rows)
    forget(rows)
    seen = sorted({r["half"] for r in found})
    table = np.mean([halves.embeddings[h] @ halves.weights[h] for h in seen], axis=0)
    return Model(names, table, np.zeros(len(names)), temperature, below)


def lettered(data: np.ndarray) -> bool:
    folded = data | np.uint8(32)
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs(doc_id, text).

    Whole texts are scored. A null text and one without a letter is `und` with score 0 and rejected,
    as is all where there is no model. rejected: the calibrated score is under the model's threshold.
    A null doc_id counts as held out. Repeated rows and ids are each answered; other columns are not
    carried; an empty table gives an empty result.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            langs, scores = [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                lang, score = model(text) if model is not None and lettered(text) else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            below = model.reject_below if model is not None else 1.0
            rejected = [lang == "und" or score < below for lang, score in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(text: Column, model: Model) -> Column:
    """Whether a text's language is told with a calibrated score that isn't under the model's threshold;
    false for a null text and one without a letter. A column of the same row: nothing is joined."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffer(texts)
        whole = (data[offsets[i] : offsets[i + 1]] for i in range(len(texts)))
        out = pa.array([lettered(t) and model(t)[1] >= model.reject_below for t in whole], pa.bool_())
        release()
        return out

    return judge(text)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))


SQL: dict[str, str] = {}
QUERIES = {"op10_language_id": op10_language_id}
