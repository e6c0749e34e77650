"""Mixing sources to target weights: raking token weights to margins, then sampling documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import MASK, forget, mix, released, slices, stored, text_buffer, word_hashes
from corpusflow.llm.near_dedup import _LOWER, SLICE, words_of

MARGINS = ("source", "lang", "topic")
#: What own shares are raised to where a margin has no targets: rare sources gain, languages and topics hold.
POWERS = {"source": 0.7, "lang": 1.0, "topic": 1.0}
TOPICS, BUCKETS = 8, 4096
#: A language that holds at least one of so many documents has a mean of its own; rarer ones, and
#: documents without a language, share one.
OWN_MEAN = 1024
#: Sums over all documents are of whole numbers, of so many to 1, so they are the same in any order.
FIXED = float(1 << 28)
#: Pairs of a text and a bucket that are worked on at a time.
PAIRS = 1 << 17
#: Cells (source x language x topic) that the driver rakes itself; more are raked as joins, in the same steps.
CELLS = 200_000
#: Of a level without a given goal so much may be taken, so that the other margins have room.
ROOM = 0.95
#: A cell's weight is never raised beyond so many times what takes all its documents.
HIGHEST = 1e6


def bucketed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each word of some texts."""
    low = _LOWER[data]
    starts, ends = words_of(low, offsets)
    return np.searchsorted(offsets, starts, "right") - 1, (word_hashes(low, starts, ends) >> np.uint64(52)).astype(np.int64)


def counted(row: np.ndarray, bucket: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row * BUCKETS + bucket, rising, and how many there are of each; row doesn't fall."""
    found, n = [], []
    for lo in range(0, rows, 256):
        a, b = np.searchsorted(row, (lo, lo + 256))
        count = np.bincount((row[a:b] - lo) * BUCKETS + bucket[a:b])
        at = np.flatnonzero(count)
        found.append(at + lo * BUCKETS)
        n.append(count[at])
    return np.concatenate(found), np.concatenate(n)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values as binary, cut at the n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def profiled(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokens, at, n). tokens: words of the whole text; at and n: the buckets they
    lie in, as uint16, and how many in each, as uint32. docs has source and lang without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                row, bucket = bucketed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found, n = counted(row, bucket, hi - lo)
                ends = np.searchsorted(found, np.arange(hi - lo + 1) * BUCKETS)
                lists = [packed((found % BUCKETS).astype(np.uint16), ends), packed(n.astype(np.uint32), ends)]
                rest = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "source", "lang")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.bincount(row, minlength=hi - lo), pa.int64()), *lists], ["doc_id", "source", "lang", "tokens", "at", "n"])

    return docs.mapInArrow(released(run), "doc_id long, source string, lang string, tokens long, at binary, n binary")


def shares(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi of profiled() at a time: the row from lo on, the bucket and the share of its text's
    words of each pair."""
    at, ends = text_buffer(batch.column("at"))
    at, ends, n = at.view(np.uint16), ends // 2, text_buffer(batch.column("n"))[0].view(np.uint32)
    tokens = batch.column("tokens").to_numpy()
    for lo, hi in slices(ends, PAIRS):
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        yield lo, hi, row, at[ends[lo] : ends[hi]].astype(np.int64), n[ends[lo] : ends[hi]] / tokens[lo:hi][row]


def products(table: np.ndarray, row: np.ndarray, bucket: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """(n, columns of table): the sums over each row's pairs of x times the table's row of the bucket."""
    return np.stack([np.bincount(row, column[bucket] * x, n) for column in np.ascontiguousarray(table.T)], axis=1)


@dataclass
class Topics:
    """table: a row of TOPICS weights for each bucket of words; usual: what the texts of a language get
    on average, so that a topic isn't just a language ('': of those that aren't there). A text's topic
    has the largest mean weight beyond the usual."""

    table: np.ndarray
    usual: dict[str, np.ndarray]

    def __call__(self, batch: pa.RecordBatch) -> list[str]:
        langs, tokens, out = batch.column("lang").to_pylist(), batch.column("tokens").to_pylist(), []
        for lo, hi, row, bucket, share in shares(batch):
            usual = np.stack([self.usual.get(x, self.usual[""]) for x in langs[lo:hi]])
            best = (products(self.table, row, bucket, share, hi - lo) - usual).argmax(axis=1)
            out += [f"t{b}" if m else "none" for b, m in zip(best.tolist(), tokens[lo:hi], strict=True)]
        return out


def totals(profiles: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], n: int) -> np.ndarray:
    """The sum over all tasks of n whole numbers that each makes of its batches; BUCKETS of them at a
    time are summed on the executors."""
    schema = "block int, sums binary"

    def made(of: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array([x.tobytes() for x in of.values()], pa.binary())], ["block", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sums(batches)
        yield made({i: x for i, x in enumerate(np.split(found, range(BUCKETS, n, BUCKETS))) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64)
                of[i] = of[i] + x if i in of else x
        yield made(of)

    out = np.zeros(n, np.int64)
    got = profiles.mapInArrow(released(run), schema).repartition("block").mapInArrow(released(add), schema).toArrow()
    for i, x in zip(got["block"].to_pylist(), got["sums"].to_pylist(), strict=True):
        out[i * BUCKETS : i * BUCKETS + len(x) // 8] = np.frombuffer(x, np.int64)
    return out


@dataclass
class Usual:
    """weight: of each bucket, by inverse document frequency; means: of the weighted shares of `langs`,
    and last the one that all others share."""

    weight: np.ndarray
    langs: list[str]
    means: np.ndarray

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        code = {x: i for i, x in enumerate(self.langs)}
        return np.array([code.get(x, len(code)) for x in batch.column("lang").to_pylist()], np.int64)


def usual_words(profiles: DataFrame) -> Usual:
    """Of all documents with words."""
    count = profiles.groupBy("lang").agg(F.count("*").alias("n"))
    whole = count.agg(F.sum("n")).first()[0] or 0
    own = {r["lang"]: r["n"] for r in count.where((F.col("n") * OWN_MEAN >= whole) & (F.col("lang") != "")).collect()}
    usual = Usual(np.zeros(BUCKETS), sorted(own), np.zeros((len(own) + 1, BUCKETS)))

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((len(own) + 2) * BUCKETS, np.int64)
        for batch in batches:
            lang = usual.codes(batch)
            for lo, hi, row, bucket, share in shares(batch):
                out[:-BUCKETS] += np.bincount(lang[lo:hi][row] * BUCKETS + bucket, np.rint(share * FIXED), len(out) - BUCKETS).astype(np.int64)
                out[-BUCKETS:] += np.bincount(bucket, minlength=BUCKETS)
        return out

    got = totals(profiles, sums, (len(own) + 2) * BUCKETS).reshape(-1, BUCKETS)
    weight = np.log((1 + whole) / (1 + got[-1]))
    n = np.array([*(own[x] for x in usual.langs), whole - sum(own.values())])
    return Usual(weight, usual.langs, got[:-1] / FIXED / np.maximum(n, 1)[:, None] * weight)


def directed(profiles: DataFrame, usual: Usual) -> DataFrame:
    """(h, mean, times, scale, at, n): each document's weighted shares of words, less its language's
    mean, at length 1. at, n: its buckets and how many words are in each, as bytes (a bucket of more words
    comes again); scale times n times the bucket's weight is a share over the length, and of the unit
    vector of the mean so many `times` go off. A document that is its language's mean but for rounding
    has no direction and no row."""
    squares = (usual.means**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, langs, tokens = batch.column("h").to_numpy(), usual.codes(batch), batch.column("tokens").to_numpy()
            for lo, hi, row, bucket, share in shares(batch):
                lang, x = langs[lo:hi], share * usual.weight[bucket]
                mean = usual.means[lang[row], bucket]
                left = np.bincount(row, (x - mean) ** 2 - mean**2, hi - lo) + squares[lang]
                some = left > 1e-8 * (np.bincount(row, x**2, hi - lo) + squares[lang])
                length = np.sqrt(left[some])
                n = np.rint(share * tokens[lo:hi][row]).astype(np.int64)
                again = np.where(some[row], -(-n // BYTE), 0)
                ends = np.r_[0, np.cumsum(np.bincount(row, again, hi - lo)[some].astype(np.int64))]
                part = np.full(int(again.sum()), BYTE, np.uint8)
                part[np.cumsum(again)[again > 0] - 1] = (n - (again - 1) * BYTE)[again > 0]
                yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi][some]), pa.array(lang[some].astype(np.int32)), pa.array(np.sqrt(squares[lang[some]]) / length), pa.array(1 / (tokens[lo:hi][some] * length)), packed(np.repeat(bucket, again).astype(np.uint16), ends), packed(part, ends)], DIRECTED_NAMES)

    return profiles.mapInArrow(released(run), DIRECTED)


#: The largest count that directed() holds in one byte.
BYTE = 255
DIRECTED = "h long, mean int, times double, scale double, at binary, n binary"
DIRECTED_NAMES = [c.split()[0] for c in DIRECTED.split(", ")]


def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi of directed() at a time: their means, times and scales, where their pairs begin and
    the last ends, and the bucket and n of each pair."""
    n, ends = text_buffer(batch.column("n"))
    at = text_buffer(batch.column("at"))[0].view(np.uint16)
    mean, times, scale = (batch.column(c).to_numpy() for c in ("mean", "times", "scale"))
    for lo, hi in slices(ends, PAIRS):
        a, b = ends[lo], ends[hi]
        yield lo, hi, mean[lo:hi].astype(np.int64), times[lo:hi], scale[lo:hi], ends[lo : hi + 1] - a, at[a:b].astype(np.int64), n[a:b].astype(np.float32)


@dataclass
class Centres:
    """Of spherical k-means over directed(). weight: of the buckets; units: the unit vectors of the
    languages' means."""

    at: np.ndarray
    weight: np.ndarray
    units: np.ndarray

    def near(self, mean: np.ndarray, times: np.ndarray, scale: np.ndarray, ends: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(rows, centres) inner products; every row has pairs."""
        words = np.stack([np.add.reduceat(c[bucket] * n, ends[:-1]) for c in (self.at * self.weight).astype(np.float32)], axis=1)
        return words * scale[:, None] - times[:, None] * (self.units @ self.at.T)[mean]

    def far(self, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The document that is drawn among a task's, more often the further it is from all centres: the
        least of exponential variables, which are made of the hashes `h`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                h = batch.column("h").to_numpy()
                for lo, hi, *rest in pairs_of(batch):
                    far = np.maximum(0, 1 - self.near(*rest).max(axis=1)) + 1e-9 if len(self.at) else np.ones(hi - lo)
                    draws = ((mix(h[lo:hi].view(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & MASK)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                    wait = -np.log(draws) / far
                    i = int(np.lexsort((h[lo:hi], wait))[0])
                    if best is None or (wait[i], h[lo + i]) < best[:2]:
                        best = wait[i], h[lo + i], batch.slice(lo + i, 1)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), *best[2].columns], ["wait", *best[2].schema.names])

        return run

    def drawn(self, docs: DataFrame, turn: int) -> np.ndarray:
        """The direction of the document that is drawn among all of directed(), which has some."""
        row = docs.mapInArrow(released(self.far(turn)), f"wait double, {DIRECTED}").orderBy("wait", "h").first()
        at, n = np.frombuffer(row["at"], np.uint16), np.frombuffer(row["n"], np.uint8)
        return np.bincount(at, n * self.weight[at] * row["scale"], BUCKETS) - row["times"] * self.units[row["mean"]]

    def moved(self, docs: DataFrame) -> np.ndarray:
        """(centres, BUCKETS) sums of the directions that are nearest to each centre."""
        n, m = len(self.at), len(self.units)

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            words, means = np.zeros(n * BUCKETS, np.int64), np.zeros(n * m, np.int64)
            for batch in batches:
                for _, _, mean, times, scale, ends, bucket, count in pairs_of(batch):
                    own, long = self.near(mean, times, scale, ends, bucket, count).argmax(axis=1), np.diff(ends)
                    share = self.weight[bucket] * count * np.repeat(scale * FIXED, long)
                    words += np.bincount(np.repeat(own * BUCKETS, long) + bucket, np.rint(share), len(words)).astype(np.int64)
                    means += np.bincount(own * m + mean, np.rint(times * FIXED), len(means)).astype(np.int64)
            return np.r_[words, means]

        got = totals(docs, sums, n * (BUCKETS + m)) / FIXED
        return got[: n * BUCKETS].reshape(n, BUCKETS) - got[n * BUCKETS :].reshape(n, m) @ self.units


def learn_topics(profiles: DataFrame, steps: int = 20) -> Topics:
    """Clusters of vocabulary: spherical k-means over the directions of all documents with words, at most
    so many steps. Each draw of a first centre and each step is one pass over a stored table of them on
    the executors; the driver holds centres, weights and means of languages. Neither the order of rows
    nor how they are dealt to tasks matters. profiles: stored rows of profiled()."""
    profiles = profiles.where("tokens > 0").select("lang", "tokens", "at", "n", F.xxhash64("lang", "at", "n").alias("h"))
    usual = usual_words(profiles)
    docs = stored(directed(profiles, usual))
    units = usual.means / np.maximum(np.linalg.norm(usual.means, axis=1, keepdims=True), 1e-12)
    centres = Centres(np.zeros((0, BUCKETS)), usual.weight, units)
    if docs.isEmpty():  # no document but is its language's mean
        centres, steps = Centres(np.zeros((TOPICS, BUCKETS)), usual.weight, units), 0
    while len(centres.at) < TOPICS:  # far from those before
        centres = Centres(np.vstack([centres.at, centres.drawn(docs, len(centres.at))]), usual.weight, units)
    for _ in range(steps):
        sums, before = centres.moved(docs), centres.at
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = Centres(np.where(size > 1e-6, sums / np.maximum(size, 1e-12), before), usual.weight, units)
        if (before == centres.at).all():
            break
    forget(docs)
    found = usual.means @ centres.at.T
    return Topics(usual.weight[:, None] * centres.at.T, {"": found[-1], **dict(zip(usual.langs, found, strict=False))})


def labelled(profiles: DataFrame, topics: Topics) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of rows of profiled(). topic: `none` for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "source", "lang")], pa.array(topics(batch), pa.string()), batch.column("tokens")], ["doc_id", "source", "lang", "topic", "tokens"])

    return profiles.mapInArrow(released(run), "doc_id long, source string, lang string, topic string, tokens long")


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def goals_of(tokens: dict[str, dict[str, float]], targets: dict[str, dict[str, float]], powers: dict[str, float], rate: float) -> dict[str, dict[str, float]]:
    """The share of each level of each margin; levels without tokens drop out. A goal that isn't given
    takes at most ROOM of its level's tokens at that rate, and what is over goes to the other levels."""
    out = {}
    for m in MARGINS:
        total = sum(tokens[m].values())
        if targets.get(m) is None:
            share = {k: v / total for k, v in tokens[m].items()}
            goal = filled(tempered(share, powers.get(m, 1.0)), {k: max(v, ROOM * v / rate) for k, v in share.items()})
        else:
            goal = {k: v for k, v in targets[m].items() if tokens[m].get(k, 0) > 0}
        whole = sum(goal.values())
        out[m] = {k: goal.get(k, 0.0) / whole if whole else 0.0 for k in tokens[m]}
    return out


def filled(goal: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """goal, scaled up where it isn't above `most` and cut down to that where it is, with the same sum."""
    full: set[str] = set()
    while True:
        free = sum(v for k, v in goal.items() if k not in full)
        scale = (1 - sum(most[k] for k in full)) / free if free > 0 else 0.0
        over = {k for k, v in goal.items() if k not in full and v * scale > most[k]}
        if not over:
            return {k: most[k] if k in full else v * scale for k, v in goal.items()}
        full |= over


def within_reach(tokens: dict[str, dict[str, float]], goals: dict[str, dict[str, float]], rate: float) -> float:
    """The rate at which no level is asked for more than all its tokens."""
    total = sum(tokens["source"].values())
    return min([rate, *(tokens[m][k] / (goal * total) for m in MARGINS for k, goal in goals[m].items() if goal > 0)])


class Here:
    """Cells on the driver: probabilities min(1, q)."""

    def __init__(self, cells: DataFrame) -> None:
        self.rows = cells.orderBy(*MARGINS).collect()
        self.tokens = np.array([c["tokens"] for c in self.rows], float)
        self.codes = {m: np.unique([c[m] for c in self.rows], return_inverse=True) for m in MARGINS}

    def levels(self) -> dict[str, dict[str, float]]:
        return {m: dict(zip(names.tolist(), np.bincount(code, self.tokens).tolist(), strict=True)) for m, (names, code) in self.codes.items()}

    def begin(self, rate: float) -> None:
        self.q = np.full(len(self.tokens), rate)

    def step(self, m: str, wanted: dict[str, float]) -> float:
        names, code = self.codes[m]
        now = np.bincount(code, self.tokens * np.minimum(1, self.q), len(names))
        goal = np.array([wanted[n] for n in names.tolist()])
        self.q = np.minimum(HIGHEST, self.q * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code])
        return float(np.abs(now - goal).max()) / self.tokens.sum()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r["source"], r["lang"], r["topic"], float(p)) for r, p in zip(self.rows, np.minimum(1, self.q), strict=True)]
        return F.broadcast(spark.createDataFrame(rows, "source string, lang string, topic string, probability double"))


class Joined:
    """The same steps over a cell table of any size, one stored table a step; the levels of a margin
    stay on the driver, the cells never come there."""

    def __init__(self, cells: DataFrame) -> None:
        self.cells = cells

    def levels(self) -> dict[str, dict[str, float]]:
        return {m: {r[0]: float(r[1]) for r in self.cells.groupBy(m).agg(F.sum("tokens")).collect()} for m in MARGINS}

    def begin(self, rate: float) -> None:
        self.held, self.total = self.cells.withColumn("q", F.lit(rate)), None

    def step(self, m: str, wanted: dict[str, float]) -> float:
        now = {r[0]: float(r[1]) for r in self.held.groupBy(m).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("q")))).collect()}
        self.total = self.total or float(self.cells.agg(F.sum("tokens")).first()[0])
        factors = self.cells.sparkSession.createDataFrame([(k, wanted[k] / v if v > 0 else 0.0) for k, v in now.items()], f"{m} string, factor double")
        self.held = stored(self.held.join(factors, m).select(*MARGINS, "tokens", F.least(F.lit(HIGHEST), F.col("q") * F.col("factor")).alias("q")))
        return max(abs(now[k] - wanted[k]) for k in now) / self.total

    def table(self, spark: SparkSession) -> DataFrame:
        return self.held.select(*MARGINS, F.least(F.lit(1.0), F.col("q")).alias("probability"))


def calibrated(cells: Here | Joined, targets: dict[str, dict[str, float]], rate: float, powers: dict[str, float], rounds: int, tolerance: float) -> tuple[float, float]:
    """Rakes under the bound that no probability is above 1: each step scales the levels of one margin to
    their goals, over what the bound lets through, so margins hold at the end and not only before it.
    Where they can't hold at `rate`, the rate gives way, a twentieth at a time. The rate reached, and the largest
    gap left, as a share of all tokens."""
    levels = cells.levels()
    goals, total = goals_of(levels, targets, powers, rate), sum(levels["source"].values())
    rate, off = within_reach(levels, goals, rate), 1.0
    for _ in range(40):
        cells.begin(rate)
        for _ in range(rounds):
            off = max(cells.step(m, {k: v * rate * total for k, v in goals[m].items()}) for m in MARGINS)
            if off < tolerance:
                return rate, off
        if off < 1e-4:
            break
        rate *= 0.95
    return rate, off


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = 0.7, powers: dict[str, float] | None = None, rounds: int = 200, tolerance: float = 1e-6, cells_here: int = CELLS, topics: Topics | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled) for every row of
    docs(doc_id, text, lang, source).

    Token weights of the cells source x language x topic are raked until their margins meet the
    targets ({margin: {level: share}}; a margin without targets gets its own shares to
    its power (POWERS unless given) as far as they have the tokens, so that a hot source gives way; a level without a target gets nothing). A cell's
    probability is its raked share of its tokens, at most 1; a hash of doc_id decides. A share `rate` of
    all tokens is expected, less if the margins can't hold at that rate. A document without tokens has
    probability 0, as has a cell without weight. Topics are clusters of vocabulary, learned here from
    all documents unless given. Null source or lang is the level ''. Null doc_ids hash alike; repeated rows decide alike;
    other columns are not carried; an empty table gives an empty result. Only cell totals reach the
    driver, and only if there are at most cells_here of them; else they stay tables.
    """
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), level("source"), level("lang"), F.col("text").cast("string").alias("text"))
    profiles = profiled(docs) if topics is not None else stored(profiled(docs))
    rows = stored(labelled(profiles, learn_topics(profiles) if topics is None else topics))
    if topics is None:
        forget(profiles)
    cells = stored(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    n = cells.count()
    if n == 0:
        return rows.select("*", F.lit(0.0).alias("probability"), F.lit(False).alias("sampled"))
    held = Here(cells) if n <= cells_here else Joined(cells)
    calibrated(held, targets or {}, rate, POWERS if powers is None else powers, rounds, tolerance)
    p = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    out = rows.join(held.table(docs.sparkSession), list(MARGINS), "left")
    return out.select("doc_id", *MARGINS, "tokens", p.alias("probability"), (draw(F.col("doc_id")) < p).alias("sampled"))


def draw(key: Column) -> Column:
    """In [0, 1), from the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("mix")), 11) / F.lit(float(1 << 53))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op3_mix_sources": op3_mix_sources}
