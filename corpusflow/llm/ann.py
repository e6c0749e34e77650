"""Approximate nearest neighbours by multi-index hashing over learned, rotated binary codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.blocks import best, ties, usable
from corpusflow.llm.common import stored, vectors

#: Vectors that codes are learned from, and queries that the radius is learned from, at most about so many.
SAMPLE, TRIALS = 4096, 128
#: Bits of a code, and of one of its substrings.
BITS, PART = 256, 16
#: Values of a substring by distance from 0: MASKS[:WITHIN[r]] are those up to r bits away.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint32)), kind="stable").astype(np.uint16)
WITHIN = np.searchsorted(np.sort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint32))), np.arange(PART + 1), "right")


class Codes:
    """Binary codes of vectors: signs after rotations. The first rotation is learned (principal axes,
    then alternating minimisation of the quantisation error), the further ones turn it at random, so
    that a code may be longer than the vector. A last coordinate that lifts all vectors to one norm
    makes the angle follow the inner product."""

    def __init__(self, sample: np.ndarray, norm: float, bits: int = BITS, steps: int = 20, seed: int = 7) -> None:
        self.norm = norm
        rng = np.random.default_rng(seed)
        x = self.lifted(sample)
        d = x.shape[1]
        turn = np.linalg.svd(x, full_matrices=True)[2].T if len(x) else np.eye(d)
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = x @ turn
        for _ in range(steps if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        learned = turn @ r
        parts, have = [learned], d
        while have < bits:
            parts.append(learned @ np.linalg.qr(rng.standard_normal((d, d)))[0])
            have += d
        self.turn = np.concatenate(parts, axis=1)[:, :bits]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = np.asarray(x, np.float64)
        square = (x * x).sum(axis=1)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - square))
        return np.concatenate([x, last[:, None]], axis=1)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One row of bits // 8 bytes a vector."""
        return np.packbits(self.lifted(x, query) @ self.turn >= 0, axis=1)


class MultiIndex:
    """One table for each substring of the codes. Codes within a Hamming radius R of a query agree with
    it in some substring up to R // substrings bits, so probing each table that far finds all of them."""

    def __init__(self, codes: np.ndarray) -> None:
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        parts = np.ascontiguousarray(codes).view(np.uint16)
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(parts.shape[1])]
        self.starts = [np.r_[0, np.cumsum(np.bincount(parts[:, j], minlength=1 << PART))] for j in range(parts.shape[1])]
        #: Codes seen by all queries so far, and those that probing or scanning looked at.
        self.could, self.did = 0, 0

    def far(self, code: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        words = self.words if at is None else self.words[at]
        return np.bitwise_count(words ^ code.view(np.uint64)).sum(axis=1, dtype=np.int32)

    def probed(self, code: np.ndarray, reach: int) -> np.ndarray | None:
        """Places of the codes some substring of which is up to `reach` bits from that of code; None where
        the tables hold more than half as many of them as there are codes, so looking at all costs less."""
        n, found = len(self.words), []
        if WITHIN[reach] * len(self.order) > n:
            return None
        for value, order, start in zip(code.view(np.uint16), self.order, self.starts, strict=True):
            near = (MASKS[: WITHIN[reach]] ^ value).astype(np.int64)
            lo, count = start[near], start[near + 1] - start[near]
            lo, count = lo[count > 0], count[count > 0]
            found.append(order[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())] if len(lo) else order[:0])
            if 2 * sum(map(len, found)) > n:
                return None
        return np.unique(np.concatenate(found))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of the codes at that distance at most, in order."""
        at = self.probed(code, min(PART, radius // len(self.order)))
        self.could += len(self.words)
        self.did += len(self.words) if at is None else len(at)
        if at is None:
            return np.flatnonzero(self.far(code) <= radius)
        return at[self.far(code, at) <= radius]


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows have equal sums."""
    return np.einsum("ij,j->i", x, y)


def reranked(candidates: np.ndarray, rough: np.ndarray, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places `at` the k nearest and their scores in double precision. `rough` holds the
    candidates in single precision: what can't be among the k by it, with room for its error, isn't
    summed twice."""
    if len(at) > 4 * k:
        score = rough[at] @ query.astype(np.float32)
        slack = 1e-5 * float(np.abs(query).sum()) * float(np.abs(rough).max(initial=0))
        at = at[score >= np.partition(score, len(at) - k)[len(at) - k] - slack]
    score = dot(candidates[at], query)
    first = ties(score, k)
    return at[first], score[first]


def probe(q_ids, queries, ids, candidates, codes: Codes, radius: int, k: int):
    index, asked = MultiIndex(codes(candidates)), codes(queries, query=True)
    rough = candidates.astype(np.float32)
    for i in range(len(q_ids)):
        at = index.within(asked[i], radius)
        if len(at):
            yield i, *reranked(candidates, rough, queries[i], at, k + 1)


def exhaustive(q_ids, queries, ids, candidates, k: int):
    for i in range(len(q_ids)):
        score = dot(candidates, queries[i])
        first = ties(score, k + 1)
        yield i, first, score[first]


def matrix(df: DataFrame) -> np.ndarray:
    table = df.select("vec_id", "embedding").toArrow().sort_by("vec_id")
    return vectors(table.column("embedding")) if len(table) else np.zeros((0, 1))


def learned(df: DataFrame, k: int, sample: int, trials: int, bits: int, keep: float) -> tuple[Codes, int, int]:
    """Codes, radius and the commonest length of vectors. Codes are learned on about `sample` vectors taken
    by a hash of vec_id; the radius holds a share `keep` of the k nearest of all rows to about `trials`
    of them, found exhaustively, so it narrows as the table grows."""
    norm = F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")
    common = df.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), norm).orderBy(F.desc("n"), "d").first()
    if common is None:
        return Codes(np.zeros((0, 1)), 1.0, bits), 0, 0
    df = df.where(F.size("embedding") == common["d"])
    chance = F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(1 << 30))
    upto = lambda n: int(min(1.0, n / common["n"]) * (1 << 30)) + 1
    codes = Codes(matrix(df.where(chance < upto(sample))), common["norm"], bits)
    found = best(df, chance < upto(trials), k, "score double", lambda *block: exhaustive(*block, k)).select("query_id", "vec_id").toPandas()
    if not len(found):
        return codes, bits, common["d"]
    ids = df.sparkSession.createDataFrame([(int(i),) for i in np.unique(found.to_numpy())], "vec_id long")
    rows = df.join(F.broadcast(ids), "vec_id").select("vec_id", "embedding").toArrow()
    at, x = rows["vec_id"].to_numpy(), vectors(rows["embedding"])
    place = np.argsort(at)
    q, c = (x[place[np.searchsorted(at[place], found[name].to_numpy())]] for name in ("query_id", "vec_id"))
    far = np.bitwise_count(codes(q, query=True).view(np.uint64) ^ codes(c).view(np.uint64)).sum(axis=1)
    return codes, int(np.quantile(far, keep)), common["d"]


def ann_topk(df: DataFrame, is_query=None, k: int = 20, sample: int = SAMPLE, trials: int = TRIALS, bits: int = BITS, keep: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product in double
    precision, ties to the smaller vec_id. Every vector is indexed; codes and radius are learned on
    bounded samples. A query with fewer than k rows within the radius is searched exhaustively, so k rows
    (or all, if fewer) always come back.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do
    rows without vec_id. Of a repeated vec_id the largest vector counts. Vectors of a rarer length
    than the commonest are searched among themselves without codes. An empty table gives an empty result.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    df = usable(df, nonzero=True)
    codes, radius, dim = learned(df, k, sample, trials, bits, keep)

    def search(q_ids, queries, ids, candidates):
        if candidates.shape[1] == dim:
            return probe(q_ids, queries, ids, candidates, codes, radius, k)
        return exhaustive(q_ids, queries, ids, candidates, k)

    found = stored(best(df, is_query, k, "score double", search))
    sizes = df.groupBy(F.size("embedding").alias("d")).agg(F.least(F.lit(k), F.count("*") - 1).alias("most"))
    asked = df.where(is_query).select("vec_id", F.size("embedding").alias("d")).join(F.broadcast(sizes), "d")
    had = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = stored(asked.join(had, "vec_id", "left").where("coalesce(n, 0) < most").select("vec_id", F.lit(True).alias("short")))
    if short.isEmpty():
        return found
    more = df.join(short, "vec_id", "left")
    rest = best(more, F.coalesce("short", F.lit(False)), k, "score double", lambda *block: exhaustive(*block, k))
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def op6_ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op6_ann_topk": op6_ann_topk}
