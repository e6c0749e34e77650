"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.blocks import best, ties, usable

#: Score cells filled at a time: 16 queries by as many candidates stay in a core's cache.
AT_ONCE, CELLS = 16, 8192


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers, of Python where they don't fit 64 bits."""
    x = np.floor(scale * x)
    if np.abs(x).max(initial=0) < 2**62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object)


def fitting(weights: np.ndarray, asked: np.ndarray) -> type:
    """Integers that hold every sum of products."""
    limit = int(np.abs(weights).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(1, weights.shape[1])
    return np.int32 if limit < 2**31 else np.int64 if limit < 2**63 else object


def taat(q_ids, queries, ids, candidates, k, scale):
    """Postings of each dimension over the block; a query's weights are scattered into a dense row of
    scores one dimension at a time, then the k + 1 largest are selected (its own row may be one)."""
    wanted = whole(queries, scale)
    for begin in range(0, len(ids), CELLS):
        weights = whole(candidates[begin : begin + CELLS], scale)
        kind = fitting(weights, wanted)
        weights, asked, n = weights.astype(kind), wanted.astype(kind), len(weights)
        postings = []
        for term in range(weights.shape[1]):
            where = np.flatnonzero(weights[:, term])
            dense = 2 * len(where) > n
            postings.append((None if dense else where, weights[:, term].copy() if dense else weights[where, term]))
        for lo in range(0, len(q_ids), AT_ONCE):
            some = asked[lo : lo + AT_ONCE]
            scores, buffer = np.zeros((len(some), n), kind), np.empty(n, kind)
            for term, (where, posted) in enumerate(postings):
                for i in np.flatnonzero(some[:, term]):
                    if where is None:
                        np.multiply(posted, some[i, term], out=buffer)
                        scores[i] += buffer
                    else:
                        scores[i][where] += posted * some[i, term]
            for i in range(len(some)):
                places = ties(scores[i], k + 1)
                found = scores[i][places]
                if kind is object and max(map(abs, found)) >= 2**63:
                    raise OverflowError("a score doesn't fit 64 bits")
                yield lo + i, begin + places, found.astype(np.int64)


def exact_topk(df: DataFrame, is_query=None, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products of
    floor(scale * x), ties to the smaller vec_id; all other rows if fewer. Rows are (vec_id, embedding).

    Null vectors and those with null or non-finite components take no part, nor do rows without
    vec_id; empty vectors neither. Of a repeated vec_id the largest vector counts. Vectors of another
    length than the query's are no candidates of it. Sums are exact whatever the components; a score
    among a block's best that doesn't fit 64 bits is an error. An empty table gives an empty result.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    return best(usable(df, nonzero=False), is_query, k, "score long", lambda *block: taat(*block, k, scale))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
}
QUERIES = {"op1_exact_topk": op1_exact_topk}
