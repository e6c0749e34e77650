"""Query vectors against all vectors, which stay where they lie."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import keyed, vectors

#: Bytes of query vectors that are sent to all tasks at once; more are searched in turns.
QUERY_BYTES = 32 << 20
#: Vectors of one block, and how many found rows a task holds for each query before it drops the rest.
BLOCK, HELD = 65_536, 4

#: search(query ids, queries, ids, candidates) yields the place of a query, and places and scores of its best candidates.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def usable(df: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, embedding array<double>): vectors that are null, empty or hold null or non-finite components go."""
    df = keyed(df, "vec_id", "embedding", "array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad
    if nonzero:
        keep = keep & F.exists("embedding", lambda x: x != 0)
    return df.where(keep)


def by_length(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids, in order, and vectors of each length."""
    sizes = pc.list_value_length(table.column("embedding")).to_numpy()
    for d in np.unique(sizes).tolist():
        some = table.filter(pa.array(sizes == d))
        ids = some.column("vec_id").to_numpy()
        order = np.argsort(ids)
        yield ids[order], vectors(some.column("embedding"))[order]


def best_of(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best rows, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], ids[rank < k], scores[rank < k]


def best(df: DataFrame, is_query: Column, k: int, score: str, search: Search) -> DataFrame:
    """Each query's k best of all other rows. Queries are sent to the candidates, up to QUERY_BYTES at a
    time: a turn is one pass over the table, in blocks of BLOCK rows, and only k rows a query and task
    leave it. search() gives more than k rows where the query's own may be among them. Vectors of another
    length than the query's score nothing with it."""
    spark = df.sparkSession
    asked = df.where(is_query)
    size = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    turns = max(1, math.ceil(8 * size / QUERY_BYTES))
    name, kind = score.split()
    schema = f"query_id long, vec_id long, {score}"
    spread = df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(spark.sparkContext.defaultParallelism)
    out = None
    for turn in range(turns):
        some = asked.where(F.pmod(F.xxhash64("vec_id", F.lit("turn")), F.lit(turns)) == turn) if turns > 1 else asked
        queries = {x.shape[1]: (ids, x) for ids, x in by_length(some.select("vec_id", "embedding").toArrow())}
        found = spread.mapInArrow(_task(queries, k, name, kind, search), schema)
        out = found if out is None else out.unionByName(found)
    ranked = Window.partitionBy("query_id").orderBy(F.desc(name), "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", name)


def _task(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, name: str, kind: str, search: Search):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(lo, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 0
        for block in blocks(batches):
            for ids, matrix in by_length(block):
                q_ids, ask = queries.get(matrix.shape[1], (None, None))
                if q_ids is None:
                    continue
                for i, places, scores in search(q_ids, ask, ids, matrix):
                    other = ids[places] != q_ids[i]
                    held.append((np.full(int(other.sum()), q_ids[i]), ids[places[other]], scores[other]))
                    n += len(held[-1][0])
                most = max(most, len(q_ids) * k * HELD)
                if n > most:
                    held = [best_of(*(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                    n = len(held[0][0])
        if held:
            q, c, s = best_of(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64() if kind == "long" else pa.float64())], ["query_id", "vec_id", name])

    return run


def ties(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > edge)
    return np.concatenate([over, np.flatnonzero(scores == edge)[: k - len(over)]])
