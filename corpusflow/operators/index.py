"""The chunk index: flat rows with vectors, upsert, delete by document, search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import once

#: Bytes of query vectors that are sent to the tasks at once; more are searched in turns.
QUERY_BYTES = 32 << 20


class Embedder(Protocol):
    """Texts to vectors; `kind` is `document` or `query`."""

    dim: int

    def __call__(self, texts: list[str], kind: str) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashed words, scaled to norm 1: needs no model and gives the same vectors everywhere."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str], kind: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def embedded(text: Column, embedder: Embedder, kind: str = "document", batch: int = 96, or_null: bool = False) -> Column:
    """Vectors as a column of the same row, so a count can't differ; the model sees `batch` texts at a time.
    or_null: where it fails on a batch its texts are tried alone, and those it fails on get null."""

    def tried(texts: list[str]) -> list:
        try:
            return list(np.asarray(embedder(texts, kind), np.float32))
        except Exception:
            return [None] if len(texts) == 1 else [x for t in texts for x in tried([t])]

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        values, out = [t or "" for t in texts.to_pylist()], []
        for lo in range(0, len(values), batch):
            some = values[lo : lo + batch]
            got = tried(some) if or_null else np.asarray(embedder(some, kind), np.float32)
            if len(got) != len(values[lo : lo + batch]):
                raise ValueError("the embedder returned another number of vectors than of texts")
            out += list(got)
        return pa.array(out, pa.list_(pa.float32()))

    return once(run)(text)


def index_rows(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    rows = chunks.withColumn("vector", embedded(F.col("text"), embedder))
    return rows.select("chunk_id", "vector", *flat_metadata())


def flat_metadata() -> list[Column | str]:
    return ["doc_id", "source_url", "page_title", "section_heading", F.array_join("heading_path", " > ").alias("heading_path"), "content_type", "token_count", "chunk_index", "chunk_count", "crawled_at", "language", "source_hash", "text"]


def upsert(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """index with rows in place of those that share their key."""
    return index.join(rows.select(key), key, "left_anti").select(*index.columns).unionByName(rows)


def delete_documents(index: DataFrame, docs: DataFrame) -> DataFrame:
    """index without the chunks of docs(doc_id)."""
    return index.join(docs.select("doc_id"), "doc_id", "left_anti").select(*index.columns)


def replace_documents(index: DataFrame, rows: DataFrame) -> DataFrame:
    """All chunks of the documents in rows go, then rows come."""
    return delete_documents(index, rows.select("doc_id").distinct()).unionByName(rows.select(*index.columns))


def deleted_count(index: DataFrame, docs: DataFrame) -> DataFrame:
    return index.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("deleted_chunks"))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with `batch`, counted from 0, of `size` rows in order of key. Ranks are counted over range
    parts, so no task sorts the table."""
    spread = rows.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id())
    spread = spread.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    offsets = F.broadcast(counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o")))  # a row a partition
    out = spread.join(offsets, F.col("__part") == F.col("__p"))
    return out.withColumn("batch", F.floor((F.col("__at") + F.col("__o") - 1) / size)).select(*rows.columns, "batch")


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _nearest(table: pa.Table, key: str, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, keys and cosines: each query's k best rows of a batch. One product in single
    precision tells which rows can be among them; only those are summed in double precision."""
    rows = table.column("__v").combine_chunks()
    matrix = (pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows).flatten().to_numpy().reshape(len(table), -1).astype(np.float64)
    keys = table.column(key).to_numpy()
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    real = norm > 0
    matrix, keys, norm = matrix[real], keys[real], norm[real]
    if not len(keys):
        return np.empty(0, np.int64), keys, norm
    rough = (asked.astype(np.float32) @ (matrix / norm[:, None]).astype(np.float32).T)
    q, c, s = [], [], []
    for i, row in enumerate(rough):
        at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-5)
        score = np.einsum("ij,j->i", matrix[at], asked[i]) / norm[at]
        first = np.lexsort((keys[at], -score))[:k]
        q.append(np.full(len(first), i))
        c.append(keys[at[first]])
        s.append(score[first])
    return np.concatenate(q), np.concatenate(c), np.concatenate(s)


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(query_id, key, vector_score, vector_rank): each query's k nearest rows by cosine, ties by key.

    The stated query set meets every index row where that row lies, an Arrow batch at a time; only k rows
    a query and batch leave it. Query vectors are sent along, up to QUERY_BYTES of them; more are searched
    in turns. Zero vectors, nulls and vectors of another length than the query's have no score.
    """
    spark = index.sparkSession
    real = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    asked = queries.where(real("vector")).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.sum(F.size("vector"))).first()[0] or 0
    turns = max(1, -(-8 * size // QUERY_BYTES))
    rows = index.where(real(vector)).select(key, F.col(vector).alias("__v"))
    kinds = [next(f.dataType.simpleString() for f in df.schema if f.name == c) for df, c in ((queries, "query_id"), (index, key))]
    schema = f"query_id {kinds[0]}, {key} {kinds[1]}, vector_score double"
    out = None
    for turn in range(turns):
        some = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        held: dict[int, tuple[list, list]] = {}
        for r in some.toArrow().to_pylist():
            ids, x = held.setdefault(len(r["vector"]), ([], []))
            ids.append(r["query_id"])
            x.append(r["vector"])
        found = rows.mapInArrow(_searcher({d: (ids, np.array(x)) for d, (ids, x) in held.items()}, key, k), schema)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), key)
    return out.withColumn("vector_rank", F.row_number().over(best)).where(F.col("vector_rank") <= k)


def _searcher(held: dict[int, tuple[list, np.ndarray]], key: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = pc.list_value_length(table.column("__v")).to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in held:
                    continue
                ids, x = held[d]
                norm = np.linalg.norm(x, axis=1)
                use = np.flatnonzero(norm > 0)
                for lo in range(0, len(use), 1024):
                    some = use[lo : lo + 1024]
                    q, c, s = _nearest(table.filter(pa.array(sizes == d)), key, np.array(ids, object)[some], x[some] / norm[some, None], k)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[some[i]] for i in q.tolist()], _arrow(ids)), pa.array(c, batch.schema.field(key).type), pa.array(s, pa.float64())], ["query_id", key, "vector_score"])

    return run


def _arrow(ids: list) -> pa.DataType:
    return pa.string() if ids and isinstance(ids[0], str) else pa.int64()


def index_size(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("vectors"))


def upsert_remote(rows: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], batch: int = 100) -> None:
    """Send rows to an index elsewhere, `batch` at a time. connect() is called once a task and gives what
    takes a batch; rows are keyed by chunk_id there, so a task that is run again does no harm."""

    def send(part: Iterator) -> None:
        put, held = connect(), []
        for row in part:
            held.append(row.asDict(recursive=True))
            if len(held) == batch:
                put(held)
                held = []
        if held:
            put(held)

    rows.foreachPartition(send)
