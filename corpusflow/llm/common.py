"""What the operators of this package share: scratch tables, keys, and Arrow text as numpy bytes.

Conventions that hold for every operator here: each selects the columns it needs first, so extra
columns (also ones that clash with its own names) never reach it; rows whose key is null have no
identity and take no part, unless identified() gave them one; of documents only equal rows of
(doc_id, text) are one record, other texts of a doc_id get a row key; of vectors the largest counts.
The result has one row for each key.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none, a temporary folder on
    local[*], and an error on a cluster: its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpusflow-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor loses nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by stored()."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Row keys lie from here on, above the doc_ids of the tables.
ROW_KEYS = 1 << 62


def identified(docs: DataFrame) -> DataFrame:
    """docs with a distinct, non-null doc_id (a long) for each distinct (doc_id, text); equal rows of the
    two become one.

    Of the texts of a doc_id one keeps it, a real text before null, by least hash; each other one, and
    each text without doc_id, gets ROW_KEYS + 62 bits of a hash of (doc_id, text), so it is the same
    in every run. Rows meet by key and text, never by key alone, so a key that holds many rows lies
    in no one task; only where keys repeat or are null is anything shuffled and stored.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, n, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows == n == distinct:
        return docs
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    pick = F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in others])) if others else F.first(whole)
    one = docs.groupBy(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).agg(pick.alias("__row"))
    one = stored(one.select("__id", F.col("__text").isNull().alias("__null"), F.xxhash64("__text", F.lit("row")).alias("__h"), "__row"))
    keeps = one.where("__id IS NOT NULL").groupBy("__id").agg(F.min(F.struct("__null", "__h")).alias("m"))
    keeps = keeps.select("__id", F.col("m.__null").alias("__null"), F.col("m.__h").alias("__h"), F.lit(True).alias("__keeps"))
    own = F.lit(ROW_KEYS) + F.pmod(F.xxhash64("__row.doc_id", F.col("__row.doc_id").isNull(), "__row.text", "__null"), F.lit(ROW_KEYS))
    key = F.when(F.col("__keeps"), F.col("__id")).otherwise(own)
    out = one.join(keeps, ["__id", "__null", "__h"], "left")
    return stored(out.select(*[key.alias(c) if c == "doc_id" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))


def keyed(df: DataFrame, key: str, value: str, cast: str) -> DataFrame:
    """(key, value) with non-null, distinct keys, of repeated ones the largest value. Keys alone are
    shuffled to see whether they repeat; values only where they do."""
    df = df.select(F.col(key).cast("long").alias(key), F.col(value).cast(cast).alias(value)).where(F.col(key).isNotNull())
    n, distinct = df.agg(F.count(key), F.count_distinct(key)).first()
    return df if n == distinct else df.groupBy(key).agg(F.max(value).alias(value))


def keyed_texts(docs: DataFrame, unique: bool = False) -> DataFrame:
    """(doc_id, text) of the rows with a doc_id, identified. unique: doc_ids are known to be distinct
    and not null, as those of identified() are, so they needn't be counted again."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs if unique else identified(docs.where("doc_id IS NOT NULL"))


#: Rows of ids that may be broadcast (16 MB).
SMALL = 2_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among gone(doc_id). The ids are stored and counted; up to SMALL of them
    are broadcast, more are met by a shuffle."""
    ids = stored(gone.select("doc_id").distinct())
    side = F.broadcast(ids) if ids.count() <= SMALL else ids
    return docs.join(side, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def release() -> None:
    """Give the memory back that the allocators of Arrow and of C hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and release() after its last batch: Python workers live on, and what each stage needed at most
    would add up over the stages of a job."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), in place where x is owned."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_HEADS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Bytes of a word that are hashed in steps of eight; a longer word takes a digest.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time, each mixed in before the next, so no pattern
    of bytes cancels out as it may in a polynomial."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    n = ends - starts
    out = mix(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    some = np.arange(len(starts))
    for at in range(0, LONG_WORD, 8):
        v = eights[starts[some] + at] & _HEADS[np.minimum(n[some] - at, 8)]
        out[some] = mix(out[some] ^ v)
        some = some[n[some] > at + 8]
        if not len(some):
            return out
    for i in some.tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) halves of 128-bit BLAKE2b digests of byte ranges."""
    held = memoryview(np.ascontiguousarray(data))
    found = b"".join([blake2b(held[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


class Rolling:
    """64-bit polynomial hashes of the windows of one buffer, over random byte codes. They choose
    places to cut at; nothing is held to be equal because they are."""

    BASE = 0x9E3779B97F4A7C15 | 5
    CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(Rolling._up) < n:
            for name, base in (("_up", self.BASE), ("_down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(n, base & MASK, np.uint64)
                powers[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(powers))
        self.sums = np.empty(n, np.uint64)
        self.sums[0] = 0
        codes = self.CODES[data]
        codes *= Rolling._up[: n - 1]
        np.cumsum(codes, out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of the k bytes from each position; empty where the buffer is shorter."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * Rolling._down[:n] + np.uint64(k))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys; the input is sorted by the key within its partition."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        k = held.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
