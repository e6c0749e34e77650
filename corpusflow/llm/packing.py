"""Best-fit packing of documents into bins of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import groups, identified, keyed_texts, released, tasks
from corpusflow.llm.token_counts import counted

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Documents packed together; more would hardly fill bins better, and a task holds one group at a time.
GROUP = 4096
#: What a bin costs besides its length.
OVERHEAD = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def opened(lengths: Sequence[int], falling: Sequence[int], at: int, capacities: Sequence[int], overhead: int) -> int:
    """The least-cost length of a bin for piece `at` of lengths (largest first): each is filled with what
    of the later pieces fits, largest first, cut down to what that takes, and the least cost a token wins.
    falling: the lengths, negated."""
    best, n = (float("inf"), 0), len(lengths)
    for c in capacities:
        room = c - lengths[at]
        if room < 0:
            continue
        i = at + 1
        while room and i < n:
            i = bisect_left(falling, -room, i)
            if i < n:
                room -= lengths[i]
                i += 1
        held = c - room
        best = min(best, ((next(x for x in capacities if x >= held) + overhead) / held, c))
    return best[1]


def fit(lengths: Sequence[int], capacities: Sequence[int], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of pieces (largest first) into bins, each opened at its own least-cost length. Each
    piece's bin and start, and each bin's content."""
    room: list[tuple[int, int]] = []
    which, start, content, size = [], [], [], []
    falling = [-n for n in lengths]
    for at, n in enumerate(lengths):
        i = bisect_left(room, (n, -1))
        if i < len(room):
            _, b = room.pop(i)
        else:
            b = len(content)
            content.append(0)
            size.append(opened(lengths, falling, at, capacities, overhead))
        which.append(b)
        start.append(content[b])
        content[b] += n
        if content[b] < size[b]:
            insort(room, (size[b] - content[b], b))
    return which, start, content


def pack(sizes: np.ndarray, capacities: Sequence[int], overhead: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, piece, tokens, bin, start, capacity) for sizes > 0: all lengths are used jointly, bin by
    bin, and at the end each bin is cut down to the least length that holds its content. One length for
    all bins is tried too, and taken where that happens to cost less."""
    capacities = sorted(set(capacities))
    most, pieces = capacities[-1], []
    for i, n in enumerate(sizes.tolist()):
        pieces += [(min(most, n - at), i, at // most) for at in range(0, n, most)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    lengths, chosen = [p[0] for p in pieces], None
    for permitted in (capacities, [most]):
        which, start, content = fit(lengths, permitted, overhead)
        cut = [next(c for c in capacities if c >= n) for n in content]
        cost = sum(cut) + overhead * len(cut)
        if chosen is None or cost < chosen[0]:
            chosen = cost, which, start, cut
    _, which, start, cut = chosen
    return [(i, piece, n, b, s, cut[b]) for (n, i, piece), b, s in zip(pieces, which, start, strict=True)]


def best_fit(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, group_rows: int = GROUP, tokens: Column | None = None, tokenizer: str | None = None, unique: bool = False) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_start, bin_capacity): where every document of
    docs(doc_id, text) lies. bin_id is `group-number`; documents are dealt to groups of about
    group_rows by a hash of doc_id, and each group is packed on its own.

    Tokens are those of a byte-level BPE (token_counts.counted) unless a column over `text` says otherwise. A document longer than the largest
    capacity is cut into pieces of that length and a rest, numbered from 0. A document without tokens
    (null or blank text) needs no room: piece 0, 0 tokens, null bin. Rows without doc_id take no part;
    of a repeated doc_id each distinct text counts, under the key identified() gives it (unique: ids are known to be
    distinct). Other columns are not carried. An empty table gives an empty result.
    """
    docs = keyed_texts(docs, unique)
    parts = max(1, math.ceil(docs.count() / group_rows))
    count = counted(docs, tokenizer) if tokens is None else docs.select("doc_id", F.coalesce(tokens, F.lit(0)).cast("long").alias("n"))
    rows = count.select(F.pmod(F.xxhash64("doc_id", F.lit("pack")), F.lit(parts)).alias("grp"), "doc_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "grp"):
            group = table.column("grp").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                ids, n = table.column("doc_id").to_numpy()[lo:hi], table.column("n").to_numpy()[lo:hi]
                order = np.argsort(ids)
                ids, n = ids[order], n[order]
                found = pack(n, capacities, overhead)
                none = ids[n <= 0]
                nulls = [None] * len(none)
                yield pa.RecordBatch.from_arrays([
                    pa.array([*(ids[i] for i, *_ in found), *none], pa.int64()), pa.array([*(x[1] for x in found), *([0] * len(none))], pa.int32()), pa.array([*(x[2] for x in found), *([0] * len(none))], pa.int64()),
                    pa.array([*(f"{group[lo]}-{x[3]}" for x in found), *nulls], pa.string()), pa.array([*(x[4] for x in found), *nulls], pa.int64()), pa.array([*(x[5] for x in found), *nulls], pa.int64()),
                ], ["doc_id", "piece", "n_tokens", "bin_id", "bin_start", "bin_capacity"])

    dealt = rows.repartition(min(parts, 8 * tasks(docs.sparkSession)), "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(released(run), "doc_id long, piece int, n_tokens long, bin_id string, bin_start long, bin_capacity long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), unique=True)


SQL: dict[str, str] = {}
QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
