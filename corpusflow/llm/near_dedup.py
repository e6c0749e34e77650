"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

Texts with the same words collapse to a class before anything is paired. Classes that meet in a band
form candidate groups; a group is verified in cells of a bounded number of pivots and members, and a
pivot leaves the group once it has met every member, so no task holds a whole group and no group
emits all its pairs. Members of a group's largest component so far needn't become pivots. Rounds, each
with more pivots, go on until the members left in a group are known to be connected.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import MASK, forget, groups, identified, keyed_texts, mix, released, slices, stored, tasks, text_buffer, word_hashes
from corpusflow.llm.graph import components

#: 42 bands of 6: at a similarity of 0.80 a pair meets in some band but for 3 in 1,000,000.
BANDS, ROWS = 42, 6
#: Places of a sketch, a power of two; the bands leave out the last ones.
T = 256
#: Members of a group that one cell compares, and pivots they are compared with there; and about how many
#: shingles there are on either side.
CHUNK, SHINGLES = 128, 1 << 20
#: Each round takes so many times the pivots of the one before.
GROWTH = 8
SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_WEIGHTS = mix(np.arange(101, 101 + 64, dtype=np.uint64))


def words_of(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a buffer in lower case."""
    ink = ~_BLANK[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, ink]
    return np.flatnonzero(ink & (~before[:-1] | edge[:-1])), np.flatnonzero(ink & (~np.r_[ink[1:], False] | edge[1:])) + 1 if len(low) else np.empty(0, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of every text, end to end, and the n + 1 offsets."""
    n = len(offsets) - 1
    low = _LOWER[data]
    starts, ends = words_of(low, offsets)
    word = word_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    wide = max(0, len(word) - words + 1)
    rolled = np.zeros(wide, np.uint64)
    for j in range(words):
        rolled += word[j : j + wide] * _WEIGHTS[j]
    sizes = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    out, at = np.empty(int(sizes.sum()), np.uint64), np.r_[0, np.cumsum(sizes)]
    for i in range(n):
        lo, a, b = first[i], at[i], at[i + 1]
        if count[i] >= words:
            out[a:b] = rolled[lo : lo + sizes[i]]
        elif count[i]:
            out[a] = (word[lo : lo + count[i]] * _WEIGHTS[: count[i]]).sum(dtype=np.uint64) + np.uint64(count[i])
    out = mix(out)
    for i in range(n):
        out[at[i] : at[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][sizes > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][at]


def long_set(data: np.ndarray, words: int, size: int) -> np.ndarray:
    """The same for one long text, about `size` bytes at a time: slices end between words, and each
    begins with the last words of the one before."""
    out, at, n = np.empty(0, np.uint64), 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n and not _BLANK[data[end]]:
            end += 1
        got, _ = shingle_sets(data[at:end], np.array([0, end - at]), words)
        if end == n and at == 0:
            return got
        low = _LOWER[data[at:end]]
        starts, _ = words_of(low, np.array([0, end - at]))
        if len(starts) >= words:
            out = np.union1d(out, got)
            if end < n:
                end = at + int(starts[len(starts) - words + 1]) if words > 1 else end
        elif end < n:  # too few words for a shingle: take more bytes
            size *= 2
            continue
        elif not len(out):
            out = got
        at = end
    return out


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, T) coordinates. In round i < T each element is thrown into a hashed place of the T, in
    round T + j into place j; a place keeps its smallest value, and values grow by round, so only texts
    with places still open need another round. Every place of a non-empty text fills."""
    n = len(at) - 1
    out = np.full(n * T, np.iinfo(np.uint64).max, np.uint64)
    texts = np.repeat(np.arange(n), np.diff(at))
    left, rows = sets, texts
    for i in range(2 * T):
        for lo in range(0, len(left), SLICE):
            h = mix(left[lo : lo + SLICE] + np.uint64((i + 1) * 0xD1342543DE82EF95 & MASK))
            place = (h & np.uint64(T - 1)).astype(np.int64) if i < T else np.full(len(h), i - T)
            np.minimum.at(out, rows[lo : lo + SLICE] * T + place, (h >> np.uint64(9)) | (np.uint64(i) << np.uint64(55)))
        open_ = (out.reshape(n, T) == np.iinfo(np.uint64).max).any(axis=1)[rows]
        if not open_.any():
            break
        if not open_.all():
            left, rows = left[open_], rows[open_]
    return out.reshape(n, T)


def bands(sketch: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys: equal where all coordinates of the band are."""
    parts = sketch[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(ROWS):
        key += mix(parts[:, :, j] + np.uint64(j)) * _WEIGHTS[j]
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): k1 and k2 are the halves of a 128-bit digest of the text's
    words, so texts of one name have one shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                if offsets[hi] - offsets[lo] > 2 * SLICE:
                    sets = long_set(data[offsets[lo] : offsets[hi]], words, SLICE)
                    at = np.array([0, len(sets)])
                else:
                    sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                some = np.flatnonzero(np.diff(at))
                names = np.zeros((hi - lo, 2), np.int64)
                for i in some.tolist():
                    names[i] = np.frombuffer(named(data[offsets[lo + i] : offsets[lo + i + 1]]), np.int64)
                keys = np.zeros((hi - lo, BANDS), np.uint64)
                keys[some] = bands(sketches(sets, np.r_[at[:-1][some], at[-1]]))
                lists = pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(released(run), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def named(data: np.ndarray) -> bytes:
    """Digest of a text's words in lower case, a blank between them; of a long text piece by piece."""
    whole, held = blake2b(digest_size=16), b""
    for at in range(0, max(1, len(data)), SLICE):
        text = held + data[at : at + SLICE].tobytes().lower()
        cut = len(text)
        if at + SLICE < len(data):  # the last word may go on
            cut = max(map(text.rfind, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))) + 1
        held = text[cut:]
        for_now = b" ".join(text[:cut].split())
        whole.update(for_now + b" " if for_now else b"")
    return whole.digest()


class Linker:
    """Exact links of one cell: words are numbered by their bytes, shingles by their words, and sets of
    those numbers compared."""

    def __init__(self, texts: list[bytes], words: int, percent: int) -> None:
        known: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids = [[known[w] for w in t.lower().split()] for t in texts]
        at = np.r_[0, np.cumsum([len(x) for x in ids])]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(at[-1]))
        runs = flat
        for j in range(1, words):  # numbers of the runs of j + 1 words
            if len(runs) < 2:
                break
            runs = np.unique(runs[:-1] * len(known) + flat[j : j + len(runs) - 1], return_inverse=True)[1].astype(np.int64)
        short: dict[tuple[int, ...], int] = {}
        self.percent, self.sets = percent, []
        for i, own in enumerate(ids):
            if len(own) >= words:
                self.sets.append(np.unique(runs[at[i] : at[i + 1] - words + 1]))
            else:
                self.sets.append(np.array([-1 - short.setdefault(tuple(own), len(short))] if own else [], np.int64))

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        small, large = min(len(a), len(b)), max(len(a), len(b))
        if not small or 100 * small < self.percent * large:
            return False
        both = np.concatenate([a, b])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= self.percent * (len(a) + len(b) - common)

    def links(self, pivots: list[int], members: list[int], near: np.ndarray) -> list[tuple[int, int]]:
        """near[i, j]: i and j meet in a band. A pair already connected isn't compared again."""
        out, comp = [], {}
        left = list(pivots)
        while left:  # breadth first over the pivots
            queue = [left.pop(0)]
            comp[queue[0]] = root = queue[0]
            while queue:
                p, rest = queue.pop(), []
                for x in left:
                    if near[p, x] and self.linked(p, x):
                        comp[x] = root
                        out.append((p, x))
                        queue.append(x)
                    else:
                        rest.append(x)
                left = rest
        for m in members:
            seen: set[int] = set()
            for p in pivots:
                if comp[p] not in seen and near[m, p] and self.linked(m, p):
                    seen.add(comp[p])
                    out.append((m, p))
        return out


def verified(members: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """(a, b) links of members(cell, pivot, rep, bands, text); a block's pivots come with each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "cell"):
            cell, rep, pivot = table.column("cell").to_numpy(), table.column("rep").to_numpy(), table.column("pivot").to_numpy()
            keys = table.column("bands").combine_chunks()
            keys = (pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(-1, BANDS)
            cuts = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            a, b = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                is_pivot = pivot[lo:hi]
                if not is_pivot.any() or hi - lo < 2:
                    continue
                link = Linker([t.as_buffer().to_pybytes() for t in table.column("text").slice(lo, hi - lo)], words, percent)
                own = keys[lo:hi]
                near = np.zeros((hi - lo, hi - lo), bool)
                for j in range(BANDS):
                    near |= own[:, j, None] == own[None, :, j]
                for x, y in link.links(np.flatnonzero(is_pivot).tolist(), np.flatnonzero(~is_pivot).tolist(), near):
                    a.append(rep[lo + x])
                    b.append(rep[lo + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(released(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, unique: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document of docs(doc_id, text).

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and return, in
    lower case (A-Z). The set of a text: its distinct runs of `words` words; with fewer words, the
    whole sequence. Two texts are linked if 100 * |intersection| >= percent * |union|, of sets that are
    compared word by word. component_id is the smallest doc_id reachable over links; kept marks it. A
    null or blank text has an empty set and is linked with nothing. Rows without doc_id take no part;
    of a repeated doc_id each distinct text counts, under the key identified() gives it (unique: ids
    are known to be distinct). Other columns are not carried. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = keyed_texts(docs, unique)
    sketch = stored(sketched(docs, words))
    same = ["n_shingles", "k1", "k2"]
    names = stored(sketch.select("doc_id", *same))
    first = sketch.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    reps = stored(first.select(*same, F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    forget(sketch)

    places = reps.select("rep", F.explode("bands").alias("band"))
    met = places.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    group = components(places.join(met, "band").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    # What is compared is fetched once: one row for each class that meets another.
    held = group.select(F.col("node").alias("rep"), F.col("comp").alias("grp")).join(reps.select("rep", "bands", "n_shingles"), "rep")
    held = stored(held.join(docs.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "grp", "bands", "text", F.col("n_shingles").alias("size")))
    forget(group)

    # `done`: the class has been a pivot.
    state = stored(held.select("rep", "grp", "size", F.col("rep").alias("comp"), F.lit(False).alias("done")))
    edges, turn = None, 0
    while True:
        sizes = state.groupBy("grp").agg(F.count("*").alias("members"), F.sum("size").alias("weight"), F.count_if(~F.col("done")).alias("open"), F.min(F.when(~F.col("done"), F.col("comp"))).alias("low"), F.max(F.when(~F.col("done"), F.col("comp"))).alias("high"))
        live = sizes.where("open > 0 AND (low <> high)")
        if turn and live.isEmpty():
            break
        # Pivots: all of a group that is small enough, else some of those outside its largest component.
        each = state.groupBy("grp", "comp").agg(F.count_if(~F.col("done")).alias("n"))
        largest = each.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("m")).select("grp", F.col("m.comp").alias("main"), F.col("m.n").alias("main_n"))
        rows = state.join(live.select("grp", "members", "weight", "open"), "grp").join(largest, "grp")
        outside = ~F.col("done") & ((F.col("comp") != F.col("main")) | (F.col("main_n") <= 1))
        chance = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        pool = F.when(F.col("main_n") <= 1, F.col("open")).otherwise(F.col("open") - F.col("main_n"))
        taken = F.least(pool, F.lit(CHUNK * GROWTH**turn))
        # A cell is bounded in rows and in shingles, on both of its sides.
        split = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK), F.ceil(F.col("weight") * n / F.col("members") / SHINGLES)).cast("int")
        chunks, blocks = split(F.col("members")), split(taken)
        rows = stored(rows.select(
            "rep", "grp", (outside & (chance * pool <= taken)).alias("pivot"), chunks.alias("chunks"), blocks.alias("blocks"),
            F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("c"), F.pmod(F.xxhash64("rep", F.lit("block")), blocks).cast("int").alias("p"),
        ))
        # A cell is one block of pivots with one chunk of members; members come to every block, pivots to every chunk.
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = rows.select("rep", "pivot", "grp", "c", "p", upto("blocks").alias("at")).where("NOT (pivot AND at = p)")
        own = own.select("rep", F.lit(False).alias("pivot"), F.xxhash64("grp", "c", "at").alias("cell"))
        led = rows.where("pivot").select("rep", "pivot", "grp", "p", upto("chunks").alias("c")).select("rep", "pivot", F.xxhash64("grp", "c", "p").alias("cell"))
        found = stored(verified(own.unionByName(led).join(held.select("rep", "bands", "text"), "rep").select("cell", "pivot", "rep", "bands", "text"), words, percent, tasks(spark)))
        edges = found if edges is None else edges.unionByName(found)
        joined = components(edges).select(F.col("node").alias("rep"), F.col("comp").alias("now"))
        met_all = rows.where("pivot").select("rep", F.lit(True).alias("met"))
        after = stored(state.join(joined, "rep", "left").join(met_all, "rep", "left").select("rep", "grp", "size", F.coalesce("now", "comp").alias("comp"), (F.col("done") | F.coalesce("met", F.lit(False))).alias("done")))
        for table in (state, rows, joined):
            forget(table)
        state, turn = after, turn + 1
    if edges is not None:
        forget(edges)
    forget(held)

    named_ = stored(reps.join(state.select("rep", "comp"), "rep", "left").select(*same, F.coalesce("comp", "rep").alias("component_id")))
    forget(reps)
    forget(state)
    out = names.join(named_, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), percent=85, unique=True)


#: All pairs of distinct word sequences that share a shingle; doc_ids are distinct. For small tables.
SQL = {
    "op4_near_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS own, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS rep FROM d),
e AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s WHERE doc_id = rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (sizes - shared)), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, rep FROM s UNION SELECT rep, doc_id FROM s),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
}
QUERIES = {"op4_near_dedup": op4_near_dedup}
