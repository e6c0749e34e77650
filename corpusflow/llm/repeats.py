"""Removal of repeated passages by prefix-free parsing.

The corpus is parsed into phrases at rolling-hash triggers: of the k-grams in each 100-byte string the
one with the smallest hash is its trigger, and the strings that follow one another and share a trigger
make a phrase. A string's trigger depends on its content alone, so equal strings meet at equal
triggers, at one distance from it. Distinct phrases form the dictionary; of a phrase only its first
place in the parse stays, all later places repeat.

What is left are strings shared by different phrases of the dictionary. Its suffixes at the triggers
are sorted by their bytes, and so are the reversed bytes before the triggers, each order with the
lengths of common prefixes between neighbours. A string whose trigger is r bytes in is a class of the
first order at depth r and one of the second at depth 100 - r: strings are equal just where both are.
Phrases are numbered in the order of the parse (doc_id, position), so of each pair of classes the
first number is the first place in the corpus, and all others repeat. Phrases overlap by 99 bytes, so
every string lies within one phrase and what follows in the parse needn't be sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import Rolling, digests, identified, keyed_texts, mix, released, slices, stored, tasks, text_buffer

LENGTH, K = 100, 32
SLICE = 1 << 20
#: Bytes of text to each task that dictionary and suffixes are dealt to.
SHARE = 32 << 20
#: Phrases or strings that a task sorts at a time; rows of one trigger or string stay together.
AT_ONCE = 1 << 17
#: Triggers with so many phrases in one slice are dealt by phrase, not by trigger ...
LOCAL_HOT = 32
#: ... and of those with more phrases than this in all, single strings are compared, dealt by content.
HOT = 4096
PHRASE = np.dtype([("trigger", "<u4"), ("n1", "<u8"), ("n2", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "<u2"), ("before", "<u2")])
STRINGS = np.dtype([("n1", "<u8"), ("n2", "<u8"), ("doc", "<i8"), ("start", "<i8")])
PLACED = np.dtype([("trigger", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<i8"), ("before", "<i8"), ("blob", "<i8"), ("at", "<i8")])
MARK = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])
#: Kinds of rows: phrases by trigger, triggers that are hot somewhere, phrases of hot triggers; what is
#: to be compared as phrases and as strings; and what repeats.
SEGMENT, TOLD, SPREAD, EXPAND, STRING, REMOVE = range(6)
PACKED = "part int, kind int, data binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def parse(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Phrases of the texts of one buffer: text, first string, last string and trigger (places in the
    buffer), and trigger hash."""
    grams = Rolling(data).windows(k)
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    low = np.uint64((1 << 24) - 1)
    if len(data) > int(low):
        raise ValueError("a buffer holds at most 16 MB")
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    at = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[text + 1]
    key = np.where(inside, at, -1)
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[cut[1:], n] - 1
    real = key[cut] >= 0
    first, last = cut[real], last[real]
    return text[first], first, last, at[first], grams[at[first]]


def packed(kind: int, parts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One (part, kind, bytes) for each part that has rows."""
    order = np.argsort(parts, kind="stable")
    parts, rows = parts[order], rows[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]), len(parts)] if len(parts) else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(parts[lo]), kind, rows[lo:hi].tobytes()


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of digest, doc, start; and which of them are the first of their digest."""
    rows = rows[np.lexsort([rows["start"], rows["doc"], rows["n2"], rows["n1"]])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["n1"][1:] != rows["n1"][:-1]) | (rows["n2"][1:] != rows["n2"][:-1])
    return rows, new


def marks(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """MARK rows, with touching and overlapping runs of a document joined."""
    doc, start, end = doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
    order = np.lexsort([start, doc])
    doc, start, end = doc[order], start[order], end[order]
    out = np.empty(len(doc), MARK)
    if not len(doc):
        return out
    new = np.r_[True, doc[1:] != doc[:-1]]
    top = np.maximum.accumulate(end + np.cumsum(new) * (1 << 40)) - np.cumsum(new) * (1 << 40)
    cut = new.copy()
    cut[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(cut)
    out = np.empty(len(at), MARK)
    out["doc"], out["start"], out["end"] = doc[at], start[at], top[np.r_[at[1:], len(doc)] - 1]
    return out


def repeated(again: np.ndarray, length: int) -> np.ndarray:
    """Marks of the later places of phrases, or of strings."""
    more = again["more"].astype(np.int64) if "more" in again.dtype.names else 0
    return marks(again["doc"], again["start"], again["start"].astype(np.int64) + more + length)


def shares(rows: np.ndarray, key: str, size: int | None = None) -> Iterator[np.ndarray]:
    """rows in shares of about AT_ONCE by a hash of key; size: what they count as."""
    n = -(-(len(rows) if size is None else size) // AT_ONCE)
    if n <= 1:
        yield rows
        return
    share = (mix(rows[key].astype(np.uint64) + np.uint64(977)) >> np.uint64(32)) % np.uint64(n)
    for i in range(n):
        yield rows[share == i]


def dealt(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def by_doc(doc: np.ndarray, parts: int) -> np.ndarray:
    return dealt(doc.astype(np.int64).view(np.uint64), parts)


def phrases(docs: DataFrame, parts: int, length: int, k: int, local_hot: int) -> DataFrame:
    """The parse, one row a slice, part and kind; a phrase that repeats within the slice is told at once.
    Phrases go to the part of their trigger. A trigger with local_hot distinct phrases in a slice sends
    them by phrase instead, and word of that to its part: no part holds all phrases of a hot trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for piece, rows, shift in pieces(data, offsets, ids, length):
                text, first, last, trigger, value = parse(piece, rows[0], length, k)
                if not len(text):
                    continue
                got = np.empty(len(text), PHRASE)
                names = digests(piece, first, last + length)
                got["trigger"], got["n1"], got["n2"] = value >> np.uint64(32), names[:, 0], names[:, 1]
                got["doc"], got["start"], got["more"], got["before"] = rows[1][text], first - rows[0][text] + shift, last - first, trigger - first
                got, new = firsts(got)
                found = repeated(got[~new], length)
                got = got[new]
                values, index, n = np.unique(got["trigger"], return_inverse=True, return_counts=True)
                hot = n >= local_hot
                cold, spread, told = got[~hot[index]], got[hot[index]], values[hot]
                yield as_batch([
                    *packed(SEGMENT, dealt(cold["trigger"], parts), cold), *packed(SPREAD, dealt(spread["n1"], parts), spread),
                    *packed(TOLD, dealt(told, parts), told), *packed(REMOVE, by_doc(found["doc"], parts), found),
                ])

    return docs.mapInArrow(released(run), PACKED)


def pieces(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], int]]:
    """Slices of about SLICE bytes as (bytes, (offsets, doc ids), place of the first byte in its text). A
    longer text comes in slices that overlap by length - 1 bytes: every string lies in just one."""
    for lo, hi in slices(offsets, SLICE):
        size = int(offsets[hi] - offsets[lo])
        if size <= 2 * SLICE:
            yield data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo], ids[lo:hi]), 0
            continue
        for at in range(0, max(1, size - length + 1), SLICE):
            end = min(size, at + SLICE + length - 1)
            yield data[offsets[lo] + at : offsets[lo] + end], (np.array([0, end - at]), ids[lo:hi]), at


def blobs(part: list[pa.RecordBatch], kind: int) -> list[bytes]:
    """The packed rows of one kind, from every batch of a part."""
    out: list[bytes] = []
    for batch in part:
        keep = np.flatnonzero(batch.column("kind").to_numpy() == kind)
        out += batch.column("data").take(pa.array(keep)).to_pylist()
    return out


def unpacked(part: list[pa.RecordBatch], kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs(part, kind)), dtype)


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """All batches of a part, of batches sorted by part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("part")[0].as_py() != int(part[lo]):
                yield held
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def dictionary(rows: DataFrame, parts: int, length: int, most: int) -> DataFrame:
    """(doc_id, kind, a, b, trigger, before): REMOVE for bytes that lie in a later place of a phrase,
    EXPAND (or, of a hot trigger, STRING) for the first place of a phrase whose trigger has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_parts(batches):
            told = np.unique(unpacked(part, TOLD, np.dtype("<u4")))
            for some in shares(unpacked(part, SEGMENT, PHRASE), "trigger"):
                got, new = firsts(some)
                again, got = got[~new], got[new]
                _, index, n = np.unique(got["trigger"], return_inverse=True, return_counts=True)
                n, hot = n[index] if len(index) else np.zeros(0, int), np.isin(got["trigger"], told)
                ask = (n > 1) | hot
                yield answer(repeated(again, length), got[ask], np.where(hot | (n > most), STRING, EXPAND)[ask])
            for some in shares(unpacked(part, SPREAD, PHRASE), "n1"):
                got, new = firsts(some)
                yield answer(repeated(got[~new], length), got[new], np.full(int(new.sum()), STRING))
            gone = unpacked(part, REMOVE, MARK)
            yield answer(marks(gone["doc"], gone["start"], gone["end"]), np.empty(0, PHRASE), np.empty(0, int))

    def answer(found: np.ndarray, ask: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(found), np.int64)
        start = ask["start"].astype(np.int64)
        columns = [(found["doc"], ask["doc"]), (none + REMOVE, kind), (found["start"], start), (found["end"], start + ask["more"]), (none, ask["trigger"]), (none, ask["before"])]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.astype(np.int64) for x in c]).astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "kind", "a", "b", "trigger", "before"])

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(run), "doc_id long, kind int, a long, b long, trigger long, before int")


def compared(asked: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, kind, data) of what is to be compared: EXPAND phrases with their bytes under the trigger,
    of STRING phrases each string under its content; strings that repeat within a batch only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, text = batch.column("spans"), batch.column("text")
            ids = batch.column("doc_id").to_numpy()
            flat = lists.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            kind, a, b, trigger, before = (flat.field(i).to_numpy() for i in range(5))
            data, offsets = text_buffer(text)
            begin, span = offsets[row] + a, b - a + length
            expand = kind == EXPAND
            for at in np.array_split(np.flatnonzero(expand), max(1, -(-int(expand.sum()) // 20_000))):
                yield whole(data, dealt(trigger[at], parts), np.stack([trigger[at], ids[row[at]], a[at], span[at], before[at]], axis=1), begin[at], span[at])
            hot = np.flatnonzero(~expand)
            for lo in range(0, len(hot), 2000):
                yield single(data, ids[row[hot[lo : lo + 2000]]], a[hot[lo : lo + 2000]], begin[hot[lo : lo + 2000]], span[hot[lo : lo + 2000]] - length + 1)

    def whole(data, part, heads, begin, span):
        order = np.argsort(part, kind="stable")
        held, out, said = memoryview(np.ascontiguousarray(data)), {}, heads.astype(np.int64)
        for i in order.tolist():
            out.setdefault(int(part[i]), []).extend((said[i].tobytes(), held[begin[i] : begin[i] + span[i]]))
        return as_batch([(p, EXPAND, b"".join(x)) for p, x in out.items()])

    def single(data, doc, a, begin, n):
        step = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        at = np.repeat(begin, n) + step
        got = np.empty(len(at), STRINGS)
        names = digests(data, at, at + length)
        got["n1"], got["n2"], got["doc"], got["start"] = names[:, 0], names[:, 1], np.repeat(doc, n), np.repeat(a, n) + step
        got, new = firsts(got)
        found, got = repeated(got[~new], length), got[new]
        return as_batch([*packed(STRING, dealt(got["n1"], parts), got), *packed(REMOVE, by_doc(found["doc"], parts), found)])

    return asked.mapInArrow(released(run), PACKED)


def placed(texts: list[bytes]) -> np.ndarray:
    """Head of each phrase, and where its bytes are."""
    out = []
    for i, blob in enumerate(texts):
        at = 0
        while at < len(blob):
            head = np.frombuffer(blob, np.int64, 5, at).tolist()
            out.append((*head, i, at + 40))
            at += 40 + head[3]
    return np.array(out, PLACED)


def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row of bytes in their order, and in that order the length of the prefix that
    each shares with the one before (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel())
    inorder = rows[order]
    same = inorder[1:] == inorder[:-1]
    common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    return place, np.r_[0, common] if len(rows) else np.zeros(0, int)


def later_strings(texts: list[bytes], rows: np.ndarray, length: int, k: int) -> np.ndarray:
    """Marks of the strings of some phrases (PLACED, all phrases of each trigger) that also start earlier
    in the corpus, within one of these phrases."""
    rows = rows[np.lexsort([rows["start"], rows["doc"]])]
    n, deep = len(rows), length - k
    size, before = rows["size"], rows["before"]
    data = np.frombuffer(b"".join([bytes(length), *(texts[i][at : at + m] for i, at, m in zip(rows["blob"].tolist(), rows["at"].tolist(), size.tolist(), strict=True)), bytes(length)]), np.uint8)
    trigger = length + np.r_[0, np.cumsum(size)[:-1]] + before
    name = rows["trigger"].astype(">u4").view(np.uint8).reshape(n, 4)

    def side(buffer: np.ndarray, at: np.ndarray, depth: int, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = np.lib.stride_tricks.sliding_window_view(buffer, depth)[at] if depth else np.empty((n, 0), np.uint8)
        got = np.where(np.arange(depth) < have[:, None], got, np.uint8(0))
        return neighbours(np.concatenate([name, got], axis=1))

    after_at, after = side(data, trigger, length, size - before)
    ahead_at, ahead = side(data[::-1], len(data) - trigger, deep, before)
    number, again = np.arange(n), np.zeros((deep + 3, n), bool)
    bits = np.uint64(max(1, int(n).bit_length()))
    if 3 * int(bits) > 64:
        raise ValueError("too many phrases at once")
    for r in range(deep + 1):
        has = np.flatnonzero((before >= r) & (before - r <= size - length))
        if len(has) < 2:
            continue
        left = np.maximum.accumulate(np.where(ahead - 4 < r, number, 0))[ahead_at[has]].astype(np.uint64)
        right = np.maximum.accumulate(np.where(after - 4 < length - r, number, 0))[after_at[has]].astype(np.uint64)
        key = np.sort((((left << bits) | right) << bits) | has.astype(np.uint64))
        same = key >> bits
        later = key[1:][same[1:] == same[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))
        again[r + 1, later.astype(np.int64)] = True
    # Runs of distances r; the string at distance r starts r bytes before the trigger.
    edge = again[1:].astype(np.int8) - again[:-1]
    opens, closes = np.nonzero(edge.T == 1), np.nonzero(edge.T == -1)
    i = opens[0]
    base = rows["start"][i] + before[i]
    return marks(rows["doc"][i], base - (closes[1] - 1), base - opens[1] + length)


def sorted_suffixes(rows: DataFrame, parts: int, length: int, k: int) -> DataFrame:
    """(doc_id, a, b) REMOVE rows: of equal strings all but the first in corpus order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_parts(batches):
            texts = blobs(part, EXPAND)
            for some in shares(placed(texts), "trigger"):
                yield remove_batch(later_strings(texts, some, length, k))
            for some in shares(unpacked(part, STRING, STRINGS), "n1"):
                got, new = firsts(some)
                yield remove_batch(repeated(got[~new], length))
            gone = unpacked(part, REMOVE, MARK)
            yield remove_batch(marks(gone["doc"], gone["start"], gone["end"]))

    def remove_batch(done: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[c]), pa.int64()) for c in ("doc", "start", "end")], ["doc_id", "a", "b"])

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(run), "doc_id long, a long, b long")


def removed(docs: DataFrame, keep_text: bool, carry: bool) -> DataFrame:
    """docs with its spans; what is kept as text, and the row, if asked for."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    names = [c.split()[0] for c in schema.split(", ")] + ["row"] * carry
    if carry:
        schema += f", row {docs.schema['row'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            lists = batch.column("spans")
            flat = lists.flatten()
            count = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
            spans = marks(np.repeat(np.arange(batch.num_rows), count), flat.field(0).to_numpy(), flat.field(1).to_numpy())
            cut = np.searchsorted(spans["doc"], np.arange(batch.num_rows + 1))
            gone = np.bincount(spans["doc"], spans["end"] - spans["start"], batch.num_rows).astype(np.int64) if len(spans) else np.zeros(batch.num_rows, np.int64)
            held, digest, texts = memoryview(np.ascontiguousarray(data)), [], []
            null = batch.column("text").is_null().to_pylist()
            for i in range(batch.num_rows):
                mine = spans[cut[i] : cut[i + 1]]
                left = [held[x:y] for x, y in zip((offsets[i] + np.r_[0, mine["end"]]).tolist(), [*(offsets[i] + mine["start"]).tolist(), int(offsets[i + 1])], strict=True)] if len(mine) else [held[offsets[i] : offsets[i + 1]]]
                whole = hashlib.sha256()
                for x in left:
                    whole.update(x)
                digest.append(whole.hexdigest())
                if keep_text:
                    texts.append(None if null[i] else b"".join(left).decode("utf-8", "ignore"))
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(gone), pa.array(np.diff(cut), pa.int64()), pa.array(digest, pa.string())]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
            if carry:
                columns.append(batch.column("row"))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(released(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, keep_text: bool = False, carry: bool = False, unique: bool = False, local_hot: int = LOCAL_HOT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, row]) for every document of
    docs(doc_id, text): each byte goes that is covered by a `length`-byte string which also starts
    earlier (smaller doc_id, or the same document, earlier start), judged on the input.

    Texts are UTF-8 bytes; a null text is empty; strings never cross documents. kept_text (null for a null
    text) leaves out the bytes of characters that were cut in two. Strings are compared by their bytes, whole phrases
    (and strings of triggers with more than `hot` phrases) by 128-bit BLAKE2b digests. Rows without
    doc_id take no part; of a repeated doc_id each distinct text counts, under the key identified()
    gives it (unique: ids are known to be distinct). carry: a struct `row` holds the
    other columns; else they are not carried. An empty table gives an empty result.
    """
    if k >= length:
        raise ValueError("k must be less than length")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(True).alias("none")]
    docs = (docs if unique else identified(docs.where("doc_id IS NOT NULL"))) if carry else keyed_texts(docs, unique)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct(*rest).alias("row")] * carry).where("doc_id IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(tasks(docs.sparkSession), math.ceil(size / SHARE))
    told = stored(dictionary(phrases(docs, parts, length, k, local_hot), parts, length, hot))
    ask = told.where(F.col("kind") != REMOVE).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "a", "b", "trigger", "before")).alias("spans"))
    # Both joins take the same columns of docs, so the texts are shuffled once for the two.
    strings = sorted_suffixes(compared(docs.join(ask, "doc_id").select(*docs.columns, "spans"), parts, length), parts, length, k)
    gone = told.where(F.col("kind") == REMOVE).select("doc_id", "a", "b").unionByName(strings)
    spans = gone.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return removed(docs.join(spans, "doc_id", "left").select(*docs.columns, "spans"), keep_text, carry)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), unique=True)


#: Every string of 100 bytes by its digest; doc_ids are distinct. For small tables.
SQL = {
    "op7_repeated_passages": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n FROM d),
s AS (SELECT doc_id, b, unnest(range(n - 99)) AS lo FROM n WHERE n >= 100), h AS (SELECT doc_id, lo, md5(b[lo + 1:lo + 100]) AS h FROM s),
f AS (SELECT h, min({'doc_id': doc_id, 'lo': lo}) AS first FROM h GROUP BY 1 HAVING count(*) > 1), r AS (SELECT doc_id, lo FROM h JOIN f USING (h) WHERE {'doc_id': doc_id, 'lo': lo} <> first),
m AS (SELECT doc_id, lo, lo > lag(lo, 1, -101) OVER (PARTITION BY doc_id ORDER BY lo) + 100 AS new FROM r), i AS (SELECT doc_id, lo, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM m),
t AS (SELECT doc_id, run, min(lo) AS lo, max(lo) + 100 AS hi FROM i GROUP BY 1, 2), u AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo)::BIGINT AS removed FROM t GROUP BY 1),
k AS (SELECT doc_id, n, coalesce(removed, 0) AS n_removed, coalesce(len(los), 0) AS n_spans, hex(b) AS x, [0] || coalesce(his, []) AS a, coalesce(los, []) || [n] AS z FROM n LEFT JOIN u USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda j: substring(x, 2 * a[j] + 1, 2 * (z[j] - a[j]))), ''))) AS kept_sha256 FROM k"""
}
QUERIES = {"op7_repeated_passages": op7_repeated_passages}
