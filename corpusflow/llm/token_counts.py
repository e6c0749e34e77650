"""Token counts that follow edits: pre-token trees whose sums change only along an edit's path.

A table of trees has a row a document: its text, the characters and tokens of its pre-tokens in leaves,
and the sums of a binary tree over the leaves. It is made once, stored, and brought up to date by edit
tables; only edited documents are touched, and of those only the pre-tokens around an edit are encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import released, slices, text_buffer

#: Pre-tokens of a leaf; one that grows to four times as many makes the tree be built anew.
LEAF = 64
#: Pre-tokens whose tokens a task remembers.
MEMORY = 200_000
#: Bytes of text whose trees are sent on at once.
SLICE = 1 << 21
#: A byte-level BPE; another file may be named by the setting below.
TOKENIZER, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.corpusflow.tokenizer"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Known(dict):
    """Tokens of pre-tokens, remembered for up to MEMORY of them."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= MEMORY:
            self.clear()
        self[piece] = n
        return n


class Counter:
    """Tokens of a pre-token under a byte-level BPE."""

    def __init__(self, ranks: bytes) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.split = regex.compile(PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.known = Known(self.encoding)

    def __call__(self, piece: str) -> int:
        return self.known[piece]

    def total(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.split.findall(text)))


def ranks_of(spark: SparkSession, tokenizer: str | None) -> bytes:
    """The tokenizer's table (under 2 MB), read by the driver and sent with the code."""
    with open(tokenizer or spark.conf.get(SETTING, TOKENIZER), "rb") as f:
        return f.read()


class TokenTree:
    """A document's pre-tokens in leaves of (characters, tokens), under a binary tree of sums."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.text, self.encoded = counter, text, 0
        pieces = counter.split.findall(text)
        rows = np.empty((len(pieces), 2), np.int32)
        rows[:, 0] = np.fromiter(map(len, pieces), np.int32, len(pieces))
        rows[:, 1] = np.fromiter(map(counter.known.__getitem__, pieces), np.int32, len(pieces))
        self._build(rows)

    @classmethod
    def load(cls, text: str, pieces: bytes, sizes: bytes, sums: bytes, counter: Counter) -> TokenTree:
        """A tree as saved()."""
        self = cls.__new__(cls)
        self.counter, self.text, self.encoded = counter, text, 0
        rows = np.frombuffer(pieces, np.int32).reshape(-1, 2)
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        self.leaves = [rows[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.chars, self.tokens = (x.copy() for x in np.frombuffer(sums, np.int64).reshape(2, -1))
        self.m = len(self.chars) // 2
        return self

    def saved(self) -> tuple[bytes, bytes, bytes]:
        """Pre-tokens, sizes of the leaves, and sums."""
        return np.concatenate(self.leaves).astype(np.int32).tobytes(), np.array([len(x) for x in self.leaves], np.int32).tobytes(), np.stack([self.chars, self.tokens]).tobytes()

    def _build(self, rows: np.ndarray) -> None:
        self.leaves = [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)] or [rows]
        m = 1
        while m < len(self.leaves):
            m *= 2
        self.m, self.chars, self.tokens = m, np.zeros(2 * m, np.int64), np.zeros(2 * m, np.int64)
        if len(rows):
            held = np.add.reduceat(rows.astype(np.int64), np.arange(0, len(rows), LEAF))
            self.chars[m : m + len(held)], self.tokens[m : m + len(held)] = held[:, 0], held[:, 1]
        while m > 1:
            for sums in (self.chars, self.tokens):
                sums[m // 2 : m] = sums[m : 2 * m].reshape(-1, 2).sum(axis=1)
            m //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.leaves))

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character `at` (or the last), and where it begins."""
        i, begin = 1, 0
        while i < self.m:
            i *= 2
            if at >= begin + self.chars[i] and self.chars[i + 1]:
                begin += int(self.chars[i])
                i += 1
        return i - self.m, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]. A match depends on what follows its begin and on nothing before it,
        and looks at most one character beyond its end; so matches that end two characters before the
        edit stand, and from the first new match that begins where an old one did, all the rest do."""
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        end = max(start, end)
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first, begin = self._leaf(max(0, start - 2))
        while first and not len(self.leaves[first]):
            first -= 1
        leaf, skip = self.leaves[first] if first < len(self.leaves) else np.empty((0, 2), np.int32), 0
        while skip < len(leaf) and begin + leaf[skip, 0] <= start - 2:
            begin += int(leaf[skip, 0])
            skip += 1
        # Old boundaries from here on, leaf by leaf, while new matches are made.
        last, index, old, fresh = first, skip, begin, []
        for match in self.counter.split.finditer(text, begin):
            if match.start() >= start + len(new):
                goal = match.start() - shift
                while old < goal and last < len(self.leaves):
                    if index < len(self.leaves[last]):
                        old += int(self.leaves[last][index, 0])
                        index += 1
                    else:
                        last, index = last + 1, 0
                if old == goal and goal >= end:
                    break
            fresh.append((match.end() - match.start(), self.counter(match.group())))
        else:
            last, index = len(self.leaves), 0
        self.encoded += len(fresh)
        self.text = text
        made = np.array(fresh, np.int32).reshape(-1, 2)
        rest = self.leaves[last][index:] if last < len(self.leaves) else made[:0]
        if last == first:
            self.leaves[first] = np.concatenate([self.leaves[first][:skip], made, rest])
        else:
            self.leaves[first] = np.concatenate([self.leaves[first][:skip], made])
            for i in range(first + 1, min(last, len(self.leaves))):
                self.leaves[i] = made[:0]
            if last < len(self.leaves):
                self.leaves[last] = rest
        if len(self.leaves[first]) > 4 * LEAF:
            self._build(np.concatenate(self.leaves))
            return
        for i in range(first, min(last + 1, len(self.leaves))):
            j = self.m + i
            self.chars[j], self.tokens[j] = self.leaves[i].sum(axis=0, dtype=np.int64)
            while j > 1:
                j //= 2
                for sums in (self.chars, self.tokens):
                    sums[j] = sums[2 * j] + sums[2 * j + 1]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with up to SLICE bytes of text in a batch, or one row."""
    for batch in batches:
        for a, b in slices(text_buffer(batch.column("text"))[1], SLICE):
            yield batch.slice(a, b - a)


TREES = "doc_id long, text string, pieces binary, leaves binary, sums binary, n_pretokens long, n_tokens long"


def build_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, pieces, leaves, sums, n_pretokens, n_tokens) for every row of docs(doc_id, text): the
    table of trees. A null text has the tree of an empty one. Rows without doc_id and repeated rows have
    trees too; other columns are not carried."""
    ranks = ranks_of(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for batch in _sliced(batches):
            out = []
            for text in batch.column("text"):
                tree = TokenTree(text.as_py() or "", counter)
                out.append((*tree.saved(), tree.n_pretokens, tree.n_tokens))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [c.split()[0] for c in TREES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def edit_all(tree: TokenTree, script: list[dict]) -> int:
    """Applies edits in turn; how many there were."""
    for e in script:
        tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
    return len(script)


EDITS = "array<struct<start:long,stop:long,replacement:string>>"


def updated(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """trees(TREES, edits) after their `edits`, an array of (start, stop, replacement) in characters,
    applied in turn: the columns of TREES, n_edits, n_reencoded (pre-tokens encoded anew), and what
    n_pretokens and n_tokens were before. A null text isn't edited; null places mean 0, a null replacement an empty one, and places beyond
    the text its end."""
    ranks = ranks_of(trees.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for batch in _sliced(batches):
            out, texts = [], []
            columns = [batch.column(c) for c in ("text", "pieces", "leaves", "sums", "edits")]
            for text, pieces, leaves, sums, edits in zip(*columns, strict=True):
                script = edits.as_py() or []
                text = text.as_py()
                script = script if text is not None else []
                tree = TokenTree.load(text or "", pieces.as_py(), leaves.as_py(), sums.as_py(), counter)
                edit_all(tree, script)
                texts.append(None if text is None else tree.text)
                out.append((*tree.saved(), tree.n_pretokens, tree.n_tokens, len(script), tree.encoded))
            rows = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (*[pa.binary()] * 3, *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True)), batch.column("n_pretokens"), batch.column("n_tokens")], names)

    schema = f"{TREES}, n_edits long, n_reencoded long, n_pretokens_before long, n_tokens_before long"
    names = [c.split()[0] for c in schema.split(", ")]
    return trees.select(*[c.split()[0] for c in TREES.split(", ")], "edits").mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The table of trees after edits(doc_id, seq, start, stop, replacement), those of a document in order
    of seq. Trees of other documents stay as they are and don't pass through Python. An edit of a
    doc_id that has no tree, or of null, is of no effect; of a doc_id that has several, it holds for each."""
    script = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "replacement"))).alias("edits"))
    script = script.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["replacement"].alias("replacement"))).alias("edits"))
    columns = [c.split()[0] for c in TREES.split(", ")]
    rows = trees.select(*columns).join(script, "doc_id", "left")
    return rows.where("edits IS NULL").select(*columns).unionByName(updated(rows.where("edits IS NOT NULL"), tokenizer).select(*columns))


def sample_edits(text: Column) -> Column:
    """A deletion, an insertion and a replacement whose places follow from the text's length."""
    n = F.length(text).cast("long")
    at = lambda x: F.floor(x).cast("long")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("stop"), F.lit(new).alias("replacement"))
    return F.array(edit(at(2 * n / 3), at(2 * n / 3) + 11, ""), edit(at(n / 4), at(n / 4), " (edited)"), edit(at(n / 2), at(n / 2) + 5, "xyz 42"))


def edited_counts(docs: DataFrame, edits: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_edits, n_tokens_edited, n_reencoded) for every row of
    docs(doc_id, text): tokens of the whole text by its tree, and after `edits`, a column of EDITS over
    `text` (three sample edits unless given). n_reencoded: pre-tokens the edits encoded anew. A tree lives while
    its row is answered; where trees are to be kept for later edits, build_trees and apply_edits keep them.

    A null text is empty and isn't edited. Places beyond the text mean its end. Repeated rows and null
    ids are each answered; other columns are not carried; an empty table gives an empty result.
    """
    ranks = ranks_of(docs.sparkSession, tokenizer)
    names = ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text"), batch.column("edits"), strict=True):
                text, script = text.as_py(), edits.as_py() or []
                tree = TokenTree(text or "", counter)
                before = tree.n_pretokens, tree.n_tokens
                n = 0 if text is None else edit_all(tree, script)
                out.append((*before, n, tree.n_tokens, tree.encoded))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (sample_edits(F.col("text").cast("string")) if edits is None else edits).alias("edits"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n) for every row of docs(doc_id, text): the tokens of its text, 0 for null."""
    ranks = ranks_of(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([counter.total(t.as_py() or "") for t in batch.column("text")], pa.int64())], ["doc_id", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, n long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op5_token_counts": op5_token_counts}
