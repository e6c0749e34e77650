"""Connected components of an edge table: contraction within partitions, then joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, released, stored

#: Edges that one task contracts.
LOCAL = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, and the smallest node each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        after = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(after, end, low)
        while True:  # to the label of the label
            ahead = after[after]
            if (ahead == after).all():
                break
            after = ahead
        if (after == label).all():
            break
        label = after
    return nodes, nodes[label]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if ends:
        node, comp = least_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], ["node", "comp"])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, comp) for every node of edges(a, b): comp is the smallest node reachable.

    Each task first replaces its share of at most about `local` edges by stars around their smallest
    nodes. Where more than one share exists, stars of different tasks are joined in rounds: each takes
    the least label among neighbours and then the label of that label, so the number of rounds follows
    the logarithm of a component's diameter. Labels are combined before each shuffle; edges and labels
    live in shared tables, never on the driver, and no task holds more than its share. Null ends are
    ignored; an empty table gives an empty result.
    """
    edges = stored(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    shares = math.ceil(edges.count() / local)
    stars = stored(edges.coalesce(max(1, shares)).mapInArrow(released(contract), "node long, comp long"))
    forget(edges)
    if shares <= 1:
        return stars
    pairs = stars.where("node <> comp")
    both = stored(pairs.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(pairs.select(F.col("comp").alias("a"), F.col("node").alias("b"))).distinct())
    forget(stars)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("comp").alias("before"), F.least("comp", "least").alias("via"))
        ahead = labels.select(F.col("node").alias("via"), F.col("comp").alias("there"))
        after = stored(lower.join(ahead, "via").select("node", "before", F.least("via", "there").alias("comp")))
        forget(labels)
        labels = after
        if labels.where("comp <> before").isEmpty():
            forget(both)
            return labels.select("node", "comp")
