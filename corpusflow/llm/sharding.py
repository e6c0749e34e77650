"""Sharding by weighted rendezvous hashing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of all shards together in which slots are numbered, at least one a shard: so many offsets are broadcast.
PARTS = 65_536
#: Rows that are equal in all columns and get their slots in one place; more are dealt out.
EQUAL = 65_536


def bids(key: Column, weights: dict[int, float]) -> Column:
    """One (cost, shard) for each shard: -ln(u) / weight with u in (0, 1) hashed from key and shard.
    A key's costs don't depend on which other shards there are, so a new shard only takes keys."""
    return F.array(*[
        F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))
        for shard, weight in weights.items()
    ])


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the lowest cost, ties to the smaller shard. Shards of weight 0 or less get nothing."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        raise ValueError("no shard has a positive weight")
    return F.array_min(bids(key, weights))["shard"]


def with_slots(df: DataFrame, shard: str, order: list[str], n_shards: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard. Rows equal in all columns are counted, which combines
    before the shuffle, and get consecutive slots; the rest are numbered within hashed parts of a shard,
    whose counts give each part its offset. A part is told by whole rows, so neither a shard nor a key
    that holds many rows lies in one task."""
    parts = max(1, PARTS // max(1, n_shards))
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__part", F.pmod(F.xxhash64(*columns), F.lit(parts)))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col(shard).alias("__s"), F.col("__part").alias("__p")).agg(F.sum("__n").alias("__m"))
    offsets = counts.select("__s", "__p", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(shard, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    at = at.join(F.broadcast(offsets), (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p"))).withColumn("__at", F.col("__at") + F.col("__offset"))
    at = at.select(*columns, "__at", "__n")
    few = at.where(F.col("__n") <= EQUAL)
    shares = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / EQUAL).cast("long"))
    many = at.where(F.col("__n") > EQUAL).withColumn("__i", F.explode(shares)).repartition(F.col("__i"), F.col("__at"))
    many = many.select(*columns, (F.col("__at") + F.col("__i") * EQUAL).alias("__at"), F.least(F.lit(EQUAL).cast("long"), F.col("__n") - F.col("__i") * EQUAL).alias("__n"))
    return few.unionByName(many).select(*columns, F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("__n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, weights: dict[int, float] | None = None, grown: dict[int, float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text).

    Law `key`: doc_id and the weighted shards alone decide; `grown` adds shards (one more of weight 1
    unless given), which take rows only into themselves. size is the text's UTF-8 bytes plus 1; a null
    text has size 1 and a null text_crc32. A null doc_id is a key like any other. Repeated rows share
    a shard and have slots of their own, ordered by part, doc_id, size and crc; keys are hashed as text, so
    their type doesn't matter. Other columns are not carried. An empty table gives an empty result.
    """
    weights = {i: 1.0 for i in range(16)} if weights is None else weights
    grown = {max(weights) + 1: 1.0} if grown is None else grown
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    key = F.col("doc_id").cast("string")
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, weights).cast("int").alias("shard"), shard_of(key, weights | grown).cast("int").alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"], len(weights))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op2_rendezvous_shards": op2_rendezvous_shards}
