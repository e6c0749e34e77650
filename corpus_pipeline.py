"""Documents to packed training bins: language ID, near-dedup, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all the stage before kept; all but the last return
the columns of documents. doc_id is the key: a stage first gives rows without one, and all but one of
the distinct texts that share one, a row key (identified()), which later stages keep; equal rows of
doc_id and text become one. So each decision, and each text that is cut, is that of one row. A null text
counts as an empty one, an empty table gives an empty one, columns beyond the needed ones are carried
along untouched whatever their names, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import identified, stored, without
from corpusflow.llm.language import accepted, learn_from_all
from corpusflow.llm.mixing import mix_sources
from corpusflow.llm.near_dedup import near_duplicates
from corpusflow.llm.packing import best_fit
from corpusflow.llm.repeats import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence; texts that are null or have no letter
    go. The model and its threshold are learned from all labelled rows; where no row is labelled there is no model to reject anything, and all documents stay."""
    docs = identified(docs)
    model = learn_from_all(docs)
    return docs if model is None else docs.where(accepted(F.col("text"), model))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.80 or more. Null and blank texts are
    copies of nothing and stay."""
    docs = identified(docs)
    return without(docs, near_duplicates(docs, percent=80, unique=True).where("NOT kept"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a document of which nothing but blanks is left goes. Rows
    that lose nothing come back as they were; n_chars, where there is one, follows a text that is cut."""
    docs = identified(docs)
    rows = remove_repeats(docs, keep_text=True, carry=True, unique=True)
    cut = F.col("n_removed") > 0
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.where(~cut | F.col("kept_text").rlike(r"\S")).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights of sources, languages and topics. Texts without
    words weigh nothing and go."""
    docs = identified(docs)
    return without(docs, mix_sources(docs).where("NOT sampled"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies: one row a piece."""
    return best_fit(identified(docs), unique=True)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_to_targets", mix_to_targets),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the learned model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
