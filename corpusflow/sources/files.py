"""Tables in files: scans that skip bad rows, sinks with stable keys, snapshots, persisted settings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import schemas
from corpusflow.functions.urls import file_key

BAD = "__corrupt"


def _scan(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    """Rows that parse; files whose name begins with `_` are no data. A missing folder is an error."""
    rows = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("multiLine", whole).json(path)
    columns = [c for c in rows.columns if c != BAD]
    return rows.select(*columns, BAD).where(F.col(BAD).isNull()).select(*columns).where(F.col(columns[0]).isNotNull())


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.RAW, True)


def cleaned_pages(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.CLEANED, True)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; blank and malformed lines are skipped."""
    return _scan(spark, path, schema, False)


def write_entities(rows: DataFrame, path: str, url: str = "url") -> None:
    """JSON rows with the key that names each entity's file elsewhere."""
    rows.withColumn("file_key", file_key(F.col(url))).write.mode("overwrite").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(row: DataFrame, path: str) -> None:
    """A one-row aggregate."""
    row.coalesce(1).write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _pointers(fs, root) -> list[int]:
    """Numbers of the pointers under a root, the newest first."""
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    return sorted((int(n.removeprefix("pointer-")) for n in names if n.removeprefix("pointer-").isdigit()), reverse=True)


def save_versioned(rows: DataFrame, root: str, version: int = schemas.SNAPSHOT_VERSION) -> str:
    """Write a table beside those before it, then a pointer with the next number. Nothing is overwritten or
    deleted, so after a crash at any point the table before is still the current one."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{root}/data-{name}")
    made = f"{root}/new-{name}"
    spark.createDataFrame([(json.dumps({"version": version, "data": f"data-{name}"}),)], "value string").coalesce(1).write.text(made)
    fs, at, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    number = next(iter(_pointers(fs, at)), 0) + 1
    while fs.exists(path(f"{root}/pointer-{number}")) or not fs.rename(path(made), path(f"{root}/pointer-{number}")):
        if not fs.exists(path(made)):
            raise OSError(f"no pointer could be set under {root}")
        number += 1
    return f"{root}/data-{name}"


def load_versioned(spark: SparkSession, root: str, schema: str = schemas.SNAPSHOT, version: int = schemas.SNAPSHOT_VERSION) -> DataFrame:
    """The table of the newest complete pointer; an empty one where there is none, it is of another version or unreadable."""
    empty = spark.createDataFrame([], schema)
    fs, at, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    for number in _pointers(fs, at):
        if not fs.exists(path(f"{root}/pointer-{number}/_SUCCESS")):
            continue
        try:
            said = json.loads(spark.read.text(f"{root}/pointer-{number}").first()[0])
        except (ValueError, TypeError):
            return empty
        if not isinstance(said, dict) or said.get("version") != version or not fs.exists(path(f"{root}/{said.get('data')}")):
            return empty
        return spark.read.schema(schema).parquet(f"{root}/{said['data']}")
    return empty
