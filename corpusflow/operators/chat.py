"""Chat messages and the events of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import LANGUAGES, SUGGESTED
from corpusflow.functions.text import trimmed
from corpusflow.operators.answer import language_code


def last_user_message(messages: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, query) of each conversation that has a user message: the text of the last one."""
    user = F.col("role") == "user"
    rows = messages.groupBy(conversation).agg(F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("query"), F.count_if(user).alias("n"))
    return rows.where("n > 0").select(conversation, "query")


def valid_request(query):
    return F.length(trimmed(F.coalesce(query, F.lit("")))) > 0


def with_language(rows: DataFrame, column: str = "language") -> DataFrame:
    """rows with the served language, its name and direction; the table of languages is a constant."""
    table = rows.sparkSession.createDataFrame(list(LANGUAGES), "code string, language_name string, direction string")
    return rows.withColumn("code", language_code(F.col(column))).join(F.broadcast(table), "code", "left")


def suggested_questions(rows: DataFrame, column: str = "language") -> DataFrame:
    """rows with the questions that a chat in their language begins with: one row a question, `place` from 0."""
    table = [(code, list(asked)) for code, asked in SUGGESTED.items()]
    table = rows.sparkSession.createDataFrame(table, "code string, asked array<string>")
    found = rows.withColumn("code", language_code(F.col(column))).join(F.broadcast(table), "code")  # one row a language
    return found.select(*rows.columns, F.posexplode("asked").alias("place", "question"))


def events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): metadata, a text event for each delta, sources, done; of a row with
    an error only that. answers(query_id, confident, reason, deltas, sources, error)."""
    event = lambda name, body: F.struct(F.lit(name).alias("event"), F.to_json(body).alias("data"))
    deltas = F.transform("deltas", lambda d: event("text", F.struct(d.alias("delta"))))
    good = F.concat(F.array(event("metadata", F.struct("confident", "reason"))), deltas, F.array(event("sources", F.struct("sources"))), F.array(F.struct(F.lit("done").alias("event"), F.lit("{}").alias("data"))))
    rows = F.when(F.col("error").isNotNull(), F.array(event("error", F.struct(F.col("error").alias("message"))))).otherwise(good)
    return answers.select("query_id", F.posexplode(rows).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")


def wire(rows: DataFrame) -> DataFrame:
    return rows.withColumn("frame", F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n")))


def parse_wire(streams: DataFrame, column: str = "body") -> DataFrame:
    """Events of streams(query_id, body) in the order they came; frames without data are left out."""
    frames = streams.select("query_id", F.posexplode(F.split(column, "\n\n", -1)).alias("seq", "frame"))
    lines = F.split("frame", "\n", -1)
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name)), lambda x: trimmed(F.substring(x, len(name) + 1, 1 << 30)))
    data = field("data:")
    return frames.select("query_id", "seq", F.coalesce(F.try_element_at(field("event:"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"), F.size(data).alias("n")).where("n > 0").drop("n")


def fold(rows: DataFrame) -> DataFrame:
    """(query_id, content, sources, is_refusal, error) of the events of each answer."""
    value = lambda name, kind="string": F.from_json("data", f"struct<{name}:{kind}>")[name]
    deltas = F.array_sort(F.collect_list(F.when(F.col("event") == "text", F.struct("seq", F.coalesce(value("delta"), F.lit("")).alias("d")))))
    parts = rows.groupBy("query_id").agg(
        F.array_join(F.transform(deltas, lambda x: x["d"]), "").alias("content"),
        F.max_by(F.when(F.col("event") == "sources", value("sources", "array<string>")), F.when(F.col("event") == "sources", F.col("seq"))).alias("raw"),
        F.coalesce(F.bool_or((F.col("event") == "metadata") & (value("confident", "boolean") == F.lit(False))), F.lit(False)).alias("is_refusal"),
        F.max(F.when(F.col("event") == "error", F.coalesce(value("message"), F.lit("Stream error")))).alias("error"),
    )
    # A source is a url, or an object with url and title.
    source = lambda s: F.when(s.startswith("{"), F.struct(F.from_json(s, "struct<url:string,title:string>")["url"].alias("url"), F.coalesce(F.from_json(s, "struct<url:string,title:string>")["title"], F.lit("")).alias("title"))).otherwise(F.struct(s.alias("url"), F.lit("").alias("title")))
    return parts.select("query_id", "content", F.transform(F.coalesce("raw", F.array().cast("array<string>")), source).alias("sources"), "is_refusal", "error")


def upsert_messages(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last version of each message, at the place of its first."""
    rest = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("m"), F.min(order).alias(order))
    return last.select(key, order, *[F.col(f"m.{c}").alias(c) for c in rest])


MESSAGES = "session string, id string, seq long, role string, content string"


def save_messages(rows: DataFrame, path: str) -> None:
    """Append rows(MESSAGES) to the history; what was written before is never rewritten."""
    rows.select(*[c.split()[0] for c in MESSAGES.split(", ")]).write.mode("append").parquet(path)


def load_messages(spark: SparkSession, path: str) -> DataFrame:
    """The history with the last version of each message of a session, at the place of its first; empty
    where there is none. Files that can't be read are left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MESSAGES)
    rows = spark.read.schema(MESSAGES).option("ignoreCorruptFiles", True).parquet(path)
    last = rows.groupBy("session", "id").agg(F.max_by(F.struct("role", "content"), "seq").alias("m"), F.min("seq").alias("seq"))
    return last.select("session", "id", "seq", "m.role", "m.content")
