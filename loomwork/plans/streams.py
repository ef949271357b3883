"""Queries that run as streams to the end of their input, and give their result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions.score import KeywordScorer
from ..functions.text import RegexSplit
from ..operators.cache import AnswerCache
from ..sources.store import Store, shared_folder
from .registry import KEYWORDS, LINES, any_keyword, query, table


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. As a pattern, the path may be a file as well as a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streaming.window_counts(events, "ts", ["event_type"])
    out = streaming.run_to_table(counts, shared_folder(spark, "window-counts"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(f"WITH {LINES} SELECT doc_id, pos, chunk FROM c WHERE {any_keyword('chunk')}")
def stream_keyword_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the table, on a stream."""
    chunks = streaming.prepare(stream(spark, sf_dir, "documents"), "text", RegexSplit("\n"), KeywordScorer(KEYWORDS), "score > 0.5")
    out = streaming.run_to_table(chunks.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk"), shared_folder(spark, "keyword-chunks"))
    return out


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, max(n) AS n FROM c GROUP BY user_id")
def stream_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user's most frequent event occurred, by a stateful operator."""
    votes = streaming.majority(stream(spark, sf_dir, "events"), "user_id", F.col("event_type"))
    out = streaming.run_to_table(votes, shared_folder(spark, "majority"), "update")
    return out.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.max_by("n", "batch").alias("n"))


@query("SELECT CAST(count(DISTINCT sha256(text)) AS BIGINT) AS chunks FROM documents")
def stream_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of equal texts; all of them come within the watermark."""
    docs = stream(spark, sf_dir, "documents").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = streaming.run_to_table(streaming.distinct_chunks(docs, "ts", column="text").select("doc_id"), shared_folder(spark, "distinct-texts"))
    return out.agg(F.count("*").alias("chunks"))


@query("""
    WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM n GROUP BY user_id, session
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that end with half an hour without an event."""
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streaming.session_counts(events, "ts", ["user_id"], late="3650 days")
    out = streaming.run_to_table(counts, shared_folder(spark, "sessions"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT conv_id, turn, lower(text) AS answer FROM conversations")
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a stream, answered in micro-batches through the cache."""
    folder = shared_folder(spark, "stream-extract")
    prompts = stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("key"), F.col("text").alias("prompt"))
    ask = lambda df: df.select("key", F.lower("prompt").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))
    writer = streaming.extract(prompts, ask, AnswerCache(spark, folder + "/cache"), Store(spark, folder).keep, lambda df: df.select("conv_id", "turn", "answer"), folder + "/rows", folder + "/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder + "/rows").select("conv_id", "turn", "answer")
