"""The same operators over streams.

Splitting, scoring, filtering and cleaning hold no state, so they run on a
streaming DataFrame as they do on a table. What needs state is here: windowed
counts with a watermark, one copy of repeated chunks, the majority of a
record's answers as they come in, and extraction in micro-batches with the
cache looked up and filled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.conditions import query
from ..functions.score import Scorer
from ..functions.text import Splitter
from ..operators.cache import AnswerCache
from ..operators.chunks import chunk, score
from ..operators.extraction import answers


def prepare(stream: DataFrame, target: str, splitter: Splitter | None, scorer: Scorer | None = None, score_filter: str | None = None, drop_empty: bool = True) -> DataFrame:
    """Chunks of a stream of records, with pos. A chunk is named by its record and pos: dense ids need all rows."""
    out = score(chunk(stream, target, splitter, drop_empty=drop_empty, ids=False), scorer)
    return query(out, score_filter) if score_filter and scorer is not None else out


def window_counts(stream: DataFrame, ts: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by..., n) by tumbling, or sliding, windows; rows later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(stream: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, by..., n) by sessions that end with a gap."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def distinct_chunks(stream: DataFrame, ts: str, late: str = "1 hour", column: str = "chunk") -> DataFrame:
    """The first of equal chunks that come within the watermark of each other; state is a hash a chunk."""
    keyed = stream.withColumn("_key", F.sha2(F.col(column), 256)).withWatermark(ts, late)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def majority(stream: DataFrame, by: str, value: Column) -> DataFrame:
    """(key, value, n): for each micro-batch, the majority so far of every key that has new values (ties go to the value that came first). State is a count a distinct value."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = json.loads(state.get[0]) if state.exists else {}
        for b in batches:
            for v in b["value"].dropna():
                counts[v] = counts.get(v, 0) + 1
        state.update((json.dumps(counts),))
        if counts:
            top = max(counts, key=counts.__getitem__)  # of equals, the first that was put in
            yield pd.DataFrame({"key": [str(key[0])], "value": [top], "n": [counts[top]]})

    rows = stream.select(F.col(by).cast("string").alias("key"), value.cast("string").alias("value")).where("key is not null")
    return rows.groupBy("key").applyInPandasWithState(update, "key string, value string, n long", "counts string", "update", GroupStateTimeout.NoTimeout)


def extract(
    prompts: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    cache: AnswerCache,
    keep: Callable[[DataFrame], DataFrame],
    finish: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Writer of a stream of (key, prompt, ...): each micro-batch is looked up in the cache, what it lacks is asked once and added, and finish(answered) goes to a Parquet folder under the batch's number, so a batch that is run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        rows = keep(df)
        answered, fresh = answers(rows, ask, keep(cache.read()), keep)
        cache.add(fresh)
        finish(answered).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return prompts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def run_to_table(stream: DataFrame, path: str, mode: str = "append", **trigger: Any) -> DataFrame:
    """Runs a stream until it has no more input and gives its result as a table: the rows of append mode, the last complete result, or the updates, with the number of the micro-batch of each in `batch`."""
    out = f"{path}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        query_ = writer.format("parquet").option("path", out).start()
    else:
        to = (lambda n: f"{out}/batch={n}") if mode == "update" else (lambda n: out)
        query_ = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(to(n))).start()
    query_.awaitTermination()
    schema = stream.schema if mode != "update" else StructType([*stream.schema.fields, StructField("batch", LongType())])
    return stream.sparkSession.read.schema(schema).parquet(out)
