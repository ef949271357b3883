"""The cache of answers: a Parquet table (key, value, ts, bytes), appended to and compacted.

Compaction writes a new generation of the table, and removes the one before
the last: what was read from the last one can still be computed again.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, value string, ts timestamp, bytes bigint"


def latest(table: DataFrame) -> DataFrame:
    """The newest row of each key (of equal times, the greatest value)."""
    return table.groupBy("key").agg(F.max(F.struct("ts", "value", "bytes")).alias("r")).select("key", "r.value", "r.ts", "r.bytes")


def stats(table: DataFrame) -> DataFrame:
    """One row: entries and bytes."""
    return latest(table).agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def prune(table: DataFrame, max_bytes: int) -> DataFrame:
    """The newest entries that together have at most max_bytes.

    Bytes are summed up by the hour first, and only the hour in which the
    limit falls is looked at row by row, so no task sorts the whole table.
    """
    rows = latest(table).withColumn("_hour", F.coalesce(F.floor(F.unix_timestamp("ts") / 3600), F.lit(0)))
    hours = rows.groupBy("_hour").agg(F.sum("bytes").alias("_sum"))
    newer = Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_hour", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_newer")).where(F.col("_newer") < max_bytes)
    inside = Window.partitionBy("_hour").orderBy(F.desc("ts"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(hours, "_hour").withColumn("_run", F.col("_newer") + F.sum("bytes").over(inside)).where(F.col("_run") <= max_bytes).select("key", "value", "ts", "bytes")


class AnswerCache:
    """A cache in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, max_mb: int = 512):
        self.spark, self.path, self.max_bytes = spark, path.rstrip("/"), max_mb * 1_000_000
        self.hits = self.misses = 0

    def _fs(self, *parts: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        p, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdecimal())

    def _current(self) -> str:
        return f"{self.path}/gen-{max(self._generations(), default=0)}"

    def table(self) -> DataFrame:
        if not self._generations():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self._current())

    def read(self) -> DataFrame:
        return latest(self.table())

    def add(self, fresh: DataFrame) -> None:
        """Appends (key, value)."""
        fresh.select("key", "value", F.current_timestamp().alias("ts"), F.octet_length("value").cast("bigint").alias("bytes")).write.mode("append").option("compression", "zstd").parquet(self._current())

    def count(self, answered: DataFrame) -> None:
        """Counts the rows that the cache had an answer for, and the others, by their column hit."""
        n = answered.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).first()
        self.hits, self.misses = self.hits + n["hits"], self.misses + n["misses"]

    def stats(self) -> DataFrame:
        """One row: entries and bytes of the table, hits and misses since this object was made."""
        return stats(self.table()).withColumns({"hits": F.lit(self.hits).cast("bigint"), "misses": F.lit(self.misses).cast("bigint")})

    def compact(self, max_bytes: int | None = None) -> None:
        """Rewrites the table without old versions and, newest first, within the size limit (or another)."""
        have = self._generations()
        if not have:
            return
        made, fs = self._fs("writing")
        prune(self.table(), self.max_bytes if max_bytes is None else max_bytes).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/writing")
        fs.rename(made, self._fs(f"gen-{have[-1] + 1}")[0])
        for old in have[:-1]:
            fs.delete(self._fs(f"gen-{old}")[0], True)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """Command line: statistics of a cache, or a cache made smaller."""
    p = argparse.ArgumentParser(prog="python -m loomwork.operators.cache", description="Looks into a cache of answers, or prunes it.")
    p.add_argument("path", help="the folder of the cache")
    p.add_argument("--stats", action="store_true", help="print entries and bytes")
    p.add_argument("--prune", type=int, metavar="MB", help="keep the newest entries within so many megabytes")
    given = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("loomwork-cache").getOrCreate()
    cache = AnswerCache(spark, given.path)
    if given.prune is not None:
        cache.compact(given.prune * 1_000_000)
    if given.stats:
        print(json.dumps(stats(cache.table()).first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
