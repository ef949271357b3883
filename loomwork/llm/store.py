"""Durable intermediate tables, and distributed union-find over edges.

Intermediates go to the folder that the cluster names in `spark.checkpoint.dir`
(shared by all executors), as Parquet; so losing an executor loses nothing.
Only where a session names none and runs on one machine, as in tests, a folder
below the session's warehouse is used; on a cluster without one it is an error.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENDED: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """Where all executors read and write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """A folder of intermediate tables. drop() removes tables that are read no more; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/loomwork-{what}-{uuid.uuid4().hex}", 0
        self.kept: list[str] = []
        if not _ENDED:
            atexit.register(_clear)
        _ENDED.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """df, written once and read back: its lineage is the written table."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept.append(path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._scratch_path)

    def only(self, df: DataFrame) -> DataFrame:
        """The saved table df, after all others are dropped."""
        for path in [p for p in self.kept if p != df._scratch_path]:
            self._delete(path)
        return df

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in self.kept:
            self.kept.remove(path)


def _clear() -> None:
    """Removes the folders of all scratches whose session is still there."""
    for s in _ENDED:
        try:
            s._delete(s.path)
        except Exception:  # noqa: BLE001 - the session has ended
            return


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a bigint, b bigint) as (id, root), root the least id; only nodes that have an edge.

    Alternating large-star and small-star: each round links every node to the
    least node it knows of, and the number of rounds is logarithmic in the
    size of a component. A round is two shuffles of the edges still there. The
    least neighbour is found by partial aggregation; the join back to the
    edges streams a hot node's edges, which adaptive execution splits over
    tasks. Callers keep exact copies out, so that they make no hot node.
    """
    e = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = -1
    while True:
        # large star: neighbours above a node go to the least of the node and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
            ).alias("x")
        ).select("x.a", "x.b").where("a <> b").distinct()
        new = scratch.save(small)
        n = new.count()
        same = n == before and new.join(e, ["a", "b"], "left_anti").isEmpty()
        scratch.drop(e)
        e, before = new, n
        if same:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def unused(name: str, names: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
